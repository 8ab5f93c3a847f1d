"""URL filter on a sorted digest array.

The rule list becomes one file: a sorted array of 64-bit xxhash keys beside
the rules' full strings. The file lies in the shared folder, Spark hands each
executor a copy (``SparkContext.addFile``; a replaced executor fetches it
again), and tasks memory-map it. Urls are probed in Arrow batches: every
candidate string (a host suffix at a label border joined to a path prefix of a
length that occurs among the rules) is hashed once a batch, found by a
vectorised binary search, and confirmed against the stored string, so that a
hash collision never decides a verdict.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: then up to ``?``, ``#`` or the end; a null url or one
without ``://`` has an empty host and path, and no rule. A rule fits its host
and all subdomains if the url's path starts with its path; the longest rule
string wins, then the longer host. An url that no rule fits has the filter's
default verdict, ``allow`` unless set otherwise: the array lists exceptions.
Repeated pages are judged alike; a null page_id stays null; an empty table
gives an empty result, an empty rule list the default everywhere; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airseries.llm.common import ascii_lower
from airseries.session import checkpoint_dir

#: Rules that one array may hold; more raise an error (the driver builds it).
MAX_RULES = 5_000_000

#: The rules of the query (fixed values): verdict, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


class DigestArray:
    """Sorted keys and, in the same order, the entries' strings, host lengths and verdicts."""

    def __init__(self, keys, offsets, hosts, verdicts, heap, lengths):
        self.keys, self.offsets, self.hosts, self.verdicts, self.heap = keys, offsets, hosts, verdicts, heap
        self.lengths = lengths  # distinct path lengths in code points

    @staticmethod
    def pack(rules: Iterable[tuple[str, str, str]], hasher=xxhash.xxh64_intdigest) -> bytes:
        """The file's bytes; of rules with equal host and path, a block wins over an allow."""
        by_string: dict[tuple[str, str], int] = {}
        for verdict, host, path in rules:
            by_string[host, path] = min(by_string.get((host, path), 1), 0 if verdict == "block" else 1)
        if len(by_string) > MAX_RULES:
            raise ValueError(f"{len(by_string)} rules; the array is bounded at {MAX_RULES}")
        rows = sorted((hasher((h + p).encode()), h + p, len(h.encode()), v) for (h, p), v in by_string.items())
        strings = [r[1].encode() for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in strings], dtype=np.int64)])
        lengths = np.array(sorted({len(p) for _, p in by_string}), dtype=np.int64)
        parts = [np.array([r[0] for r in rows], dtype=np.uint64), offsets.astype(np.int64),
                 np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64), lengths]
        head = np.array([len(rows), len(lengths)], dtype=np.int64)
        return b"".join([head.tobytes(), *(x.tobytes() for x in parts), *strings])

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n, m = (int(x) for x in raw[:16].view(np.int64))
        at, parts = 16, []
        for count, kind in ((n, np.uint64), (n + 1, np.int64), (n, np.int64), (n, np.int64), (m, np.int64)):
            parts.append(raw[at:at + 8 * count].view(kind))
            at += 8 * count
        return cls(*parts[:4], raw[at:], parts[4])

    def find(self, strings: np.ndarray, host_lens: np.ndarray, hasher=xxhash.xxh64_intdigest) -> np.ndarray:
        """For each candidate the entry's position, or -1; host_lens in UTF-8 bytes."""
        raw = [s.encode("utf-8", "surrogatepass") for s in strings]
        probe = np.fromiter((hasher(x) for x in raw), dtype=np.uint64, count=len(raw))
        at = np.searchsorted(self.keys, probe, side="left")
        end = np.searchsorted(self.keys, probe, side="right")
        found = np.full(len(raw), -1, dtype=np.int64)
        for i in np.flatnonzero(end > at):  # equal digests: the stored string decides
            for k in range(at[i], end[i]):
                if self.hosts[k] == host_lens[i] and self.heap[self.offsets[k]:self.offsets[k + 1]].tobytes() == raw[i]:
                    found[i] = k
                    break
        return found

    def judge(self, hosts: pd.Series, paths: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(rule position or -1) of each url, and the entry strings."""
        codes, uniq = pd.factorize(hosts)
        best = np.full(len(hosts), -1, dtype=np.int64)
        best_len = np.full(len(hosts), -1, dtype=np.int64)
        suffixes = [_suffixes(h) for h in uniq]
        depth = max((len(s) for s in suffixes), default=0)
        for length in self.lengths:
            prefix = paths.str.slice(0, int(length))
            fits = (paths.str.len() >= length).to_numpy(dtype=bool)
            for k in range(depth):  # from the whole host to its last label
                suffix = np.array([s[k] if k < len(s) else "" for s in suffixes], dtype=object)
                rows = np.flatnonzero(fits & (suffix[codes] != ""))
                if not len(rows):
                    continue
                pairs = pd.MultiIndex.from_arrays([suffix[codes[rows]], prefix.to_numpy(dtype=object)[rows]])
                pair_code, pair = pd.factorize(pairs)
                strings = np.array([h + p for h, p in pair], dtype=object)
                host_lens = np.array([len(h.encode("utf-8", "surrogatepass")) for h, _ in pair])
                entry = self.find(strings, host_lens)[pair_code]
                size = np.array([len(s) for s in strings], dtype=np.int64)[pair_code]
                # the suffixes come longest host first, so an equal length keeps the longer host
                better = (entry >= 0) & ((size > best_len[rows])
                                         | ((size == best_len[rows]) & (best[rows] >= 0)
                                            & (self.hosts[entry] > self.hosts[best[rows]])))
                best[rows[better]], best_len[rows[better]] = entry[better], size[better]
        return best, best_len

    def string(self, k: int) -> str:
        return self.heap[self.offsets[k]:self.offsets[k + 1]].tobytes().decode()


def _suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first; none for an empty host."""
    return [host] + [host[i + 1:] for i, c in enumerate(host) if c == "." and i + 1 < len(host)] if host else []


def publish(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Write the array to the shared folder, have Spark hand it out, return its file name."""
    data = DigestArray.pack(rules)
    name = f"urls-{hashlib.sha256(data).hexdigest()[:16]}.digests"
    uri = f"{checkpoint_dir(spark).rstrip('/')}/llm-url-filter/{name}"
    store, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if store.get_file_info(path).type == pafs.FileType.NotFound:
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path) as out:  # the name is the content's hash: a second write is the same
            out.write(data)
    spark.sparkContext.addFile(uri)
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow",
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    name = publish(pages.sparkSession, list(rules))
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    parsed = pages.select(F.col(f"`{id_col}`").alias("page_id"), rest.alias("rest")).select(
        "page_id", ascii_lower(F.regexp_extract("rest", "^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        array = DigestArray.mapped(SparkFiles.get(name))
        for hosts, paths in batches:
            best, _ = array.judge(hosts, paths)
            strings = {k: array.string(k) for k in np.unique(best[best >= 0])}
            verdict = {k: "allow" if array.verdicts[k] else "block" for k in strings}
            yield pd.DataFrame({"rule": [strings.get(k) for k in best],
                                "verdict": [verdict.get(k, default) for k in best]})

    return parsed.withColumn("judged", judged("host", "path")).select(
        "page_id", "host", "path", "judged.rule", "judged.verdict")


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE = """
WITH u AS (
  SELECT page_id, row_number() OVER () AS rid, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, rid,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, f) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                      ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
j AS (
  SELECT p.*, r.v, r.h || r.f AS rule FROM p LEFT JOIN r
    ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.f)),
k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC NULLS LAST) AS n FROM j)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM k WHERE n = 1
"""
