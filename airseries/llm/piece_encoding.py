"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model does (identity rule: a leading mark, spaces
become marks) and cut into units (words with their leading marks) and these into
stretches that no piece of the vocabulary reaches across, so that each can be
encoded alone. Within a stretch a score-ordered agenda holds the adjacent symbol pairs whose
concatenation is a piece; the best pair (then the leftmost) is merged, and the
pairs with its new neighbours join the agenda, until it is empty. Symbols that
are no piece fall back to byte pieces. Units and stretches recur, so bounded tables
keep their ids.

Each Arrow batch is checked against the sentencepiece library: every whole text is
encoded by both, and a difference raises an error.

Null text is empty and gives no ids; a null doc_id stays null; repeated rows are
encoded alike; texts of any length are encoded whole; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from airseries.llm.common import id_and_text

MARK = "▁"
#: Units and stretches whose ids a worker keeps (some 200 MB each); a full table makes way for a new one.
KEPT_UNITS = 800_000
KEPT_STRETCHES = 1_000_000
#: Characters up to which the agenda is a plain list.
SHORT = 40
NEVER = float("inf")
#: Longer units and stretches (a text without spaces) are encoded but not kept.
KEPT_LENGTH = 64


class PieceEncoder:
    def __init__(self, model_path: str):
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.pieces = {sp.id_to_piece(i): i for i in range(n)
                       if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.costs = {p: -sp.get_score(i) for p, i in self.pieces.items()}
        if len(self.byte_ids) != 256 or sp.normalize(" a  b") != f"{MARK}{MARK}a{MARK}{MARK}b":
            raise ValueError("a merge vocabulary with byte pieces and the identity rule is expected")
        # Adjacent characters that no piece holds side by side can never be merged.
        self.joins = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        apart = not any(j[1] == MARK != j[0] for j in self.joins)
        self.unit = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else "(?s).+")
        self.known: dict[str, tuple[int, ...]] = {}  # units met lately
        self.older: dict[str, tuple[int, ...]] = {}  # and before that
        self.stretches: dict[str, tuple[int, ...]] = {}

    def merge(self, stretch: str) -> tuple[int, ...]:
        """The agenda, on one stretch of characters."""
        symbols = self._short(list(stretch)) if len(stretch) <= SHORT else self._long(list(stretch))
        out: list[int] = []
        for s in symbols:
            known = self.pieces.get(s)
            if known is not None:
                out.append(known)
            else:
                out += [self.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def _short(self, symbols: list[str]) -> list[str]:
        """The agenda as a list beside the symbols: the first least cost is the best, leftmost pair."""
        cost = self.costs.get
        agenda = [cost(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] = pair = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = cost(pair + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + pair, NEVER)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap, for stretches whose every pair cannot be looked at for each merge."""
        costs, n = self.costs, len(symbols)
        agenda = []
        for a in range(n - 1):
            pair = symbols[a] + symbols[a + 1]
            if pair in costs:
                agenda.append((costs[pair], a, a + 1, pair))
        heapq.heapify(agenda)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, a, b, pair = heapq.heappop(agenda)
            # stale unless both still stand, unmerged since the offer
            if right[a] != b or symbols[a] + symbols[b] != pair:
                continue
            symbols[a], symbols[b] = pair, ""
            after = right[a] = right[b]
            right[b] = -1
            if after < n:
                left[after] = a
                both = pair + symbols[after]
                if both in costs:
                    heapq.heappush(agenda, (costs[both], a, after, both))
            before = left[a]
            if before >= 0:
                both = symbols[before] + pair
                if both in costs:
                    heapq.heappush(agenda, (costs[both], before, a, both))
        return [s for s in symbols if s]

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit from those of its stretches, which end where no piece can reach across."""
        joins, stretches, out, start = self.joins, self.stretches, (), 0
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1:i + 1] not in joins:
                stretch = unit[start:i]
                got = stretches.get(stretch)
                if got is None:
                    got = self.merge(stretch)
                    if len(stretch) <= KEPT_LENGTH:
                        stretches[stretch] = got
                out += got
                start = i
        return out

    def encode(self, texts: list[str], check: bool = True) -> list[list[int]]:
        if len(self.known) > KEPT_UNITS:
            self.older, self.known = self.known, {}
        if len(self.stretches) > KEPT_STRETCHES:
            self.stretches = {}
        known, older, find, out = self.known, self.older, self.unit.findall, []
        for text in texts:
            ids: list[int] = []
            for unit in find(MARK + text.replace(" ", MARK)) if text else ():
                got = known.get(unit)
                if got is None:
                    got = older.get(unit)
                    if got is None:
                        got = self._unit(unit)
                    if len(unit) <= KEPT_LENGTH:
                        known[unit] = got
                ids += got
            out.append(ids)
        # Text by text: the library takes a third less time so than for a list.
        if check and out != list(map(self.sp.encode_as_ids, texts)):
            raise AssertionError("the agenda and the library differ")
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1) if ids else []


@lru_cache(maxsize=2)
def encoder(model_path: str) -> PieceEncoder:
    return PieceEncoder(model_path)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None, check: bool = True,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path or default_model())
        for b in batches:
            ids = e.encode(b.column(1).to_pylist(), check)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(e.decode(ids), pa.string())],
                ["doc_id", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str | None = None, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids stay in the Python batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path or default_model())
        decimal = [str(i) for i in range(e.sp.get_piece_size())]
        sha = hashlib.sha256
        for b in batches:
            ids = e.encode(b.column(1).to_pylist(), check)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([sha(",".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                 pa.array([sha(t.encode("utf-8", "surrogatepass")).hexdigest() for t in e.decode(ids)], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
