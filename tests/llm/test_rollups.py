from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
import tiktoken.load
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from airseries.llm import token_rollups as T
from airseries.llm import tokens
from airseries.llm.common import shared_folder
from airseries.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm import cases

SCHEMA = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, seq long, batch string"


def apply(state, nameless, changes):
    """Brute force on a dict."""
    order = sorted(changes, key=lambda c: (c[6] or 0, c[0] == "delete", c[5] or 0, c[2] is not None, c[2] or "", c[3] is not None, c[3] or ""))
    last = {}
    for op, doc, source, lang, tok, n, seq, _ in order:
        if op not in ("insert", "revise", "delete"):
            continue
        if doc is None:
            if op == "insert":
                nameless.append((source, lang, tok or "", n or 0))
        else:
            last[doc, tok or ""] = None if op == "delete" else (source, lang, n or 0)
    state.update(last)


def sums(state, nameless):
    out = defaultdict(lambda: [0, 0])
    for (doc, tok), v in state.items():
        if v:
            out[v[0], v[1], tok][0] += 1
            out[v[0], v[1], tok][1] += v[2]
    for source, lang, tok, n in nameless:
        out[source, lang, tok][0] += 1
        out[source, lang, tok][1] += n
    return {k: tuple(v) for k, v in out.items()}


BATCHES = [
    [("insert", i, f"s{i % 2}", "en", "v1", 10 * i, 0, "x") for i in range(20)]
    + [("insert", 3, "s1", "en", "v1", 30, 0, "x"), ("insert", 4, "s0", "en", "v1", 99, 5, "x"), ("insert", None, "s0", None, "v1", 7, 0, "x"),
       ("insert", None, "s0", None, "v1", 7, 0, "x"), ("insert", 50, None, None, "v1", None, None, "x"), ("insert", 1, "s1", "en", "v2", 11, 0, "x")],
    [("delete", 2, "s0", "en", "v1", 20, 0, "x"), ("delete", 77, "s0", "en", "v1", 1, 0, "x"), ("revise", 5, "s1", "en", "v1", 1, 0, "x"),
     ("revise", 60, "s9", "de", "v1", 4, 0, "x"), ("delete", None, "s0", None, "v1", 7, 0, "x"), ("unknown", 6, "s0", "en", "v1", 1, 0, "x"),
     ("insert", 7, "s1", "fr", "v1", 71, 0, "x"), ("revise", 8, "s0", "en", "v1", 3, 1, "x"), ("delete", 8, "s0", "en", "v1", 3, 1, "x")],
    [],
    [("insert", 2, "s0", "en", "v1", 21, 0, "x"), ("delete", 5, "s1", "en", "v1", 0, 0, "x"), ("revise", 1, "s1", "en", "v2", 12, 0, "x")],
]


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_batches_match_brute_force_and_repeat_without_effect(spark):
    rollup = T.TokenRollup(spark, shared_folder(spark, "test-rollup"))
    assert totals(rollup) == {}
    state, nameless = {}, []
    for k, batch in enumerate(BATCHES, 1):
        frame = spark.createDataFrame(batch, SCHEMA)
        assert rollup.commit(k, frame)
        apply(state, nameless, batch)
        assert totals(rollup) == sums(state, nameless)
        assert not rollup.commit(k, frame) and not rollup.commit(1, frame)
        assert totals(rollup) == sums(state, nameless)
    assert rollup.committed() == [1, 2, 3, 4]


def test_a_batch_that_broke_off_is_written_anew(spark):
    path = shared_folder(spark, "test-rollup")
    rollup = T.TokenRollup(spark, path)
    frame = spark.createDataFrame(BATCHES[0], SCHEMA)
    # the ledger and part of the sums were written, the success mark was not
    frame.limit(2).select("doc_id", "tokenizer", "source", "lang", "n_tokens", F.lit(True).alias("live")).write.parquet(f"{path}/ledger/batch=1")
    spark.createDataFrame([("s0", "en", "v1", 9, 9)], "source string, lang string, tokenizer string, n_docs long, n_tokens long") \
        .write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/sums/batch=1")
    assert rollup.committed() == [] and totals(rollup) == {}
    assert rollup.commit(1, frame)
    state, nameless = {}, []
    apply(state, nameless, BATCHES[0])
    assert totals(rollup) == sums(state, nameless)


def test_late_ids_are_refused(spark):
    rollup = T.TokenRollup(spark, shared_folder(spark, "test-rollup"))
    rollup.commit(5, spark.createDataFrame(BATCHES[0], SCHEMA))
    with pytest.raises(ValueError):
        rollup.commit(4, spark.createDataFrame(BATCHES[1], SCHEMA))


def test_query_matches_a_recount(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF001}/labels.parquet").where("toxic = 1").collect()}
    first = Tokenizer.from_file(tokens.default_json())
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    multi = tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=tiktoken.load.load_tiktoken_bpe(path))
    want = defaultdict(lambda: [0, 0])
    for d in docs:
        if d["doc_id"] in toxic:
            continue
        lines = []
        for line in d["text"].split("\n"):
            if line not in lines:
                lines.append(line)
        for name, n in (("byte_bpe_50k", len(first.encode("\n".join(lines), add_special_tokens=False).ids)),
                        ("byte_bpe_multi_50k", len(multi.encode_ordinary(d["text"])))):
            want[d["source"], d["lang"], name][0] += 1
            want[d["source"], d["lang"], name][1] += n
    got = {tuple(r[:3]): list(r[3:]) for r in QUERIES["op5_token_rollups"](spark, SF001).collect()}
    assert got == dict(want)


def test_the_tenth_commit_reads_a_snapshot_and_its_tail(spark):
    rollup = T.TokenRollup(spark, shared_folder(spark, "test-rollup"), every=3)
    state, nameless = {}, []
    for k in range(1, 11):
        batch = [("insert", 100 * k + i, f"s{i % 2}", "en", "v1", k, 0, "x") for i in range(4)]
        batch += [("delete", 100 * (k - 1), "s0", "en", "v1", 0, 0, "x"), ("revise", 101, "s1", "fr", "v1", k, 0, "x")]
        assert rollup.commit(k, spark.createDataFrame(batch, SCHEMA))
        apply(state, nameless, batch)
        assert totals(rollup) == sums(state, nameless)
        assert len(rollup.reads("ledger", rollup.committed())) <= 4 and len(rollup.reads("sums", rollup.committed())) <= 4
    assert not rollup.commit(2, spark.createDataFrame(BATCHES[0], SCHEMA))  # remembered behind the snapshot
    before = rollup.reads("ledger", rollup.committed())
    rollup.compact()
    rollup.compact()
    assert len(rollup.reads("ledger", rollup.committed())) == 1 <= len(before)
    assert totals(rollup) == sums(state, nameless)


def test_a_snapshot_that_broke_off_is_not_read(spark):
    path = shared_folder(spark, "test-rollup")
    rollup = T.TokenRollup(spark, path, every=100)
    state, nameless = {}, []
    for k, batch in enumerate(BATCHES[:2], 1):
        rollup.commit(k, spark.createDataFrame(batch, SCHEMA))
        apply(state, nameless, batch)
    spark.createDataFrame([("s0", "en", "v1", 9, 9)], "source string, lang string, tokenizer string, n_docs long, n_tokens long") \
        .write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/sums-snapshot/batch=2")
    assert totals(rollup) == sums(state, nameless)
    rollup.compact()
    assert totals(rollup) == sums(state, nameless) and len(rollup.reads("sums", [1, 2])) == 1


def test_counts_of_awkward_documents(spark):
    first = Tokenizer.from_file(tokens.default_json())
    first.encode_special_tokens = True  # a special token's string in a text is ordinary text
    multi = tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))

    def size(text):
        return len(first.encode(text, add_special_tokens=False).ids)

    want = []
    for d, text, lang, source, *_ in cases.rows():
        text = text or ""
        short = "\n".join(dict.fromkeys(text.split("\n")))
        want.append((d, source, lang, size(text), len(multi.encode_ordinary(text)), size(short) if short != text else None))
    got = [tuple(r) for r in T.count_tokens(cases.documents(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert T.count_tokens(cases.empty(spark)).count() == 0
