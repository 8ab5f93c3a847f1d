import hashlib
import random

import pytest
import sentencepiece

from airseries.llm import piece_encoding as E
from tests.llm import cases


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=E.default_model())


def random_texts(n):
    rng = random.Random(8)
    parts = list("abcdefghinorst .,!?\n\t▁<>0123€漢😀é​\r\x00") + ["  ", "    ", "<s>", "<0x0A>", " the", " in", "ing", "####"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 150))) for _ in range(n)]


def test_agenda_equals_the_library(library):
    texts = [t or "" for _, t, *_ in cases.rows()] + random_texts(1500)
    assert E.PieceEncoder(E.default_model()).encode(texts) == library.encode(texts, num_threads=1)


def test_list_and_heap_agendas_agree():
    e = E.PieceEncoder(E.default_model())
    for t in random_texts(200):
        assert e._short(list(t)) == e._long(list(t))


def test_a_long_word_and_a_full_table(library, monkeypatch):
    monkeypatch.setattr(E, "KEPT_UNITS", 5)
    monkeypatch.setattr(E, "KEPT_STRETCHES", 5)
    e = E.PieceEncoder(E.default_model())
    texts = ["abracadabra" * 3000, " " * 500, *random_texts(50)]
    for at in range(0, len(texts), 4):
        assert e.encode(texts[at:at + 4]) == library.encode(texts[at:at + 4], num_threads=1)


def test_a_difference_is_an_error():
    e = E.PieceEncoder(E.default_model())
    e.known["▁the"] = (5,)
    for texts in (["the"], ["a", "b", "of the"]):  # wherever in the batch
        with pytest.raises(AssertionError):
            e.encode(texts)


def test_digests_and_real_outputs(spark, library):
    want = []
    for i, t, *_ in cases.rows():
        ids = library.encode(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in E.digests(cases.documents(spark)).collect()]
    assert sorted(got) == sorted(want)
    for r in E.encode_documents(cases.documents(spark)).collect():
        assert r["decoded"] == library.decode(list(r["ids"]))


def test_empty(spark):
    assert E.digests(cases.empty(spark)).count() == 0
