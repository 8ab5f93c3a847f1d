import random

import public_tokenizers
import pytest

from airseries.llm import tokens


@pytest.fixture(scope="module")
def both():
    path = tokens.default_json()
    return tokens._tokenizer(path), tokens._ranked(path.removesuffix(".json") + ".tiktoken", public_tokenizers.PATTERN)


def same(both, texts):
    library, ranked = both
    return all(e.ids == tokens.ordinary(ranked, t) for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)))


def test_every_code_point(both):
    points = [c for c in range(0x33480) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 8192):
        assert same(both, [f"a{c}b {c} {c}{c}1 {c}'s\n{c}  {c}.x{c}" for c in map(chr, points[at:at + 8192])])


def test_mixed_texts(both):
    rng = random.Random(5)
    parts = [*"aZ09 \t\n\r.,'é漢ß١́‍　\x85\x1c\x00", "'s", "'LL", "  ", "\n\n", "😀", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 80))) for _ in range(5000)]
    assert same(both, texts)


def test_long_runs_of_white_space(both, monkeypatch):
    library, ranked = both
    big = ["x" + " " * 1_000_000 + "y", "\n" * 1_000_000, " \n" * 400_000 + "end", "a" * 300_000]
    assert [x.tolist() for x in tokens.encode(big)] == [e.ids for e in library.encode_batch(big, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "LONG_RUN", 3)
    rng = random.Random(6)
    assert same(both, ["".join(rng.choices(["a", "1", ".", " ", "\n", "　", "   ", "\n\n\n", " word"], k=rng.randint(0, 60)))
                       for _ in range(5000)])


def test_code_points_beyond_the_compared_ones():
    texts = ["plain", "\U000e0001 tag \U0010ffff", ""]
    library = tokens._tokenizer(tokens.default_json())
    assert [x.tolist() for x in tokens.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
