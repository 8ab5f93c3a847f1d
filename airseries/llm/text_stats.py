"""Statistics of a text that the quality operators share (plain Python on one text)."""

from __future__ import annotations

import numpy as np

WINDOW = 8
_WINDOW_MULTIPLIERS = np.random.default_rng(8).integers(1, 2**62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Columns of :func:`counts`.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
          "n_digits", "n_stops", "n_exclaim", "n_adjacent", "n_distinct", "n_bars"]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint64, count=len(words))
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        keys += mixed[k:k + n] * _WINDOW_MULTIPLIERS[k]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    # Windows with equal keys are compared word by word, so a chance collision counts nothing.
    shared = np.zeros(n, dtype=bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    starts = np.flatnonzero(shared)
    wide = np.lib.stride_tricks.sliding_window_view(ids, window)[starts]
    _, inverse, times = np.unique(wide, axis=0, return_inverse=True, return_counts=True)
    starts = starts[times[inverse.ravel()] > 1]
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """The values of :data:`COUNTS`; words are runs of ``[^\\x20\\x09-\\x0D]``."""
    raw = text.encode("utf-8", "surrogatepass")
    by = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()  # splits at exactly \x20 and \x09-\x0D
    filled = [x for x in raw.split(b"\n") if x.strip()]
    points = len(raw) - int(by[128:192].sum())
    upper = int(by[65:91].sum())
    return (len(words), points - int(by[9:14].sum() + by[32]), int(by[list(b"#*$%&|<>")].sum()),
            len(filled) - len(set(filled)), repeat_words(words), len(filled), upper,
            upper + int(by[97:123].sum()), int(by[48:58].sum()), int(by[list(b".,;:?")].sum()), int(by[33]),
            sum(a == b for a, b in zip(words, words[1:])), len(set(words)), words.count(b"|"))


def ratios(c: np.ndarray) -> np.ndarray:
    """Rule statistics that do not depend on the length of a text, from rows of :data:`COUNTS`."""
    c = np.asarray(c, dtype=float).reshape(-1, len(COUNTS))
    col = {k: c[:, i] for i, k in enumerate(COUNTS)}
    words, lines = np.maximum(col["n_words"], 1), np.maximum(col["n_lines"], 1)
    return np.column_stack([
        col["word_chars"] / words, col["n_symbols"] / words, col["n_dup_lines"] / lines,
        col["n_repeat_words"] / words, col["n_upper"] / np.maximum(col["n_letters"], 1), col["n_exclaim"] / words,
        col["n_adjacent"] / words, col["n_bars"] / words, col["n_digits"] / words, col["n_stops"] / words])
