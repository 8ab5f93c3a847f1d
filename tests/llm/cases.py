"""Small tables with the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "n long, sha string, length string, part int, `a.b` string, "
          "__doc_id string, __rows string, of_rows string, row string, digest string, `tick``ed` string")


def _word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(_word(rng) for _ in range(n))


def rows():
    base = prose(1, 300)
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "\n", 4)), (4, base + "  "),  # equal up to white space
        (5, base + " tail"), (6, prose(2, 40)), (7, ""), (8, None), (9, " \t\n"), (10, "one"), (11, "one two"),
        (12, "Ünïcödé 漢字 😀 \x85 ​ text" * 5), (13, prose(3, 20_000)),  # very long
        (None, "no id " + prose(4, 50)), (None, base), (14, prose(5, 60) + "\n" + prose(5, 60) + "\n\nx\nx"),
        (15, "### $$$ %%% " * 40 + prose(6, 30)), (16, "word " * 200), (17, "A\r\nB\x0bC\x0cD"), (18, "▁x  y ▁"),
        (19, "<|endoftext|> <s> <0x0A>"), (20, base.upper()), (21, prose(7, 300)), (21, prose(7, 300)),  # a repeated row
        (22, "a b c"), (22, "a  b c"), (23, "AB  c"), (24, "A B c"),  # one id with two texts, ties in length
    ]
    texts += [(100 + i, prose(50 + i, 80) + ".") for i in range(60)]
    texts += [(200 + i, base) for i in range(40)]  # a hot group
    return [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}",
             None if t is None else len(t), k, "x", "y", 1, "z",
             "1", "2", "3", "4", "5", "6") for k, (i, t) in enumerate(texts)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    """Good prose and junk, so that both kinds occur; a null label, a null id, two labels for one document."""
    data = [(100 + i, 1, i % 9 == 0) for i in range(60)] + [(15, 0, True), (16, 0, False), (6, 1, False), (6, 1, False)]
    data += [(None, 1, False), (21, None, False), (5, 1, None)]
    return spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in data],
                                 "doc_id long, quality int, toxic int")
