"""Small documents with every awkward case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, texts=(), extra=False):
    """Nulls in every column, empty and long texts, repeated rows, repeated and missing ids, and ``texts``."""
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, "  \t ", "en", "b", 4), (4, "one line\nshared line\n", "en", "b", 21),
        (4, "one line\nshared line\n", "en", "b", 21), (5, "\n\n\n", "en", None, 3), (None, "no id here at all", "en", "c", 17),
        (None, None, None, None, None), (6, "word " * 20000, "en", "c", 100000), (7, "!!! ??? 123", None, "c", 11),
        (7, "another text of the same id", "en", "c", 27), (8, "Ünïcödé ŽÁBA \U0001F600 x́ ​", "de", "d", 20),
    ] + [(100 + n, t, "en", "z", len(t)) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    if extra:  # columns with names that operators use themselves
        for name in ("text_hash", "hit_id", "cleaned", "ids", "number", "taken", "fp", "row_number", "shard", "place", "key", "Language", "keys"):
            frame = frame.selectExpr("*", f"cast(doc_id as string) as `{name}`")
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(rng: random.Random, n: int, words: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(n))


def rows(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)
