"""Small tables with the cases every operator has to stand, and plain readings of the contracts."""

from __future__ import annotations

import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Columns with the names the operators give to theirs.
CLASHING = ["_row", "score", "kept", "n_words", "class", "block", "rank", "size", "part", "cell", "id", "th", "n", "k", "h"]

WORDS = "river stone cloud winter garden letter market silver window harbour candle forest".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * 3 + i * seed) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


def odd_rows() -> list[tuple]:
    long = " ".join(sentence(s, 40) for s in range(400))
    base = sentence(3, 60)
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base.replace("river", "lake", 1), None, "b", None),
        (4, None, "en", "b", None),
        (5, "", "en", None, 0),
        (6, " \t\n ", "en", None, 0),
        (7, long, "en", "c", 9),
        (None, sentence(5, 80), "en", "c", 9),
        (None, None, None, None, None),
        (8, "one two\nthree Ünïcode 漢字 wörter\n\none two", "de", "c", 9),
        (9, "x" * 5000, "en", "a", 9),
        (10, base + "\n" + sentence(9, 30) + "\n" + sentence(9, 30), "en", "b", 9),
        (11, "tiny", "en", "a", 4),
    ]


def docs(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def widened(frame):
    """The same rows with extra columns whose names an operator uses itself."""
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit(7).alias(c) for c in CLASHING if c not in frame.columns])


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
