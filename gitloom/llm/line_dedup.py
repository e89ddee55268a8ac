"""Line deduplication within one edit, by joining deletion neighbourhoods. DataFrame functions only.

A line goes if an earlier occurrence of the same line, or of a line within one edited character,
stands in the input: a lower doc_id, or the same document higher up. That is judged on the input,
not on what is left. Lines without a word are left alone. Lines shorter than ``min_chars``
characters go where they are equal to an earlier one; one edit is too much of them to be the same
line. Without ``short`` they are left alone altogether.

Emitting all one-character deletions of long lines would multiply the text by its own length, so
the neighbourhood is emitted coarse to fine. A line leaves out one of three blocks at a time and
emits the hash of the rest, with the block's place: two lines within one edit agree in everything
but the block the edit lies in. A longer line meets the shorter one by leaving out one character
more. Keys that only one line has are dropped; of the others the left-out block is cut again, until
blocks are short enough for all deletions of one character. There equal keys mean one edit, and the
distance is verified on the blocks. Each group of equal keys needs only its earliest line, so no
pairs are formed, however many lines share a key.

Documents are told apart by id and text: repeated rows are one document and get one result each.
NULL ids come first in order. NULL texts stay NULL, empty ones empty. An empty table gives an empty
table. Lines are identified by two 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitloom.llm.common import ROW
from gitloom.session import materialise

LEVEL0, BRANCHES, SHORT = 3, 8, 32
SPACE = " \t\n\x0b\x0c\r"
# Cells of the hashed set of documents that a join is narrowed to: a bound on what is broadcast.
CELL_BITS = 20


@dataclass(frozen=True)
class Rule:
    min_chars: int = 16
    near: bool = True
    short: bool = True


def _identity(docs: DataFrame, text: str, key: str) -> DataFrame:
    value = F.col(f"`{text}`")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW),
        F.col(f"`{key}`").alias("id"),
        F.xxhash64(value).alias("th"),
        value.alias("body"),
    )


def _cell() -> Column:
    return F.pmod(F.xxhash64("th", F.lit(3)), F.lit(1 << CELL_BITS)).cast("int")


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, th, no, line): the lines that are compared, of *least* characters or more."""
    every = docs.select("id", "th", F.posexplode(F.split("body", "\n", -1)).alias("no", "line"))
    # A line of white space alone has nothing left when that is taken off.
    return every.filter((F.char_length("line") >= least) & (F.ltrim("line", F.lit(SPACE)) != ""))


def _named(lines: DataFrame) -> DataFrame:
    return lines.withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64(F.lit(1), "line"))


def _block(base: Column, branches: int, i: int) -> tuple[Column, Column]:
    """Where block *i* of *base* characters begins (from 0), and its length."""
    size = F.ceil(base / branches).cast("int")
    begin = F.least(size * i, base)
    return begin, F.least(size, base - begin)


def _level0_keys() -> list[Column]:
    """Keys of a line as the shorter or equal one (first half) and as the longer one (second half)."""
    keys, length = [], F.char_length("line")
    for extra in (0, 1):
        base = length - extra
        for i in range(LEVEL0):
            begin, size = _block(base, LEVEL0, i)
            before = F.substring("line", F.lit(1), begin)
            after = F.substring("line", begin + size + (extra + 1), length)
            keys.append(F.xxhash64(F.lit(i), base, before, after))
    return keys


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key has another line too and a line that is not the longer one."""
    groups = (
        rows.groupBy("key")
        .agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.min("extra").alias("least"))
        .filter((F.col("lo") < F.col("hi")) & (F.col("least") == 0))
        .select("key")
    )
    return rows.join(groups, "key")


def _near(docs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): lines that have an earlier line within one edit."""
    n = 2 * LEVEL0
    keyed = _named(_lines(docs, rule.min_chars)).select(
        "a", "b", "id", "th", "no", *[k.alias(f"k{i}") for i, k in enumerate(_level0_keys())]
    )
    distinct = keyed.groupBy("a", "b").agg(
        F.min(F.struct("id", "th", "no")).alias("first"), *[F.first(f"k{i}").alias(f"k{i}") for i in range(n)]
    )
    # Read twice below, with different columns: as a table the lines are read and hashed once.
    distinct = materialise(distinct, "line-hashes")
    spread = distinct.select(
        "a", "b", "first", F.posexplode(F.array(*[f"k{i}" for i in range(n)])).alias("slot", "key")
    ).withColumn("extra", (F.col("slot") >= LEVEL0).cast("int"))
    found = materialise(_shared(spread), "line-keys")

    # The candidates' text, from the documents whose cell one of them has.
    cells = F.broadcast(found.select(F.col("first.th").alias("th")).select(_cell().alias("cell")).distinct())
    held = docs.select("id", "th", "body").withColumn("cell", _cell()).join(cells, "cell", "left_semi")
    held = held.select("id", "th", "body").dropDuplicates(["id", "th"])
    same = held["id"].eqNullSafe(found["first.id"]) & (held["th"] == found["first.th"])
    line = F.get(F.split("body", "\n", -1), F.col("first.no"))
    told = found.join(held, same).select("a", "b", "first", "slot", "key", "extra", line.alias("line"))
    base = F.char_length("line") - F.col("extra")
    begin = F.coalesce(*[F.when(F.col("slot") % LEVEL0 == i, _block(base, LEVEL0, i)[0]) for i in range(LEVEL0)])
    size = F.coalesce(*[F.when(F.col("slot") % LEVEL0 == i, _block(base, LEVEL0, i)[1]) for i in range(LEVEL0)])
    rows = told.select(
        "a", "b", "first", "key", "extra", F.substring("line", begin + 1, size + F.col("extra")).alias("w")
    )
    rows = materialise(rows, "line-blocks")
    done = None
    while True:
        longest = rows.agg(F.max(F.char_length("w") - F.col("extra"))).first()[0]
        short = rows.filter(F.char_length("w") - F.col("extra") <= SHORT)
        done = short if done is None else done.unionByName(short)
        if longest is None or longest <= SHORT:
            break
        long = rows.filter(F.char_length("w") - F.col("extra") > SHORT)
        rows = materialise(_shared(_narrowed(long)), "line-blocks")
    return _within_one(done)


def _narrowed(rows: DataFrame) -> DataFrame:
    """Each left-out block cut into smaller ones, one left out at a time."""
    base = F.char_length("w") - F.col("extra")
    parts = []
    for i in range(BRANCHES):
        begin, size = _block(base, BRANCHES, i)
        before = F.substring("w", F.lit(1), begin)
        inside = F.substring("w", begin + 1, size + F.col("extra"))
        after = F.substring("w", begin + size + F.col("extra") + 1, F.char_length("w"))
        key = F.xxhash64("key", F.lit(i), before, after)
        parts.append(F.struct(key.alias("key"), inside.alias("w")))
    cut = rows.select("a", "b", "first", "extra", F.explode(F.array(*parts)).alias("p"))
    return cut.select("a", "b", "first", "extra", "p.key", "p.w")


def _within_one(rows: DataFrame) -> DataFrame:
    """All deletions of one character of the short blocks, joined: lines that have an earlier one."""
    places = F.sequence(F.lit(1), F.char_length("w"))
    without = lambda i: F.concat(
        F.substring("w", F.lit(1), i - 1), F.substring("w", i + 1, F.char_length("w"))
    )
    some = rows.filter(F.char_length("w") > 0)
    # One character changed: the same length, and the same rest without the same place.
    changed = some.filter("extra = 0").select(
        "a", "b", "first", "key", "w", F.explode(F.transform(places, lambda i: F.struct(i.alias("i"), without(i).alias("v")))).alias("d")
    )
    earliest = changed.groupBy("key", "d").agg(F.min(F.struct("first", "w")).alias("e"), F.count(F.lit(1)).alias("n"))
    swaps = (
        changed.join(earliest.filter("n > 1"), ["key", "d"])
        .filter((F.col("first") > F.col("e.first")) & (F.levenshtein("w", F.col("e.w")) <= 1))
        .select("a", "b")
    )
    # One character more: the longer line without one place is the shorter line.
    longer = some.filter("extra = 1").select(
        "a", "b", "first", "key", "w", F.explode(F.array_distinct(F.transform(places, without))).alias("v")
    )
    shorter = rows.filter("extra = 0").select(
        "key", F.col("w").alias("v"), F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("first").alias("sf")
    )
    met = longer.join(shorter, ["key", "v"]).filter(F.levenshtein("w", "v") <= 1)
    late = F.col("first") > F.col("sf")
    grown = met.select(F.when(late, F.col("a")).otherwise(F.col("sa")).alias("a"), F.when(late, F.col("b")).otherwise(F.col("sb")).alias("b"))
    return swaps.unionByName(grown).distinct()


def removed_lines(docs: DataFrame, rule: Rule = Rule(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, th, no, near): every line that goes; *near* where a line of other wording stays for it."""
    return _removed(_identity(docs, text, key), rule)


def _removed(docs: DataFrame, rule: Rule) -> DataFrame:
    lines = _named(_lines(docs, 0 if rule.short else rule.min_chars)).select("a", "b", "id", "th", "no")
    first = lines.groupBy("a", "b").agg(F.min(F.struct("id", "th", "no")).alias("first"))
    if rule.near:
        near = materialise(_near(docs, rule), "line-near").withColumn("near", F.lit(True))
        first = first.join(near, ["a", "b"], "left")
    else:
        first = first.withColumn("near", F.lit(False))
    judged = lines.join(first, ["a", "b"]).withColumn("near", F.coalesce("near", F.lit(False)))
    again = F.struct("id", "th", "no") != F.col("first")
    return judged.filter(F.col("near") | again).select("id", "th", "no", "near")


def deduplicated(docs: DataFrame, rule: Rule = Rule(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_row, text, n_lines, n_removed, n_near): each document with the lines that stay."""
    named = _identity(docs, text, key)
    gone = (
        _removed(named, rule)
        .groupBy("id", "th")
        .agg(
            F.collect_set("no").alias("gone"),
            F.size(F.collect_set(F.when(F.col("near"), F.col("no")))).alias("n_near"),
        )
    )
    gone = materialise(gone, "line-gone").withColumnRenamed("id", "gid").withColumnRenamed("th", "gth")
    # Documents that lose no line are not shuffled.
    cells = gone.select(F.col("gth").alias("th")).select(_cell().alias("cell")).distinct().withColumn("hit", F.lit(True))
    marked = named.withColumn("cell", _cell()).join(F.broadcast(cells), "cell", "left")
    whole = marked.filter(F.col("hit").isNull()).select(
        ROW, "body", F.array().cast("array<int>").alias("gone"), F.lit(0).alias("n_near")
    )
    touched = (
        marked.filter(F.col("hit"))
        .join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
        .select(
            ROW,
            "body",
            F.coalesce("gone", F.array().cast("array<int>")).alias("gone"),
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
        )
    )
    parts = F.split("body", "\n", -1)
    # The text is split once, as a lambda's argument; places are set apart by hashing, not one by one.
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone"))
    rest = lambda p: F.array_join(F.transform(stay(p), lambda i: F.get(p, i)), "\n")
    left = F.get(F.transform(F.array(parts), rest), F.lit(0))
    return whole.unionByName(touched).select(
        ROW,
        F.when(F.size("gone") == 0, F.col("body")).otherwise(left).alias("text"),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.col("n_near").cast("long").alias("n_near"),
    )
