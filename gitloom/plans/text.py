"""Registered queries over text: first lines, estimates, hashes, patches, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitloom.functions import text as t
from gitloom.plans.registry import query
from gitloom.sources import adapters as a


@query(
    "first_lines",
    r"""SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')[1] AS first_line,
          CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, sha256(text) AS sha256,
          substring(sha256(text), 1, 8) AS short_sha FROM documents""",
)
def first_lines(spark, sf):
    text = F.col("text")
    return a.table(spark, sf, "documents").select(
        "doc_id",
        t.first_line(text).alias("first_line"),
        t.token_estimate(text).alias("tokens"),
        F.sha2(text, 256).alias("sha256"),
        t.short_sha(F.sha2(text, 256)).alias("short_sha"),
    )


@query(
    "bounded_text",
    """SELECT page_id, substring(html, 1, 4000) AS text, CAST(least(length(html), 4000) AS INTEGER) AS characters,
         CAST(length(html) AS INTEGER) AS characters_total, length(html) > 4000 AS truncated FROM pages""",
)
def bounded_text(spark, sf):
    return a.table(spark, sf, "pages").select("page_id", t.bounded(F.col("html")).alias("b")).select("page_id", "b.*")


@query(
    "path_forms",
    r"""SELECT page_id, CASE WHEN starts_with(replace(w, '\', '/'), './') THEN substring(replace(w, '\', '/'), 3)
            ELSE replace(w, '\', '/') END AS path, nullif(trim(html), '') AS trimmed
       FROM (SELECT page_id, html, '.\' || replace(replace(url, 'https://', ''), '/', '\') AS w FROM pages)""",
)
def path_forms(spark, sf):
    written = F.concat(F.lit(".\\"), F.translate(F.replace("url", F.lit("https://"), F.lit("")), "/", "\\"))
    return a.table(spark, sf, "pages").select(
        "page_id",
        t.normalise_path(written).alias("path"),
        t.trimmed_or_null(F.col("html")).alias("trimmed"),
    )


@query(
    "ordinal_words",
    """SELECT p_partkey, CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 100 BETWEEN 10 AND 20 THEN 'th'
         WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd'
         ELSE 'th' END AS word,
         CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR)
              ELSE CAST(p_size AS VARCHAR) || '-' || CAST(p_size + p_size % 3 AS VARCHAR) END AS lines,
         p_type AS scope
       FROM part""",
)
def ordinal_words(spark, sf):
    size = F.col("p_size")
    qualname = F.when(
        F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(".<locals>.a.<locals>."), "p_brand")
    ).otherwise(F.concat("p_type", F.lit("."), "p_brand"))
    return a.table(spark, sf, "part").select(
        "p_partkey",
        t.ordinal_word(F.col("p_partkey")).alias("word"),
        t.line_range(size, size + size % 3).alias("lines"),
        t.enclosing_scope(qualname).alias("scope"),
    )


@query(
    "hunk_ranges",
    """WITH hunks AS (
         SELECT l_orderkey, 's' || CAST(l_suppkey AS VARCHAR) AS path, l_linenumber AS start,
                l_linenumber + CAST(l_quantity AS INTEGER) - 1 AS "end" FROM lineitem
         UNION ALL
         SELECT l_orderkey, 's' || CAST(l_suppkey AS VARCHAR), l_linenumber + CAST(l_quantity AS INTEGER) + 10,
                l_linenumber + CAST(l_quantity AS INTEGER) + 10 FROM lineitem)
       SELECT lpad(CAST(l_orderkey AS VARCHAR), 19, '0') AS commit_sha, path, start, "end" FROM hunks""",
)
def hunk_ranges(spark, sf):
    return a.patch_ranges(spark, sf).select("commit_sha", "path", "start", "end")


@query(
    "patch_sections",
    """SELECT l_orderkey, l_partkey, CASE n WHEN 1 THEN 's' || CAST(l_suppkey AS VARCHAR)
           WHEN 2 THEN 'p' || CAST(l_partkey AS VARCHAR) ELSE 'new' || CAST(l_partkey AS VARCHAR) END AS path,
         CASE n WHEN 1 THEN 2 ELSE 0 END AS ranges, n = 2 AS gone
       FROM lineitem, (VALUES (1), (2), (3)) v(n)""",
)
def patch_sections(spark, sf):
    return (
        a.patches(spark, sf)
        .select("l_orderkey", "l_partkey", F.explode(t.file_sections(F.col("patch"))).alias("s"))
        .select(
            "l_orderkey",
            "l_partkey",
            t.section_path(F.col("s")).alias("path"),
            F.when(t.new_side_path(F.col("s")).isNull(), 0)
            .otherwise(F.size(t.new_side_ranges(F.col("s"))))
            .alias("ranges"),
            t.new_side_path(F.col("s")).isNull().alias("gone"),
        )
    )


@query(
    "cited_ids",
    r"""SELECT conv_id, turn, array_to_string(regexp_extract_all(
           replace(replace(text, '. ', '] '), ' a', ' [a'), '\[([A-Za-z][A-Za-z0-9_-]*)\]', 1), ',') AS ids
       FROM conversations""",
)
def cited_ids(spark, sf):
    marked = F.replace(F.replace("text", F.lit(". "), F.lit("] ")), F.lit(" a"), F.lit(" [a"))
    return a.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(t.citation_ids(marked), ",").alias("ids")
    )


@query(
    "event_properties",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         '{"k":' || json_extract_string(props, '$.k') || ',"kind":"' || event_type || '"}' AS document
       FROM events""",
)
def event_properties(spark, sf):
    parsed = F.from_json("props", "k int")
    return a.table(spark, sf, "events").select(
        "event_id",
        parsed["k"].alias("k"),
        F.to_json(F.struct(parsed["k"].alias("k"), F.col("event_type").alias("kind"))).alias("document"),
    )


@query(
    "running_turns",
    """SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role,
         CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS user_turns
       FROM conversations""",
)
def running_turns(spark, sf):
    from gitloom.operators.sequence import Running, ordered, running

    walk = ordered(a.table(spark, sf, "conversations"), ["conv_id", "turn"])
    return running(
        walk,
        ["conv_id"],
        [
            Running("previous_role", "last", F.col("role"), before=True),
            Running("user_turns", "sum", F.when(F.col("role") == "user", 1).otherwise(0)),
        ],
    ).select("conv_id", "turn", "role", "previous_role", "user_turns")
