"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitloom.llm import (
    chat,
    context_tree,
    curriculum,
    hard_negatives,
    line_dedup,
    max_score,
    packing,
    quality_bands,
    repeats,
    resample,
    shingle_join,
    toxicity,
    vantage,
)
from gitloom.llm.common import crc_remainder, small_batches, table
from gitloom.session import ship, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def declare(plan: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(tune(spark))
            ship(spark)
            return plan(spark, sf_dir)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return prepared

    return declare


@query("op2_lexical_packing")
def lexical_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH told AS (
  SELECT conv_id, turn AS pos, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said,
         coalesce(role, 'unknown') = 'system' AS scene FROM conversations),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY pos, who, said) - 1) AS n FROM told),
speakers AS (SELECT DISTINCT conv_id AS c, who AS speaker FROM told WHERE NOT scene),
rendered AS (
  SELECT conv_id, speaker, n, n // 64 AS part,
         CASE WHEN scene THEN '<|system|>' WHEN who = speaker THEN '<|assistant|>'
              ELSE '<|user|>' || who || ': ' END AS head,
         said || '<|end|>' || chr(10) AS body, NOT scene AND who = speaker AS mine
  FROM placed JOIN speakers ON conv_id IS NOT DISTINCT FROM c),
offsets AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (
      PARTITION BY conv_id, speaker, part ORDER BY n
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rendered)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY n) AS text,
       coalesce(string_agg(CASE WHEN mine THEN CAST(CAST(before + length(head) AS BIGINT) AS VARCHAR) || '+'
           || CAST(length(body) AS VARCHAR) END, ' ' ORDER BY n), '') AS mask
FROM offsets GROUP BY conv_id, speaker, part
"""


@query("op4_perspective_rotation", CHAT_SQL)
def perspective_rotation(spark, sf_dir):
    spans = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string")))
    rows = chat.rotated(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "speaker", "part", "n_turns", "text", F.array_join(spans, " ").alias("mask"))


@query("op9_compression_bands")
def compression_bands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_bands.measured(docs)
    return found.select(
        "_row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "ratio",
        "bad_chunk_bytes",
        "chunk_bytes",
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ready AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM per_source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS b FROM ready),
ratios AS (SELECT *, source_size * 2.0::DOUBLE / w AS ratio FROM weighed),
levels AS (
  SELECT *, (b - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0.0))
          / (sum(w) OVER () - coalesce(sum(w) OVER before, 0.0)) AS level
  FROM ratios
  WINDOW before AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ranked AS (SELECT *, row_number() OVER (ORDER BY ratio, place) AS r FROM levels),
settled AS (SELECT min(r) AS r FROM ranked WHERE level < ratio),
plan AS (
  SELECT p.source, p.source_size, p.place,
         CASE WHEN s.r IS NULL OR p.r < s.r THEN p.source_size * 2.0::DOUBLE
              ELSE p.w * (SELECT level FROM ranked q WHERE q.r = s.r) END AS target
  FROM ranked p CROSS JOIN settled s),
joined AS (
  SELECT doc_id, size, source_size, target, place,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
counted AS (
  SELECT *, CAST(passes + CASE WHEN size > 0 AND before + size / 2.0 <= target - passes * source_size
                               THEN 1 ELSE 0 END AS BIGINT) AS copies FROM joined),
-- The share of a source's words that is asked for when its first and its last copy comes.
shares AS (
  SELECT *, least((before + CAST(size AS DOUBLE) / 2) / greatest(target, 1e-9::DOUBLE), 1) AS a,
         least(((copies - 1) * source_size + before + CAST(size AS DOUBLE) / 2) / greatest(target, 1e-9::DOUBLE), 1) AS z
  FROM counted),
-- Weights fall from 1.5 to 0.5; stay; rise from 0.5 to 1 at 0.7 and to 2 at the end (0.975 in all).
timed AS (
  SELECT *, [CASE place % 3 WHEN 0 THEN 1.5 - sqrt(2.25::DOUBLE - 2 * s) WHEN 1 THEN s
      ELSE CASE WHEN s < 0.525::DOUBLE / 0.975 THEN (sqrt(0.25::DOUBLE + s * 0.975 / 0.7) - 0.5) * 1.4
           ELSE 0.7 + (sqrt(1 + (s * 0.975::DOUBLE - 0.525) * 20 / 3) - 1) * 0.3 END END
      FOR s IN [a, z]] AS times FROM shares)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, size * copies AS taken, copies,
       CASE WHEN copies > 0 THEN round(times[1], 9) END AS first_position,
       CASE WHEN copies > 0 THEN round(times[2], 9) END AS last_position
FROM timed
"""


@query("op10_curriculum_mix", MIX_SQL)
def curriculum_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # In the order in which training first meets the documents; those it never takes come last.
    found = curriculum.by_first_position(curriculum.mixed(docs, keep_rows=False), "doc_id")
    return found.select(
        "_row.doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.col("copies").cast("long").alias("copies"),
        F.round(F.get("positions", F.lit(0)), 9).alias("first_position"),
        F.round(F.get("positions", F.col("copies") - 1), 9).alias("last_position"),
    )


@query("op1_toxic_segments")
def toxic_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.scored(docs, model).withColumn("doc_id", F.col("_row.doc_id"))
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "evidence",
        F.size("passages").alias("n_passages"),
    )


@query("op6_vantage_trees")
def vantage_trees(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vantage.neighbours(vectors, lambda key: key % 20 == 0)


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS no, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
told AS (
  SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS nth FROM told),
firsts AS (
  SELECT line, length(line) AS n, row_number() OVER (ORDER BY doc_id, no) AS pos FROM ranked
  WHERE nth = 1 AND length(line) >= 16),
-- One edit leaves the first or the last half of the shorter line as it is.
halves AS (
  SELECT line, n, pos, n // 2 AS h, 0 AS extra FROM firsts
  UNION ALL SELECT line, n - 1, pos, (n - 1) // 2, 1 FROM firsts),
pairs AS (
  SELECT s.line AS x, s.pos AS xa, t.line AS y, t.pos AS ya FROM halves s JOIN halves t
    ON s.n = t.n AND left(s.line, s.h) = left(t.line, t.h) WHERE s.extra = 0 AND s.line <> t.line
  UNION
  SELECT s.line, s.pos, t.line, t.pos FROM halves s JOIN halves t
    ON s.n = t.n AND right(s.line, s.h) = right(t.line, t.h) WHERE s.extra = 0 AND s.line <> t.line),
near AS (
  SELECT DISTINCT CASE WHEN xa < ya THEN y ELSE x END AS line FROM pairs WHERE levenshtein(x, y) <= 1),
gone AS (
  SELECT r.doc_id, r.no, near.line IS NOT NULL AS near FROM ranked r LEFT JOIN near ON r.line = near.line
  WHERE near.line IS NOT NULL OR nth > 1),
stay AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) AS text FROM lines l
  LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no WHERE g.no IS NULL GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE near) AS n_near FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_near, 0) AS BIGINT) AS n_near
FROM documents d LEFT JOIN stay s ON d.doc_id = s.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id
"""


@query("op3_line_neighbourhoods", LINE_SQL)
def line_neighbourhoods(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.deduplicated(docs)
    return found.select("_row.doc_id", "text", "n_lines", "n_removed", "n_near")


@query("op3_every_line", LINE_SQL)
def every_line(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.deduplicated(docs, line_dedup.Rule(short=True))
    return found.select("_row.doc_id", "text", "n_lines", "n_removed", "n_near")


@query("op8_set_relation_join")
def set_relation_join(spark, sf_dir):
    found = shingle_join.grouped(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "links"
    )


@query("op7_context_tree")
def context_tree_score(spark, sf_dir):
    train = crc_remainder(F.col("doc_id"), 10) != 0
    found = context_tree.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), train)
    return found.select(
        F.col("id").alias("doc_id"),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query("op5_suffix_repeats")
def suffix_repeats(spark, sf_dir):
    found = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "_row.doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# The vectors that take part, as whole numbers; products of these are exact in doubles.
WHOLE_SQL = r"""
  SELECT vec_id, {label}[floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL {told}
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"""

TOP_SQL = f"""
WITH whole AS ({WHOLE_SQL.format(label="", told="")}),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op11_max_score", TOP_SQL)
def max_score_search(spark, sf_dir):
    return max_score.top(table(spark, sf_dir, "embeddings"), lambda key: key % 50 == 0)


NEGATIVE_SQL = f"""
WITH whole AS ({WHOLE_SQL.format(
    label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, ", told="AND label IS NOT NULL")}),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM whole a JOIN whole c ON len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scores WHERE alike),
ranked AS (
  SELECT s.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY s.anchor_id, nth ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM scores s JOIN positives p ON s.anchor_id = p.anchor_id AND nth <= 5
  WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


@query("op12_hard_negatives", NEGATIVE_SQL)
def angular_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mined(vectors, lambda key: key % 100 == 0)


@query("op13_importance_draw")
def importance_draw(spark, sf_dir):
    drawn = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
