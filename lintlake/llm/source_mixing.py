"""Mixing of sources to target weights along a time-varying curriculum.

Every source has a target of words. Its weight over training time is a piecewise linear schedule;
the integral of the schedule is the share of the target that is due by a time. A document starts
where the words before it in its source end, in the order of digests of id and text; inverting the integral
turns that demand into a training position, and a range sort by position gives the training order.
Where a target exceeds its source, the source is gone through again.

Words before a document are a sum over BUCKETS ranges of digests and a running sum within one, so a
source that holds most rows is spread over as many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lintlake.llm._store import table

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in order, repeating
SHARE = 1.5  # of all words that the mix takes
REPEATS = 2.0  # times that a source may be gone through
#: Weight by training time, 0 to 1, for each of WEIGHTS; only the shape counts.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.7, 0.75), (1.0, 3.0)),
)
BUCKET_DIGITS = 3  # hex digits of a digest: 4096 buckets a source
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, source_size, nth, target): SHARE of all words by weight, at most REPEATS times the
    words of a source, and what a source cannot take shared among the others by weight.

    With sources by cap per weight, the level at which all words are given out is the largest of
    (words left after the caps before) / (weights from here on).
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    # One row a source: these windows are over a table of that length.
    named = sums.withColumn(
        "nth", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    ).withColumn("weight", weight).withColumn("cap", F.col("source_size") * REPEATS)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    given = named.withColumn(
        "level",
        (F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(rest),
    )
    return given.withColumn(
        "target", F.least("cap", F.col("weight") * F.max("level").over(whole))
    ).select("source", "source_size", "nth", "target")


def _inverse(schedule: Sequence[tuple[float, float]], due: Column) -> Column:
    """Time by which the share `due` of a schedule's integral is reached."""
    pieces = list(zip(schedule, schedule[1:]))
    area = sum((u1 - u0) * (a + b) / 2 for (u0, a), (u1, b) in pieces)
    done, out = 0.0, None
    for (u0, a), (u1, b) in pieces:
        slope = (b - a) / (u1 - u0)
        y = (due - done / area) * area
        root = F.sqrt(F.greatest(F.lit(a * a) + y * (2 * slope), F.lit(0.0)))
        time = F.when(root + a > 0, F.lit(u0) + 2 * y / (root + a)).otherwise(F.lit(u0))
        done += (u1 - u0) * (a + b) / 2
        reached = due <= done / area
        out = F.when(reached, time) if out is None else out.when(reached, time)
    return out.otherwise(F.lit(schedule[-1][0]))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, keep_columns: bool = False,
) -> DataFrame:
    """One row per row of `docs`: id, size (words), source_size, target (of its source), taken
    (words that the mix takes, repeats counted), position (when it is first trained on, 0 to 1; null
    if not taken) and again (when for the second time).

    Sources are ordered by code point, null last, and weigh `weights`, repeating. A source's last
    document may be taken in part, so that taken words add up to the rounded target. A null text has
    no words; documents without words are taken with none. Rows that repeat an id count each, and
    rows without id too: their texts tell them apart. Reruns agree: order depends on ids and texts
    alone, and rows equal in both are alike. Other columns are ignored or, with `keep_columns`, kept
    in front; of those, any that is named like a column added here is replaced.
    """
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws(" ", F.col(id_col).cast("string"), text_col)).alias("digest"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep_columns else []),
    )
    sized = sized.withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"),
    )
    targets = source_targets(sized, weights).withColumnRenamed("source", "s2")
    within = Window.partitionBy("source", "bucket").orderBy("digest", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    ).join(targets, F.col("source").eqNullSafe(F.col("s2")))
    start = F.col("offset") + F.col("ahead")
    budget = F.floor(F.col("target") + 0.5)
    passes = [
        F.least(F.greatest(budget - F.col("source_size") * k - start, F.lit(0)), F.col("size"))
        for k in range(int(REPEATS))
    ]

    def when(k: int) -> Column:
        due = (F.col("source_size") * k + start) / budget
        out = None
        for n, schedule in enumerate(schedules):
            hit = F.col("nth") % len(schedules) == n
            time = _inverse(schedule, due)
            out = F.when(hit, time) if out is None else out.when(hit, time)
        return F.when((passes[k] > 0) & (budget > 0), out)

    added = {
        "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"),
        "taken": sum(passes[1:], passes[0]).cast("long"), "position": when(0), "again": when(1),
    }
    front = [F.col("id").alias(id_col)]
    if keep_columns:
        front = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return placed.select(*front, *(c.alias(name) for name, c in added.items()))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mix in training order; what it does not take comes last."""
    return mix_sources(table(spark, sf_dir, "documents")).orderBy(
        F.asc_nulls_last("position"), "doc_id"
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(' ', CAST(doc_id AS VARCHAR), text)) AS digest
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, nth
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, nth, least(cap, weight * (SELECT max(level) FROM l)) AS target FROM l
), o AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d
), c AS (  -- the schedules, piece by piece: weight a at time u0, weight b at time u1
  SELECT kind, CAST(u0 AS DOUBLE) AS u0, CAST(a AS DOUBLE) AS a, CAST(u1 AS DOUBLE) AS u1, CAST(b AS DOUBLE) AS b
  FROM (VALUES (0, 0, 1.5, 0.5, 1), (0, 0.5, 1, 1, 0.5), (1, 0, 1, 1, 1),
               (2, 0, 0.25, 0.7, 0.75), (2, 0.7, 0.75, 1, 3)) v(kind, u0, a, u1, b)
), g AS (
  SELECT *, (u1 - u0) * (a + b) / 2 AS part, sum((u1 - u0) * (a + b) / 2) OVER (PARTITION BY kind) AS area,
         coalesce(sum((u1 - u0) * (a + b) / 2) OVER (
           PARTITION BY kind ORDER BY u0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM c
), p AS (
  SELECT kind, u0, a, (b - a) / (u1 - u0) AS slope, area, done / area AS past,
         CASE WHEN u0 = 0 THEN -1 ELSE done / area END AS above, (done + part) / area AS upto
  FROM g
), r AS (
  SELECT doc_id, size, source_size, target, nth,
         least(greatest(floor(target + 0.5) - start, 0), size) AS first_pass,
         least(greatest(floor(target + 0.5) - source_size - start, 0), size) AS second_pass,
         CAST(start AS DOUBLE) / floor(target + 0.5) AS due1,
         CAST(source_size + start AS DOUBLE) / floor(target + 0.5) AS due2
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(first_pass + second_pass AS BIGINT) AS taken,
       p1.u0 + (due1 - p1.past) * p1.area * 2
         / (sqrt(greatest(p1.a * p1.a + (due1 - p1.past) * p1.area * (2 * p1.slope), 0)) + p1.a) AS position,
       p2.u0 + (due2 - p2.past) * p2.area * 2
         / (sqrt(greatest(p2.a * p2.a + (due2 - p2.past) * p2.area * (2 * p2.slope), 0)) + p2.a) AS again
FROM r
LEFT JOIN p p1 ON first_pass > 0 AND p1.kind = nth % 3 AND due1 > p1.above AND due1 <= p1.upto
LEFT JOIN p p2 ON second_pass > 0 AND p2.kind = nth % 3 AND due2 > p2.above AND due2 <= p2.upto
"""
