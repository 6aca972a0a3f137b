"""Exact top-k search by distributed histogram selection.

Queries and candidates are dealt into blocks and every pair of blocks is scored in one task, as a
matrix product. First each task counts, for each query, its scores in BINS bins of the range that
the norms allow; the counts are added up, and the bin that holds the k-th best score becomes the
next range, until it is one value. Then only scores at or above that value leave their tasks, ties
by id, and at most k of a task can matter. Memory is bounded by the block sizes, and what is
shuffled between passes are at most k bins of each query and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lintlake.llm._store import keep, table

BINS = 1024
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
STEP = 256  # queries scored at a time
LARGEST = 2.0**62  # of a component and of a product
EXACT = 1 << 53  # products up to here are exact in doubles


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _scores(queries: np.ndarray, candidates: np.ndarray):
    """Integer inner products of all queries with all candidates, STEP queries at a time."""
    width = queries.shape[1] if queries.size else 0
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * width
    kind = np.float64 if bound < EXACT else np.int64
    side = candidates.astype(kind).T
    for at in range(0, len(queries), STEP):
        yield at, (queries[at:at + STEP].astype(kind) @ side).astype(np.int64)


def _by_query(left: pa.Table, right: pa.Table):
    """(query id, its low and width, scores, candidate ids without its own) of one pair of blocks."""
    if not left.num_rows or not right.num_rows:
        return
    ids = right.column("id").to_numpy()
    names, low, width = (left.column(c).to_numpy() for c in ("id", "low", "width"))
    for at, block in _scores(_rows(left.column("v")), _rows(right.column("v"))):
        for k, scores in enumerate(block):
            yield names[at + k], low[at + k], width[at + k], scores, ids


def _histogram(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        for name, low, width, scores, ids in _by_query(left, right):
            part = scores[(scores >= low) & (ids != name)]
            # What lies above the range stays counted in one bin on top.
            bins = np.minimum((part - low) // width, BINS)
            counts = np.bincount(bins, minlength=BINS + 1)
            full = np.flatnonzero(counts)[::-1]
            # The k-th score of all blocks is no lower than that of this one.
            need = int(np.searchsorted(np.cumsum(counts[full]), k)) + 1
            full = full[:need]
            out[0].append(np.full(len(full), name))
            out[1].append(full)
            out[2].append(counts[full])
        return pa.table({
            n: pa.array(np.concatenate(x) if x else [], pa.int64())
            for n, x in zip(("id", "bin", "n"), out)
        })

    return run


def _select(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        for name, low, _, scores, ids in _by_query(left, right):
            at = np.flatnonzero((scores >= low) & (ids != name))
            at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            out[0].append(np.full(len(at), name))
            out[1].append(ids[at])
            out[2].append(scores[at])
        return pa.table({
            n: pa.array(np.concatenate(x) if x else [], pa.int64())
            for n, x in zip(("query_id", "vec_id", "score"), out)
        })

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest inner product for each query.

    `vectors` has id (long) and v (array of long). Rows where `is_query` holds are queries; all rows
    but the query's own are candidates. Ties go to the smaller id. Vectors of different lengths have
    no product and do not meet. Rows without id or vector take no part; of rows that repeat an id
    the least vector counts. A query with fewer candidates has them all. An empty table gives an
    empty one. Products are whole numbers below 2**62.
    """
    rows = vectors.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    rows = keep(
        rows.withColumn("norm", F.sqrt(F.aggregate(
            "v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
        ))).withColumn("query", F.coalesce(is_query, F.lit(False))),
        "vectors",
    )
    size = rows.agg(
        F.count("*").alias("rows"), F.count_if("query").alias("queries"), F.max("norm").alias("most")
    ).first()
    across, down = -(-size["rows"] // CANDIDATE_BLOCK), -(-size["queries"] // QUERY_BLOCK)
    blocks = lambda n: F.sequence(F.lit(0), F.lit(max(n, 1) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(max(n, 1))).cast("int")
    candidates = rows.select(
        "id", "v", F.size("v").alias("len"), dealt(across).alias("c"), F.explode(blocks(down)).alias("q")
    )
    # No product is larger than that of the norms, so the first range holds all scores.
    reach = F.ceil(F.least(F.col("norm") * float(size["most"] or 0.0) + 1, F.lit(LARGEST))).cast("long")
    ranges = rows.where("query").select(
        "id", "v", F.size("v").alias("len"), (-reach).alias("low"),
        F.ceil(reach / (BINS // 2) + 1).cast("long").alias("width"), F.lit(0).cast("long").alias("over"),
    )
    ranges = keep(ranges, "ranges")

    def scored(bounds: DataFrame, run, schema: str) -> DataFrame:
        left = bounds.select(
            "id", "v", "len", "low", "width", dealt(down).alias("q"),
            F.explode(blocks(across)).alias("c"),
        )
        return left.groupBy("len", "q", "c").cogroup(
            candidates.groupBy("len", "q", "c")
        ).applyInArrow(run, schema)

    for _ in range(8):  # every pass divides the width by BINS; 64 bits take seven
        counts = scored(ranges, _histogram(k), "id long, bin long, n long").groupBy("id", "bin").agg(
            F.sum("n").alias("n")
        )
        # With fewer than k candidates the lowest bin is taken, which keeps them all.
        down_to = Window.partitionBy("id").orderBy(F.desc("bin"))
        kth = counts.withColumn("above", F.sum("n").over(down_to)).groupBy("id").agg(
            F.coalesce(F.max(F.when(F.col("above") >= k, F.col("bin"))), F.lit(0)).alias("bin")
        )
        ranges = keep(
            ranges.join(kth, "id", "left").select(
                "id", "v", "len",
                F.when(F.col("bin") < BINS, F.col("low") + F.col("bin") * F.col("width"))
                .otherwise(F.col("low")).alias("low"),
                F.ceil(F.col("width") / BINS).cast("long").alias("width"),
                F.when(F.col("width") > 1, 1).otherwise(0).cast("long").alias("over"),
            ),
            "ranges",
        )
        if not ranges.where("over > 0").limit(1).count():
            break
    best = scored(ranges, _select(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vectors = rows.where(F.forall("embedding", finite)).select(
        F.col("vec_id").cast("long").alias("id"),
        F.transform("embedding", lambda x: F.floor(
            F.greatest(F.least(x.cast("double") * 64, F.lit(LARGEST)), F.lit(-LARGEST))
        ).cast("long")).alias("v"),
    )
    return top_k(vectors, F.col("id") % 20 == 0, k=20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.c) = len(v.c)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
