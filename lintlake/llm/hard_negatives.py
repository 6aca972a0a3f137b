"""Hard negatives with score bounds handed down a spanning tree of the anchors.

Anchors are dealt into groups of about ANCHOR_BLOCK, and each group gets a minimum spanning tree
under Euclidean distance. Every group meets every block of candidates in one task. There the root's
scores are computed; for a child anchor c of parent p and a candidate x, <c, x> differs from <p, x>
by at most |c - p| |x|, so each candidate has an interval for its score before any product is taken.
Only candidates whose interval can still matter are scored: for positives those that may be among
the best of their label, for negatives those whose interval meets a window below a positive's score.
A candidate that is not scored hands its wider interval on to the children, so results are exact.

A task gives at most a few rows for each anchor; the best of all blocks are chosen by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lintlake.llm._store import keep, table

ANCHOR_BLOCK, CANDIDATE_BLOCK = 512, 8192
LARGEST = 2.0**62  # of a component
EXACT = 1 << 53  # products up to here are exact in doubles
SLACK = 1e-9  # of a bound, for the rounding of square roots


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _tree(group: pa.Table) -> pa.Table:
    """Prim's spanning tree of one group of anchors: place in its order, parent's place, and edge.

    Edges are in units of doubles; the row of the least id is the root (parent -1).
    """
    group = group.sort_by("id")
    points = _matrix(group.column("v")).astype(np.float64)
    n = len(points)
    place, parent, edge = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n)
    near, via = np.full(n, np.inf), np.zeros(n, np.int32)
    waiting = np.ones(n, bool)
    at = 0
    for step in range(n):
        waiting[at] = False
        place[at] = step
        if step:
            parent[at], edge[at] = place[via[at]], near[at]
        away = np.sqrt(((points - points[at]) ** 2).sum(1))
        closer = waiting & (away < near)
        near[closer], via[closer] = away[closer], at
        at = int(np.argmin(np.where(waiting, near, np.inf)))
    out = group.select(["id", "label", "v", "len", "g"])
    for name, values in (("place", place), ("parent", parent), ("edge", edge)):
        out = out.append_column(name, pa.array(values))
    return out


class _Block:
    """A block of candidates, and what is known of their scores at each anchor of a group."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table) -> None:
        anchors = anchors.sort_by("place")
        vectors, points = _matrix(candidates.column("v")), _matrix(anchors.column("v"))
        bound = int(np.abs(vectors).max(initial=0)) * int(np.abs(points).max(initial=0)) * vectors.shape[1]
        kind = np.float64 if bound < EXACT else np.int64
        self.vectors, self.points = vectors.astype(kind), points.astype(kind)
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        self.ids = candidates.column("id").to_numpy()
        self.labels = candidates.column("label").to_numpy()
        self.anchors = anchors
        self.scored = 0  # products taken

    def walk(self, wanted):
        """Every anchor in tree order, with the candidates that `wanted` asks for and their scores.

        `wanted(k, low, high)` takes the bounds of all candidates at anchor k and gives a mask.
        """
        parents = self.anchors.column("parent").to_numpy()
        edges = self.anchors.column("edge").to_numpy()
        children = np.bincount(parents[parents >= 0], minlength=len(parents))
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, (parent, edge) in enumerate(zip(parents, edges)):
            most = np.sqrt((self.points[k].astype(np.float64) ** 2).sum()) * self.norms * (1 + SLACK) + 1
            low, high = -most, most
            if parent >= 0:
                reach = edge * self.norms * (1 + SLACK) + SLACK * most + SLACK
                above = known[parent]
                low, high = np.maximum(low, above[0] - reach), np.minimum(high, above[1] + reach)
                children[parent] -= 1
                if not children[parent]:
                    del known[parent]
            mask = wanted(k, low, high) if parent >= 0 else np.ones(len(low), bool)
            at = np.flatnonzero(mask)
            scores = (self.vectors[at] @ self.points[k]).astype(np.int64)
            self.scored += len(at)
            if children[k]:
                low, high = low.copy(), high.copy()
                # Beyond 2**53 a double is off by less than this slack, which bounds take anyway.
                low[at] = scores - np.abs(scores) * SLACK
                high[at] = scores + np.abs(scores) * SLACK
                known[k] = (low, high)
            yield k, at, scores


def _best(at: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids[at], -scores))[:k]


def _least_of_best(low: np.ndarray, k: int) -> float:
    """The k-th largest lower bound: no score below it is among the best k."""
    return np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf


def _written(columns: list[list], names: tuple[str, ...]) -> pa.Table:
    return pa.table({
        n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(names, columns)
    })


def _positives(k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if anchors.num_rows and candidates.num_rows:
            block = _Block(anchors, candidates)
            names = block.anchors.column("id").to_numpy()
            labels = block.anchors.column("label").to_numpy()
            same = lambda i: (block.labels == labels[i]) & (block.ids != names[i])

            def wanted(i, low, high):
                mask = same(i)
                return mask & (high >= _least_of_best(low[mask], k))

            for i, at, scores in block.walk(wanted):
                own = same(i)[at]
                at, scores = at[own], scores[own]
                best = _best(at, scores, block.ids, k)
                out[0].append(np.full(len(best), names[i]))
                out[1].append(block.ids[at[best]])
                out[2].append(scores[best])
        return _written(out, ("anchor_id", "positive_id", "positive_score"))

    return run


def _negatives(k: int, low_percent: int, high_percent: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if anchors.num_rows and candidates.num_rows:
            block = _Block(anchors, candidates)
            names = block.anchors.column("id").to_numpy()
            labels = block.anchors.column("label").to_numpy()
            windows = [
                [(p, -(-low_percent * p // 100), high_percent * p // 100) for p in sorted(set(found or ()))]
                for found in block.anchors.column("found").to_pylist()
            ]

            def wanted(i, low, high):
                other = block.labels != labels[i]
                mask = np.zeros(len(low), bool)
                for _, least, most in windows[i]:
                    meets = other & (high >= least) & (low <= most)
                    inside = meets & (low >= least) & (high <= most)
                    mask |= meets & (high >= _least_of_best(low[inside], k))
                return mask

            for i, at, scores in block.walk(wanted):
                other = block.labels[at] != labels[i]
                for p, least, most in windows[i]:
                    held = np.flatnonzero(other & (scores >= least) & (scores <= most))
                    best = held[_best(at[held], scores[held], block.ids, k)]
                    out[0].append(np.full(len(best), names[i]))
                    out[1].append(np.full(len(best), p))
                    out[2].append(block.ids[at[best]])
                    out[3].append(scores[best])
        return _written(out, ("anchor_id", "positive_score", "negative_id", "negative_score"))

    return run


def hard_negatives(
    vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5,
    low_percent: int = 80, high_percent: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` has id (long), label (int) and v (array of long); `is_anchor` is a condition on them. An
    anchor's positives are its best `positives` other rows of its label by inner product; a positive's
    negatives are the best `negatives` rows of other labels whose score is from low_percent to
    high_percent of the positive's. Ties go to the smaller id. Fewer are all; a positive without a
    negative has no row, so positives below 0 have none (the window is empty).

    Rows without id, label or vector take no part; of rows that repeat an id the least (label,
    vector) counts. Vectors of different lengths have no product and do not meet. Other columns are
    ignored. An empty table gives an empty one. Products are whole numbers below 2**62.
    """
    rows = vectors.where("id is not null and label is not null and v is not null").groupBy("id").agg(
        F.min(F.struct(F.col("label").cast("long").alias("label"), "v")).alias("r")
    ).select("id", "r.label", "r.v", F.size("r.v").alias("len"))
    rows = keep(rows.withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "vectors")
    size = rows.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    across = max(1, -(-size["rows"] // CANDIDATE_BLOCK))
    groups = max(1, -(-size["anchors"] // ANCHOR_BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tree = keep(
        rows.where("anchor").select("id", "label", "v", "len", dealt(groups).alias("g"))
        .groupBy("len", "g").applyInArrow(
            _tree, "id long, label long, v array<long>, len int, g int, place int, parent int, edge double"
        ),
        "anchor-tree",
    )
    candidates = rows.select(
        "id", "label", "v", "len", dealt(across).alias("c"), blocks(groups).alias("g")
    )

    def scored(anchors: DataFrame, run, schema: str) -> DataFrame:
        left = anchors.select("*", blocks(across).alias("c"))
        return left.groupBy("len", "g", "c").cogroup(
            candidates.groupBy("len", "g", "c")
        ).applyInArrow(run, schema)

    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = keep(
        scored(tree, _positives(positives), "anchor_id long, positive_id long, positive_score long")
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"),
        "positives",
    )
    scores = found.groupBy(F.col("anchor_id").alias("id")).agg(  # at most `positives` of them
        F.collect_set("positive_score").alias("found")
    )
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    best = scored(
        tree.join(scores, "id", "left"), _negatives(negatives, low_percent, high_percent),
        "anchor_id long, positive_score long, negative_id long, negative_score long",
    ).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.join(best, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    label = F.col("label").cast("long")
    vectors = rows.where(F.forall("embedding", finite)).select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(
            F.greatest(F.least(x.cast("double") * 256, F.lit(LARGEST)), F.lit(-LARGEST))
        ).cast("long")).alias("v"),
    )
    return hard_negatives(vectors, F.col("id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
         CAST(list_dot_product(CAST(a.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.c) = len(v.c)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
WHERE rank <= 5
"""
