"""File versions of a watch as append-only segments, and who points to them.

Every batch writes a segment: the contents it brought and the issues found in them. What is current
stands in a narrow state table, partitioned by a bucket of the repository: one row per file that
names the segment of its content, one row per repository with its last scan and score. A batch
rewrites the state of the buckets it touches, so the state is as large as what is watched, however
many batches there were, and contents are read by pointer only. A head names the state of every
bucket; writing it completes a batch, and a batch without one can run again.

When more than `max_segments` segments hold current rows, the smaller ones are merged into one and
the pointers moved. What neither of the last two heads names is deleted.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lintlake.schema import ISSUE_SCHEMA

CONTENT = "repo_id string, path string, content string, mtime timestamp"
SEGMENTS = {"versions": CONTENT, "file_issues": ISSUE_SCHEMA, "repo_issues": ISSUE_SCHEMA}
#: `seen` is the batch that brought the version; `outline` what scans of whole repositories read.
FILE_STATE = "repo_id string, path string, mtime timestamp, seen long, segment long, outline string"
REPO_STATE = "repo_id string, segment long, overall long, grade string"
HEAD = "bucket int, snapshot long, segment long, live long"


@dataclass(frozen=True)
class Head:
    """State of all buckets after a batch: which snapshot each has, and current rows by segment."""

    batch: int
    snapshots: dict[int, int]
    live: dict[tuple[int, int], int]  # (bucket, segment): rows that point there

    def segments(self, buckets: Iterable[int] | None = None) -> list[int]:
        wanted = None if buckets is None else set(buckets)
        return sorted({s for b, s in self.live if wanted is None or b in wanted})


EMPTY = Head(-1, {}, {})


@dataclass
class VersionStore:
    """Segments and state below `location`, a folder that all executors reach."""

    location: str
    buckets: int = 64
    max_segments: int = 16

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("repo_id"), F.lit(self.buckets)).cast("int")

    # ---- folders -----------------------------------------------------------------------------

    def _folder(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _ids(self, spark: SparkSession, name: str) -> list[int]:
        """Numbers of the folders `key=number` that were written to the end."""
        system, path = self._folder(spark, name)
        if not system.exists(path):
            return []
        done = lambda p: system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        found = [s.getPath() for s in system.listStatus(path) if "=" in s.getPath().getName()]
        return sorted(int(p.getName().split("=")[1]) for p in found if done(p))

    def _delete(self, spark: SparkSession, name: str) -> None:
        system, path = self._folder(spark, name)
        system.delete(path, True)

    # ---- segments ----------------------------------------------------------------------------

    def write_segment(self, frame: DataFrame, name: str, segment: int) -> None:
        frame.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(f"{self.location}/{name}/batch_id={segment}")

    def read_segments(
        self, spark: SparkSession, name: str, segments: Iterable[int],
        buckets: Iterable[int] | None = None,
    ) -> DataFrame:
        """Rows of the named segments with the number of theirs as `segment`; other folders are not
        looked at."""
        schema = SEGMENTS[name]
        folders = [f"{self.location}/{name}/batch_id={s}" for s in segments]
        if not folders:
            return spark.createDataFrame([], f"{schema}, segment long")
        rows = (
            spark.read.schema(f"{schema}, batch_id long, bucket int")
            .option("basePath", f"{self.location}/{name}").parquet(*folders)
        )
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(*buckets))
        return rows.drop("bucket").withColumnRenamed("batch_id", "segment")

    # ---- state -------------------------------------------------------------------------------

    def head(self, spark: SparkSession, upto: int | None = None) -> Head:
        """The state after the last completed batch, or the last one up to a batch."""
        done = [n for n in self._ids(spark, "heads") if upto is None or n <= upto]
        if not done:
            return EMPTY
        # At most `buckets` times `max_segments` and the segments of one batch more.
        rows = spark.read.schema(HEAD).parquet(f"{self.location}/heads/head={done[-1]}").collect()
        return Head(
            done[-1], {r.bucket: r.snapshot for r in rows}, {(r.bucket, r.segment): r.live for r in rows}
        )

    def is_done(self, spark: SparkSession, batch: int) -> bool:
        return batch in self._ids(spark, "heads")

    def _state(self, spark: SparkSession, name: str, schema: str, head: Head, buckets=None) -> DataFrame:
        wanted = head.snapshots if buckets is None else {
            b: head.snapshots[b] for b in buckets if b in head.snapshots
        }
        if not wanted:
            return spark.createDataFrame([], schema)
        folders = [f"{self.location}/{name}/snapshot={s}/bucket={b}" for b, s in sorted(wanted.items())]
        return spark.read.schema(schema).parquet(*folders)

    def file_state(self, spark: SparkSession, head: Head, buckets=None) -> DataFrame:
        return self._state(spark, "files", FILE_STATE, head, buckets)

    def repo_state(self, spark: SparkSession, head: Head, buckets=None) -> DataFrame:
        return self._state(spark, "repos", REPO_STATE, head, buckets)

    def write_state(self, frame: DataFrame, name: str, snapshot: int) -> None:
        # One file a bucket: the next batch reads whole buckets.
        frame.withColumn("bucket", self.bucket()).repartition("bucket").write.mode(
            "overwrite"
        ).partitionBy("bucket").parquet(f"{self.location}/{name}/snapshot={snapshot}")

    def commit(self, spark: SparkSession, base: Head, batch: int, snapshot: int, buckets: list[int]) -> Head:
        """Complete a batch: `buckets` have the given snapshot, the others what `base` has."""
        now = Head(batch, {**base.snapshots, **{b: snapshot for b in buckets}}, {})
        pointed = self.file_state(spark, now, buckets).select("repo_id", "segment").unionByName(
            self.repo_state(spark, now, buckets).select("repo_id", "segment")
        )
        counts = pointed.groupBy(self.bucket().alias("bucket"), "segment").agg(
            F.count("*").alias("live")
        ).collect()
        live = {k: n for k, n in base.live.items() if k[0] not in set(buckets)}
        live |= {(r.bucket, r.segment): r.live for r in counts}
        rows = [(b, now.snapshots[b], s, n) for (b, s), n in sorted(live.items())]
        spark.createDataFrame(rows, HEAD).coalesce(1).write.mode("overwrite").parquet(
            f"{self.location}/heads/head={batch}"
        )
        return Head(batch, now.snapshots, live)

    # ---- reading by pointer --------------------------------------------------------------------

    def contents(self, spark: SparkSession, head: Head, buckets=None, segments=None) -> DataFrame:
        """Current versions, read from the segments that hold any."""
        segments = head.segments(buckets) if segments is None else segments
        rows = self.read_segments(spark, "versions", segments, buckets)
        now = self.file_state(spark, head, buckets).select("repo_id", "path", "segment")
        return rows.join(now, ["repo_id", "path", "segment"], "left_semi").select(
            "repo_id", "path", "content", "mtime"
        )

    def file_issues(self, spark: SparkSession, head: Head, buckets=None, segments=None) -> DataFrame:
        """Issues of current versions."""
        segments = head.segments(buckets) if segments is None else segments
        now = self.file_state(spark, head, buckets).select(
            "repo_id", F.col("path").alias("file"), "segment"
        )
        rows = self.read_segments(spark, "file_issues", segments, buckets)
        return rows.join(now, ["repo_id", "file", "segment"], "left_semi").drop("segment")

    def repo_issues(self, spark: SparkSession, head: Head, buckets=None, segments=None) -> DataFrame:
        """Issues of each repository's last scan."""
        segments = head.segments(buckets) if segments is None else segments
        now = self.repo_state(spark, head, buckets).select("repo_id", "segment")
        rows = self.read_segments(spark, "repo_issues", segments, buckets)
        return rows.join(now, ["repo_id", "segment"], "left_semi").drop("segment")

    # ---- compaction ----------------------------------------------------------------------------

    def compact(self, spark: SparkSession, head: Head) -> Head:
        """Merge the smaller half of the segments into one if there are too many.

        The merged segment is at least as large as each of its parts, so a row is rewritten about as
        often as the number of segments can be halved. The number of a merged segment is negative.
        """
        rows: dict[int, int] = {}
        for (_, segment), n in head.live.items():
            rows[segment] = rows.get(segment, 0) + n
        if len(rows) <= self.max_segments:
            return head
        small = sorted(rows, key=lambda s: (rows[s], s))[: len(rows) - self.max_segments // 2]
        buckets = sorted({b for b, s in head.live if s in set(small)})
        merged = -head.batch - 1
        self.write_segment(self.contents(spark, head, buckets, small), "versions", merged)
        self.write_segment(self.file_issues(spark, head, buckets, small), "file_issues", merged)
        self.write_segment(self.repo_issues(spark, head, buckets, small), "repo_issues", merged)
        moved = F.when(F.col("segment").isin(*small), merged).otherwise(F.col("segment")).cast("long")
        self.write_state(
            self.file_state(spark, head, buckets).withColumn("segment", moved), "files", merged
        )
        self.write_state(
            self.repo_state(spark, head, buckets).withColumn("segment", moved), "repos", merged
        )
        return self.commit(spark, head, head.batch, merged, buckets)

    def vacuum(self, spark: SparkSession) -> None:
        """Delete heads before the last two, and segments and snapshots that those do not name."""
        heads = self._ids(spark, "heads")
        kept = [self.head(spark, n) for n in heads[-2:]]
        if not kept:
            return
        segments = {s for h in kept for s in h.segments()}
        snapshots = {s for h in kept for s in h.snapshots.values()}
        # What belongs to a batch after the last head is being written.
        old = lambda n: n <= kept[-1].batch and -n - 1 <= kept[-1].batch
        for n in heads[:-2]:
            self._delete(spark, f"heads/head={n}")
        for name in SEGMENTS:
            for n in self._ids(spark, name):
                if n not in segments and old(n):
                    self._delete(spark, f"{name}/batch_id={n}")
        for name in ("files", "repos"):
            for n in self._ids(spark, name):
                if n not in snapshots and old(n):
                    self._delete(spark, f"{name}/snapshot={n}")
