"""Watching repositories: file versions as a stream, issues and scores kept up to date."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lintlake.functions.text import ecma
from lintlake.operators.fixes import apply_fixes, build_fix_plan
from lintlake.operators.issues import render, union_all
from lintlake.operators.rules import Options
from lintlake.plans.auditing import file_issues, repo_issues, score_audit, text_evidence
from lintlake.schema import CATEGORIES, FILES_SCHEMA
from lintlake.sources.files import RELATIVE_IMPORT
from lintlake.streaming.store import Head, VersionStore

SETTLE = "300 milliseconds"  # fixed value: quiet time before a change counts
BUCKETS = 64


def stream_files(
    spark: SparkSession, location: str, fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """File versions as they arrive."""
    reader = spark.readStream.format(fmt).schema(FILES_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(location)


def debounce(
    stream: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Give `emit` the last version of every file that changed since the last trigger.

    Changes settle by arrival, not by their own times: the trigger waits `SETTLE`, and what came in
    meanwhile counts once. There is no watermark, so a repository that lags behind, a backfill or a
    copy with old times loses nothing, and nothing is held back at the end. An old version may
    follow a newer one in a later batch; `latest_versions` over both settles that by time.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, n: emit(latest_versions(batch), n))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": SETTLE}))
        .start()
    )


def stream_issues(
    stream: DataFrame,
    categories: tuple[str, ...] = CATEGORIES,
    options: Options = Options(),
    packs: tuple[str, ...] = (),
) -> DataFrame:
    """Issues of the line and file rules on changed files; a stateless map, no shuffle."""
    return render(union_all(text_evidence(stream, categories, options, packs)))


def match_changed(issues: DataFrame, changed: DataFrame) -> DataFrame:
    """Issues of changed files, by exact path."""
    keys = changed.select("repo_id", F.col("path").alias("file"))
    return issues.join(keys, ["repo_id", "file"], "left_semi")


def latest_versions(versions: DataFrame, *order: str) -> DataFrame:
    """Newest row per file; one row per file and map task is shuffled. Of versions with the same
    time the greater text counts, so that a repeated batch gives the same rows."""
    rest = [c for c in versions.columns if c not in ("repo_id", "path")]
    order = order or ("mtime", "content")
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("v")
    return versions.groupBy("repo_id", "path").agg(newest).select("repo_id", "path", "v.*")


def outline() -> Column:
    """What scans of whole repositories read of a text: a root manifest as it is, of other files
    the relative import specifiers. `repo_issues` and scores are the same on it as on the text."""
    specifiers = F.regexp_extract_all("content", F.lit(ecma(RELATIVE_IMPORT)), 0)
    return F.when(F.col("path") == "package.json", F.col("content")).otherwise(
        F.array_join(F.when(F.contains("content", F.lit("from")), specifiers), "\n")
    )


@dataclass
class Refresh:
    """State of a watch below one folder, fed by `foreachBatch`.

    A batch reads its own files, and of the repositories it touches the narrow state and the issues
    of current versions; older contents are never read again. It writes its own folders and a head
    at the end, so a batch that was lost half way can run again, and one whose head is there is done.
    """

    location: str
    options: Options = field(default_factory=Options)
    advisories: DataFrame | None = None
    buckets: int = BUCKETS
    max_segments: int = 16

    @property
    def store(self) -> VersionStore:
        return VersionStore(self.location, self.buckets, self.max_segments)

    def files(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """Newest version of every file."""
        store = self.store
        return store.contents(spark, store.head(spark, upto))

    def issues(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """Issues of the newest file versions and of the newest scan of each repository."""
        store = self.store
        head = store.head(spark, upto)
        return store.file_issues(spark, head).unionByName(store.repo_issues(spark, head))

    def scores(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """Newest score of every repository."""
        store = self.store
        return store.repo_state(spark, store.head(spark, upto)).drop("segment")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # A stream turns adaptive execution off in its session. The work below is plain batch work
        # and wants it, for merged partitions and split hot keys; the stream gets its setting back.
        spark = batch.sparkSession
        adaptive = "spark.sql.adaptive.enabled"
        before = spark.conf.get(adaptive)
        spark.conf.set(adaptive, "true")
        try:
            if not self.store.is_done(spark, batch_id):
                self._refresh(spark, batch, batch_id)
        finally:
            spark.conf.set(adaptive, before)

    def _refresh(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        store = self.store
        base = store.head(spark, batch_id)
        store.write_segment(latest_versions(batch), "versions", batch_id)
        changed = store.read_segments(spark, "versions", [batch_id])
        touched = [r[0] for r in changed.select(store.bucket()).distinct().collect()]  # <= buckets
        if not touched:
            return
        store.write_segment(file_issues(changed, options=self.options), "file_issues", batch_id)

        # Pointers of the touched buckets: of two versions of a file the later time counts.
        fresh = changed.select(
            "repo_id", "path", "mtime", F.lit(batch_id).cast("long").alias("seen"), "segment",
            outline().alias("outline"),
        )
        known = store.file_state(spark, base, touched)
        store.write_state(latest_versions(known.unionByName(fresh), "mtime", "seen"), "files", batch_id)
        now = Head(batch_id, {**base.snapshots, **{b: batch_id for b in touched}}, {})
        pointers = store.file_state(spark, now, touched)
        repos = changed.select("repo_id").distinct()
        current = pointers.join(repos, "repo_id", "left_semi").select(
            "repo_id", "path", F.col("outline").alias("content"), "mtime"
        )
        whole = repo_issues(current, options=self.options, advisories=self.advisories)
        store.write_segment(whole, "repo_issues", batch_id)

        live = sorted({*base.segments(touched), batch_id})
        own = store.file_issues(spark, now, touched, live).join(repos, "repo_id", "left_semi")
        whole = store.read_segments(spark, "repo_issues", [batch_id]).drop("segment")
        scores = score_audit(current, own.unionByName(whole), options=self.options).scores
        rest = store.repo_state(spark, base, touched).join(repos, "repo_id", "left_anti")
        store.write_state(
            rest.unionByName(scores.select(
                "repo_id", F.lit(batch_id).cast("long").alias("segment"), "overall", "grade"
            )),
            "repos", batch_id,
        )
        # A version that came late and is not the current one is not fixed.
        newest = pointers.where(F.col("segment") == batch_id).select("repo_id", "path")
        edited = changed.join(newest, ["repo_id", "path"], "left_semi")
        plan = build_fix_plan(match_changed(own, newest), edited)
        store.write_segment(apply_fixes(edited, plan), "fixed", batch_id)
        store.compact(spark, store.commit(spark, base, batch_id, batch_id, touched))
        store.vacuum(spark)


def stream_refresh(
    stream: DataFrame, refresh: Refresh, checkpoint: str, **trigger
) -> StreamingQuery:
    """Keep issues, scores and fixed versions up to date with a stream of file versions."""
    return debounce(stream, refresh, checkpoint, **(trigger or {"availableNow": True}))
