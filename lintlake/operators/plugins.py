"""User scans over the file table."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from lintlake.operators.issues import union_all
from lintlake.schema import ISSUE_COLUMNS, ISSUE_SCHEMA
from lintlake.session import cut
from lintlake.sources.files import CODE_EXTENSIONS, INSTALLED_IGNORES, walk_condition

log = logging.getLogger(__name__)

Scan = Callable[[DataFrame], DataFrame]
_scans: dict[str, Scan] = {}


def register_scan(name: str, scan: Scan) -> None:
    """Register a function from the file table to issue rows; the same name overwrites.

    A scan may use any DataFrame operation, also `pandas_udf` or `mapInPandas`. It returns at
    least `repo_id`, `file`, `severity`, `title`; other issue columns may be missing.
    """
    if name in _scans:
        log.warning("scan %r is already registered, overwriting", name)
    _scans[name] = scan


def unregister_scan(name: str) -> None:
    _scans.pop(name, None)


def registered_scans() -> list[str]:
    return list(_scans)


def plugin_files(files: DataFrame) -> DataFrame:
    return files.where(walk_condition(CODE_EXTENSIONS, default_ignores=INSTALLED_IGNORES))


def run_plugins(files: DataFrame, isolate: bool = False) -> DataFrame | None:
    """Issues of all registered scans, each under its own category `plugin:<name>`.

    A scan that fails to build its plan is logged and left out. With `isolate` each scan also runs
    here, into the checkpoint folder, so that a fault at run time stays with its scan too.
    """
    frames = []
    for place, (name, scan) in enumerate(_scans.items()):
        try:
            rows = scan(plugin_files(files))
            rows = _as_issues(rows, name, place)
            rows = cut(rows) if isolate else rows
        except Exception as fault:  # noqa: BLE001
            log.warning("scan %r failed: %s", name, fault)
            continue
        frames.append(rows)
    return union_all(frames) if frames else None


def _as_issues(rows: DataFrame, name: str, place: int) -> DataFrame:
    have = set(rows.columns)
    types = {f.name: f.dataType for f in StructType.fromDDL(ISSUE_SCHEMA)}
    out = []
    for c in ISSUE_COLUMNS:
        if c == "category":
            value = F.lit(f"plugin:{name}")
        elif c == "ord":
            zero = F.lit(0)
            value = F.struct(
                F.lit(100 + place).alias("cat"), zero.alias("phase"),
                F.col("file").alias("path"), zero.alias("grp"),
                (F.coalesce("line", zero) if "line" in have else zero).cast("int").alias("k1"),
                zero.alias("k2"),
            )
        elif c in have:
            value = F.col(c)
        elif c == "id":
            value = F.concat_ws(
                "-", F.concat(F.col("repo_id"), F.lit(f":plugin-{name}")), F.col("file"),
                *([F.col("line").cast("string")] if "line" in have else []),
            )
        else:
            value = F.lit(None)
        out.append(value.cast(types[c]).alias(c))
    return rows.select(*out)


def plugin_scores(files: DataFrame, issues: DataFrame, points: dict[str, float]) -> DataFrame:
    """Score per repository and plugin category: 100 less the given points per issue.

    Plugin scores stay beside the six categories and have no weight in the overall score.
    """
    cost = F.lit(0.0)
    for severity, value in points.items():
        cost = F.when(F.col("severity") == severity, value).otherwise(cost)
    names = F.array(*[F.lit(f"plugin:{n}") for n in _scans])
    spent = issues.groupBy("repo_id", "category").agg(F.sum(cost).alias("penalty"))
    grid = files.groupBy("repo_id").agg(F.count("*").alias("n")).select(
        "repo_id", F.explode(names).alias("category")
    )
    return grid.join(spent, ["repo_id", "category"], "left").select(
        "repo_id", "category",
        F.greatest(F.lit(0.0), 100 - F.coalesce("penalty", F.lit(0.0))).alias("score"),
    )
