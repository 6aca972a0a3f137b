"""Dependencies against an advisory table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lintlake.functions.versions import KEY_TYPE, package_name, range_keys, version_key
from lintlake.operators.joins import lookup_join
from lintlake.schema import FIX_TYPE, ISSUE_COLUMNS, ORD_TYPE

ADVISORY_SCHEMA = (
    "name string, introduced string, fixed string, severity string, title string, url string, "
    "fix_available boolean"
)


def match_advisories(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies of which a lowest allowed version lies in `[introduced, fixed)`; an empty bound
    is open.

    A range without a number (`*`, `latest`, a URL) matches only advisories without bounds. An
    `npm:` alias is looked up under the name of the package that it stands for.
    """
    ranged = advisories.select(
        "*",
        version_key(F.col("introduced")).alias("_from"),
        version_key(F.col("fixed")).alias("_to"),
    )
    inside = lambda v: (F.col("_from").isNull() | (v >= F.col("_from"))) & (
        F.col("_to").isNull() | (v < F.col("_to"))
    )
    hit = (F.col("_from").isNull() & F.col("_to").isNull()) | F.exists("_versions", inside)
    keyed = deps.select(
        *[c for c in deps.columns if c != "name"],
        package_name(F.col("name"), F.col("range")).alias("name"),
        F.coalesce(range_keys(F.col("range")), F.array().cast(f"array<{KEY_TYPE}>"))
        .alias("_versions"),
    )
    return lookup_join(keyed, ranged, "name", hit).drop("_from", "_to", "_versions")


def advisory_join(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Issues of vulnerable dependencies."""
    severity = F.when(F.col("severity") == "moderate", "medium").when(
        F.col("severity").isin("critical", "high", "low", "info"), F.col("severity")
    ).otherwise("medium")
    columns = {
        "id": F.concat(F.col("repo_id"), F.lit(":security-npm-"), F.col("name")),
        "repo_id": F.col("repo_id"),
        "category": F.lit("security"),
        "severity": severity,
        "title": F.concat(F.lit("Vulnerable Dependency: "), F.col("name")),
        "description": F.coalesce(
            "title", F.concat(F.lit("Security vulnerability in "), F.col("name"))
        ),
        "file": F.lit("package.json"),
        "line": F.lit(None).cast("int"),
        "rule": F.lit("npm-audit"),
        "fix": F.struct(
            F.when(F.col("fix_available"), "Run: npm audit fix")
            .otherwise("Update or replace the dependency manually").alias("description"),
            F.lit(None).cast("string").alias("before"),
            F.lit(None).cast("string").alias("after"),
            F.coalesce("fix_available", F.lit(False)).alias("automated"),
        ).cast(FIX_TYPE),
        "tags": F.array(F.lit("dependency"), F.lit("npm-audit")),
        "effort": F.lit("easy"),
        "impact": F.lit("high"),
        "references": F.when(F.col("url").isNotNull(), F.array("url")).otherwise(
            F.array().cast("array<string>")
        ),
        "ord": F.struct(
            F.lit(1).alias("cat"), F.lit(1).alias("phase"), F.col("name").alias("path"),
            F.lit(0).alias("grp"), F.lit(0).alias("k1"), F.lit(0).alias("k2"),
        ).cast(ORD_TYPE),
    }
    return match_advisories(deps, advisories).select(
        *[columns[c].alias(c) for c in ISSUE_COLUMNS]
    )
