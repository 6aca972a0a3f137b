"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_issues(issues: DataFrame, location: str, mode: str = "overwrite") -> None:
    """Issue table, one directory per category. Rows are rebalanced by category first: adaptive
    execution merges small categories into few files and splits large ones."""
    issues.hint("rebalance", "category").write.mode(mode).partitionBy("category").parquet(location)


def write_report_json(reports: DataFrame, location: str, mode: str = "overwrite") -> None:
    """One JSON line per repository. Keys and other secrets never enter the report frame; columns
    that look like one are dropped all the same."""
    secret = [c for c in reports.columns if c.lower() in ("apikey", "api_key", "token")]
    reports.drop(*secret).write.mode(mode).json(location)


def read_issues(spark, location: str) -> DataFrame:
    from lintlake.schema import ISSUE_COLUMNS, ISSUE_SCHEMA

    return spark.read.schema(ISSUE_SCHEMA).parquet(location).select(*map(F.col, ISSUE_COLUMNS))
