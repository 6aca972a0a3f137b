"""Ranked lists and report tables.

Every list is a ranked filter: Spark keeps at most k rows per group and map task before it
shuffles, so a repository with a third of all issues does not reach one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.functions.grades import severity_rank

# Issues shown per category and report.
SHOWN = {"markdown": 30, "html": 50, "pdf": 25, "terminal": 20}
SUGGESTED = 5
CRITICALS = 5
PROMPT_ISSUES = 20


def top_k(frame: DataFrame, keys: tuple[str, ...], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("rank", rank).where(F.col("rank") <= k)


def by_severity() -> list[Column]:
    """Stable order of a report: severity first, then the order in which issues were emitted."""
    return [severity_rank(F.col("severity")), *in_order()]


def in_order() -> list[Column]:
    return [F.col("ord"), F.col("id"), F.col("description")]


def top_issues(issues: DataFrame, k: int = SHOWN["markdown"]) -> DataFrame:
    return top_k(issues, ("repo_id", "category"), by_severity(), k)


def hidden_counts(totals: DataFrame, k: int = SHOWN["markdown"]) -> DataFrame:
    """How many issues a report of k per category leaves out (`totals`: `issue_totals`)."""
    return totals.where(F.col("issues") > k).select(
        "repo_id", "category", F.lit(k).alias("shown"), F.col("issues").alias("total"),
        (F.col("issues") - k).alias("hidden"),
    )


def suggested_fixes(issues: DataFrame, k: int = SUGGESTED) -> DataFrame:
    """First critical and high issues with a fix per category."""
    serious = issues.where(F.col("severity").isin("critical", "high") & F.col("fix").isNotNull())
    return top_k(serious, ("repo_id", "category"), by_severity(), k)


def critical_list(issues: DataFrame, k: int = CRITICALS) -> DataFrame:
    return top_k(issues.where(F.col("severity") == "critical"), ("repo_id",), in_order(), k)


def category_table(scores: DataFrame) -> DataFrame:
    """The score table of every report (`scores`: `sub_scores`)."""
    return scores.select(
        "repo_id", "category", "score", "grade",
        F.col("issue_count").alias("issues"), F.col("critical_count").alias("critical"),
    )
