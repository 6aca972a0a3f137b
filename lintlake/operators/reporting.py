"""One Markdown text per repository, from the bounded tables of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.operators.ranking import SHOWN, hidden_counts, suggested_fixes, top_issues
from lintlake.operators.scoring import issue_totals
from lintlake.schema import CATEGORIES


def _joined(order: list[Column], line: Column) -> Column:
    """Lines of a group in order; every list here has a bound per repository."""
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return F.array_join(F.transform(rows, lambda r: r["_line"]), "\n")


def _place(category: Column) -> Column:
    """Categories in their fixed order; those of plugins come last, by name."""
    known = F.array(*map(F.lit, CATEGORIES))
    at = F.array_position(known, category)
    return F.when(at == 0, len(CATEGORIES) + 1).otherwise(at)


def markdown_reports(
    scores: DataFrame, sub_scores: DataFrame, issues: DataFrame, k: int = SHOWN["markdown"]
) -> DataFrame:
    """`(repo_id, report)`: overall score, score table, the first `k` issues of each category with
    how many are left out, and suggested fixes.

    The lists are cut by rank before they are gathered, so the text of a repository with any number
    of issues stays small.
    """
    place = _place(F.col("category")).alias("_place")
    cell = lambda *cols: F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |"))
    table = sub_scores.groupBy("repo_id").agg(
        _joined([place], cell("category", "score", "grade", "issue_count")).alias("table")
    )
    where = F.concat(
        F.coalesce("file", F.lit("")),
        F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")),
    )
    entry = F.concat(
        F.lit("- **"), F.col("severity"), F.lit("** "), F.col("title"), F.lit(" ("), where, F.lit(")")
    )
    shown = top_issues(issues, k).groupBy("repo_id", "category").agg(
        _joined([F.col("rank")], entry).alias("list")
    )
    hidden = hidden_counts(issue_totals(issues), k).select("repo_id", "category", "hidden")
    more = F.when(F.col("hidden").isNull(), "").otherwise(
        F.format_string("\n- and %d more", "hidden")
    )
    parts = shown.join(hidden, ["repo_id", "category"], "left").groupBy("repo_id").agg(
        _joined(
            [place, F.col("category")],
            F.concat(F.lit("\n### "), F.col("category"), F.lit("\n\n"), F.col("list"), more),
        ).alias("issues")
    )
    fix = F.concat(
        F.lit("- "), F.col("title"), F.lit(": "), F.coalesce("fix.description", F.lit(""))
    )
    fixes = suggested_fixes(issues).groupBy("repo_id").agg(
        _joined([place, F.col("category"), F.col("rank")], fix).alias("fixes")
    )
    section = lambda head, body: F.coalesce(
        F.concat(F.lit(f"\n\n## {head}\n"), F.col(body)), F.lit("")
    )
    return (
        scores.join(table, "repo_id").join(parts, "repo_id", "left").join(fixes, "repo_id", "left")
        .select(
            "repo_id",
            F.concat(
                F.format_string("# %s\n\nOverall: %d (%s)\n\n", "repo_id", "overall", "grade"),
                F.lit("| category | score | grade | issues |\n|---|---|---|---|\n"), F.col("table"),
                section("Issues", "issues"), section("Suggested fixes", "fixes"),
            ).alias("report"),
        )
    )
