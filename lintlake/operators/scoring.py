"""Scores, grades, summaries and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.functions.grades import js_round, score_to_grade
from lintlake.schema import AUDIT_WEIGHTS, CATEGORIES, PENALTIES

# Which fact counts the files a category scans.
SCANNED = {
    "quality": "n_code",
    "security": "n_secure",
    "performance": "n_code",
    "accessibility": "n_markup",
    "testing": "n_code",
    "architecture": "n_walked",
}


def penalty() -> Column:
    """Points of one issue by its category and severity."""
    out = F.lit(0.0)
    for category, points in PENALTIES.items():
        by_severity = F.lit(0.0)
        for name, value in points.items():
            by_severity = F.when(F.col("severity") == name, value).otherwise(by_severity)
        out = F.when(F.col("category") == category, by_severity).otherwise(out)
    return out


def issue_totals(issues: DataFrame) -> DataFrame:
    """Penalty and counts per repository and category; partial sums are taken map-side."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("repo_id", "category").agg(
        F.sum(penalty()).alias("penalty"),
        F.count("*").alias("issues"),
        *[count(s).alias(s) for s in ("critical", "high", "medium", "low", "info")],
        F.count_if(F.col("fix.automated")).alias("fixable"),
    )


def scan_results(
    facts: DataFrame,
    totals: DataFrame,
    coverage: DataFrame,
    categories: tuple[str, ...] = CATEGORIES,
) -> DataFrame:
    """Files scanned, issue counts and unrounded score per repository and category.

    Starts from the repositories, so one without issues keeps its full score.
    """
    grid = facts.select(
        "repo_id",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("category"), F.col(SCANNED[c]).alias("files_scanned"))
            for c in categories
        ])),
    )
    cat, files = F.col("category"), F.col("files_scanned")
    points = F.coalesce("penalty", F.lit(0.0))
    raw = (
        F.when((cat.isin("quality", "testing", "architecture")) & (files == 0), 100.0)
        .when(cat == "quality", 100 - points / F.greatest(files, F.lit(1)) * 2)
        .when(
            cat == "testing",
            F.least(F.lit(100.0), F.coalesce("coverage", F.lit(100)) * 1.2) - points * 0.3,
        )
        .otherwise(100 - points)
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        grid.join(totals, ["repo_id", "category"], "left")
        .join(coverage.select("repo_id", "coverage"), "repo_id", "left")
        .select(
            "repo_id", "category", "files_scanned",
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).alias("score"),
            *[zero(c) for c in
              ("issues", "critical", "high", "medium", "low", "info", "fixable")],
        )
    )


def category_score(results: DataFrame) -> DataFrame:
    return results.select("repo_id", "category", "files_scanned", "score")


def sub_scores(results: DataFrame) -> DataFrame:
    """Rounded score and grade per repository and category; a category not scanned gets 100."""
    done = results.select(
        "repo_id", "category",
        js_round(F.col("score")).alias("score"),
        score_to_grade(F.col("score")).alias("grade"),
        F.col("issues").alias("issue_count"),
        F.col("critical").alias("critical_count"),
        F.col("high").alias("high_count"),
    )
    grid = results.select("repo_id").distinct().select(
        "repo_id", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.join(done, ["repo_id", "category"], "left").select(
        "repo_id", "category",
        F.coalesce("score", F.lit(100)).alias("score"),
        F.coalesce("grade", F.lit("A+")).alias("grade"),
        zero("issue_count"), zero("critical_count"), zero("high_count"),
    )


def resolve_weights(
    overrides: DataFrame, repos: DataFrame, defaults: dict[str, float] = AUDIT_WEIGHTS
) -> DataFrame:
    """Weight per repository and category: the override if there is one, else the default."""
    grid = repos.select(
        "repo_id",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("category"), F.lit(w).alias("default_weight"))
            for c, w in defaults.items()
        ])),
    )
    return grid.join(overrides, ["repo_id", "category"], "left").select(
        "repo_id", "category", F.coalesce("weight", "default_weight").alias("weight")
    )


def overall_score(
    results: DataFrame,
    weights: dict[str, float] | DataFrame = AUDIT_WEIGHTS,
) -> DataFrame:
    """Weighted mean of the rounded scores of the scanned categories.

    Scores are pivoted to one row and added in the fixed category order, so the result does not
    depend on the order in which rows arrive.
    """
    rows = results.select("repo_id", "category", js_round(F.col("score")).alias("score"))
    if isinstance(weights, DataFrame):
        rows = rows.join(weights, ["repo_id", "category"])
        weight_of = lambda c: F.max(F.when(F.col("category") == c, F.col("weight")))
    else:
        weight_of = lambda c: F.max(
            F.when(F.col("category") == c, F.lit(weights.get(c, 0.0)))
        )
    wide = rows.groupBy("repo_id").agg(
        *[F.max(F.when(F.col("category") == c, F.col("score"))).alias(f"s_{c}")
          for c in CATEGORIES],
        *[weight_of(c).alias(f"w_{c}") for c in CATEGORIES],
    )
    weighted, total = F.lit(0.0), F.lit(0.0)
    for c in CATEGORIES:
        scanned = F.col(f"s_{c}").isNotNull()
        weighted = weighted + F.when(scanned, F.col(f"s_{c}") * F.col(f"w_{c}")).otherwise(0.0)
        total = total + F.when(scanned, F.col(f"w_{c}")).otherwise(0.0)
    overall = F.when(total > 0, js_round(weighted / total)).otherwise(0)
    return wide.select("repo_id", overall.alias("overall")).withColumn(
        "grade", score_to_grade(F.col("overall"))
    )


def audit_summary(results: DataFrame) -> DataFrame:
    """Totals per repository. A file counts once per scanner that reads it."""
    total = lambda c, name: F.sum(c).alias(name)
    return results.groupBy("repo_id").agg(
        total("files_scanned", "total_files"),
        total("issues", "total_issues"),
        total("critical", "critical_issues"),
        total("high", "high_issues"),
        total("medium", "medium_issues"),
        total("low", "low_issues"),
        total("info", "info_issues"),
        F.map_from_entries(
            F.collect_list(F.struct("category", "issues"))  # one entry per category
        ).alias("categories"),
    )


def severity_rollup(issues: DataFrame) -> DataFrame:
    """Counts per category and severity with subtotals (NULL marks a total)."""
    return issues.rollup("category", "severity").agg(F.count("*").alias("n"))


def plugin_results(totals: DataFrame) -> DataFrame:
    """Rows for the summary and the gate from the totals of plugin categories: their issues count,
    their files and scores do not."""
    return totals.where(F.col("category").startswith("plugin:")).select(
        "repo_id", "category", F.lit(0).cast("bigint").alias("files_scanned"),
        F.lit(None).cast("double").alias("score"),
        "issues", "critical", "high", "medium", "low", "info", "fixable",
    )


def gate(results: DataFrame) -> DataFrame:
    """Failure flags: a full audit fails on any critical issue, one scanner on critical or high."""
    return results.groupBy("repo_id").agg(
        F.bool_or(F.col("critical") > 0).alias("audit_fails"),
        F.bool_or((F.col("critical") > 0) | (F.col("high") > 0)).alias("scanner_fails"),
    )


def fixable_count(results: DataFrame) -> DataFrame:
    return results.groupBy("repo_id").agg(F.sum("fixable").alias("fixable"))


def score_trend(scores: DataFrame) -> DataFrame:
    """Direction of the overall score against the previous run of the repository."""
    before = F.lag("overall").over(Window.partitionBy("repo_id").orderBy("run_ts"))
    now = F.col("overall")
    return scores.select(
        "repo_id", "run_ts", "overall",
        F.when(before.isNull() | (now == before), "stable")
        .when(now > before, "improving").otherwise("declining").alias("trend"),
    )
