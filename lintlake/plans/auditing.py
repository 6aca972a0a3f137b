"""Full audits and single scanners."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.operators import (
    accessibility, architecture, frameworks, performance, quality, security, testing,
)
from lintlake.operators.advisories import advisory_join
from lintlake.operators.catalogue import INDEX
from lintlake.operators.facts import repo_facts
from lintlake.operators.fused import fused_evidence
from lintlake.operators.graph import import_cycles
from lintlake.operators.issues import render, union_all
from lintlake.operators.plugins import run_plugins
from lintlake.operators.rules import (
    FileRule, LineRule, Options, apply_file_rules, apply_line_rules,
)
from lintlake.operators.scoring import (
    audit_summary, gate, issue_totals, overall_score, plugin_results, resolve_weights, scan_results,
    sub_scores,
)
from lintlake.operators.stack import detect_stack
from lintlake.schema import AUDIT_WEIGHTS, CATEGORIES
from lintlake.sources.files import extract_deps, parse_manifest
from lintlake.sources.sinks import read_issues, write_issues, write_report_json

REPORT_VERSION = "1"  # of the report rows of this library

LINE_RULES = {
    "quality": quality.LINE_RULES,
    "security": security.LINE_RULES,
    "performance": performance.LINE_RULES,
    "accessibility": accessibility.LINE_RULES,
}
FILE_RULES = {
    "quality": quality.FILE_RULES,
    "security": security.FILE_RULES,
    "performance": performance.FILE_RULES,
    "architecture": architecture.FILE_RULES,
}


def with_shift(evidence: DataFrame) -> DataFrame:
    """Markup findings in components come after those in templates."""
    markup = [INDEX[r.kind] for r in accessibility.LINE_RULES]
    late = F.when(F.col("entry").isin(*markup), accessibility.is_component()).otherwise(0)
    return evidence.withColumn("shift", late)


def _rules(
    categories: tuple[str, ...], packs: tuple[str, ...], more: tuple[FileRule, ...]
) -> tuple[list[LineRule], list[FileRule]]:
    lines = [r for c in categories for r in LINE_RULES.get(c, ())]
    whole = [r for c in categories for r in FILE_RULES.get(c, ())]
    for pack in packs:
        lines += frameworks.PACKS[pack][0]
        whole += frameworks.PACKS[pack][1]
    return lines, [*whole, *more]


def text_evidence(
    files: DataFrame,
    categories: tuple[str, ...] = CATEGORIES,
    options: Options = Options(),
    packs: tuple[str, ...] = (),
    more: tuple[FileRule, ...] = (),
) -> list[DataFrame]:
    """Line rules of all chosen categories in one pass over the texts, file rules, with those of
    `more`, in another."""
    lines, whole = _rules(categories, packs, more)
    frames = []
    if lines:
        frames.append(with_shift(apply_line_rules(files, lines, options)))
    if whole:
        frames.append(apply_file_rules(files, whole, options))
    return frames


def file_issues(
    files: DataFrame,
    categories: tuple[str, ...] = CATEGORIES,
    options: Options = Options(),
    packs: tuple[str, ...] = (),
) -> DataFrame:
    """Issues that depend on one file only, in one pass over the texts; `packs` names framework packs
    for all repositories, or is `DETECTED` for those of each one's stack."""
    more = tuple(testing.FILE_RULES) if "testing" in categories else ()
    detected = packs == frameworks.DETECTED
    lines, whole = _rules(categories, tuple(frameworks.PACKS) if detected else packs, more)
    found = with_shift(fused_evidence(files, lines, whole, options, "quality" in categories))
    if detected:
        stack = detect_stack(repo_facts(files, options), parse_manifest(files))
        found = frameworks.keep_wanted(found, frameworks.packs_of(stack))
    return render(found)


def repo_issues(
    files: DataFrame,
    categories: tuple[str, ...] = CATEGORIES,
    options: Options = Options(),
    advisories: DataFrame | None = None,
) -> DataFrame | None:
    """Issues that need all files of a repository."""
    facts, manifests = repo_facts(files, options), parse_manifest(files)
    frames = []
    if "performance" in categories:
        frames.append(performance.heavy_dependencies(manifests))
    if "testing" in categories:
        frames.append(testing.testing_evidence(files, facts, options))
    if "architecture" in categories:
        frames.append(architecture.structure_evidence(facts))
        frames.append(import_cycles(files, options))
    issues = [render(union_all(frames))] if frames else []
    if "security" in categories and advisories is not None:
        issues.append(advisory_join(extract_deps(manifests), advisories))
    return union_all(issues) if issues else None


def collect_issues(
    files: DataFrame,
    categories: tuple[str, ...] = CATEGORIES,
    options: Options = Options(),
    packs: tuple[str, ...] = (),
    advisories: DataFrame | None = None,
    plugins: bool = True,
) -> DataFrame:
    """Issues of the chosen categories as one lazy frame. Plugins run here, each on its own, so that
    one that fails at run time takes only its own issues along."""
    parts = [
        file_issues(files, categories, options, packs),
        repo_issues(files, categories, options, advisories),
        run_plugins(files, isolate=True) if plugins else None,
    ]
    return union_all([p for p in parts if p is not None])


def run_scanner(
    files: DataFrame, category: str, options: Options = Options(),
    advisories: DataFrame | None = None,
) -> DataFrame:
    """Issues of one category."""
    if category not in CATEGORIES:
        raise ValueError(f"Unknown scanner category: {category}")
    return collect_issues(files, (category,), options, advisories=advisories, plugins=False)


def audit_quality(files: DataFrame, **kw) -> DataFrame:
    return run_scanner(files, "quality", **kw)


def audit_security(files: DataFrame, **kw) -> DataFrame:
    return run_scanner(files, "security", **kw)


def audit_performance(files: DataFrame, **kw) -> DataFrame:
    return run_scanner(files, "performance", **kw)


def audit_accessibility(files: DataFrame, **kw) -> DataFrame:
    return run_scanner(files, "accessibility", **kw)


def audit_testing(files: DataFrame, **kw) -> DataFrame:
    return run_scanner(files, "testing", **kw)


def audit_architecture(files: DataFrame, **kw) -> DataFrame:
    return run_scanner(files, "architecture", **kw)


@dataclass
class Audit:
    """Frames of one audit run; all are lazy except what `issues` was written to."""

    issues: DataFrame
    facts: DataFrame
    results: DataFrame
    sub_scores: DataFrame
    scores: DataFrame
    summary: DataFrame
    gate: DataFrame
    stack: DataFrame
    weights: DataFrame

    def reports(self) -> DataFrame:
        """One nested row per repository. Issues stay in their own table, as a repository may
        hold more of them than fit in one row."""
        results = self.results.groupBy("repo_id").agg(
            F.sort_array(F.collect_list(F.struct(
                "category", "score", "files_scanned", "issues", "critical", "high"
            ))).alias("results")
        )
        parts = self.sub_scores.join(self.weights, ["repo_id", "category"], "left").groupBy(
            "repo_id"
        ).agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(
                "category",
                F.struct(
                    "score", "grade", F.coalesce("weight", F.lit(0.0)).alias("weight"),
                    "issue_count", "critical_count", "high_count",
                ),
            )))).alias("categories")
        )  # one entry per category
        return (
            self.scores.withColumnRenamed("overall", "score")
            .join(parts, "repo_id")
            .join(self.summary.withColumnRenamed("categories", "issue_counts"), "repo_id")
            .join(self.stack, "repo_id")
            .join(results, "repo_id")
            .select(
                F.col("repo_id").alias("path"),
                F.uuid().alias("id"),
                F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
                .alias("timestamp"),
                F.lit(REPORT_VERSION).alias("version"),
                F.struct("score", "grade", "categories").alias("score"),
                F.struct(*[c for c in self.stack.columns if c != "repo_id"]).alias("stack"),
                F.struct(*[
                    F.col("issue_counts").alias(c) if c == "categories" else F.col(c)
                    for c in self.summary.columns if c != "repo_id"
                ]).alias("summary"),
                "results",
            )
        )

    def write(self, location: str) -> None:
        write_issues(self.issues, f"{location}/issues")
        write_report_json(self.reports(), f"{location}/reports")


def score_audit(
    files: DataFrame,
    issues: DataFrame,
    categories: tuple[str, ...] = CATEGORIES,
    options: Options = Options(),
    weights: dict[str, float] | DataFrame = AUDIT_WEIGHTS,
) -> Audit:
    """Scores of an issue table. Issues of plugins count in summary and gate, not in scores."""
    facts = repo_facts(files, options)
    totals = issue_totals(issues)
    results = scan_results(facts, totals, testing.coverage(files, options), categories)
    counted = results.unionByName(plugin_results(totals))
    if not isinstance(weights, DataFrame):
        none = "repo_id string, category string, weight double"
        by_repo = resolve_weights(files.sparkSession.createDataFrame([], none), facts, weights)
    else:
        by_repo = weights
    return Audit(
        issues=issues,
        facts=facts,
        results=results,
        sub_scores=sub_scores(results),
        scores=overall_score(results, weights),
        summary=audit_summary(counted),
        gate=gate(counted),
        stack=detect_stack(facts, parse_manifest(files)),
        weights=by_repo,
    )


def audit(
    files: DataFrame,
    categories: tuple[str, ...] = CATEGORIES,
    options: Options = Options(),
    weights: dict[str, float] | DataFrame = AUDIT_WEIGHTS,
    packs: tuple[str, ...] = (),
    advisories: DataFrame | None = None,
    issue_table: str | None = None,
) -> Audit:
    """Scan, score and summarise all repositories of a file table.

    With `issue_table` the issues are written there once and every later step reads that table.
    Without it they are cached; issues are small next to the texts, which are never cached.
    """
    issues = collect_issues(files, categories, options, packs, advisories)
    if issue_table:
        write_issues(issues, issue_table)
        issues = read_issues(SparkSession.getActiveSession(), issue_table)
    else:
        issues = issues.persist(StorageLevel.MEMORY_AND_DISK)
    return score_audit(files, issues, categories, options, weights)
