"""Rules of the testing category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.functions.grades import js_round
from lintlake.functions.paths import base_name, dir_name, join_path
from lintlake.functions.text import ecma
from lintlake.operators.catalogue import CRITICAL_MODULES, TEST_BLOCK
from lintlake.operators.issues import entry_of, evidence, found, union_all
from lintlake.operators.rules import FileRule, Options, SCOPES



def candidate_paths(path: Column) -> Column:
    """The five places where the test of a source may live, in order."""
    ext = F.regexp_extract(path, r"(\.[^./]+)\z", 1)
    stem = F.regexp_replace(path, r"\.[^./]+\z", "")
    directory, name = dir_name(path), base_name(stem)
    beside = lambda sub, kind: join_path(
        directory, F.concat(F.lit(sub + "/"), name, F.lit(f".{kind}"), ext)
    )
    return F.array(
        F.concat(stem, F.lit(".test"), ext),
        F.concat(stem, F.lit(".spec"), ext),
        beside("__tests__", "test"),
        beside("__tests__", "spec"),
        beside("tests", "test"),
    )


def infer_test_paths(sources: DataFrame) -> DataFrame:
    return sources.select(
        "repo_id", "path", F.posexplode(candidate_paths(F.col("path"))).alias("pos", "candidate")
    )


def covered_paths(files: DataFrame) -> DataFrame:
    """Source paths that some file tests: the candidate rule read backwards.

    Only files named `*.test.*` or `*.spec.*` produce rows, one or two each, instead of five
    candidates for every source.
    """
    path = F.col("path")
    shape = r"^(?:(.*)/)?([^/]*)\.(test|spec)(\.[^./]+)\z"
    part = lambda k: F.regexp_extract(path, shape, k)
    directory, target = part(1), F.concat(part(2), part(4))
    parent = F.regexp_extract(directory, r"^(?:(.*)/)?[^/]*\z", 1)
    last = base_name(directory)
    nested = (last == "__tests__") | ((last == "tests") & (part(3) == "test"))
    targets = F.array(
        join_path(directory, target), F.when(nested, join_path(parent, target))
    )
    return files.where(path.rlike(shape)).select(
        "repo_id", F.explode(F.array_compact(targets)).alias("path")
    ).distinct()


def is_critical() -> Column:
    return F.col("path").rlike("(?i)" + "|".join(CRITICAL_MODULES))


def source_coverage(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Every source with a flag whether a test file exists for it."""
    sources = files.where(SCOPES["code"](options)).select("repo_id", "path")
    covered = covered_paths(files).withColumn("tested", F.lit(True))
    return sources.join(covered, ["repo_id", "path"], "left").select(
        "repo_id", "path", F.coalesce("tested", F.lit(False)).alias("tested"),
        is_critical().alias("critical"),
    )


def untested_files(files: DataFrame, options: Options = Options()) -> DataFrame:
    sources = files.where(SCOPES["code"](options)).select("repo_id", "path")
    return sources.join(covered_paths(files), ["repo_id", "path"], "left_anti")


def coverage(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Sources, untested sources and estimated coverage per repository."""
    total = F.count("*")
    untested = F.count_if(~F.col("tested"))
    share = js_round((total - untested) / total * 100)
    return source_coverage(files, options).groupBy("repo_id").agg(
        total.alias("sources"),
        untested.alias("untested"),
        F.count_if(~F.col("tested") & F.col("critical")).alias("untested_critical"),
        share.alias("coverage"),
    )


def untested_evidence(
    coverage_rows: DataFrame, limit: int | None = Options.first_untested
) -> DataFrame:
    """Critical untested files, and the others among the first `limit` untested in path order.

    The limit is a ranked filter, so each map task keeps at most that many rows per repository;
    None reports all of them.
    """
    open_files = coverage_rows.where(~F.col("tested"))
    first = (
        open_files.withColumn(
            "rn", F.row_number().over(Window.partitionBy("repo_id").orderBy("path"))
        )
        .where(F.lit(True) if limit is None else F.col("rn") <= limit)
        .where(~F.col("critical"))
    )
    name = candidate_paths(F.col("path"))[0].alias("name")
    return union_all([
        open_files.where("critical").select(
            "repo_id", "path", entry_of("no-untested-critical").alias("entry"), name
        ),
        first.select("repo_id", "path", entry_of("missing-test").alias("entry"), name),
    ])


def coverage_evidence(covered: DataFrame) -> DataFrame:
    share = F.col("coverage")
    entry = F.when(share < 50, entry_of("low-coverage")).when(
        share < 70, entry_of("medium-coverage")
    )
    return covered.select(
        "repo_id", F.lit("project-wide").alias("path"), F.lit("").alias("ord_path"),
        entry.alias("entry"), share.alias("n"),
    ).where(F.col("entry").isNotNull())


def no_tests_evidence(facts: DataFrame) -> DataFrame:
    return facts.where((F.col("n_tests") == 0) & (F.col("n_code") > 5)).select(
        "repo_id", F.lit("project-wide").alias("path"), F.lit("").alias("ord_path"),
        entry_of("no-tests").alias("entry"),
    )


def _empty() -> Column:
    return found(
        F.col("in_tests") & ~F.col("content").rlike(ecma(r"\b(?:it|test)\s*\(")),
        evidence("no-empty-tests"),
    )


def _silent() -> Column:
    blocks = F.regexp_extract_all("content", F.lit(ecma(TEST_BLOCK)), 0)
    return found(
        F.col("in_tests") & F.exists(blocks, lambda b: ~b.rlike("expect|assert|should")),
        evidence("require-assertions"),
    )


# The patterns and word lists inside these rules.
FILE_RULES = (
    FileRule(("no-empty-tests",), ("tests",), _empty),
    FileRule(("require-assertions",), ("tests",), _silent),
)


def testing_evidence(
    files: DataFrame, facts: DataFrame, options: Options = Options()
) -> DataFrame:
    """Findings that need all files of a repository (`FILE_RULES` need one)."""
    return union_all([
        untested_evidence(source_coverage(files, options), options.first_untested),
        coverage_evidence(coverage(files, options)),
        no_tests_evidence(facts),
    ])


def untested_critical(files: DataFrame, options: Options = Options()) -> DataFrame:
    """The untested files of critical paths, one row each."""
    return source_coverage(files, options).where(~F.col("tested") & F.col("critical")).select(
        "repo_id", "path"
    )


def testing_metadata(
    files: DataFrame, facts: DataFrame, options: Options = Options()
) -> DataFrame:
    """Counts per repository. The untested critical files stay rows of `untested_files`, since a
    list of them per repository has no bound."""
    return facts.select("repo_id", "n_code", "n_tests").join(
        coverage(files, options), "repo_id", "left"
    ).select(
        "repo_id",
        F.col("n_code").alias("source_files"),
        F.col("n_tests").alias("test_files"),
        F.coalesce("untested", F.lit(0)).alias("untested_files"),
        F.coalesce("untested_critical", F.lit(0)).alias("untested_critical"),
        F.concat(F.coalesce("coverage", F.lit(100)).cast("string"), F.lit("%")).alias("coverage"),
    )
