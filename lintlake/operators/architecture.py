"""Rules of the architecture category (import cycles are in `graph`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.text import ecma
from lintlake.operators.catalogue import DESIGN_PATTERNS
from lintlake.operators.issues import evidence, found
from lintlake.operators.rules import FileRule, Options
from lintlake.sources.files import DEFAULT_EXTENSIONS, has_content


def structure_evidence(facts: DataFrame) -> DataFrame:
    """Folder, size and root-file findings; each is a condition on the fact row."""
    n = F.col("n_walked")
    rows = (
        (~F.col("has_src") & (n > 5), "src-directory", ".", None),
        (F.col("n_flat") > 10, "folder-structure", ".", F.col("n_flat")),
        (n > 200, "module-size", ".", n),
        (~F.col("has_readme"), "require-readme", "README.md", None),
        (F.col("has_env") & ~F.col("has_env_example"), "require-env-example", ".env", None),
    )
    items = [
        F.when(cond, F.struct(F.lit(where).alias("path"), evidence(key, n=count).alias("e")))
        for cond, key, where, count in rows
    ]
    return facts.select("repo_id", F.inline(F.array_compact(F.array(*items)))).select(
        "repo_id", "path", F.lit("").alias("ord_path"), "e.*"
    )


def _layers() -> Column:
    path, text = F.col("path"), F.col("content")
    data = r"from\s+['\"].*(?:repository|db|database|prisma|mongoose|typeorm)"
    return found(
        F.col("in_walked")
        & path.rlike("(?i)controller|route")
        & ~path.contains("__tests__")
        & text.rlike(ecma(data, True))
        & ~text.rlike("(?i)service"),
        evidence("layer-separation"),
    )


# The layers and patterns inside these rules.
FILE_RULES = (FileRule(("layer-separation",), ("walked",), _layers),)


def design_patterns(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Patterns seen anywhere in a repository, one row each.

    Six booleans are aggregated map-side and then unpivoted; no list is collected.
    """
    flags = [
        F.bool_or(F.col("content").rlike(ecma(p, ci))).alias(name)
        for name, p, ci in DESIGN_PATTERNS
    ]
    names = [name for name, _, _ in DESIGN_PATTERNS]
    return (
        files.where(options.walk(DEFAULT_EXTENSIONS) & has_content())
        .groupBy("repo_id")
        .agg(*flags)
        .select(
            "repo_id",
            F.explode(
                F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
            ).alias("pattern"),
        )
    )


def folder_structure_score(facts: DataFrame) -> DataFrame:
    """100 less ten per folder issue; the missing source directory is the only one."""
    missing = (~F.col("has_src") & (F.col("n_walked") > 5)).cast("int")
    return facts.select("repo_id", F.greatest(F.lit(0), 100 - 10 * missing).alias("score"))
