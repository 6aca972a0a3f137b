"""Text rules of the quality category."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lintlake.functions.text import any_of, ecma
from lintlake.operators.catalogue import CONSOLE, DEBUGGER, FUNCTION_NAME, TODO
from lintlake.operators.issues import EVIDENCE_TYPE, evidence, found
from lintlake.operators.rules import FileRule, LineRule, repeated_evidence, sorted_names

# Patterns and guards of the rules.
LINE_RULES = (
    LineRule("no-console", "code", ecma(CONSOLE), ("console.",), k2=0),
    LineRule("no-debugger", "code", ecma(DEBUGGER), ("gger",), k2=1),
    LineRule("no-todo", "code", ecma(TODO, ignore_case=True), ("//",), k2=2),
)

MAX_FILE_LINES = 500
MAX_DEPTH = 4


def nesting_depth(content: Column) -> Column:
    """Highest brace depth; the counter never goes below zero.

    Only braces reach the fold, as one short string per file.
    """
    braces = F.split(F.regexp_replace(content, "[^{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, c: Column) -> Column:
        now = (
            F.when(c == "{", acc["now"] + 1)
            .when(c == "}", F.greatest(acc["now"] - 1, F.lit(0)))
            .otherwise(acc["now"])
        )
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(braces, start, step, lambda acc: acc["top"])


def _size() -> Column:
    n = F.size("lines")
    return found(F.col("in_code") & (n > MAX_FILE_LINES), evidence("max-file-size", n=n))


def _depth() -> Column:
    depth = F.col("depth")
    return found(depth > MAX_DEPTH, evidence("max-depth", n=depth))


FILE_RULES = (
    FileRule(("max-file-size",), ("code",), _size),
    FileRule(
        ("max-depth",), ("code",), _depth,
        {"depth": lambda: F.when(F.col("in_code"), nesting_depth(F.col("content")))},
    ),
    FileRule(
        ("no-duplicate-functions",), ("code",),
        lambda: F.coalesce(
            repeated_evidence("no-duplicate-functions", F.col("functions")),
            F.array().cast(f"array<{EVIDENCE_TYPE}>"),
        ),
        {
            "functions": lambda: F.when(
                F.col("in_code") & any_of(*[F.contains("content", F.lit(w)) for w in ("function", "const")]),
                sorted_names(
                    F.regexp_extract_all("content", F.lit(ecma(FUNCTION_NAME)), 1)
                ),
            )
        },
    ),
)

