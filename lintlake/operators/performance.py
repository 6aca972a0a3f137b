"""Rules of the performance category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.text import any_of, ecma
from lintlake.operators.catalogue import (
    API_CALL, HEAVY_DEPENDENCIES, NESTED_LOOP, PAGE_IMPORT,
)
from lintlake.operators.issues import EVIDENCE_TYPE, evidence, found
from lintlake.operators.rules import (
    FileRule, LineRule, first_line, lines_from, repeated_evidence, sorted_names,
)

_EMPTY = f"array<{EVIDENCE_TYPE}>"


def _stale(lines: Column, i: Column) -> Column:
    block = lines_from(lines, i, 10, "\n")
    return block.rlike(ecma(r",\s*\[\s*\]\s*\)")) & block.rlike(ecma(r"\b[a-z]\w+\s*\("))


# Patterns and guards of the rules.
LINE_RULES = (
    LineRule("exhaustive-deps", "react", ecma(r"useEffect\s*\("), ("Effect",), near=_stale),
    LineRule("no-sync-fs", "code", "readFileSync|writeFileSync|existsSync|mkdirSync", ("Sync",)),
)


def _nested() -> Column:
    text = F.col("content")
    return found(
        F.col("in_code") & text.contains("for") & text.rlike(ecma(NESTED_LOOP)),
        evidence(
            "no-nested-loops",
            line=first_line(F.col("lines"), lambda l: l.rlike(ecma(r"\bfor\s*\("))),
        ),
    )


def _memo() -> Column:
    text = F.col("content")
    return found(
        F.col("in_react")
        & (F.size("lines") > 50)
        & text.rlike(ecma(r"export\s+default\s+function"))
        & text.rlike(ecma(r"return\s*\(?\s*<"))
        & ~text.rlike(r"React\.memo|memo\("),
        evidence("react-memo"),
    )


def _use_memo() -> Column:
    text = F.col("content")
    return found(
        F.col("in_react")
        & (F.size("lines") > 30)
        & text.rlike(ecma(r"\.filter\(.*\)\.map\(|\.reduce\("))
        & ~text.rlike(ecma(r"useMemo\s*\(")),
        evidence("react-usememo"),
    )


def _lazy() -> Column:
    at, lines = F.col("lazy_line"), F.col("lines")
    line = F.get(lines, at - 1)
    name = F.coalesce(
        F.nullif(F.regexp_extract(line, ecma(r"import\s+(\w+)"), 1), F.lit("")),
        F.lit("Component"),
    )
    return found(at > 0, evidence("react-lazy-routes", line=at, name=name, text=line, k1=at))


def _lazy_line() -> Column:
    late = lambda l: l.rlike(ecma(PAGE_IMPORT)) & ~l.rlike("lazy|dynamic|Suspense")
    gate = F.col("in_react") & F.col("content").rlike(ecma(PAGE_IMPORT))
    return F.when(gate, first_line(F.col("lines"), late)).otherwise(0)


def _repeated_calls() -> Column:
    return F.coalesce(
        repeated_evidence("no-duplicate-api-calls", F.col("calls")), F.array().cast(_EMPTY)
    )


FILE_RULES = (
    FileRule(("no-nested-loops",), ("code",), _nested),
    FileRule(("react-memo",), ("react",), _memo),
    FileRule(("react-usememo",), ("react",), _use_memo),
    FileRule(("react-lazy-routes",), ("react",), _lazy, {"lazy_line": _lazy_line}),
    FileRule(
        ("no-duplicate-api-calls",), ("react",), _repeated_calls,
        {
            "calls": lambda: F.when(
                F.col("in_react") & any_of(*[F.contains("content", F.lit(w)) for w in ("fetch", "axios.")]),
                sorted_names(F.regexp_extract_all("content", F.lit(ecma(API_CALL)), 1)),
            )
        },
    ),
)


def _starts_with(name: str):
    return lambda dep: dep.startswith(name)


def heavy_dependencies(manifests: DataFrame) -> DataFrame:
    """Listed packages among the run-time dependencies, matched by name or by prefix.

    The six names are unrolled over the dependency map of the manifest row: one finding per
    listed package, no join and no shuffle.
    """
    names = F.map_keys("deps")
    hits = [
        F.when(
            F.exists(names, _starts_with(name)),
            evidence(f"heavy-{k}", k1=0),
        )
        for k, (name, _, _) in enumerate(HEAVY_DEPENDENCIES)
    ]
    return manifests.select(
        "repo_id", F.lit("package.json").alias("path"), F.inline(F.array_compact(F.array(*hits)))
    )
