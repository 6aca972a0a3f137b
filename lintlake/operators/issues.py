"""Evidence rows and their rendering into issues.

Evidence is what a rule finds, as narrow as possible; `render` adds the constants of the rule.
A query that only counts severities therefore never builds a text.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.grades import severity_rank
from lintlake.functions.text import js_trim, redact, replace_first
from lintlake.operators.catalogue import CATALOGUE, INDEX
from lintlake.schema import ISSUE_COLUMNS

EVIDENCE_TYPE = "struct<entry:int,line:int,n:bigint,name:string,text:string,k1:int,k2:int>"

# Positional arguments of the text templates.
_ARGUMENTS = ("file", "line", "i", "n", "name", "trim", "red", "after")
_PLACEHOLDER = re.compile("%|" + "|".join("{%s}" % a for a in _ARGUMENTS))

_CONSTANTS_TYPE = (
    "array<struct<rule:string,category:string,severity:string,title:string,description:string,"
    "id:string,fix:string,automated:boolean,before:string,after:string,effort:string,"
    "impact:string,tags:array<string>,references:array<string>,cat:int,phase:int,grp:int,"
    "bump_over:bigint,bump_to:string>>"
)


def _template(text: str | None) -> str | None:
    if text is None:
        return None
    swap = lambda m: "%%" if m[0] == "%" else f"%{_ARGUMENTS.index(m[0][1:-1]) + 1}$s"
    return _PLACEHOLDER.sub(swap, text)


def _constants() -> Column:
    """The catalogue as one literal; Catalyst folds it, so it is parsed once per query."""
    rows = []
    for kind in CATALOGUE:
        row = {f: getattr(kind, f) for f in kind.__dataclass_fields__ if f != "key"}
        for f in ("description", "id", "fix", "before", "after"):
            row[f] = _template(row[f])
        rows.append(row)
    return F.from_json(F.lit(json.dumps(rows)), _CONSTANTS_TYPE)


# The attribute a suggestion inserts, by rule.
SUGGESTED_TAGS = {
    "img-alt": ("<img", '<img alt="Description of image"'),
    "label-for-input": ("<input", '<input aria-label="Field description"'),
    "button-aria-label": ("<button", '<button aria-label="Action description"'),
    "html-has-lang": ("<html", '<html lang="en"'),
}


def _after(entry: Column, trimmed: Column) -> Column:
    """Rewritten line of the rules whose suggestion edits the line."""
    out = F.when(
        entry == INDEX["no-sync-fs"], js_trim(replace_first(trimmed, r"Sync\b", ""))
    ).when(
        entry == INDEX["interactive-element-semantics"],
        replace_first(replace_first(trimmed, "<div", "<button"), "</div>", "</button>"),
    )
    for key, (tag, new) in SUGGESTED_TAGS.items():
        out = out.when(entry == INDEX[key], replace_first(trimmed, tag + r"\b", new))
    return out


def entry_of(key: str) -> Column:
    return F.lit(INDEX[key])


def evidence(
    key: str | Column,
    line: Column | None = None,
    n: Column | None = None,
    name: Column | None = None,
    text: Column | None = None,
    k1: Column | int = 0,
    k2: Column | int = 0,
) -> Column:
    """One finding as a struct of `EVIDENCE_TYPE`."""
    null = F.lit(None)
    pick = lambda c, t: (null if c is None else c).cast(t)
    num = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("int")
    return F.struct(
        (entry_of(key) if isinstance(key, str) else key).cast("int").alias("entry"),
        pick(line, "int").alias("line"),
        pick(n, "bigint").alias("n"),
        pick(name, "string").alias("name"),
        pick(text, "string").alias("text"),
        num(k1).alias("k1"),
        num(k2).alias("k2"),
    )


def found(condition: Column, item: Column) -> Column:
    """`item` as a one-element array when the condition holds, else an empty array."""
    empty = F.array().cast(f"array<{EVIDENCE_TYPE}>")
    return F.when(condition, F.array(item)).otherwise(empty)


def unpack(rows: DataFrame, items: Column, *extra: str | Column) -> DataFrame:
    """Explode an array of evidence structs into evidence rows."""
    return rows.select("repo_id", "path", *extra, F.inline(items))


def render(rows: DataFrame) -> DataFrame:
    """Evidence rows to issues. All columns but `repo_id`, `path` and `entry` may be missing;
    `shift` is added to the phase, `ord_path` takes the place of the path in the order."""
    optional = {"line": "int", "n": "bigint", "name": "string", "text": "string", "k1": "int",
                "k2": "int", "shift": "int", "ord_path": "string"}
    missing = {c: F.lit(None).cast(t) for c, t in optional.items() if c not in rows.columns}
    rows = rows.withColumns(missing) if missing else rows
    shift, ord_path = F.col("shift"), F.coalesce("ord_path", "path")
    rows = rows.withColumn("_c", F.get(_constants(), F.col("entry")))
    entry, trimmed = F.col("entry"), js_trim(F.col("text"))
    arguments = (
        F.col("path"), F.col("line"), F.col("line") - 1, F.col("n"), F.col("name"),
        trimmed, redact(F.col("text")), _after(entry, trimmed),
    )
    text = lambda field: F.call_function("format_string", F.col(f"_c.{field}"), *arguments)
    bumped = (F.col("_c.bump_over").isNotNull()) & (F.col("n") > F.col("_c.bump_over"))
    columns = {
        "repo_id": F.col("repo_id"),
        "id": F.concat(F.col("repo_id"), F.lit(":"), text("id")),
        "category": F.col("_c.category"),
        "severity": F.when(bumped, F.col("_c.bump_to")).otherwise(F.col("_c.severity")),
        "title": F.col("_c.title"),
        "description": text("description"),
        "file": F.col("path"),
        "line": F.col("line"),
        "rule": F.col("_c.rule"),
        "fix": F.when(
            F.col("_c.fix").isNotNull(),
            F.struct(
                text("fix").alias("description"),
                text("before").alias("before"),
                text("after").alias("after"),
                F.col("_c.automated").alias("automated"),
            ),
        ),
        "tags": F.col("_c.tags"),
        "effort": F.col("_c.effort"),
        "impact": F.col("_c.impact"),
        "references": F.col("_c.references"),
        "ord": F.struct(
            F.col("_c.cat").alias("cat"),
            (F.col("_c.phase") + F.coalesce(shift, F.lit(0))).alias("phase"),
            ord_path.alias("path"),
            F.col("_c.grp").alias("grp"),
            F.coalesce("k1", F.lit(0)).alias("k1"),
            F.coalesce("k2", F.lit(0)).alias("k2"),
        ),
    }
    return rows.select(*[columns[c].alias(c) for c in ISSUE_COLUMNS])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def min_severity(issues: DataFrame, level: str) -> DataFrame:
    """Keep issues at or above a level."""
    return issues.where(severity_rank(F.col("severity")) <= severity_rank(F.lit(level)))


def count_by_rule(issues: DataFrame) -> DataFrame:
    return (
        issues.where(F.col("rule").isNotNull())
        .groupBy("repo_id", "rule")
        .agg(F.count("*").alias("n"))
    )
