"""Line fixes: planned as rows, applied by rewriting whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.text import DOT, SPACE, js_trim_end, replace_first, split_lines
from lintlake.sources.files import has_content

# What an automated fix inserts.
CONSOLE_TAIL = " // TODO: use a proper logger"
EVAL_TAIL = " // SECURITY: replace eval() with safe alternative"
INSERTED = {
    "img-alt": ("<img", '<img alt=""'),
    "label-for-input": ("<input", '<input aria-label="TODO: add label"'),
    "button-aria-label": ("<button", '<button aria-label="TODO: describe action"'),
    "html-has-lang": ("<html", '<html lang="en"'),
}


def _automated() -> Column:
    return F.coalesce(F.col("fix.automated"), F.lit(False)) & F.col("line").isNotNull()


def split_fixable(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues with an automated fix on a line, and the others."""
    return issues.where(_automated()), issues.where(~_automated())


def commented_out(line: Column, tail: str) -> Column:
    """Turn a line into a comment; its indent and a final `\\r` stay."""
    plain = tail.replace("$", "\\$")
    return F.regexp_replace(
        line, f"\\A([{SPACE}&&[^\\r]]*)({DOT}*)(\\r?)\\z", f"$1// $2{plain}$3"
    )


def replacement(rule: Column, line: Column, fix_eval: bool = False) -> Column:
    """New text of a line by rule, NULL when the rule has no fix.

    A line that holds only `debugger` becomes empty.
    """
    out = F.when(rule == "no-console", commented_out(line, CONSOLE_TAIL)).when(
        rule == "no-debugger", js_trim_end(replace_first(line, r"\bdebugger\b\s*;?", ""))
    )
    for name, (tag, new) in INSERTED.items():
        out = out.when(rule == name, replace_first(line, tag + r"\b", new))
    if fix_eval:
        out = out.when(rule == "no-eval", commented_out(line, EVAL_TAIL))
    return out


def build_fix_plan(issues: DataFrame, files: DataFrame, fix_eval: bool = False) -> DataFrame:
    """`line_changes(repo_id, path, line_no, original, replacement, rule, ord)`.

    Issues are grouped per file before they meet its text, so a text is split once and one file
    is the largest group there is.
    """
    wanted = issues.where(
        _automated() | (F.lit(fix_eval) & (F.col("rule") == "no-eval"))
    )
    grouped = wanted.groupBy("repo_id", F.col("file").alias("path")).agg(
        F.collect_list(F.struct("line", "rule", "ord")).alias("asks")
    )
    return (
        files.where(has_content())
        .select("repo_id", "path", "content")
        .join(grouped, ["repo_id", "path"])
        .select("repo_id", "path", split_lines(F.col("content")).alias("lines"), "asks")
        .select(
            "repo_id", "path",
            F.inline(F.expr(
                "transform(asks, a -> struct(a.line as line_no, get(lines, a.line - 1) as "
                "original, a.rule as rule, a.ord as ord))"
            )),
        )
        .where(F.col("original").isNotNull())
        .select(
            "repo_id", "path", "line_no", "original",
            replacement(F.col("rule"), F.col("original"), fix_eval).alias("replacement"),
            "rule", "ord",
        )
        .where(F.col("replacement").isNotNull())
    )


def apply_fixes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """New versions of the files that have changes; the source table stays as it is.

    On one line the change emitted last wins. The text is put together from the runs between
    changed lines, which is linear in its length.
    """
    last = (
        changes.groupBy("repo_id", "path", "line_no")
        .agg(F.max_by("replacement", "ord").alias("new"))
        .groupBy("repo_id", "path")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "new"))).alias("edits"))
    )
    pieces = F.expr("""
        concat(
          flatten(transform(edits, (e, j) -> concat(
            slice(lines,
                  coalesce(get(edits, j - 1).line_no, 0) + 1,
                  e.line_no - coalesce(get(edits, j - 1).line_no, 0) - 1),
            array(e.new)))),
          slice(lines, element_at(edits, -1).line_no + 1,
                size(lines) - element_at(edits, -1).line_no))
    """)
    return (
        files.select("repo_id", "path", "content")
        .join(last, ["repo_id", "path"])
        .select("repo_id", "path", split_lines(F.col("content")).alias("lines"), "edits")
        .select("repo_id", "path", F.array_join(pieces, "\n").alias("content"))
    )


def fix_summary(changes: DataFrame) -> DataFrame:
    """Fixes and changed lines per file; two fixes of one line count twice."""
    return changes.groupBy("repo_id", "path").agg(
        F.count("*").alias("issues_fixed"),
        F.count("*").alias("lines_changed"),
        F.count_distinct("line_no").alias("distinct_lines"),
    )


def fix_totals(issues: DataFrame, changes: DataFrame) -> DataFrame:
    """Fixes, files and issues left to do by hand, per repository."""
    manual = issues.groupBy("repo_id").agg(F.count_if(~_automated()).alias("manual"))
    done = fix_summary(changes).groupBy("repo_id").agg(
        F.sum("issues_fixed").alias("fixes"), F.count("*").alias("files")
    )
    return manual.join(done, "repo_id", "left").select(
        "repo_id", "manual",
        F.coalesce("fixes", F.lit(0)).alias("fixes"),
        F.coalesce("files", F.lit(0)).alias("files"),
    )


def revert_console_fix(files: DataFrame) -> DataFrame:
    """Undo the comment-out in `.ts` files below `src/`; returns the changed files.

    One multi-line replacement over the text; `d` makes `\\n` the only line end.
    """
    indent = f"[{SPACE}&&[^\\n]]*"
    pattern = f"(?md)^({indent})// ({DOT}*) // TODO: use a proper logger(\\r?)$"
    return (
        files.where(
            F.col("path").startswith("src/") & F.col("path").endswith(".ts")
            & F.col("content").contains(CONSOLE_TAIL)
        )
        .select(
            "repo_id", "path", F.col("content").alias("_old"),
            F.regexp_replace("content", pattern, "$1$2$3").alias("content"),
        )
        .where(F.col("content") != F.col("_old"))
        .drop("_old")
    )
