"""All rules that look at one file, in one pass over its text.

Every layer below is a projection that adds columns to the file's row: which scopes the file is in,
which rules can hit at all, its lines and tokens (cut once, for the files that need them), and an
array of evidence for each family of rules. The arrays are put together and become rows once, so a
text is read once and never shuffled, and rules share lines and tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.text import any_of, split_lines
from lintlake.operators import tokens
from lintlake.operators.catalogue import INDEX
from lintlake.operators.issues import EVIDENCE_TYPE, evidence
from lintlake.operators.rules import SCOPES, FileRule, LineRule, Options
from lintlake.sources.files import has_content

_FILE = ("repo_id", "path", "content")


def _line_items(rules: Sequence[LineRule]) -> Column:
    """Evidence of the line rules, from `lines` and the flag of each rule. A rule goes over the lines of
    the files that its flag names, so lines cost nothing for the many rules that cannot hit."""

    def of_rule(r: LineRule) -> Column:
        def item(line: Column, i: Column) -> Column:
            return F.when(r.condition(line, F.col("lines"), i), evidence(
                r.kind, line=i + 1, n=r.count and r.count(line), name=r.name and r.name(line), text=line,
                k1=i + 1, k2=r.k2,
            ))

        return F.when(F.col(f"on_{INDEX[r.kind]}"), F.array_compact(F.transform("lines", item)))

    return F.flatten(F.array_compact(F.array(*map(of_rule, rules))))


def fused_evidence(
    files: DataFrame, line_rules: Sequence[LineRule] = (), file_rules: Sequence[FileRule] = (),
    options: Options = Options(), typed: bool = False,
) -> DataFrame:
    """Evidence rows of line rules, file rules and, if `typed`, the rules on TypeScript tokens.

    The same rows as those of `apply_line_rules`, `apply_file_rules` and `typed_evidence`. No filter
    follows a column that is costly: Spark would push it down and compute the column again.
    """
    whole = list(dict.fromkeys(s for r in file_rules for s in r.scopes))
    scopes = list(dict.fromkeys([*(r.scope for r in line_rules), *whole]))
    flags = {f"on_{INDEX[r.kind]}": r for r in line_rules}
    rows = files.where(has_content()).select(
        *_FILE, *[SCOPES[s](options).alias(f"in_{s}") for s in scopes],
        *([F.lower("content").alias("folded")] if any(r.fold for r in line_rules) else []),
        *([options.walk(("ts", "tsx"), tests=False).alias("typed")] if typed else []),
    )
    may = {
        "functions": tokens.may_hold_finding(), "unused": tokens.declaring(), "any": tokens.may_hold_any(),
    } if typed else {}
    kept = [f"in_{s}" for s in whole]
    rows = rows.select(
        *_FILE, *kept, *[r.possible().alias(f) for f, r in flags.items()],
        *[(F.col("typed") & c).alias(f"may_{n}") for n, c in may.items()],
    )

    needs_lines = [*map(F.col, flags), *map(F.col, kept)]
    add = {"lines": F.when(any_of(*needs_lines), split_lines(F.col("content")))} if needs_lines else {}
    if typed:
        add["raw"] = F.when(any_of(*[F.col(f"may_{n}") for n in may]), tokens.matches())
    rows = rows.withColumns(add) if add else rows

    add = {name: make() for r in file_rules for name, make in r.prepare.items()}
    if typed:
        add["code"] = tokens.code_of()
    rows = rows.withColumns(add) if add else rows

    items: dict[str, Column] = {}
    if line_rules:
        # Only rules that can hit run on a line; without any there are no lines to run on.
        items["line_items"] = F.when(any_of(*map(F.col, flags)), _line_items(line_rules))
    if file_rules:
        found = [r.find() for r in file_rules]
        joined = F.concat(*found) if len(found) > 1 else found[0]
        items["file_items"] = F.when(any_of(*map(F.col, kept)), joined)
    if typed:
        items["any_items"] = F.when(F.col("may_any"), tokens.any_items())
        items["marks"] = F.when(F.col("may_functions") & tokens.has_code(tokens.HEADS), tokens.function_marks())
        items["name_marks"] = F.when(F.col("may_unused") & tokens.has_code(tokens.DECLARING), tokens.name_marks())
    done = [n for n in items if n.endswith("_items")]
    rows = rows.select(*_FILE, *(["raw", "code"] if typed else []), *[v.alias(k) for k, v in items.items()])
    if typed:
        rows = rows.select(
            *_FILE, "raw", "code", *done, F.when(F.col("marks").isNotNull(), tokens.function_fold()).alias("found"),
            F.when(F.col("marks").isNotNull(), tokens.offsets()).alias("offsets"),
            F.when(F.col("name_marks").isNotNull(), tokens.all_names()).alias("names"),
        )
        rows = rows.select(
            *_FILE, "raw", *done, "found", "offsets", "names",
            F.when(F.col("names").isNotNull(), tokens.shadows()).alias("hidden"),
        )
        rows = rows.select(
            *_FILE, *done, F.when(F.col("names").isNotNull(), tokens.unused_items()).alias("unused_items"),
            tokens.spans_of().alias("spans")
        )
        rows = rows.select(
            "repo_id", "path", *done, "unused_items", tokens.function_items().alias("function_items")
        )
        done += ["unused_items", "function_items"]
    none = F.array().cast(f"array<{EVIDENCE_TYPE}>")
    every = F.concat(*[F.coalesce(F.col(n), none) for n in done]) if done else none
    # An outer generator, for the reason given above; a file without a finding gives no row.
    return rows.select("repo_id", "path", F.inline_outer(every)).where("entry is not null")
