"""Opt-in rule packs for React, Next.js and Node; not part of a default audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.text import ecma
from lintlake.operators.catalogue import INDEX
from lintlake.operators.issues import entry_of, evidence, found
from lintlake.operators.rules import FileRule, LineRule, first_line, lines_from


def _without(text: str):
    return lambda lines, i: ~lines_from(lines, i, 5, "").contains(text)


# Patterns and guards of the rules.
REACT_LINE_RULES = (
    LineRule("react-key", "jsx", ecma(r"\.map\s*\("), (".map",), near=_without("key="), k2=0),
    LineRule(
        "react-prop-drilling", "jsx", "props", ("props.",), over=3, k2=1,
        count=lambda line: F.regexp_count(line, F.lit(ecma(r"\bprops\.\w+"))),
    ),
)
NODE_LINE_RULES = (
    LineRule("node-promise", "node", ecma(r"\.then\s*\("), (".then",), near=_without(".catch(")),
)


def _reducer() -> Column:
    text = F.col("content")
    calls = F.regexp_count("content", F.lit(ecma(r"\buseState\s*\(")))
    return found(
        F.col("in_jsx") & text.contains("useState") & ~text.contains("useReducer") & (calls > 5),
        evidence("react-use-reducer", n=calls, k2=2),
    )


def _line_of(scope: str, gate: Column, matches) -> Column:
    return F.when(F.col(f"in_{scope}") & gate, first_line(F.col("lines"), matches)).otherwise(0)


def _next_first() -> Column:
    """The first line that breaks either rule; an image wins on the same line."""
    img, link = F.col("next_img_line"), F.col("next_link_line")
    use_img = (img > 0) & ((link == 0) | (img <= link))
    at = F.when(use_img, img).otherwise(link)
    text = F.get(F.col("lines"), at - 1)
    entry = F.when(use_img, entry_of("next-img")).otherwise(entry_of("next-link"))
    return found(at > 0, evidence(entry, line=at, text=text, k1=at))


def _middleware() -> Column:
    at = F.col("app_use_line")
    return found(at > 0, evidence("node-middleware", k1=at, k2=1))


# The patterns inside these rules.
REACT_FILE_RULES = (FileRule(("react-use-reducer",), ("jsx",), _reducer),)
NEXT_FILE_RULES = (
    FileRule(
        ("next-img", "next-link"), ("code",), _next_first,
        {
            "next_img_line": lambda: _line_of(
                "code",
                F.col("content").rlike("(?i)<img")
                & ~F.col("content").rlike("next/image|Image from"),
                lambda l: l.rlike(ecma(r"<img\b", True)),
            ),
            "next_link_line": lambda: _line_of(
                "code",
                F.col("content").contains("href=")
                & ~F.col("content").rlike("next/link|Link from"),
                lambda l: l.rlike(ecma(r"<a\s+href=")) & ~l.contains("http"),
            ),
        },
    ),
)
NODE_FILE_RULES = (
    FileRule(
        ("node-middleware",), ("node",), _middleware,
        {
            "app_use_line": lambda: _line_of(
                "node",
                F.col("content").contains("app.use")
                & ~F.col("content").contains("(err, req, res, next)")
                & F.col("content").contains("express"),
                lambda l: l.rlike(ecma(r"app\.use\s*\(")),
            )
        },
    ),
)

# Asks for the packs that the detected stack of each repository calls for.
DETECTED = ("detected",)


def packs_of(stack: DataFrame) -> DataFrame:
    """`(repo_id, pack)` for the packs of each repository's stack."""
    has = lambda *names: F.col("primary").isin(*names) | F.exists(
        "secondary", lambda s: s.isin(*names)
    )
    wanted = {"react": has("react"), "next": has("nextjs"), "node": has("node")}
    return stack.select(
        "repo_id",
        F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for p, c in wanted.items()])))
        .alias("pack"),
    )


def keep_wanted(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """Evidence of no pack, and that of packs that its repository wants."""
    pack = F.lit(None).cast("string")
    for name, (lines, whole) in PACKS.items():
        kinds = [r.kind for r in lines] + [k for r in whole for k in r.kinds]
        pack = F.when(F.col("entry").isin(*[INDEX[k] for k in kinds]), F.lit(name)).otherwise(pack)
    known = wanted.withColumn("_wanted", F.lit(True))
    return (
        evidence.withColumn("pack", pack).join(known, ["repo_id", "pack"], "left")
        .where(F.col("pack").isNull() | F.col("_wanted")).drop("pack", "_wanted")
    )


# Pack name to its line and file rules.
PACKS = {
    "react": (REACT_LINE_RULES, REACT_FILE_RULES),
    "next": ((), NEXT_FILE_RULES),
    "node": (NODE_LINE_RULES, NODE_FILE_RULES),
}
