"""Rules of the accessibility category; all of them look at one line and its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.text import any_of, ecma
from lintlake.operators.rules import LineRule, Options, SCOPES, lines_before, lines_from


def _silent_button(lines: Column, i: Column) -> Column:
    block = lines_from(lines, i, 3, " ")
    return ~block.rlike(ecma(r">\s*[A-Za-z]")) & ~block.rlike("aria-label|aria-labelledby")


def _level(line: Column) -> Column:
    """Level of the first heading on a line, NULL without one."""
    return F.regexp_extract(line, ecma(r"<h([1-6])\b", True), 1).try_cast("int")


def _skips_level(lines: Column, i: Column) -> Column:
    level, before = _level(F.get(lines, i)), lines_before(lines, i, 20, "\n")
    # One literal pattern for each level, so that each is compiled once.
    missing = [(level == n) & ~before.rlike(rf"(?i)<h{n - 1}(?![A-Za-z0-9_])") for n in range(3, 7)]
    return any_of(*missing)


# Patterns and guards of the rules.
LINE_RULES = (
    LineRule("img-alt", "markup", ecma(r"<img\b", True), ("<img",),
             unless=(ecma(r"\balt\s*=", True),), k2=0, fold=True),
    LineRule("label-for-input", "markup", ecma(r"<input\b", True), ("<input",),
             unless=(ecma(r"type\s*=\s*['\"](?:hidden|submit|reset|button|image)['\"]"),
                     ecma(r"\b(?:aria-label|aria-labelledby|id)\s*=")), k2=1, fold=True),
    LineRule("interactive-element-semantics", "markup", ecma(r"<div\b[^>]*onClick", True),
             ("<div",), unless=(ecma(r"role\s*="), "tabIndex"), k2=2, fold=True),
    LineRule("button-aria-label", "markup", ecma(r"<button\b[^>]*>", True), ("<button",),
             unless=(ecma(r">.*?</button>"),), near=_silent_button, k2=3, fold=True),
    LineRule("html-has-lang", "markup", ecma(r"<html\b", True), ("<html",),
             unless=(ecma(r"\blang\s*="),), k2=4, fold=True),
    LineRule("heading-order", "markup", ecma(r"<h[1-6]\b", True),
             ("<h",), fold=True, near=_skips_level,
             count=_level, name=lambda line: _level(line) - 1, k2=5),
    LineRule("focus-visible", "markup", ecma(r"outline\s*:\s*0|outline\s*:\s*none"),
             ("outline",), unless=("focus-visible",), k2=6),
)


def is_component() -> Column:
    """Components come after templates in the emission order."""
    return F.when(F.col("path").rlike(r"\.(?:tsx|jsx)\z"), 1).otherwise(0)


def markup_files(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Templates and components, each file once."""
    return files.where(SCOPES["markup"](options))
