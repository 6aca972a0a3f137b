"""Rounding, grades and bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lintlake.schema import SEVERITY_RANK

# Lowest score of each grade.
GRADE_CUTS = (
    (97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"),
    (77, "C+"), (73, "C"), (70, "C-"), (60, "D"),
)
# Lowest score of each display band.
BAND_CUTS = ((90, "excellent"), (75, "good"), (60, "fair"), (40, "poor"))


def js_round(x: Column) -> Column:
    """Half rounds up, as in ECMAScript."""
    return F.floor(x.cast("double") + 0.5)


def _ladder(score: Column, cuts: tuple, last: str) -> Column:
    out = F.when(score >= cuts[0][0], cuts[0][1])
    for low, name in cuts[1:]:
        out = out.when(score >= low, name)
    return out.otherwise(last)


def score_to_grade(score: Column) -> Column:
    return _ladder(score, GRADE_CUTS, "F")


def score_band(score: Column) -> Column:
    return _ladder(score, BAND_CUTS, "bad")


def grade_band(grade: Column) -> Column:
    """Grade without its sign."""
    return F.substring(grade, 1, 1)


def severity_rank(severity: Column) -> Column:
    out = F.when(severity == "critical", SEVERITY_RANK["critical"])
    for name in ("high", "medium", "low", "info"):
        out = out.when(severity == name, SEVERITY_RANK[name])
    return out.otherwise(5)
