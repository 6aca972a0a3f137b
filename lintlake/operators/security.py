"""Text rules of the security category (dependency advisories are in `advisories`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.text import ecma
from lintlake.operators.catalogue import (
    COMMAND_INJECTION, SECRETS, SQL_INJECTION, UNSAFE_EVAL, XSS,
)
from lintlake.operators.issues import evidence, found
from lintlake.operators.rules import FileRule, LineRule

# Words of which a hit holds one, lower case where the pattern ignores case.
_SECRET_HINTS = (
    ("KIA", "IPA", "SIA", "ROA"),
    ("key",),
    ("Iza",),
    ("gho_", "ghp_", "ghs_", "ghu_"),
    ("_live_",),
    ("_live_",),
    ("key",),
    ("jwt",),
    ("pass", "pwd"),
    ("://",),
    ("PRIVATE",),
    ("pass", "pwd"),
    ("SG.",),
    ("xox",),
    ("firebaseconfig",),
)
_XSS_HINTS = (("HTML",), ("HTML",), ("document.",), (".html",), ("HTML",))
_EVAL_HINTS = (("val",), ("Function",), ("Timeout",), ("Interval",))

LINE_RULES = (
    *(
        LineRule(f"secret-{k}", "secrets", ecma(p, ci), hint, comments=("//", "#"), fold=ci)
        for k, ((_, p, ci, _), hint) in enumerate(zip(SECRETS, _SECRET_HINTS))
    ),
    *(
        LineRule(f"sql-{k}", "secure", ecma(p, True), hint, fold=True)
        for k, (p, hint) in enumerate(
            zip(SQL_INJECTION, (("query", "xecute", "run"), ("query", "xecute", "run"), ("xec",)))
        )
    ),
    *(
        LineRule(f"xss-{k}", "secure", ecma(p), hint)
        for k, (p, hint) in enumerate(zip(XSS, _XSS_HINTS))
    ),
    *(
        LineRule(f"command-{k}", "secure", ecma(p, ci), hint, fold=ci)
        for k, ((p, ci), hint) in enumerate(
            zip(COMMAND_INJECTION, (("xec", "pawn"), ("child_process",)))
        )
    ),
    *(
        LineRule(f"eval-{k}", "secure", ecma(p), hint, comments=("//",))
        for k, (p, hint) in enumerate(zip(UNSAFE_EVAL, _EVAL_HINTS))
    ),
)


def _csrf() -> Column:
    text, path = F.col("content"), F.col("path")
    return found(
        F.col("in_secure")
        & (path.endswith(".ts") | path.endswith(".js"))
        & text.contains("app.")
        & text.rlike(ecma(r"app\.(post|put|patch|delete)\s*\("))
        & ~text.rlike("csrf|csurf|doubleCsrf|sameSite"),
        evidence("csrf-protection"),
    )


# The patterns inside these rules.
FILE_RULES = (FileRule(("csrf-protection",), ("secure",), _csrf),)


def secret_metadata(issues: DataFrame) -> DataFrame:
    """Secrets and vulnerable dependencies per repository."""
    return (
        issues.where(F.col("category") == "security")
        .groupBy("repo_id")
        .agg(
            F.count_if(F.col("rule") == "no-hardcoded-secrets").alias("secrets_found"),
            F.count_if(F.col("rule") == "npm-audit").alias("vulnerabilities"),
        )
    )


def vulnerability_counts(issues: DataFrame) -> DataFrame:
    """Vulnerable dependencies per severity, with the total per repository."""
    return (
        issues.where(F.col("rule") == "npm-audit")
        .groupBy("repo_id")
        .agg(
            *[
                F.count_if(F.col("severity") == s).alias(s)
                for s in ("critical", "high", "medium", "low", "info")
            ],
            F.count("*").alias("total"),
        )
    )
