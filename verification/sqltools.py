"""SQL pieces shared by the query counterparts: path conditions, patterns, issue rows."""

from __future__ import annotations

import re

from lintlake.operators.catalogue import CATALOGUE, INDEX, Kind
from verification.corpus import q

_SPACE = r"\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_DOT = r"[^\n\r\x{2028}\x{2029}]"


def re2(pattern: str, ignore_case: bool = False) -> str:
    """SQL literal of an RE2 pattern with ECMAScript white space and dot."""
    out, i, inside = ["(?i)" if ignore_case else ""], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            c = pattern[i]
            inside = (inside or c == "[") and c != "]"
            out.append(_DOT if c == "." and not inside else c)
            i += 1
    return q("".join(out))


def has(column: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({column}, {re2(pattern, ignore_case)})"


def trim(column: str) -> str:
    return f"regexp_replace({column}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def redact(column: str) -> str:
    pattern = "['\"][A-Za-z0-9+/=_-]{10,}['\"]"
    return f"regexp_replace({column}, {q(pattern)}, '\"[REDACTED]\"', 'g')"


# ---- path conditions -------------------------------------------------------------------------

VISIBLE = r"NOT regexp_matches(path, '(^|/)\.')"
NOT_IGNORED = (
    "NOT regexp_matches(path, '(^|/)(node_modules|dist|build|\\.next|\\.nuxt|coverage|\\.git|"
    "vendor|__pycache__)/|\\.min\\.js$|\\.min\\.css$|\\.bundle\\.js$')"
)
NOT_TEST = "NOT regexp_matches(path, '\\.(test|spec)\\.[^/]*$|(^|/)(__tests__|tests)/')"
IS_TEST_FILE = (
    f"({VISIBLE} AND regexp_matches(path, '\\.(test|spec)\\.(ts|tsx|js|jsx)$') "
    "AND NOT regexp_matches(path, '(^|/)(node_modules|dist)/'))"
)


def walk(exts: str, tests: bool = True) -> str:
    parts = [f"regexp_matches(path, '\\.({exts})$')", VISIBLE, NOT_IGNORED]
    return "(" + " AND ".join(parts + ([] if tests else [NOT_TEST])) + ")"


CODE = walk("ts|tsx|js|jsx", tests=False)
WALKED = walk("ts|tsx|js|jsx|vue|mjs|cjs")
SECURE_WALK = walk("ts|tsx|js|jsx|json|env|yaml|yml")
SECURE = f"({SECURE_WALK} AND NOT contains(path, '.lock') AND NOT path LIKE '%.min.js')"
SECRETS = f"({SECURE} AND NOT contains(path, '.env.example') AND NOT contains(path, '.env.sample'))"
MARKUP = f"({walk('html|htm|vue|svelte')} OR {walk('tsx|jsx', tests=False)})"
JSX = walk("tsx|jsx", tests=False)
NODE = walk("ts|js", tests=False)
REACT = (
    f"({CODE} AND (regexp_matches(path, '\\.(tsx|jsx)$') OR contains(content, 'React') "
    "OR contains(content, 'jsx')))"
)
TYPED = walk("ts|tsx", tests=False)

# ---- issue rows --------------------------------------------------------------------------------

ISSUE_COLUMNS = (
    "repo_id", "category", "severity", "rule", "title", "file", "line", "id", "description",
    "fix_text", "fix_before", "fix_after", "automated", "cat", "phase", "opath", "grp", "k1", "k2",
)


def _fill(template: str | None) -> str:
    """SQL text of a catalogue template."""
    if template is None:
        return "CAST(NULL AS VARCHAR)"
    values = {
        "file": "path", "line": "CAST(line AS VARCHAR)", "i": "CAST(line - 1 AS VARCHAR)",
        "n": "CAST(n AS VARCHAR)", "name": "name", "trim": trim("text"), "red": redact("text"),
        "after": "after",
    }
    parts = re.split("(" + "|".join("{%s}" % v for v in values) + ")", template)
    return " || ".join(
        values[p[1:-1]] if p[:1] == "{" and p[1:-1] in values else q(p) for p in parts if p
    ) or "''"


# Rewritten line of a rule, as SQL over the trimmed line.
AFTER = {
    "no-sync-fs": f"{trim('regexp_replace(%s, {})'.format(q('Sync' + chr(92) + 'b') + ', ' + q('')) % trim('text'))}",
    "interactive-element-semantics":
        f"regexp_replace(regexp_replace({trim('text')}, '<div', '<button'), '</div>', '</button>')",
    "img-alt": f"regexp_replace({trim('text')}, '<img\\b', '<img alt=\"Description of image\"')",
    "label-for-input":
        f"regexp_replace({trim('text')}, '<input\\b', '<input aria-label=\"Field description\"')",
    "button-aria-label":
        f"regexp_replace({trim('text')}, '<button\\b', '<button aria-label=\"Action description\"')",
    "html-has-lang": f"regexp_replace({trim('text')}, '<html\\b', '<html lang=\"en\"')",
}


def issue_sql(key: str, source: str, shift: str = "0", opath: str = "path") -> str:
    """Issue rows of one catalogue kind from SQL that yields evidence columns
    (`repo_id, path, line, n, name, text, k1, k2`)."""
    k: Kind = CATALOGUE[INDEX[key]]
    severity = q(k.severity)
    if k.bump_over is not None:
        severity = f"CASE WHEN n > {k.bump_over} THEN {q(k.bump_to)} ELSE {severity} END"
    automated = "CAST(NULL AS BOOLEAN)" if k.fix is None else str(k.automated).upper()
    return f"""SELECT repo_id, {q(k.category)} AS category, {severity} AS severity,
  {q(k.rule)} AS rule, {q(k.title)} AS title, path AS file, CAST(line AS INTEGER) AS line,
  repo_id || ':' || {_fill(k.id)} AS id, {_fill(k.description)} AS description,
  {_fill(k.fix)} AS fix_text, {_fill(k.before)} AS fix_before, {_fill(k.after)} AS fix_after,
  {automated} AS automated, {k.cat} AS cat, {k.phase} + {shift} AS phase, {opath} AS opath,
  {k.grp} AS grp, CAST(k1 AS INTEGER) AS k1, CAST(k2 AS INTEGER) AS k2
FROM (SELECT *, {AFTER.get(key, "''")} AS after FROM ({source}))"""


def evidence(
    source: str, where: str = "TRUE", line: str = "NULL", n: str = "NULL", name: str = "NULL",
    text: str = "NULL", k1: str = "0", k2: str = "0", path: str = "path",
) -> str:
    return (
        f"SELECT repo_id, {path} AS path, {line} AS line, CAST({n} AS BIGINT) AS n, "
        f"CAST({name} AS VARCHAR) AS name, CAST({text} AS VARCHAR) AS text, {k1} AS k1, "
        f"{k2} AS k2 FROM {source} WHERE {where}"
    )


def on_lines(scope: str, condition: str, k2: int = 0, source: str = "lines", **more) -> str:
    args = dict(line="line_no", text="line", k1="line_no", k2=str(k2)) | more
    return evidence(source, f"{scope} AND ({condition})", **args)


def on_files(scope: str, condition: str, source: str = "filled", **more) -> str:
    return evidence(source, f"{scope} AND ({condition})", **more)
