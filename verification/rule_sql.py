"""SQL counterpart of every rule: evidence per catalogue kind."""

from __future__ import annotations

from lintlake.operators.catalogue import (
    API_CALL, CATALOGUE, COMMAND_INJECTION, COMPLEXITY, CONSOLE, DEBUGGER, FUNCTION_NAME,
    HEAVY_DEPENDENCIES, PAGE_IMPORT, SECRETS, SQL_INJECTION, TEST_BLOCK, TODO, UNSAFE_EVAL, XSS,
)
from verification.corpus import LINES_SQL, q
from verification.sqltools import (
    CODE, IS_TEST_FILE, JSX, MARKUP, NODE, REACT, SECRETS as SECRET_FILES, SECURE, TYPED, WALKED,
    evidence, has, issue_sql, on_files, on_lines, re2,
)

# Files with content, lines with their neighbours, and the content of their file.
BASE = LINES_SQL + """,
filled AS (SELECT *, string_split(content, chr(10)) AS ls FROM files WHERE content <> ''),
near AS (
  SELECT *,
    string_agg(line, chr(10)) OVER (w ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS next10,
    string_agg(line, ' ') OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS next3,
    string_agg(line, '') OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS next5,
    coalesce(string_agg(line, chr(10)) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), '')
      AS prev20
  FROM lines WINDOW w AS (PARTITION BY repo_id, path ORDER BY line_no)
)"""

_WITH_TEXT = "(SELECT l.*, f.content FROM {} l JOIN filled f USING (repo_id, path))"
NEAR_TEXT = _WITH_TEXT.format("near")
_NOT_COMMENT = "NOT " + has("line", r"^\s*(//|#)")
_NOT_SLASHES = "NOT " + has("line", r"^\s*//")

_HEADING = "CAST(nullif(regexp_extract(line, '(?i)<h([1-6])\\b', 1), '') AS INTEGER)"


def _second(name: str, pattern: str, scope: str) -> str:
    """Names that occur twice in a file, placed at their second occurrence."""
    return f"""(SELECT repo_id, path, name, list_sort(list(i))[2] - 1 AS second FROM (
      SELECT repo_id, path, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM (
        SELECT repo_id, path, regexp_extract_all(content, {re2(pattern)}, 1) AS names
        FROM filled WHERE {scope})) GROUP BY 1, 2, 3 HAVING count(*) > 1)"""


def _depth() -> str:
    return f"""(SELECT repo_id, path, max(s - least(0, low)) AS depth FROM (
      SELECT *, min(s) OVER (PARTITION BY repo_id, path ORDER BY i) AS low FROM (
        SELECT repo_id, path, i, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END)
          OVER (PARTITION BY repo_id, path ORDER BY i) AS s
        FROM (SELECT repo_id, path, unnest(b) AS c, generate_subscripts(b, 1) AS i FROM (
          SELECT repo_id, path, regexp_extract_all(content, '[{{}}]') AS b
          FROM filled WHERE {CODE})))) GROUP BY 1, 2)"""


def _first_line(condition: str, scope: str, source: str = "lines") -> str:
    return (
        f"(SELECT repo_id, path, min(line_no) AS at_line, arg_min(line, line_no) AS line FROM {source} "
        f"WHERE {scope} AND {condition} GROUP BY 1, 2)"
    )


_NEXT = f"""(SELECT repo_id, path, arg_min(kind, line_no) AS kind, min(line_no) AS at_line,
    arg_min(line, line_no) AS line FROM (
  SELECT *, CASE WHEN {has('line', r'<img' + chr(92) + 'b', True)}
      AND NOT regexp_matches(content, 'next/image|Image from') THEN 'img'
    WHEN {has('line', r'<a' + chr(92) + r's+href=')} AND NOT contains(line, 'http')
      AND NOT regexp_matches(content, 'next/link|Link from') THEN 'link' END AS kind
  FROM {_WITH_TEXT.format('lines')} WHERE {CODE}) WHERE kind IS NOT NULL GROUP BY 1, 2)"""

FACTS = f"""(SELECT repo_id,
  count(*) FILTER ({CODE}) AS n_code, count(*) FILTER ({WALKED}) AS n_walked,
  count(*) FILTER ({WALKED} AND regexp_matches(path, '^(src/)?[^/]*$')) AS n_flat,
  count(*) FILTER ({IS_TEST_FILE}) AS n_tests,
  bool_or(path LIKE 'src/%') AS has_src, bool_or(path = 'README.md') AS has_readme,
  bool_or(path = '.env') AS has_env,
  bool_or(path IN ('.env.example', '.env.sample')) AS has_example
  FROM files GROUP BY 1)"""

CANDIDATES = f"""(SELECT repo_id, path, unnest([stem || '.test' || ext, stem || '.spec' || ext,
    dir || '__tests__/' || name || '.test' || ext, dir || '__tests__/' || name || '.spec' || ext,
    dir || 'tests/' || name || '.test' || ext]) AS candidate,
    unnest([0, 1, 2, 3, 4]) AS pos
  FROM (SELECT repo_id, path, regexp_extract(path, '\\.[^./]+$') AS ext,
          regexp_replace(path, '\\.[^./]+$', '') AS stem,
          regexp_replace(path, '[^/]*$', '') AS dir,
          regexp_extract(regexp_replace(path, '\\.[^./]+$', ''), '[^/]*$') AS name
        FROM files WHERE {CODE}))"""
COVERED = f"""(SELECT c.repo_id, c.path, max(CASE WHEN f.path IS NULL THEN 0 ELSE 1 END) AS tested,
    min(CASE WHEN pos = 0 THEN candidate END) AS first,
    regexp_matches(c.path, '(?i)auth|login|register|password|payment|checkout|database|db|api|'
      || 'middleware|controller|service|repository') AS critical
  FROM {CANDIDATES} c LEFT JOIN files f ON f.repo_id = c.repo_id AND f.path = c.candidate
  GROUP BY 1, 2)"""
RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rn
  FROM {COVERED} WHERE tested = 0)"""
COVERAGE = f"""(SELECT repo_id, count(*) AS sources, sum(1 - tested) AS untested,
    count(*) FILTER (tested = 0 AND critical) AS untested_critical,
    floor(sum(tested) / count(*) * 100 + 0.5) AS coverage
  FROM {COVERED} GROUP BY 1)"""

DEPS = """(SELECT repo_id, name, coalesce(json_extract_string(dev, '$."' || name || '"'),
    json_extract_string(run, '$."' || name || '"')) AS range,
    list_contains(json_keys(dev), name) AS is_dev
  FROM (SELECT repo_id, run, dev,
      unnest(list_distinct(list_concat(json_keys(run), json_keys(dev)))) AS name
    FROM (SELECT repo_id, json_extract(content, '$.dependencies') AS run,
            json_extract(content, '$.devDependencies') AS dev
          FROM files WHERE path = 'package.json' AND json_valid(content))))"""
RUN_DEPS = """(SELECT repo_id, unnest(json_keys(json_extract(content, '$.dependencies'))) AS name
  FROM files WHERE path = 'package.json' AND json_valid(content))"""

RULES: dict[str, str] = {
    "max-file-size": on_files(CODE, "len(ls) > 500", n="len(ls)"),
    "no-console": on_lines(CODE, has("line", CONSOLE), 0),
    "no-debugger": on_lines(CODE, has("line", DEBUGGER), 1),
    "no-todo": on_lines(CODE, has("line", TODO, True), 2),
    "max-depth": evidence(_depth(), "depth > 4", n="depth"),
    "no-duplicate-functions": evidence(
        _second("name", FUNCTION_NAME, CODE), name="name", k1="second"
    ),
    **{
        f"secret-{k}": on_lines(SECRET_FILES, f"{has('line', p, ci)} AND {_NOT_COMMENT}")
        for k, (_, p, ci, _) in enumerate(SECRETS)
    },
    **{f"sql-{k}": on_lines(SECURE, has("line", p, True)) for k, p in enumerate(SQL_INJECTION)},
    **{f"xss-{k}": on_lines(SECURE, has("line", p)) for k, p in enumerate(XSS)},
    **{
        f"command-{k}": on_lines(SECURE, has("line", p, ci))
        for k, (p, ci) in enumerate(COMMAND_INJECTION)
    },
    **{
        f"eval-{k}": on_lines(SECURE, f"{has('line', p)} AND {_NOT_SLASHES}")
        for k, p in enumerate(UNSAFE_EVAL)
    },
    "csrf-protection": on_files(
        SECURE,
        "(path LIKE '%.ts' OR path LIKE '%.js') AND "
        + has("content", r"app\.(post|put|patch|delete)\s*\(")
        + " AND NOT regexp_matches(content, 'csrf|csurf|doubleCsrf|sameSite')",
    ),
    **{
        f"heavy-{k}": evidence(
            f"(SELECT DISTINCT repo_id FROM {RUN_DEPS} WHERE starts_with(name, {q(name)}))",
            path="'package.json'",
        )
        for k, (name, _, _) in enumerate(HEAVY_DEPENDENCIES)
    },
    "no-nested-loops": on_files(
        CODE, has("content", r"for\s*\([^)]+\)\s*\{[^}]*for\s*\([^)]+\)\s*\{"),
        line="list_position(list_transform(ls, lambda x: " + has("x", r"\bfor\s*\(") + "), TRUE)",
    ),
    "react-memo": on_files(
        REACT,
        "len(ls) > 50 AND " + has("content", r"export\s+default\s+function") + " AND "
        + has("content", r"return\s*\(?\s*<")
        + " AND NOT regexp_matches(content, 'React\\.memo|memo\\(')",
    ),
    "exhaustive-deps": on_lines(
        REACT,
        has("line", r"useEffect\s*\(") + " AND " + has("next10", r",\s*\[\s*\]\s*\)") + " AND "
        + has("next10", r"\b[a-z]\w+\s*\("),
        source=NEAR_TEXT,
    ),
    "react-usememo": on_files(
        REACT,
        "len(ls) > 30 AND " + has("content", r"\.filter\(.*\)\.map\(|\.reduce\(")
        + " AND NOT " + has("content", r"useMemo\s*\("),
    ),
    "react-lazy-routes": evidence(
        _first_line(
            has("line", PAGE_IMPORT) + " AND NOT regexp_matches(line, 'lazy|dynamic|Suspense')",
            REACT, NEAR_TEXT,
        ),
        line="at_line", text="line", k1="at_line",
        name="regexp_extract(line, 'import\\s+(\\w+)', 1)",
    ),
    "no-duplicate-api-calls": evidence(
        _second("name", API_CALL, REACT), name="name", k1="second"
    ),
    "no-sync-fs": on_lines(
        CODE, "regexp_matches(line, 'readFileSync|writeFileSync|existsSync|mkdirSync')"
    ),
    "img-alt": on_lines(
        MARKUP, has("line", r"<img\b", True) + " AND NOT " + has("line", r"\balt\s*=", True), 0
    ),
    "label-for-input": on_lines(
        MARKUP,
        has("line", r"<input\b", True) + " AND NOT "
        + has("line", r"type\s*=\s*['\"](?:hidden|submit|reset|button|image)['\"]") + " AND NOT "
        + has("line", r"\b(?:aria-label|aria-labelledby|id)\s*="), 1,
    ),
    "interactive-element-semantics": on_lines(
        MARKUP,
        has("line", r"<div\b[^>]*onClick", True) + " AND NOT " + has("line", r"role\s*=")
        + " AND NOT contains(line, 'tabIndex')", 2,
    ),
    "button-aria-label": on_lines(
        MARKUP,
        has("line", r"<button\b[^>]*>", True) + " AND NOT " + has("line", r">.*?</button>")
        + " AND NOT " + has("next3", r">\s*[A-Za-z]")
        + " AND NOT regexp_matches(next3, 'aria-label')", 3, source="near",
    ),
    "html-has-lang": on_lines(
        MARKUP, has("line", r"<html\b", True) + " AND NOT " + has("line", r"\blang\s*="), 4
    ),
    "heading-order": on_lines(
        MARKUP,
        f"{_HEADING} > 2 AND NOT CASE {_HEADING} "
        + " ".join(f"WHEN {n} THEN {has('prev20', f'<h{n - 1}' + chr(92) + 'b', True)}"
                   for n in (3, 4, 5, 6)) + " END",
        5, source="near", n=_HEADING, name=f"{_HEADING} - 1",
    ),
    "focus-visible": on_lines(
        MARKUP,
        has("line", r"outline\s*:\s*0|outline\s*:\s*none")
        + " AND NOT contains(line, 'focus-visible')", 6,
    ),
    "no-untested-critical": evidence(RANKED, "critical", name="first"),
    "missing-test": evidence(RANKED, "rn <= 20 AND NOT critical", name="first"),
    "low-coverage": evidence(COVERAGE, "coverage < 50", n="coverage", path="'project-wide'"),
    "medium-coverage": evidence(
        COVERAGE, "coverage >= 50 AND coverage < 70", n="coverage", path="'project-wide'"
    ),
    "no-empty-tests": on_files(
        IS_TEST_FILE, "NOT " + has("content", r"\b(?:it|test)\s*\(")
    ),
    "require-assertions": on_files(
        IS_TEST_FILE,
        f"len(list_filter(regexp_extract_all(content, {re2(TEST_BLOCK)}), "
        "lambda b: NOT regexp_matches(b, 'expect|assert|should'))) > 0",
    ),
    "no-tests": evidence(FACTS, "n_tests = 0 AND n_code > 5", path="'project-wide'"),
    "src-directory": evidence(FACTS, "NOT has_src AND n_walked > 5", path="'.'"),
    "layer-separation": on_files(
        WALKED,
        "regexp_matches(path, '(?i)controller|route') AND NOT contains(path, '__tests__') AND ("
        + has("content", r"from\s+['\"].*repository", True) + " OR "
        + has("content", r"from\s+['\"].*(?:db|database|prisma|mongoose|typeorm)", True)
        + ") AND NOT regexp_matches(content, '(?i)service')",
    ),
    "folder-structure": evidence(FACTS, "n_flat > 10", n="n_flat", path="'.'"),
    "module-size": evidence(FACTS, "n_walked > 200", n="n_walked", path="'.'"),
    "require-readme": evidence(FACTS, "NOT has_readme", path="'README.md'"),
    "require-env-example": evidence(FACTS, "has_env AND NOT has_example", path="'.env'"),
    "react-key": on_lines(
        JSX, has("line", r"\.map\s*\(") + " AND NOT contains(next5, 'key=')", 0, source="near"
    ),
    "react-prop-drilling": on_lines(
        JSX, "len(regexp_extract_all(line, '\\bprops\\.\\w+')) > 3", 1,
        n="len(regexp_extract_all(line, '\\bprops\\.\\w+'))",
    ),
    "react-use-reducer": on_files(
        JSX,
        f"len(regexp_extract_all(content, {re2(chr(92) + 'buseState' + chr(92) + 's*' + chr(92) + '(')})) > 5 "
        "AND NOT contains(content, 'useReducer')",
        n=f"len(regexp_extract_all(content, {re2(chr(92) + 'buseState' + chr(92) + 's*' + chr(92) + '(')}))",
        k2="2",
    ),
    "next-img": evidence(_NEXT, "kind = 'img'", line="at_line", text="line", k1="at_line"),
    "next-link": evidence(_NEXT, "kind = 'link'", line="at_line", text="line", k1="at_line"),
    "node-promise": on_lines(
        NODE, has("line", r"\.then\s*\(") + " AND NOT contains(next5, '.catch(')", 0, source="near"
    ),
    "node-middleware": evidence(
        _first_line(
            has("line", r"app\.use\s*\(")
            + " AND NOT contains(content, '(err, req, res, next)') AND contains(content, 'express')",
            NODE, NEAR_TEXT,
        ),
        k1="at_line", k2="1",
    ),
}
# ---- tokens ------------------------------------------------------------------------------------

_DOUBLE = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'
_SINGLE = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"


def _template(levels: int) -> str:
    if not levels:
        return r"`[^`\\]*(?:\\[\s\S][^`\\]*)*`"
    return r"`(?:[^`\\$]|\\[\s\S]|\$\{" + _hole(levels) + r"\}|\$)*`"


def _hole(levels: int) -> str:
    braces = r"|\{" + _hole(levels - 1) + r"\}" if levels > 1 else ""
    return r"""(?:[^{}`'"]|""" + f"{_DOUBLE}|{_SINGLE}|{_template(levels - 1)}{braces})*"


# A regex literal is matched together with the operator or word before it, and split off below.
_AHEAD = (
    r"(?:=>|[(,=:\[!&|?{;~^*%]|return|typeof|case|in|of|delete|void|throw|do|else|await|yield)"
)
_IN_REGEX = r"\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\]"
_REGEX = rf"/(?:[^/*\\\[\n]|{_IN_REGEX})(?:[^/\\\[\n]|{_IN_REGEX})*/[A-Za-z]*"
_TOKEN = (
    rf"[\s\x0b]*(?:{_AHEAD}[\s\x0b]*{_REGEX}"
    r"|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|//[^\n]*"
    rf"|{_DOUBLE}|{_SINGLE}|{_template(3)}"
    r"|=>|[A-Za-z_$][A-Za-z0-9_$]*|[^\s\x0b])"
)
_PAIR = rf"^([\s\x0b]*{_AHEAD})([\s\x0b]*/[\s\S]*)$"
_BREAKS = "(length({0}) - length(replace({0}, chr(10), '')))"

TOKENS = f"""tokens AS MATERIALIZED (
  SELECT repo_id, path, pos, tok, length(tok) AS size,
    CAST(1 + sum({_BREAKS.format('raw')}) OVER w - {_BREAKS.format('tok')} AS INTEGER) AS line_no,
    CAST(sum(length(raw)) OVER w - length(tok) AS INTEGER) AS start
  FROM (SELECT *, regexp_replace(raw, '^[\\s\\x0b]+', '') AS tok FROM (
    SELECT repo_id, path, unnest(t) AS raw, generate_subscripts(t, 1) - 1 AS pos FROM (
      SELECT repo_id, path, flatten(list_transform(regexp_extract_all(content, {q(_TOKEN)}),
        lambda x: CASE WHEN regexp_matches(x, {q(_PAIR)})
          THEN [regexp_extract(x, {q(_PAIR)}, 1), regexp_extract(x, {q(_PAIR)}, 2)] ELSE [x] END)) AS t
      FROM filled WHERE {TYPED})))
  WINDOW w AS (PARTITION BY repo_id, path ORDER BY pos)
),
code_tokens AS MATERIALIZED (
  SELECT *, b.c0 + b.c1 + b.c2 - b.own AS depth,
    CASE kind WHEN '{{' THEN b.c0 WHEN '(' THEN b.c1 ELSE b.c2 END
      - CASE WHEN opens THEN 1 ELSE 0 END AS level
  FROM (
    SELECT *, tok IN ('{{', '(', '[') AS opens,
      CASE WHEN tok IN ('{{', '}}') THEN '{{' WHEN tok IN ('(', ')') THEN '('
           WHEN tok IN ('[', ']') THEN '[' END AS kind,
      {{'c0': sum(CASE tok WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w,
        'c1': sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w,
        'c2': sum(CASE tok WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w,
        'own': CASE WHEN tok IN ('{{', '(', '[') THEN 1 WHEN tok IN ('}}', ')', ']') THEN -1
               ELSE 0 END}} AS b,
      lag(tok, 1) OVER v AS prev1, lead(tok, 1) OVER v AS next1, lead(tok, 2) OVER v AS next2,
      row_number() OVER v AS rn
    FROM tokens WHERE NOT starts_with(tok, '//') AND NOT starts_with(tok, '/*')
    WINDOW v AS (PARTITION BY repo_id, path ORDER BY pos),
      w AS (PARTITION BY repo_id, path ORDER BY pos ROWS UNBOUNDED PRECEDING))
)"""

# The partner is the nearest later bracket of the pair group, if that one closes.
BRACKETS = """brackets AS MATERIALIZED (
  SELECT o.repo_id, o.path, o.kind, o.pos AS open_pos, o.line_no AS open_line, o.start AS open_start,
    o.rn AS open_rn, o.depth,
    CASE WHEN NOT c.opens THEN c.pos END AS close_pos,
    CASE WHEN NOT c.opens THEN c.line_no END AS close_line,
    CASE WHEN NOT c.opens THEN c.start + c.size END AS close_stop,
    CASE WHEN NOT c.opens THEN c.rn END AS close_rn
  FROM (SELECT * FROM code_tokens WHERE opens) o
  ASOF LEFT JOIN (SELECT * FROM code_tokens WHERE kind IS NOT NULL) c
    ON o.repo_id = c.repo_id AND o.path = c.path AND o.kind = c.kind AND o.level = c.level
    AND o.pos < c.pos
)"""

_STARTERS = (
    "('const', 'let', 'var', 'function', 'export', 'import', 'class', 'if', 'for', 'while', "
    "'return', 'type', 'interface', 'switch', 'throw', 'try')"
)
_MODS = "('export', 'default', 'async')"

SPANS = BRACKETS + f""",
bodies AS (SELECT * FROM brackets WHERE kind = '{{' AND close_pos IS NOT NULL),
by_rn AS (SELECT *, start + size AS stop FROM code_tokens),
ends AS (
  SELECT t.*, p.stop AS prev_stop, p.line_no AS prev_line
  FROM code_tokens t LEFT JOIN by_rn p
    ON p.repo_id = t.repo_id AND p.path = t.path AND p.rn = t.rn - 1
  WHERE t.tok IN (',', ';') OR (t.kind IS NOT NULL AND NOT t.opens)
    OR (t.tok IN {_STARTERS} AND p.line_no < t.line_no)
),
declared AS (
  SELECT f.repo_id, f.path, f.pos, f.rn, f.line_no, f.start, b.open_pos, b.close_stop, b.close_line,
    CASE WHEN regexp_matches(CASE WHEN f.next1 = '*' THEN f.next2 ELSE f.next1 END, '^[A-Za-z_$]')
      THEN CASE WHEN f.next1 = '*' THEN f.next2 ELSE f.next1 END ELSE 'anonymous' END AS name
  FROM (SELECT * FROM code_tokens WHERE tok = 'function' AND depth = 0) f
  ASOF JOIN (SELECT * FROM bodies WHERE depth = 0) b
    ON f.repo_id = b.repo_id AND f.path = b.path AND f.pos < b.open_pos
),
used AS (
  SELECT d.*, CASE WHEN m1.tok IN {_MODS} AND m2.tok IN {_MODS} AND m3.tok IN {_MODS} THEN 3
    WHEN m1.tok IN {_MODS} AND m2.tok IN {_MODS} THEN 2 WHEN m1.tok IN {_MODS} THEN 1 ELSE 0 END AS mods
  FROM declared d
  LEFT JOIN by_rn m1 ON m1.repo_id = d.repo_id AND m1.path = d.path AND m1.rn = d.rn - 1
  LEFT JOIN by_rn m2 ON m2.repo_id = d.repo_id AND m2.path = d.path AND m2.rn = d.rn - 2
  LEFT JOIN by_rn m3 ON m3.repo_id = d.repo_id AND m3.path = d.path AND m3.rn = d.rn - 3
  WHERE NOT EXISTS (SELECT 1 FROM code_tokens s WHERE s.repo_id = d.repo_id AND s.path = d.path
    AND s.tok = ';' AND s.depth = 0 AND s.pos > d.pos AND s.pos < d.open_pos)
),
spans AS MATERIALIZED (
  SELECT u.repo_id, u.path, 'function' AS kind, u.name, u.pos, h.start, u.close_stop AS stop,
    h.line_no, u.close_line AS end_line
  FROM used u
  JOIN by_rn h ON h.repo_id = u.repo_id AND h.path = u.path AND h.rn = u.rn - u.mods
  LEFT JOIN by_rn p ON p.repo_id = u.repo_id AND p.path = u.path AND p.rn = u.rn - u.mods - 1
  WHERE p.tok IS NULL OR p.tok IN (';', '}}')
    OR (p.line_no < h.line_no AND regexp_matches(p.tok, '[A-Za-z0-9_$)\\]''"`]$|^/.'))
  UNION ALL
  SELECT a.repo_id, a.path, 'arrow', 'anonymous', a.pos,
    coalesce(CASE WHEN b1.tok = ')' THEN q1.open_start
      WHEN regexp_matches(b1.tok, '^[A-Za-z_$]') AND b2.tok = ':' AND b3.tok = ')'
      THEN q3.open_start END, b1.start),
    CASE WHEN n.close_pos IS NOT NULL THEN n.close_stop ELSE coalesce(e.prev_stop, 2147483647) END,
    coalesce(CASE WHEN b1.tok = ')' THEN q1.open_line
      WHEN regexp_matches(b1.tok, '^[A-Za-z_$]') AND b2.tok = ':' AND b3.tok = ')'
      THEN q3.open_line END, b1.line_no),
    CASE WHEN n.close_pos IS NOT NULL THEN n.close_line ELSE coalesce(e.prev_line, a.line_no) END
  FROM (SELECT * FROM code_tokens WHERE tok = '=>') a
  ASOF LEFT JOIN ends e ON e.repo_id = a.repo_id AND e.path = a.path AND e.depth = a.depth
    AND a.pos < e.pos
  JOIN by_rn b1 ON b1.repo_id = a.repo_id AND b1.path = a.path AND b1.rn = a.rn - 1
  LEFT JOIN by_rn b2 ON b2.repo_id = a.repo_id AND b2.path = a.path AND b2.rn = a.rn - 2
  LEFT JOIN by_rn b3 ON b3.repo_id = a.repo_id AND b3.path = a.path AND b3.rn = a.rn - 3
  LEFT JOIN brackets q1 ON q1.repo_id = a.repo_id AND q1.path = a.path AND q1.close_rn = a.rn - 1
  LEFT JOIN brackets q3 ON q3.repo_id = a.repo_id AND q3.path = a.path AND q3.close_rn = a.rn - 3
  LEFT JOIN brackets n ON n.repo_id = a.repo_id AND n.path = a.path AND n.open_rn = a.rn + 1
    AND n.kind IN ('{{', '(')
),
measured AS MATERIALIZED (
  SELECT *, end_line - line_no + 1 AS n_lines, 1 + {' + '.join(
      f"len(regexp_extract_all(body, {re2(p)}))" for p in COMPLEXITY)} AS complexity
  FROM (SELECT s.*, substring(content, s.start + 1, s.stop - s.start) AS body
        FROM spans s JOIN filled USING (repo_id, path))
)"""

_K1 = "pos + CASE kind WHEN 'arrow' THEN 1073741824 ELSE 0 END"
_TYPE_USE = """tok = 'any' AND (prev1 IN (':', '<', '|', '&', 'as', '=>', 'is', 'keyof', 'extends',
  'satisfies') OR (prev1 = ',' AND next1 = '>') OR (prev1 = '=' AND next1 IN (';', '[', '|')))"""
_STARTS = """(prev1 IN ('const', 'let', 'var') OR (prev1 = ',' AND inside = 'd' AND phase = 'v'))"""
_NAMES = f"""(SELECT repo_id, path, pos, line_no, tok AS name, coalesce(
    (depth = 0 AND {_STARTS} AND tok NOT IN ('const', 'let', 'var'))
    OR (depth > 0 AND pattern = 'p' AND coalesce(next1 <> ':', TRUE)
        AND (prev1 IN ('{{', '[', ',', ':') OR (prev1 = '.' AND prev2 = '.'))), FALSE) AS declares,
    coalesce(depth > 0 AND (prev1 IN ('const', 'let', 'var', 'function', 'class', '(', ',')
      OR (prev1 = '.' AND prev2 = '.')), FALSE) AS binds,
    coalesce((prev1 = '.' AND coalesce(prev2 <> '.', TRUE)) OR (prev1 IN ('{{', ',', '(', ';')
      AND (next1 = ':' OR (next1 = '?' AND next2 = ':'))), FALSE) AS label
  FROM (
    SELECT *, last_value(CASE WHEN depth = 0 THEN CASE WHEN tok IN ('{{', '[') AND {_STARTS}
        THEN 'p' ELSE 'x' END END IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY pos) AS pattern
    FROM (
      SELECT *, last_value(CASE WHEN depth > 0 THEN NULL WHEN tok IN ('const', 'let', 'var') THEN 'd'
            WHEN tok = ';' OR tok IN ('function', 'export', 'import', 'class', 'if', 'for', 'while',
              'return', 'type', 'interface', 'switch', 'throw', 'try') THEN 's' END IGNORE NULLS)
          OVER (PARTITION BY repo_id, path ORDER BY pos) AS inside,
        last_value(CASE WHEN depth > 0 THEN NULL WHEN tok IN ('const', 'let', 'var', '=') THEN 'v'
            WHEN tok = ':' AND prev2 IN ('const', 'let', 'var', ',') THEN 't' END IGNORE NULLS)
          OVER (PARTITION BY repo_id, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          AS phase
      FROM (SELECT *, lag(tok, 2) OVER (PARTITION BY repo_id, path ORDER BY pos) AS prev2
            FROM code_tokens)))
  WHERE regexp_matches(tok, '^[A-Za-z_$]')
  UNION ALL
  SELECT repo_id, path, pos, line_no, unnest(regexp_extract_all(hole, '[A-Za-z_$][A-Za-z0-9_$]*')),
    FALSE, FALSE, FALSE
  FROM (SELECT *, unnest(CASE WHEN length(tok) - length(replace(tok, '`', '')) > 2 THEN [tok]
          ELSE regexp_extract_all(tok, '\\$\\{{([^}}]*)\\}}', 1) END) AS hole
        FROM code_tokens WHERE starts_with(tok, '`')))"""
# Blocks that declare a name anew: by a declaration whose nearest open bracket is the block's, or in the
# parameter list before the block.
_HIDDEN = """(SELECT t.repo_id, t.path, t.tok AS name, b.open_pos AS lo, b.close_pos AS hi
  FROM code_tokens t JOIN brackets b ON b.repo_id = t.repo_id AND b.path = t.path AND b.kind = '{'
    AND b.depth = t.depth - 1 AND t.pos BETWEEN b.open_pos AND b.close_pos
  WHERE t.prev1 IN ('const', 'let', 'var', 'function', 'class') AND regexp_matches(t.tok, '^[A-Za-z_$]')
  UNION ALL
  SELECT t.repo_id, t.path, t.tok, g.open_pos, b.close_pos
  FROM brackets g
  JOIN code_tokens o ON o.repo_id = g.repo_id AND o.path = g.path AND o.rn = g.open_rn
  JOIN code_tokens n ON n.repo_id = g.repo_id AND n.path = g.path AND n.rn = g.close_rn + 1
  JOIN brackets b ON b.repo_id = g.repo_id AND b.path = g.path AND b.kind = '{'
    AND b.open_rn = CASE WHEN n.tok = '=>' THEN g.close_rn + 2 ELSE g.close_rn + 1 END
  JOIN (SELECT *, lag(tok, 2) OVER (PARTITION BY repo_id, path ORDER BY pos) AS prev2 FROM code_tokens) t
    ON t.repo_id = g.repo_id AND t.path = g.path AND t.depth = g.depth + 1
    AND t.pos BETWEEN g.open_pos AND g.close_pos
  WHERE g.kind = '(' AND coalesce(o.prev1 NOT IN ('if', 'for', 'while', 'switch', 'with'), TRUE)
    AND (t.prev1 IN ('(', ',') OR (t.prev1 = '.' AND t.prev2 = '.'))
    AND regexp_matches(t.tok, '^[A-Za-z_$]'))"""
_USES = f"""(SELECT * FROM {_NAMES} n WHERE declares OR ((binds OR NOT label) AND NOT EXISTS (
  SELECT 1 FROM {_HIDDEN} h WHERE h.repo_id = n.repo_id AND h.path = n.path AND h.name = n.name
    AND n.pos BETWEEN h.lo AND h.hi)))"""

TOKEN_RULES: dict[str, str] = {
    "max-lines-per-function": evidence(
        "measured", "n_lines > 50", line="line_no", n="n_lines", name="name", k1=_K1, k2="0"
    ),
    "complexity": evidence(
        "measured", "complexity > 10", line="line_no", n="complexity", name="name", k1=_K1, k2="1"
    ),
    "no-unused-vars": evidence(
        f"""(SELECT repo_id, path, name, min(pos) AS pos, min(CASE WHEN declares THEN line_no END)
          AS line_no FROM {_USES} GROUP BY 1, 2, 3 HAVING count(*) = 1)""",
        "line_no IS NOT NULL AND NOT starts_with(name, '_')", line="line_no", name="name", k1="pos",
    ),
    "no-explicit-any": evidence(
        f"(SELECT repo_id, path, count(*) AS c, min(line_no) AS at_line FROM code_tokens "
        f"WHERE {_TYPE_USE} GROUP BY 1, 2)", line="at_line", n="c",
    ),
}

# ---- import cycles -----------------------------------------------------------------------------

IMPORTS = f"""raw_imports AS MATERIALIZED (
  SELECT DISTINCT repo_id, path AS src, dir, spec FROM (
    SELECT repo_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir,
      unnest(regexp_extract_all(content, {re2(chr(102) + 'rom' + chr(92) + "s+['" + chr(34) + "](" + chr(92) + ".[^'" + chr(34) + "]+)['" + chr(34) + "]")}, 1)) AS spec
    FROM filled WHERE {WALKED})
),
imports AS MATERIALIZED (
  SELECT DISTINCT repo_id, src, array_to_string(list_reduce(list_prepend(
      CAST([] AS VARCHAR[]), list_transform(string_split(CASE WHEN dir = '' THEN spec
        ELSE dir || '/' || spec END, '/'), lambda x: [x])),
      lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc
        WHEN x[1] = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[:-2]
        ELSE list_concat(acc, x) END), '/') AS dst
  FROM raw_imports
)"""
EDGES = IMPORTS + f""",
edges AS MATERIALIZED (
  SELECT DISTINCT repo_id, src, arg_min(path, rank) AS dst FROM (
    SELECT i.repo_id, i.src, i.dst, f.path, c.rank FROM imports i, LATERAL (
      SELECT unnest(CASE
        WHEN dst LIKE '%.js' THEN [dst, dst[:-4] || '.ts', dst[:-4] || '.tsx']
        WHEN regexp_matches(dst, '\\.(ts|tsx|jsx|vue|mjs|cjs)$') THEN [dst]
        ELSE [dst, dst || '.ts', dst || '.tsx', dst || '.js', dst || '.jsx', dst || '/index.ts',
          dst || '/index.tsx', dst || '/index.js', dst || '/index.jsx'] END) AS candidate,
        unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS rank) c
    JOIN files f ON f.repo_id = i.repo_id AND f.path = c.candidate AND {WALKED.replace('path', 'f.path')}
    WHERE c.candidate IS NOT NULL) GROUP BY repo_id, src, dst
)"""
CYCLES = EDGES + """,
reach AS (
  WITH RECURSIVE r(repo_id, a, b) AS (
    SELECT repo_id, src, dst FROM edges
    UNION SELECT r.repo_id, r.a, e.dst FROM r JOIN edges e ON e.repo_id = r.repo_id AND e.src = r.b
  ) SELECT * FROM r
),
members AS MATERIALIZED (
  SELECT x.repo_id, x.a AS node, min(x.b) AS label, count(*) AS members
  FROM reach x JOIN reach y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a
  GROUP BY 1, 2
)"""
CYCLE_RULE = evidence(
    """(SELECT m.repo_id, m.label, m.members AS total,
         coalesce(min(e.dst) FILTER (e.dst <> m.label), m.label) AS follow
       FROM (SELECT * FROM members WHERE node = label) m
       JOIN edges e ON e.repo_id = m.repo_id AND e.src = m.label
       JOIN members t ON t.repo_id = m.repo_id AND t.node = e.dst AND t.label = m.label
       GROUP BY 1, 2, 3)""",
    path="label", n="total",
    name="label || ' → ' || follow || CASE total WHEN 1 THEN '' WHEN 2 THEN ' → ' || label "
         "ELSE ' → … (' || CAST(total AS VARCHAR) || ' files)' END",
)

_MARKUP_KEYS = {k.key for k in CATALOGUE if k.category == "accessibility"}
_SHIFT = "CASE WHEN regexp_matches(path, '\\.(tsx|jsx)$') THEN 1 ELSE 0 END"
_PROJECT = {"low-coverage", "medium-coverage", "no-tests", "src-directory", "folder-structure",
            "module-size", "require-readme", "require-env-example"}


def rule_issues(key: str) -> str:
    """Issue rows of one kind (needs the CTEs of its group)."""
    source = RULES.get(key) or TOKEN_RULES.get(key) or CYCLE_RULE
    return issue_sql(
        key, source,
        shift=_SHIFT if key in _MARKUP_KEYS else "0",
        opath="''" if key in _PROJECT else "path",
    )
