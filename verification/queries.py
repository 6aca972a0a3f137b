"""Every operator as a query over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.functions.grades import (
    BAND_CUTS, GRADE_CUTS, grade_band, score_band, score_to_grade,
)
from lintlake.functions.versions import version_key
from lintlake.operators import (
    advisories as adv, architecture, fixes, frameworks, graph, insights, performance, ranking,
    reporting, scoring, security, stack, testing, tokens,
)
from lintlake.operators.catalogue import CATALOGUE, DESIGN_PATTERNS, INDEX, kinds_of
from lintlake.operators.facts import repo_facts
from lintlake.operators.issues import count_by_rule, min_severity, render, union_all
from lintlake.operators.rules import (
    apply_file_rules, apply_first_per_file, apply_line_rules, apply_window_rules,
)
from lintlake.plans import auditing
from lintlake.schema import (
    AUDIT_WEIGHTS, BARE_WEIGHTS, CATEGORIES, FILES_SCHEMA, PENALTIES, SEVERITY_RANK,
)
from lintlake.sources import files as src
from lintlake.sources.sinks import read_issues, write_issues, write_report_json
from lintlake.streaming import watch
from verification import rule_sql as rs
from verification.corpus import (
    ADVISORIES_SQL, FILES_SQL, LINES_SQL, advisories, files, q, session_folder, table,
)
from verification.sqltools import (
    CODE, IS_TEST_FILE, ISSUE_COLUMNS, MARKUP, NOT_IGNORED, NOT_TEST, SECURE_WALK, VISIBLE,
    WALKED, redact, walk,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def over_files(name: str, sql: str | None, run: Callable[[DataFrame], DataFrame]) -> None:
    """A query on the derived file table."""
    query(name, sql)(lambda spark, sf: run(files(spark, sf)))


def flat(issues: DataFrame) -> DataFrame:
    """Issues without nested columns, under the names of the SQL side."""
    return issues.select(
        "repo_id", "category", "severity", "rule", "title", "file", "line", "id", "description",
        F.col("fix.description").alias("fix_text"), F.col("fix.before").alias("fix_before"),
        F.col("fix.after").alias("fix_after"), F.col("fix.automated").alias("automated"),
        F.col("ord.cat").alias("cat"), F.col("ord.phase").alias("phase"),
        F.col("ord.path").alias("opath"), F.col("ord.grp").alias("grp"),
        F.col("ord.k1").alias("k1"), F.col("ord.k2").alias("k2"),
    )


# ---- sources and path filters ------------------------------------------------------------------

_PATHS = lambda cond: f"WITH {FILES_SQL} SELECT repo_id, path FROM files WHERE {cond}"
_paths = lambda keep: lambda f: keep(f).select("repo_id", "path")

_SHORT_IGNORE = (
    "NOT regexp_matches(path, '(^|/)(node_modules|dist|build|\\.next|coverage)/|\\.min\\.js$|"
    "\\.bundle\\.js$')"
)
_DEFAULT = "regexp_matches(path, '\\.(ts|tsx|js|jsx|vue|mjs|cjs)$')"

over_files("files", f"WITH {FILES_SQL} SELECT * FROM files", lambda f: f)
over_files("filter_extensions", _PATHS(_DEFAULT), _paths(src.filter_extensions))
over_files(
    "exclude_globs", _PATHS(f"{NOT_IGNORED} AND NOT regexp_matches(path, '^src/(ui|db)/[^/]*$')"),
    _paths(lambda f: src.exclude_globs(f, ("src/{ui,db}/*",))),
)
over_files("exclude_tests", _PATHS(NOT_TEST), _paths(src.exclude_tests))
over_files("select_templates", _PATHS(walk("html|htm|vue|svelte")), _paths(src.select_templates))
over_files("select_test_files", _PATHS(IS_TEST_FILE), _paths(src.select_test_files))
over_files(
    "select_sources",
    _PATHS(f"regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AND {VISIBLE} AND {_SHORT_IGNORE} AND "
           f"{NOT_TEST} AND NOT regexp_matches(path, '\\.stories\\.[^/]*$')"),
    _paths(src.select_sources),
)
over_files(
    "select_tests_wide",
    _PATHS(f"{VISIBLE} AND {_SHORT_IGNORE} AND (regexp_matches(path, "
           "'\\.(test|spec)\\.(ts|tsx|js|jsx)$') OR regexp_matches(path, "
           "'(^|/)__tests__/.*\\.(ts|tsx|js|jsx)$'))"),
    _paths(src.select_tests_wide),
)
over_files(
    "explode_lines", f"WITH {LINES_SQL} SELECT repo_id, path, line_no, line FROM lines",
    src.explode_lines,
)
over_files(
    "file_stats",
    f"""WITH {FILES_SQL} SELECT repo_id, path,
      CAST(len(string_split(coalesce(content, ''), chr(10))) AS INTEGER) AS lines,
      CAST(strlen(coalesce(content, '')) AS INTEGER) AS bytes,
      lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext FROM files""",
    src.file_stats,
)
over_files(
    "parse_manifest",
    f"""WITH {FILES_SQL} SELECT repo_id,
      CAST(coalesce(len(json_keys(content, '$.dependencies')), 0) AS INTEGER) AS n_deps,
      CAST(coalesce(len(json_keys(content, '$.devDependencies')), 0) AS INTEGER) AS n_dev,
      json_extract_string(content, '$.engines.node') AS node_version
      FROM (SELECT repo_id, CASE WHEN json_valid(content) THEN content ELSE '{{}}' END AS content
            FROM files WHERE path = 'package.json')""",
    lambda f: src.parse_manifest(f).select(
        "repo_id", F.size("deps").alias("n_deps"), F.size("dev_deps").alias("n_dev"),
        "node_version",
    ),
)
over_files(
    "extract_deps",
    f"WITH {FILES_SQL} SELECT repo_id, name, range, is_dev FROM {rs.DEPS}",
    lambda f: src.extract_deps(src.parse_manifest(f)),
)
over_files(
    "extract_imports", f"WITH {rs.BASE}, {rs.IMPORTS} SELECT repo_id, src, dst FROM imports",
    src.extract_imports,
)
over_files(
    "resolve_imports", f"WITH {rs.BASE}, {rs.EDGES} SELECT repo_id, src, dst FROM edges",
    graph.resolve_imports,
)
_NAMED = "import\\s+(?:type\\s+)?(?:[\\w$]+\\s*,\\s*)?\\{([^}]*)\\}\\s*from\\s*[''\"]([^''\"]+)[''\"]"
over_files(
    "extract_named_imports",
    f"""WITH {FILES_SQL} SELECT repo_id, path, module, name FROM (
      SELECT repo_id, path, module,
        regexp_extract(unnest(string_split(names, ',')),
          '^\\s*(?:type\\s+)?([A-Za-z0-9_$]+)', 1) AS name
      FROM (SELECT repo_id, path, unnest(regexp_extract_all(content, '{_NAMED}', 1)) AS names,
              unnest(regexp_extract_all(content, '{_NAMED}', 2)) AS module
            FROM files WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AND {VISIBLE}
              AND {NOT_IGNORED})) WHERE name <> ''""",
    src.extract_named_imports,
)

# ---- rules, one query each ---------------------------------------------------------------------

_RULE_SQL = lambda keys, extra="": f"WITH {rs.BASE}{extra} " + "\nUNION ALL\n".join(
    rs.rule_issues(k) for k in keys
)


def _rule_query(name: str, keys: list[str], extra: str = "") -> None:
    """All findings of a group of kinds; only the rules of that group run."""
    wanted = set(keys)

    def run(f: DataFrame) -> DataFrame:
        return flat(render(union_all(_evidence_of(f, wanted))))

    over_files(name, _RULE_SQL(keys, extra), run)


_LINE = [
    r for group in (*auditing.LINE_RULES.values(), *(p[0] for p in frameworks.PACKS.values()))
    for r in group
]
_WHOLE = [
    r
    for group in (*auditing.FILE_RULES.values(), testing.FILE_RULES,
                  *(p[1] for p in frameworks.PACKS.values()))
    for r in group
]


def _evidence_of(f: DataFrame, wanted: set[str]) -> list[DataFrame]:
    frames = []
    lines = [r for r in _LINE if r.kind in wanted]
    whole = [r for r in _WHOLE if wanted & set(r.kinds)]
    if lines:
        frames.append(auditing.with_shift(apply_line_rules(f, lines)))
    if whole:
        rows = apply_file_rules(f, whole)
        frames.append(rows.where(F.col("entry").isin(*[INDEX[k] for k in sorted(wanted)])))
    if wanted & {"max-lines-per-function", "complexity"}:
        rows = tokens.function_evidence(f)
        frames.append(rows.where(F.col("entry").isin(*[INDEX[k] for k in wanted])))
    if "no-unused-vars" in wanted:
        frames.append(tokens.unused_evidence(f))
    if "no-explicit-any" in wanted:
        frames.append(tokens.any_evidence(f))
    if "heavy-0" in wanted:
        frames.append(performance.heavy_dependencies(src.parse_manifest(f)))
    if wanted & {"no-untested-critical", "missing-test"}:
        rows = testing.untested_evidence(testing.source_coverage(f))
        frames.append(rows.where(F.col("entry").isin(*[INDEX[k] for k in wanted])))
    if "low-coverage" in wanted:
        frames.append(testing.coverage_evidence(testing.coverage(f)))
    if "no-tests" in wanted:
        frames.append(testing.no_tests_evidence(repo_facts(f)))
    structure = wanted & {"src-directory", "folder-structure", "module-size", "require-readme",
                          "require-env-example"}
    if structure:
        rows = architecture.structure_evidence(repo_facts(f))
        frames.append(rows.where(F.col("entry").isin(*[INDEX[k] for k in structure])))
    if "no-circular-dependencies" in wanted:
        frames.append(graph.import_cycles(f))
    return frames


_TOKENS = f", {rs.TOKENS}"
_SPANS = f"{_TOKENS}, {rs.SPANS}"
_by_rule = {}
for _kind in CATALOGUE:
    _by_rule.setdefault(_kind.rule, []).append(_kind.key)
_by_rule["require-tests"] = ["missing-test", "no-tests"]
for _name, _keys in _by_rule.items():
    _extra = (
        _SPANS if set(_keys) & {"max-lines-per-function", "complexity"}
        else f"{_TOKENS}, {rs.BRACKETS}" if "no-unused-vars" in _keys
        else _TOKENS if "no-explicit-any" in _keys
        else f", {rs.CYCLES}" if "no-circular-dependencies" in _keys else ""
    )
    _rule_query(_name, _keys, _extra)

# ---- the token table ----------------------------------------------------------------------------

over_files(
    "tokens",
    f"WITH {rs.BASE}{_TOKENS} SELECT repo_id, path, CAST(pos AS INTEGER) AS pos, tok, "
    "CAST(size AS INTEGER) AS size, line_no, start FROM tokens",
    lambda f: tokens.tokens(tokens.typed_sources(f)),
)
over_files(
    "match_brackets",
    f"WITH {rs.BASE}{_TOKENS}, {rs.BRACKETS} SELECT repo_id, path, kind, "
    "CAST(open_pos AS INTEGER) AS open_pos, open_line, CAST(close_pos AS INTEGER) AS close_pos, "
    "close_line FROM brackets",
    lambda f: tokens.match_brackets(tokens.typed_sources(f)),
)
over_files(
    "function_spans",
    f"WITH {rs.BASE}{_SPANS} SELECT repo_id, path, kind, name, CAST(pos AS INTEGER) AS pos, "
    "CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, line_no, end_line FROM spans",
    lambda f: tokens.function_spans(tokens.typed_sources(f)),
)

# ---- rule core ----------------------------------------------------------------------------------

_ALL_LINE_KEYS = [r.kind for rules in auditing.LINE_RULES.values() for r in rules]
_ALL_FILE_KEYS = [k for rules in auditing.FILE_RULES.values() for r in rules for k in r.kinds]
_WINDOW_KEYS = [r.kind for r in _LINE if r.near]
_COUNTS = "SELECT category, rule, severity, count(*) AS n FROM ({}) GROUP BY ALL"


def _counted(frame: DataFrame) -> DataFrame:
    return render(frame).groupBy("category", "rule", "severity").agg(F.count("*").alias("n"))


def _counts_sql(keys: list[str]) -> str:
    union = "\nUNION ALL\n".join(rs.rule_issues(k) for k in keys)
    return f"WITH {rs.BASE} " + _COUNTS.format(union)


over_files(
    "apply_line_rules", _counts_sql(_ALL_LINE_KEYS),
    lambda f: _counted(apply_line_rules(f, [r for r in _LINE if r.kind in _ALL_LINE_KEYS])),
)
over_files(
    "apply_window_rules", _counts_sql(_WINDOW_KEYS),
    lambda f: _counted(apply_window_rules(f, [r for r in _LINE if r.near])),
)
over_files(
    "apply_file_rules", _counts_sql(_ALL_FILE_KEYS),
    lambda f: _counted(apply_file_rules(f, [r for r in _WHOLE if set(r.kinds) & set(_ALL_FILE_KEYS)])),
)

# Issues of the text rules (line and file rules of all categories) feed the operators below.
_TEXT_UNION = "\nUNION ALL\n".join(rs.rule_issues(k) for k in [*_ALL_LINE_KEYS, *_ALL_FILE_KEYS])
TEXT_SQL = f"{rs.BASE}, issues AS MATERIALIZED ({_TEXT_UNION})"


def text_issues(f: DataFrame) -> DataFrame:
    return render(union_all(auditing.text_evidence(f)))


over_files(
    "issue_id", f"WITH {TEXT_SQL} SELECT id, line FROM issues",
    lambda f: text_issues(f).select("id", "line"),
)
over_files(
    "render_fix",
    f"WITH {TEXT_SQL} SELECT id, fix_text, fix_before, fix_after FROM issues "
    "WHERE fix_before IS NOT NULL",
    lambda f: flat(text_issues(f)).where("fix_before is not null")
    .select("id", "fix_text", "fix_before", "fix_after"),
)
over_files(
    "apply_first_per_file",
    f"WITH {TEXT_SQL} SELECT repo_id, file, rule, min(line) AS line FROM issues "
    "WHERE line IS NOT NULL GROUP BY ALL",
    lambda f: apply_first_per_file(
        text_issues(f).where("line is not null").select("repo_id", "file", "rule", "line")
        .distinct()
    ),
)
over_files(
    "min_severity",
    f"WITH {TEXT_SQL} SELECT id, severity FROM issues WHERE severity IN ('critical', 'high')",
    lambda f: min_severity(text_issues(f), "high").select("id", "severity"),
)
over_files(
    "count_by_rule",
    f"WITH {TEXT_SQL} SELECT repo_id, rule, count(*) AS n FROM issues GROUP BY ALL",
    lambda f: count_by_rule(text_issues(f)),
)
over_files(
    "redact_line",
    f"WITH {LINES_SQL} SELECT repo_id, path, line_no, {redact('line')} AS line FROM lines",
    lambda f: _redacted(src.explode_lines(f)),
)


def _redacted(lines: DataFrame) -> DataFrame:
    from lintlake.functions.text import redact as hide

    return lines.withColumn("line", hide(F.col("line")))


@query(
    "run_plugins",
    f"""WITH {LINES_SQL} SELECT repo_id, 'plugin:hex-token' AS category, 'high' AS severity,
      path AS file, line_no AS line FROM lines
    WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AND {VISIBLE}
      AND NOT regexp_matches(path, '(^|/)(node_modules|dist)/')
      AND regexp_matches(line, 'token = "[0-9a-f]{{40}}"')""",
)
def _plugins(spark: SparkSession, sf: str) -> DataFrame:
    from lintlake.operators.plugins import register_scan, run_plugins, unregister_scan

    register_scan("hex-token", lambda f: src.explode_lines(f)
                  .where(F.col("line").rlike('token = "[0-9a-f]{40}"'))
                  .select("repo_id", F.col("path").alias("file"), F.col("line_no").alias("line"),
                          F.lit("high").alias("severity"), F.lit("Hex token").alias("title")))
    try:
        found = run_plugins(files(spark, sf))
    finally:
        unregister_scan("hex-token")
    return found.select("repo_id", "category", "severity", "file", "line")


@query(
    "plugin_scores",
    f"""WITH {LINES_SQL}, hits AS (SELECT repo_id, count(*) AS n FROM lines
      WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AND {VISIBLE}
        AND NOT regexp_matches(path, '(^|/)(node_modules|dist)/') AND contains(line, 'password=')
      GROUP BY 1)
    SELECT repo_id, 'plugin:password' AS category,
      greatest(CAST(0 AS DOUBLE), 100 - coalesce(n, 0) * CAST(2.5 AS DOUBLE)) AS score
    FROM (SELECT DISTINCT repo_id FROM files) LEFT JOIN hits USING (repo_id)""",
)
def _plugin_scores(spark: SparkSession, sf: str) -> DataFrame:
    from lintlake.operators.plugins import (
        plugin_scores, register_scan, run_plugins, unregister_scan,
    )

    register_scan("password", lambda f: src.explode_lines(f)
                  .where(F.col("line").contains("password="))
                  .select("repo_id", F.col("path").alias("file"), F.col("line_no").alias("line"),
                          F.lit("low").alias("severity"), F.lit("Password").alias("title")))
    try:
        f = files(spark, sf)
        return plugin_scores(f, run_plugins(f), {"low": 2.5})
    finally:
        unregister_scan("password")


over_files(
    "cycle_members",
    f"WITH {FILES_SQL}, filled AS MATERIALIZED (SELECT * FROM files WHERE content <> ''), "
    f"{rs.CYCLES} SELECT repo_id, label, node, members FROM members",
    lambda f: graph.strong_components(graph.resolve_imports(f)),
)
over_files(
    "untested_critical",
    f"WITH {FILES_SQL} SELECT repo_id, path FROM {rs.COVERED} WHERE tested = 0 AND critical",
    testing.untested_critical,
)


FILES_A_TASK = 500


def _write_one_by_one(rows: DataFrame, root: str) -> int:
    """A text file for each `(repo, file)`, written by tasks of FILES_A_TASK files each, which also put
    them in place: the driver would move one after the other. Returns how many tasks.

    Hadoop starts a process, chmod, for each file and folder it makes on a local file system, four a
    row. There the tasks make them by themselves, in a folder of each task below each repository."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // FILES_A_TASK))
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getScheme() != "file":
        rows.repartition(tasks, "repo", "file").write.option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2"
        ).partitionBy("repo", "file").text(root)
        return tasks
    system.mkdirs(folder)
    pack, write = _local_writer(system.makeQualified(folder).toUri().getPath())
    texts = rows.select(
        F.col("repo").cast("string"), F.col("file").cast("string"),
        F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"),
    ).mapInArrow(pack, "repo string, file string, size int, packed binary")
    texts.repartition(tasks, "repo", "file").sortWithinPartitions("repo", "file").mapInArrow(
        write, "files long"
    ).write.format("noop").mode("overwrite").save()
    return tasks


def _local_writer(place: str):
    """Two steps for tasks: packing texts for the shuffle, and writing sorted rows, those of a key as
    lines of one file, with the names for keys and the lines of Spark's text writer. A file gets its
    name when it is whole, the same one in every attempt."""

    def pack(batches):
        import pyarrow as pa

        codec = pa.Codec("zstd", 1)
        for batch in batches:
            repo, file, value = batch.columns
            texts = value.to_pylist()
            yield pa.RecordBatch.from_pydict({
                "repo": repo, "file": file, "size": pa.array(map(len, texts), pa.int32()),
                "packed": pa.array((codec.compress(t, asbytes=True) for t in texts), pa.binary()),
            })

    def write(batches):
        import os
        from contextlib import suppress
        from itertools import groupby

        import pyarrow as pa
        from pyspark import TaskContext

        task, codec, files = TaskContext.get(), pa.Codec("zstd"), 0
        name = lambda key: "__HIVE_DEFAULT_PARTITION__" if key is None else key
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for (repo, file), same in groupby(rows, key=lambda row: row[:2]):
            folder = place
            for step in (f"repo={name(repo)}", f"part-{task.partitionId():05d}"):
                folder = f"{folder}/{step}"
                with suppress(FileExistsError):
                    os.mkdir(folder)  # fails where the root is not there, so not shared
            part = f"{folder}/.file={name(file)}-{task.taskAttemptId()}"
            with open(part, "wb") as out:
                for _, _, size, packed in same:
                    out.write(codec.decompress(packed, size, asbytes=True) + b"\n")
            os.replace(part, f"{folder}/file={name(file)}.txt")
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return pack, write


@query(
    "read_files",
    """SELECT 'repo=r' || (doc_id % 20) AS repo_id, CAST(doc_id AS VARCHAR) AS file,
      CASE WHEN doc_id % 7 = 0 THEN chr(65533) ELSE '' END || coalesce(text, '') || chr(10) AS content
    FROM documents""",
)
def _read_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file per document, a seventh of them with a malformed byte, below a root whose name comes
    again in the paths."""
    root = f"{session_folder(spark, 'walk')}/repo=r1"
    bad = F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("FF")).cast("string")).otherwise("")
    tasks = _write_one_by_one(table(spark, sf, "documents").select(
        F.concat(bad, F.coalesce("text", F.lit(""))).alias("value"),
        F.concat(F.lit("r"), (F.col("doc_id") % 20).cast("string")).alias("repo"),
        F.col("doc_id").alias("file"),
    ), root)
    # Spark counts 4 MB for opening a file, so a task would read a few, and a result have as many parts.
    return src.read_files(spark, root, path_glob="*.txt").coalesce(tasks).select(
        "repo_id", F.regexp_extract("path", "(?:^|/)file=([0-9]+)[./]", 1).alias("file"), "content"
    )



# ---- security, testing, architecture tables -------------------------------------------------------

def _version_sql(column: str) -> str:
    """Parts of a version as structs that sort: marks below numbers, longer numbers above shorter."""
    bare = f"regexp_replace({column}, '^[\\s^~>=<v]+', '')"
    core = f"regexp_extract({bare}, '^([0-9]+(?:\\.[0-9]+)*)', 1)"
    pre = f"regexp_extract({bare}, '^[0-9]+(?:\\.[0-9]+)*-([0-9A-Za-z.-]+)', 1)"
    trimmed = f"regexp_replace({core}, '^0+(?:\\.0+)*$|(?:\\.0+)+$', '')"
    part = lambda kind, size, text: f"{{'kind': {kind}, 'size': {size}, 'text': {text}}}"
    digits = "ltrim(x, '0')"
    fields = lambda text, body: (
        f"list_transform(list_filter(string_split({text}, '.'), lambda x: x <> ''), lambda x: {body})"
    )
    number = lambda kind: part(kind, f"CAST(length({digits}) AS INTEGER)", digits)
    field = (
        f"CASE WHEN regexp_matches(x, '^[0-9]+$') THEN {number(3)} ELSE {part(4, 0, 'x')} END"
    )
    end = (
        f"CASE WHEN {pre} <> '' THEN list_concat([{part(0, 0, repr(''))}], {fields(pre, field)}) "
        f"ELSE [{part(1, 0, repr(''))}] END"
    )
    return f"CASE WHEN {core} <> '' THEN list_concat({fields(trimmed, number(2))}, {end}) END"


_ADVISORY_CTES = rf"""{ADVISORIES_SQL},
sides AS (
  SELECT repo_id, CASE WHEN starts_with(trim(range), 'npm:')
      THEN regexp_extract(range, '^\s*npm:(@?[^@]+)', 1) ELSE name END AS name, range, is_dev,
    regexp_replace(trim(unnest(string_split(regexp_replace(range,
      '^\s*(?:workspace:|npm:@?[^@]*@)', ''), '||'))), '([<>=^~]+)\s+', '\1', 'g') AS side
  FROM {rs.DEPS}),
lowest AS (
  SELECT *, CASE WHEN starts_with(side, '<') AND len(c) = 0 THEN '0' ELSE c[1] END AS low
  FROM (SELECT *, list_filter(string_split_regex(side, '\s+'), lambda x: NOT starts_with(x, '<')) AS c
        FROM sides)),
keyed AS (SELECT repo_id, name, range, is_dev, list({_version_sql('low')}) AS vs
  FROM lowest GROUP BY ALL),
ranged AS (SELECT *, {_version_sql('introduced')} AS lo, {_version_sql('fixed')} AS hi FROM advisories),
matched AS (
  SELECT k.repo_id, k.name, k.range, k.is_dev, r.title, r.url, r.fix_available,
    CASE r.severity WHEN 'moderate' THEN 'medium' WHEN 'odd' THEN 'medium' ELSE r.severity END
      AS severity
  FROM keyed k JOIN ranged r ON r.name = k.name
  WHERE (lo IS NULL AND hi IS NULL) OR len(list_filter(vs, lambda v: v IS NOT NULL
    AND (lo IS NULL OR v >= lo) AND (hi IS NULL OR v < hi))) > 0
)"""
ADVISORY_SQL = f"{FILES_SQL}, {_ADVISORY_CTES}"


def _advisory_issues(spark: SparkSession, sf: str) -> DataFrame:
    deps = src.extract_deps(src.parse_manifest(files(spark, sf)))
    return adv.advisory_join(deps, advisories(spark))


@query(
    "advisory_join",
    f"""WITH {ADVISORY_SQL} SELECT repo_id, repo_id || ':security-npm-' || name AS id, severity,
      coalesce(title, 'Security vulnerability in ' || name) AS description,
      coalesce(fix_available, FALSE) AS automated, url FROM matched""",
)
def _advisory(spark: SparkSession, sf: str) -> DataFrame:
    return _advisory_issues(spark, sf).select(
        "repo_id", "id", "severity", "description", F.col("fix.automated").alias("automated"),
        F.get("references", F.lit(0)).alias("url"),
    )


@query(
    "vulnerability_counts",
    f"""WITH {ADVISORY_SQL} SELECT repo_id,
      {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ('critical', 'high', 'medium', 'low', 'info'))},
      count(*) AS total FROM matched GROUP BY 1""",
)
def _vulnerabilities(spark: SparkSession, sf: str) -> DataFrame:
    return security.vulnerability_counts(_advisory_issues(spark, sf))


@query(
    "secret_metadata",
    f"""WITH {rs.BASE}, {_ADVISORY_CTES},
    both_kinds AS (
      SELECT repo_id, 1 AS s, 0 AS v FROM ({' UNION ALL '.join(rs.rule_issues(k.key) for k in kinds_of('security', 'no-hardcoded-secrets'))})
      UNION ALL SELECT repo_id, 0, 1 FROM matched)
    SELECT repo_id, CAST(sum(s) AS BIGINT) AS secrets_found, CAST(sum(v) AS BIGINT) AS vulnerabilities
    FROM both_kinds GROUP BY 1""",
)
def _secrets(spark: SparkSession, sf: str) -> DataFrame:
    rules = [r for r in security.LINE_RULES if r.kind.startswith("secret-")]
    found = render(apply_line_rules(files(spark, sf), rules))
    return security.secret_metadata(found.unionByName(_advisory_issues(spark, sf)))


over_files(
    "version_key",
    f"""WITH {FILES_SQL} SELECT repo_id, name, range,
      array_to_string(list_transform({_version_sql('range')}, lambda k:
        k.kind || ':' || k.size || ':' || k.text), ' ') AS version FROM {rs.DEPS}""",
    lambda f: src.extract_deps(src.parse_manifest(f)).select(
        "repo_id", "name", "range",
        F.array_join(F.transform(
            version_key(F.col("range")), lambda k: F.concat_ws(":", k["kind"], k["size"], k["text"])
        ), " ").alias("version"),
    ),
)
over_files(
    "infer_test_paths",
    f"WITH {FILES_SQL} SELECT repo_id, path, CAST(pos AS INTEGER) AS pos, candidate "
    f"FROM {rs.CANDIDATES}",
    lambda f: testing.infer_test_paths(f.where(src.walk_condition(src.CODE_EXTENSIONS, tests=False))),
)
over_files(
    "untested_files",
    f"WITH {FILES_SQL} SELECT repo_id, path FROM {rs.COVERED} WHERE tested = 0",
    testing.untested_files,
)
over_files(
    "testing_metadata",
    f"""WITH {FILES_SQL} SELECT f.repo_id, n_code AS source_files, n_tests AS test_files,
      CAST(coalesce(untested, 0) AS BIGINT) AS untested_files,
      coalesce(untested_critical, 0) AS untested_critical,
      CAST(CAST(coalesce(coverage, 100) AS INTEGER) AS VARCHAR) || '%' AS coverage
    FROM {rs.FACTS} f LEFT JOIN {rs.COVERAGE} c USING (repo_id)""",
    lambda f: testing.testing_metadata(f, repo_facts(f)),
)
_PATTERNS = " UNION ALL ".join(
    f"SELECT DISTINCT repo_id, {q(name)} AS pattern FROM filled WHERE {WALKED} AND "
    + rs.has("content", p, ci)
    for name, p, ci in DESIGN_PATTERNS
)
over_files("design_patterns", f"WITH {rs.BASE} {_PATTERNS}", architecture.design_patterns)
over_files(
    "folder_structure_score",
    f"WITH {FILES_SQL} SELECT repo_id, CAST(CASE WHEN NOT has_src AND n_walked > 5 THEN 90 ELSE 100 "
    f"END AS INTEGER) AS score FROM {rs.FACTS}",
    lambda f: architecture.folder_structure_score(repo_facts(f)),
)

# ---- stack ---------------------------------------------------------------------------------------


def _has_sql(*names: str) -> str:
    return "(" + " OR ".join(f"list_contains(names, {q(n)})" for n in names) + ")"


def _group_sql(groups) -> str:
    items = ", ".join(f"CASE WHEN {_has_sql(*p)} THEN {q(n)} END" for n, p in groups)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


_KNOWN_SQL = f"""{FILES_SQL},
known AS (
  SELECT f.*, coalesce(names, []) AS names, node_version FROM (SELECT repo_id,
    bool_or(path IN ('server.js', 'app.js')) AS has_server, bool_or(path = 'yarn.lock') AS yarn,
    bool_or(path = 'pnpm-lock.yaml') AS pnpm, bool_or(path = 'bun.lockb') AS bun,
    bool_or(regexp_matches(path, '\\.(ts|tsx)$') AND {VISIBLE}
      AND NOT regexp_matches(path, '(^|/)node_modules/')) AS ts_files,
    bool_or(regexp_matches(path, '\\.(test|spec)\\.[^/]*$|(^|/)__tests__/') AND {VISIBLE}
      AND NOT regexp_matches(path, '(^|/)node_modules/')) AS test_files
    FROM files GROUP BY 1) f
  LEFT JOIN (SELECT repo_id, list_concat(coalesce(json_keys(content, '$.dependencies'), []),
      coalesce(json_keys(content, '$.devDependencies'), [])) AS names,
      json_extract_string(content, '$.engines.node') AS node_version
    FROM files WHERE path = 'package.json' AND json_valid(content)) USING (repo_id)
),
stacked AS (
  SELECT *, {_has_sql('typescript')} OR ts_files AS typescript,
    CASE WHEN {_has_sql('next')} THEN 'nextjs' WHEN {_has_sql('react', 'react-dom')} THEN 'react'
      WHEN {_has_sql('vue', '@vue/core')} THEN 'vue' WHEN {_has_sql('@angular/core')} THEN 'angular'
      WHEN {_has_sql('@nestjs/core', '@nestjs/common')} THEN 'nestjs'
      WHEN {_has_sql('express')} THEN 'express'
      WHEN {_has_sql('fastify', 'koa', 'hapi', '@hapi/hapi')} OR has_server THEN 'node' END AS framework
  FROM known
)"""
_STACK_SELECT = f"""SELECT repo_id,
  coalesce(framework, CASE WHEN typescript THEN 'typescript' ELSE 'javascript' END) AS "primary",
  array_to_string(list_filter([CASE framework WHEN 'nextjs' THEN 'react' WHEN 'nestjs' THEN 'node'
    WHEN 'express' THEN 'node' END, CASE WHEN typescript AND framework IS NOT NULL
    THEN 'typescript' END], lambda x: x IS NOT NULL), ',') AS secondary,
  typescript AS has_typescript, len({_group_sql(stack.TEST_FRAMEWORKS)}) > 0 OR test_files AS has_tests,
  CASE WHEN yarn THEN 'yarn' WHEN pnpm THEN 'pnpm' WHEN bun THEN 'bun' ELSE 'npm' END
    AS package_manager, node_version,
  coalesce(CASE framework WHEN 'nextjs' THEN 'Next.js' WHEN 'react' THEN 'React' WHEN 'vue' THEN 'Vue'
    WHEN 'angular' THEN 'Angular' WHEN 'nestjs' THEN 'NestJS' WHEN 'express' THEN 'Express'
    WHEN 'node' THEN 'Node.js' END, '') AS frameworks
FROM stacked"""


def _stack(f: DataFrame) -> DataFrame:
    return stack.stack_of(f, repo_facts(f))


over_files(
    "detect_stack", f"WITH {_KNOWN_SQL} {_STACK_SELECT}",
    lambda f: _stack(f).select(
        "repo_id", "primary", F.array_join("secondary", ",").alias("secondary"), "has_typescript",
        "has_tests", "package_manager", "node_version",
        F.array_join("frameworks", ",").alias("frameworks"),
    ),
)
_PACK_SQL = {"react": "framework IN ('react', 'nextjs')", "next": "framework = 'nextjs'",
             "node": "framework IN ('node', 'express', 'nestjs')"}
_PACK_UNION = "\nUNION ALL\n".join(
    f"SELECT i.* FROM ({rs.rule_issues(k)}) i JOIN stacked s USING (repo_id) WHERE {_PACK_SQL[name]}"
    for name, (lines, whole) in frameworks.PACKS.items()
    for k in [*(r.kind for r in lines), *(k for r in whole for k in r.kinds)]
)
over_files(
    "packs_by_stack",
    f"WITH {rs.BASE}{_KNOWN_SQL.removeprefix(FILES_SQL)} "
    f"SELECT repo_id, rule, file, line, id FROM ({_PACK_UNION})",
    lambda f: auditing.file_issues(f, (), packs=frameworks.DETECTED).select(
        "repo_id", "rule", "file", "line", "id"
    ),
)
for _name, _groups, _run in (
    ("detect_test_frameworks", stack.TEST_FRAMEWORKS, stack.detect_test_frameworks),
    ("detect_build_tools", stack.BUILD_TOOLS, stack.detect_build_tools),
):
    over_files(
        _name,
        f"WITH {_KNOWN_SQL} SELECT repo_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, "
        f"unnest(t) AS tool FROM (SELECT repo_id, {_group_sql(_groups)} AS t FROM known)",
        lambda f, run=_run: run(repo_facts(f), src.parse_manifest(f)),
    )
over_files(
    "detect_package_manager",
    f"WITH {_KNOWN_SQL} SELECT repo_id, package_manager FROM ({_STACK_SELECT})",
    lambda f: stack.detect_package_manager(repo_facts(f), src.parse_manifest(f)),
)
for _column in ("has_tests", "has_typescript", "node_version"):
    over_files(
        _column, f"WITH {_KNOWN_SQL} SELECT repo_id, {_column} FROM ({_STACK_SELECT})",
        lambda f, c=_column: _stack(f).select("repo_id", c),
    )

# ---- the issue table of a full audit ---------------------------------------------------------------

_tables: dict[tuple[str, str], str] = {}


def issue_table(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of a full audit, written once per session and read back, as `audit` does it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _tables:
        folder = session_folder(spark, "issues")
        write_issues(
            auditing.collect_issues(files(spark, sf), advisories=advisories(spark), plugins=False),
            folder,
        )
        _tables[key] = folder
    return read_issues(spark, _tables[key])


_ADVISORY_ROWS = """SELECT repo_id, 'security' AS category, severity, 'npm-audit' AS rule,
  'Vulnerable Dependency: ' || name AS title, 'package.json' AS file, CAST(NULL AS INTEGER) AS line,
  repo_id || ':security-npm-' || name AS id,
  coalesce(title, 'Security vulnerability in ' || name) AS description,
  CASE WHEN fix_available THEN 'Run: npm audit fix'
    ELSE 'Update or replace the dependency manually' END AS fix_text,
  CAST(NULL AS VARCHAR) AS fix_before, CAST(NULL AS VARCHAR) AS fix_after,
  coalesce(fix_available, FALSE) AS automated, 1 AS cat, 1 AS phase, name AS opath, 0 AS grp,
  0 AS k1, 0 AS k2 FROM matched"""
_AUDIT_KEYS = [k.key for k in CATALOGUE if k.cat < 6]
_ISSUE_UNION = "\nUNION ALL\n".join([*(rs.rule_issues(k) for k in _AUDIT_KEYS), _ADVISORY_ROWS])
FULL_SQL = (
    f"{rs.BASE}{_SPANS}, {rs.CYCLES}, {_ADVISORY_CTES}, "
    f"issues AS MATERIALIZED ({_ISSUE_UNION})"
)

_POINTS = " ".join(
    f"WHEN '{c}' THEN CASE severity " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in points.items())
    + " ELSE 0 END"
    for c, points in PENALTIES.items()
)
_SCANNED = {"quality": CODE, "security": SECURE_WALK, "performance": CODE, "accessibility": MARKUP,
            "testing": CODE, "architecture": WALKED}
_PENALTY_SUMS = f"""(SELECT repo_id, category, sum(CAST(CASE category {_POINTS} END AS DOUBLE)) AS p,
  count(*) AS issues, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITY_RANK)},
  count(*) FILTER (automated) AS fixable FROM issues GROUP BY 1, 2)"""
RESULTS_SQL = f"""results AS MATERIALIZED (
  SELECT g.repo_id, g.category, g.files_scanned,
    greatest(0.0, least(100.0, CASE
      WHEN g.category IN ('quality', 'testing', 'architecture') AND files_scanned = 0 THEN 100.0
      WHEN g.category = 'quality' THEN 100 - coalesce(p, 0) / greatest(files_scanned, 1) * 2
      WHEN g.category = 'testing' THEN
        least(CAST(100 AS DOUBLE), coalesce(coverage, 100) * CAST(1.2 AS DOUBLE))
          - coalesce(p, 0) * CAST(0.3 AS DOUBLE)
      ELSE 100 - coalesce(p, 0) END)) AS score,
    {', '.join(f"coalesce({c}, 0) AS {c}" for c in ('issues', *SEVERITY_RANK, 'fixable'))}
  FROM ({' UNION ALL '.join(
      f"SELECT repo_id, '{c}' AS category, count(*) FILTER ({cond}) AS files_scanned FROM files GROUP BY 1"
      for c, cond in _SCANNED.items())}) g
  LEFT JOIN {_PENALTY_SUMS} USING (repo_id, category)
  LEFT JOIN {rs.COVERAGE} c ON c.repo_id = g.repo_id
)"""
SCORED_SQL = f"{FULL_SQL}, {RESULTS_SQL}"
_GRADE = lambda c: "CASE " + " ".join(
    f"WHEN {c} >= {low} THEN '{g}'" for low, g in GRADE_CUTS
) + " ELSE 'F' END"
_BAND = lambda c: "CASE " + " ".join(
    f"WHEN {c} >= {low} THEN '{g}'" for low, g in BAND_CUTS
) + " ELSE 'bad' END"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"
_ORD = "cat, phase, opath, grp, k1, k2, id, description"
_SUBS = f"""(SELECT repo_id, category, CAST(floor(score + 0.5) AS BIGINT) AS score,
  {_GRADE('score')} AS grade, issues AS issue_count, critical AS critical_count,
  high AS high_count FROM results)"""


def _overall_sql(weights: dict[str, float], source: str = "results") -> str:
    pick = lambda c: f"CAST(max(floor(score + 0.5)) FILTER (category = '{c}') AS DOUBLE)"
    parts = " + ".join(f"{pick(c)} * CAST({w} AS DOUBLE)" for c, w in weights.items())
    total = " + ".join(f"CAST({w} AS DOUBLE)" for w in weights.values())
    return (
        f"(SELECT repo_id, CAST(floor(({parts}) / ({total}) + 0.5) AS BIGINT) AS overall "
        f"FROM {source} GROUP BY 1)"
    )


def _results(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    return scoring.scan_results(
        repo_facts(f), scoring.issue_totals(issue_table(spark, sf)), testing.coverage(f)
    )


def over_results(name: str, sql: str, run: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"WITH {SCORED_SQL} {sql}")(lambda spark, sf: run(_results(spark, sf)))


def over_issues(name: str, sql: str, run: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"WITH {FULL_SQL} {sql}")(lambda spark, sf: run(issue_table(spark, sf)))


_SECRET_UNION = " UNION ALL ".join(
    rs.rule_issues(k.key) for k in kinds_of("security", "no-hardcoded-secrets")
)


@query(
    "security_grades",
    f"""WITH {rs.BASE} SELECT r.repo_id, coalesce(n, 0) AS secrets, score, {_GRADE('score')} AS grade
    FROM (SELECT repo_id, coalesce(n, 0) AS n,
        CAST(greatest(0, least(100, 100 - coalesce(p, 0))) AS DOUBLE) AS score
      FROM (SELECT DISTINCT repo_id FROM files) LEFT JOIN (
        SELECT repo_id, count(*) AS n, sum(CASE severity WHEN 'critical' THEN 20 ELSE 12 END) AS p
        FROM ({_SECRET_UNION}) GROUP BY 1) USING (repo_id)) r""",
)
def _security_grades(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets, score and grade per repository: text to grade in one plan."""
    f = files(spark, sf)
    rules = [r for r in security.LINE_RULES if r.kind.startswith("secret-")]
    totals = scoring.issue_totals(render(apply_line_rules(f, rules)))
    results = scoring.scan_results(
        repo_facts(f), totals, testing.coverage(f), categories=("security",)
    )
    return results.select(
        "repo_id", F.col("issues").alias("secrets"), "score",
        score_to_grade(F.col("score")).alias("grade"),
    )


for _category in CATEGORIES:
    query(
        f"audit_{_category}",
        f"WITH {FULL_SQL} SELECT repo_id, rule, severity, count(*) AS n FROM issues "
        f"WHERE category = '{_category}' GROUP BY ALL",
    )(
        lambda spark, sf, c=_category: auditing.run_scanner(
            files(spark, sf), c, advisories=advisories(spark)
        ).groupBy("repo_id", "rule", "severity").agg(F.count("*").alias("n"))
    )
query(
    "run_scanner",
    f"WITH {FULL_SQL} SELECT {', '.join(ISSUE_COLUMNS)} FROM issues "
    "WHERE category = 'accessibility'",
)(lambda spark, sf: flat(auditing.run_scanner(files(spark, sf), "accessibility")))
over_issues("issues", f"SELECT {', '.join(ISSUE_COLUMNS)} FROM issues", flat)
over_results(
    "category_score", "SELECT repo_id, category, files_scanned, score FROM results",
    scoring.category_score,
)
over_results("sub_scores", f"SELECT * FROM {_SUBS}", scoring.sub_scores)
over_results(
    "overall_score",
    f"SELECT repo_id, overall, {_GRADE('overall')} AS grade FROM {_overall_sql(AUDIT_WEIGHTS)}",
    scoring.overall_score,
)
over_results(
    "score_to_grade",
    f"SELECT repo_id, category, score, {_GRADE('score')} AS grade FROM results",
    lambda r: r.select("repo_id", "category", "score", score_to_grade(F.col("score")).alias("grade")),
)
over_results(
    "score_band",
    f"SELECT repo_id, category, {_BAND('score')} AS band, left({_GRADE('score')}, 1) AS letter FROM results",
    lambda r: r.select(
        "repo_id", "category", score_band(F.col("score")).alias("band"),
        grade_band(score_to_grade(F.col("score"))).alias("letter"),
    ),
)


def _overrides(f: DataFrame) -> DataFrame:
    """Weights set by the repositories that have many tests."""
    return repo_facts(f).where("n_tests > 3").select(
        "repo_id", F.lit("security").alias("category"), F.lit(0.5).alias("weight")
    )


_WEIGHTS_SQL = f"""(SELECT repo_id, category,
  CASE WHEN category = 'security' AND n_tests > 3 THEN 0.5 ELSE w END AS weight
  FROM {rs.FACTS}, (VALUES {', '.join(f"('{c}', CAST({w} AS DOUBLE))" for c, w in AUDIT_WEIGHTS.items())}) d(category, w))"""
over_files(
    "resolve_weights", f"WITH {FILES_SQL} SELECT * FROM {_WEIGHTS_SQL}",
    lambda f: scoring.resolve_weights(_overrides(f), repo_facts(f)),
)


@query(
    "overall_score_with_overrides",
    f"""WITH {SCORED_SQL}, weighted AS (
      SELECT repo_id, {', '.join(f"CAST(max(floor(score + 0.5)) FILTER (category = '{c}') AS DOUBLE) AS s_{c}, max(weight) FILTER (category = '{c}') AS w_{c}" for c in CATEGORIES)}
      FROM results JOIN {_WEIGHTS_SQL} USING (repo_id, category) GROUP BY 1)
    SELECT repo_id, overall, {_GRADE('overall')} AS grade FROM (SELECT repo_id, CAST(floor(
      ({' + '.join(f"s_{c} * w_{c}" for c in CATEGORIES)})
      / ({' + '.join(f"w_{c}" for c in CATEGORIES)}) + 0.5) AS BIGINT) AS overall FROM weighted)""",
)
def _overridden(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    weights = scoring.resolve_weights(_overrides(f), repo_facts(f))
    return scoring.overall_score(_results(spark, sf), weights)


over_results(
    "audit_summary",
    f"""SELECT repo_id, CAST(sum(files_scanned) AS BIGINT) AS total_files,
      CAST(sum(issues) AS BIGINT) AS total_issues,
      {', '.join(f"CAST(sum({s}) AS BIGINT) AS {s}_issues" for s in SEVERITY_RANK)},
      {', '.join(f"CAST(sum(issues) FILTER (category = '{c}') AS BIGINT) AS {c}" for c in CATEGORIES)}
    FROM results GROUP BY 1""",
    lambda r: scoring.audit_summary(r).select(
        "*", *[F.col("categories")[c].alias(c) for c in CATEGORIES]
    ).drop("categories"),
)
over_issues(
    "severity_rollup",
    "SELECT category, severity, count(*) AS n FROM issues GROUP BY ROLLUP (category, severity)",
    scoring.severity_rollup,
)
over_results(
    "gate",
    "SELECT repo_id, bool_or(critical > 0) AS audit_fails, "
    "bool_or(critical > 0 OR high > 0) AS scanner_fails FROM results GROUP BY 1",
    scoring.gate,
)
over_results(
    "fixable_count", "SELECT repo_id, CAST(sum(fixable) AS BIGINT) AS fixable FROM results GROUP BY 1",
    scoring.fixable_count,
)
over_results(
    "score_trend",
    f"""SELECT repo_id, run_ts, overall, CASE WHEN before IS NULL OR overall = before THEN 'stable'
      WHEN overall > before THEN 'improving' ELSE 'declining' END AS trend
    FROM (SELECT *, lag(overall) OVER (PARTITION BY repo_id ORDER BY run_ts) AS before FROM (
      SELECT repo_id, 1 AS run_ts, overall FROM {_overall_sql(AUDIT_WEIGHTS)}
      UNION ALL SELECT repo_id, 2, overall FROM {_overall_sql(BARE_WEIGHTS)}))""",
    lambda r: scoring.score_trend(
        scoring.overall_score(r).withColumn("run_ts", F.lit(1)).unionByName(
            scoring.overall_score(r, BARE_WEIGHTS).withColumn("run_ts", F.lit(2))
        )
    ),
)


@query(
    "audit",
    f"""WITH {SCORED_SQL} SELECT s.repo_id, overall, {_GRADE('overall')} AS grade, total_files,
      total_issues, critical_issues, audit_fails
    FROM {_overall_sql(AUDIT_WEIGHTS)} s JOIN (
      SELECT repo_id, CAST(sum(files_scanned) AS BIGINT) AS total_files,
        CAST(sum(issues) AS BIGINT) AS total_issues, CAST(sum(critical) AS BIGINT) AS critical_issues,
        bool_or(critical > 0) AS audit_fails FROM results GROUP BY 1) USING (repo_id)""",
)
def _audit(spark: SparkSession, sf: str) -> DataFrame:
    run = auditing.audit(
        files(spark, sf), advisories=advisories(spark),
        issue_table=session_folder(spark, "audit"),
    )
    return (
        run.scores.join(run.summary, "repo_id").join(scoring.gate(run.results), "repo_id")
        .select("repo_id", "overall", "grade", "total_files", "total_issues", "critical_issues",
                "audit_fails")
    )


# ---- ranking ----------------------------------------------------------------------------------------

_top = lambda keys, order, k, where="TRUE": (
    f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank FROM issues "
    f"WHERE {where} QUALIFY rank <= {k})"
)
_BY_SEVERITY = f"{_RANK}, {_ORD}"
_SHOW = ("repo_id", "category", "rank", "severity", "id", "description")
_shown = lambda rows: rows.select(*_SHOW)
for _report, _k in ranking.SHOWN.items():
    over_issues(
        "top_issues" if _report == "markdown" else f"top_issues_{_report}",
        f"SELECT repo_id, category, CAST(rank AS INTEGER) AS rank, severity, id, description "
        f"FROM {_top('repo_id, category', _BY_SEVERITY, _k)}",
        lambda i, k=_k: _shown(ranking.top_issues(i, k)),
    )
over_issues(
    "hidden_counts",
    "SELECT repo_id, category, CAST(30 AS INTEGER) AS shown, count(*) AS total, "
    "count(*) - 30 AS hidden FROM issues GROUP BY ALL HAVING count(*) > 30",
    lambda i: ranking.hidden_counts(scoring.issue_totals(i)),
)
_SERIOUS = "severity IN ('critical', 'high')"
over_issues(
    "suggested_fixes",
    "SELECT repo_id, category, CAST(rank AS INTEGER) AS rank, severity, id, description FROM "
    + _top("repo_id, category", _BY_SEVERITY, 5, f"{_SERIOUS} AND fix_text IS NOT NULL"),
    lambda i: _shown(ranking.suggested_fixes(i)),
)
_PLACE = f"list_position([{', '.join(map(q, CATEGORIES))}], category)"


@query(
    "markdown_report",
    f"""WITH {SCORED_SQL}, subs AS (SELECT * FROM {_SUBS}),
    t AS (SELECT repo_id, string_agg('| ' || category || ' | ' || score || ' | ' || grade || ' | '
        || issue_count || ' |', chr(10) ORDER BY {_PLACE}) AS body FROM subs GROUP BY 1),
    l AS (SELECT repo_id, category, string_agg('- **' || severity || '** ' || title || ' ('
        || coalesce(file, '') || coalesce(':' || line, '') || ')', chr(10) ORDER BY rank) AS body
      FROM {_top('repo_id, category', _BY_SEVERITY, 30)} GROUP BY 1, 2),
    n AS (SELECT repo_id, category, count(*) - 30 AS more FROM issues GROUP BY 1, 2),
    p AS (SELECT repo_id, string_agg(chr(10) || '### ' || category || chr(10) || chr(10) || body
        || CASE WHEN more > 0 THEN chr(10) || '- and ' || more || ' more' ELSE '' END, chr(10)
        ORDER BY {_PLACE}) AS body FROM l JOIN n USING (repo_id, category) GROUP BY 1),
    x AS (SELECT repo_id, string_agg('- ' || title || ': ' || coalesce(fix_text, ''), chr(10)
        ORDER BY {_PLACE}, rank) AS body
      FROM {_top('repo_id, category', _BY_SEVERITY, 5, f"{_SERIOUS} AND fix_text IS NOT NULL")} GROUP BY 1)
    SELECT o.repo_id, '# ' || o.repo_id || chr(10) || chr(10) || 'Overall: ' || overall || ' ('
      || {_GRADE('overall')} || ')' || chr(10) || chr(10) || '| category | score | grade | issues |'
      || chr(10) || '|---|---|---|---|' || chr(10) || t.body
      || coalesce(chr(10) || chr(10) || '## Issues' || chr(10) || p.body, '')
      || coalesce(chr(10) || chr(10) || '## Suggested fixes' || chr(10) || x.body, '') AS report
    FROM {_overall_sql(AUDIT_WEIGHTS)} o JOIN t USING (repo_id) LEFT JOIN p USING (repo_id)
    LEFT JOIN x USING (repo_id)""",
)
def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)
    return reporting.markdown_reports(
        scoring.overall_score(results), scoring.sub_scores(results), issue_table(spark, sf)
    )


over_issues(
    "critical_list",
    "SELECT repo_id, category, CAST(rank AS INTEGER) AS rank, severity, id, description FROM "
    + _top("repo_id", _ORD, 5, "severity = 'critical'"),
    lambda i: _shown(ranking.critical_list(i)),
)
over_results(
    "category_table",
    f"SELECT repo_id, category, score, grade, issue_count AS issues, critical_count AS critical "
    f"FROM {_SUBS}",
    lambda r: ranking.category_table(scoring.sub_scores(r)),
)

# ---- prompts and replies ------------------------------------------------------------------------------

_PLACE = "file || CASE WHEN line > 0 THEN ':' || CAST(line AS VARCHAR) ELSE '' END"
_STACK_ONLY = _KNOWN_SQL.replace(FILES_SQL + ",", "", 1)
_SUB_LINES = f"""(SELECT repo_id, string_agg('- ' || category || ': ' || CAST(score AS VARCHAR) || '/100 ('
  || CAST(issue_count AS VARCHAR) || ' issues)', chr(10) ORDER BY list_position(
  [{', '.join(q(c) for c in CATEGORIES)}], category)) AS subs FROM {_SUBS} GROUP BY 1)"""


@query(
    "insight_prompt",
    f"""WITH {SCORED_SQL}, {_STACK_ONLY}
    SELECT s.repo_id, {q(insights.REVIEW_INTRO)} || '- Overall Score: ' || CAST(overall AS VARCHAR)
      || '/100 (Grade: ' || {_GRADE('overall')} || ')' || chr(10) || '- Total Issues: '
      || CAST(CAST(n AS BIGINT) AS VARCHAR) || ' (' || CAST(CAST(c AS BIGINT) AS VARCHAR) || ' critical, '
      || CAST(CAST(h AS BIGINT) AS VARCHAR) || ' high)' || chr(10) || '- Stack: ' || k."primary" || ' '
      || k.frameworks || chr(10) || chr(10) || '## Sub-scores' || chr(10) || subs || chr(10) || chr(10)
      || '## Top Critical/High Issues' || chr(10) || coalesce(bullets, 'No critical issues found.')
      || {q(insights.REVIEW_TASK)} AS prompt
    FROM {_overall_sql(AUDIT_WEIGHTS)} s
    JOIN (SELECT repo_id, sum(issues) AS n, sum(critical) AS c, sum(high) AS h FROM results GROUP BY 1) t
      USING (repo_id)
    JOIN {_SUB_LINES} l USING (repo_id) JOIN ({_STACK_SELECT}) k USING (repo_id)
    LEFT JOIN (SELECT repo_id, string_agg('- [' || upper(severity) || '] ' || title || ': '
        || description || ' (' || {_PLACE} || ')', chr(10) ORDER BY rank) AS bullets
      FROM {_top('repo_id', _ORD, 20, _SERIOUS)} GROUP BY 1) b USING (repo_id)""",
)
def _insight_prompt(spark: SparkSession, sf: str) -> DataFrame:
    f, results = files(spark, sf), _results(spark, sf)
    return insights.insight_prompt(
        issue_table(spark, sf), scoring.overall_score(results), scoring.sub_scores(results),
        scoring.audit_summary(results), _stack(f),
    )


over_issues(
    "security_prompt",
    f"""SELECT repo_id, 'You are a security expert. Review these security issues and provide '
      || 'remediation guidance:' || chr(10) || chr(10) || string_agg('- ' || title || ' (' || {_PLACE}
      || ')', chr(10) ORDER BY rank) || {q(insights.SECURITY_TASK)} AS prompt
    FROM {_top('repo_id', _ORD, 20, _SERIOUS + " AND category = 'security'")} GROUP BY 1""",
    insights.security_prompt,
)
over_issues(
    "refactor_prompt",
    f"""SELECT repo_id, id, {q(insights.REFACTOR_INTRO)} || title || chr(10) || chr(10) || 'Code:'
      || chr(10) || '```' || chr(10) || fix_before || chr(10) || '```' || {q(insights.REFACTOR_TASK)}
      AS prompt FROM issues WHERE fix_before IS NOT NULL""",
    insights.refactor_prompt,
)


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies made from the conversations: prose, full JSON, and JSON without fields."""
    text = F.col("text")
    insight = F.struct(F.lit("security").alias("category"), text.alias("summary"))
    full = F.to_json(F.struct(
        text.alias("overallSummary"),
        F.array(F.lit("a"), F.col("role"), F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f"))
        .alias("priorityActions"),
        F.array(insight, insight, insight, insight).alias("insights"),
        F.lit("2 days").alias("estimatedFixTime"),
    ))
    part = F.to_json(F.struct(F.array(F.col("role")).alias("priorityActions")))
    kind = F.col("turn") % 3
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(kind == 0, text).when(kind == 1, full).otherwise(part).alias("raw"),
    )


_REPLY_SQL = """SELECT conv_id, turn,
  CASE turn % 3 WHEN 0 THEN left(text, 500) WHEN 1 THEN text ELSE 'No summary provided.' END
    AS overall_summary,
  CASE turn % 3 WHEN 1 THEN '2 days' ELSE 'Unknown' END AS estimated_fix_time,
  CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'a,' || role || ',c,d,e{more}' ELSE role END AS actions,
  CAST(CASE turn % 3 WHEN 1 THEN {n} ELSE 0 END AS INTEGER) AS n_insights FROM conversations"""
_reply_columns = lambda d: d.select(
    "conv_id", "turn", "overall_summary", "estimated_fix_time",
    F.array_join("priority_actions", ",").alias("actions"), F.size("insights").alias("n_insights"),
)


@query("parse_insights", _REPLY_SQL.format(more=",f", n=4))
def _parse(spark: SparkSession, sf: str) -> DataFrame:
    return _reply_columns(insights.parse_insights(_replies(spark, sf)))


@query("top_insights", _REPLY_SQL.format(more="", n=3))
def _top_insights(spark: SparkSession, sf: str) -> DataFrame:
    return _reply_columns(insights.top_insights(insights.parse_insights(_replies(spark, sf))))


# ---- fixes -------------------------------------------------------------------------------------------

_INSERTED = " ".join(
    f"WHEN {q(rule)} THEN regexp_replace(line_text, {q(tag + chr(92) + 'b')}, {q(new)})"
    for rule, (tag, new) in fixes.INSERTED.items()
)
_SP = r"\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_INDENT = r"[ \t\f\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{feff}]*"
_PLAIN = r"[^\n\r\x{2028}\x{2029}]*"
CHANGES_SQL = f"""{FULL_SQL}, changes AS MATERIALIZED (
  SELECT * FROM (SELECT i.repo_id, i.file AS path, i.line AS line_no, l.line AS original,
    CASE i.rule
      WHEN 'no-console' THEN regexp_replace(line_text, '^({_INDENT})({_PLAIN})(\\r?)$',
        '\\1// \\2{fixes.CONSOLE_TAIL}\\3')
      WHEN 'no-debugger' THEN regexp_replace(regexp_replace(line_text, '\\bdebugger\\b[{_SP}]*;?', ''),
        '[{_SP}]+$', '')
      {_INSERTED} END AS replacement,
    i.rule, cat, phase, opath, grp, k1, k2
  FROM issues i JOIN (SELECT *, line AS line_text FROM lines) l
    ON l.repo_id = i.repo_id AND l.path = i.file AND l.line_no = i.line
  WHERE i.automated AND i.line IS NOT NULL) WHERE replacement IS NOT NULL
)"""
FIXED_SQL = f"""{CHANGES_SQL}, fixed AS MATERIALIZED (
  SELECT repo_id, path, string_agg(coalesce(replacement, line), chr(10) ORDER BY line_no) AS content
  FROM lines LEFT JOIN (
    SELECT repo_id, path, line_no, replacement FROM changes
    QUALIFY row_number() OVER (PARTITION BY repo_id, path, line_no
      ORDER BY cat DESC, phase DESC, opath DESC, grp DESC, k1 DESC, k2 DESC) = 1) c
    USING (repo_id, path, line_no)
  WHERE (repo_id, path) IN (SELECT (repo_id, path) FROM changes)
  GROUP BY 1, 2
)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return fixes.build_fix_plan(issue_table(spark, sf), files(spark, sf))


over_issues(
    "split_fixable",
    "SELECT id, description, TRUE AS fixable FROM issues WHERE automated AND line IS NOT NULL "
    "UNION ALL SELECT id, description, FALSE FROM issues WHERE NOT (coalesce(automated, FALSE) "
    "AND line IS NOT NULL)",
    lambda i: _marked(*fixes.split_fixable(i)),
)


def _marked(fixable: DataFrame, other: DataFrame) -> DataFrame:
    mark = lambda d, v: d.select("id", "description", F.lit(v).alias("fixable"))
    return mark(fixable, True).unionByName(mark(other, False))


query(
    "build_fix_plan",
    f"WITH {CHANGES_SQL} SELECT repo_id, path, line_no, original, replacement, rule FROM changes",
)(lambda spark, sf: _changes(spark, sf).drop("ord"))
query("apply_fixes", f"WITH {FIXED_SQL} SELECT repo_id, path, content FROM fixed")(
    lambda spark, sf: fixes.apply_fixes(files(spark, sf), _changes(spark, sf))
)
query(
    "fix_summary",
    f"WITH {CHANGES_SQL} SELECT repo_id, path, count(*) AS issues_fixed, count(*) AS lines_changed, "
    "count(DISTINCT line_no) AS distinct_lines FROM changes GROUP BY 1, 2",
)(lambda spark, sf: fixes.fix_summary(_changes(spark, sf)))
query(
    "fix_totals",
    f"""WITH {CHANGES_SQL} SELECT m.repo_id, manual, coalesce(fixes, 0) AS fixes,
      coalesce(n_files, 0) AS files
    FROM (SELECT repo_id, count(*) FILTER (NOT (coalesce(automated, FALSE) AND line IS NOT NULL))
        AS manual FROM issues GROUP BY 1) m
    LEFT JOIN (SELECT repo_id, count(*) AS fixes, count(DISTINCT path) AS n_files FROM changes
      GROUP BY 1) USING (repo_id)""",
)(lambda spark, sf: fixes.fix_totals(issue_table(spark, sf), _changes(spark, sf)))
query(
    "revert_console_fix",
    f"""WITH {FIXED_SQL} SELECT repo_id, path, string_agg(CASE WHEN regexp_matches(line, pattern)
        THEN regexp_replace(line, pattern, '\\1\\2\\3') ELSE line END, chr(10) ORDER BY i) AS content
    FROM (SELECT repo_id, path, unnest(l) AS line, generate_subscripts(l, 1) AS i,
        '^({_INDENT})// ({_PLAIN}) // TODO: use a proper logger(\\r?)$' AS pattern
      FROM (SELECT repo_id, path, string_split(content, chr(10)) AS l FROM fixed
        WHERE path LIKE 'src/%' AND path LIKE '%.ts'))
    GROUP BY 1, 2 HAVING bool_or(regexp_matches(line, pattern))""",
)(lambda spark, sf: fixes.revert_console_fix(
    fixes.apply_fixes(files(spark, sf), _changes(spark, sf))
))

# ---- streaming ----------------------------------------------------------------------------------------


@query(
    "match_changed",
    f"""WITH {FIXED_SQL} SELECT id, description FROM issues JOIN (
      SELECT repo_id, path AS file FROM fixed n JOIN files o USING (repo_id, path)
      WHERE n.content IS DISTINCT FROM o.content) USING (repo_id, file)""",
)
def _match_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of the files whose text differs between two versions, the second one being fixed."""
    before = files(spark, sf)
    after = fixes.apply_fixes(before, _changes(spark, sf)).withColumnRenamed("content", "new")
    changed = before.join(after, ["repo_id", "path"]).where(~F.col("new").eqNullSafe(F.col("content")))
    return watch.match_changed(issue_table(spark, sf), changed).select("id", "description")


def _versions(spark: SparkSession, sf: str) -> str:
    """Folder with two versions of every file, a tenth of a second apart; the later one counts."""
    folder = session_folder(spark, "versions")
    rows = files(spark, sf)
    at = F.timestamp_seconds(F.coalesce(F.octet_length("content"), F.lit(0)))
    early = rows.select("repo_id", "path", F.concat("content", F.lit("x")).alias("content"),
                        at.alias("mtime"))
    late = rows.select("*", (at + F.expr("interval 100 milliseconds")).alias("mtime"))
    early.unionByName(late).write.parquet(folder)
    return folder


def _run_stream(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over all input into a table and read it back."""
    target, state = session_folder(spark, "stream"), session_folder(spark, "state")
    (
        stream.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", state).outputMode("append")
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(target)


@query("stream_files", f"WITH {FILES_SQL} SELECT repo_id, path, content FROM files")
def _stream_files(spark: SparkSession, sf: str) -> DataFrame:
    stream = watch.stream_files(spark, _versions(spark, sf))
    return watch.latest_versions(_run_stream(stream, spark)).select("repo_id", "path", "content")


@query(
    "debounce",
    f"WITH {FILES_SQL} SELECT repo_id, path, content FROM files",
)
def _debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Every file once, with its later version, in however many batches."""
    target = session_folder(spark, "settled")
    watch.debounce(
        watch.stream_files(spark, _versions(spark, sf)),
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}"),
        session_folder(spark, "state"), availableNow=True,
    ).awaitTermination()
    settled = spark.read.schema(FILES_SCHEMA).parquet(target)
    return watch.latest_versions(settled.drop("batch")).select("repo_id", "path", "content")


@query("stream_issues", f"WITH {TEXT_SQL} SELECT id, severity, description FROM issues")
def _stream_issues(spark: SparkSession, sf: str) -> DataFrame:
    folder = session_folder(spark, "changed")
    files(spark, sf).withColumn("mtime", F.timestamp_seconds(F.lit(0))).write.parquet(folder)
    stream = watch.stream_issues(watch.stream_files(spark, folder))
    return _run_stream(stream.select("id", "severity", "description"), spark)


@query(
    "stream_refresh",
    f"WITH {SCORED_SQL} SELECT repo_id, overall, {_GRADE('overall')} AS grade "
    f"FROM {_overall_sql(AUDIT_WEIGHTS)}",
)
def _stream_refresh(spark: SparkSession, sf: str) -> DataFrame:
    refresh = watch.Refresh(session_folder(spark, "watch"), advisories=advisories(spark))
    stream = watch.stream_files(spark, _versions(spark, sf))
    watch.stream_refresh(stream, refresh, session_folder(spark, "state")).awaitTermination()
    return refresh.scores(spark)


# ---- sinks ---------------------------------------------------------------------------------------------


@query(
    "write_issues",
    f"WITH {FULL_SQL} SELECT category, count(*) AS n FROM issues GROUP BY 1",
)
def _write_issues(spark: SparkSession, sf: str) -> DataFrame:
    folder = session_folder(spark, "written")
    write_issues(issue_table(spark, sf), folder)
    return read_issues(spark, folder).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "write_report_json",
    f"""WITH {SCORED_SQL} SELECT s.repo_id, overall, {_GRADE('overall')} AS grade, total_issues
    FROM {_overall_sql(AUDIT_WEIGHTS)} s JOIN (SELECT repo_id, CAST(sum(issues) AS BIGINT)
      AS total_issues FROM results GROUP BY 1) USING (repo_id)""",
)
def _write_report(spark: SparkSession, sf: str) -> DataFrame:
    folder = session_folder(spark, "reports")
    run = auditing.score_audit(files(spark, sf), issue_table(spark, sf))
    write_report_json(run.reports(), folder)
    schema = ("path string, score struct<score:long,grade:string>, "
              "summary struct<total_issues:long>")
    return spark.read.schema(schema).json(folder).select(
        F.col("path").alias("repo_id"), F.col("score.score").alias("overall"), "score.grade",
        "summary.total_issues",
    )
