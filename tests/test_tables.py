"""Scores, fixes, graph, advisories, plugins, sources, streaming."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lintlake.functions import fold_path, glob_to_regex, score_to_grade, version_key
from lintlake.operators import fixes, graph, insights, joins, plugins, scoring, tokens
from lintlake.operators.advisories import ADVISORY_SCHEMA, match_advisories
from lintlake.plans.auditing import audit, file_issues


@pytest.mark.parametrize("score,grade", [
    (100, "A+"), (97, "A+"), (95, "A"), (91, "A-"), (88, "B+"), (84, "B"), (81, "B-"),
    (78, "C+"), (74, "C"), (71, "C-"), (65, "D"), (30, "F"),
])
def test_grades(spark, score, grade):
    assert spark.range(1).select(score_to_grade(F.lit(score))).first()[0] == grade


def _results(spark, scores):
    rows = [("r", c, 1, float(s)) for c, s in scores.items()]
    return spark.createDataFrame(
        rows, "repo_id string, category string, files_scanned long, score double"
    )


def test_exact_tie_rounds_up(spark):
    scores = dict(quality=89, security=0, performance=92, accessibility=85, testing=0,
                  architecture=98)
    assert scoring.overall_score(_results(spark, scores)).first().overall == 55


def test_no_scanned_category_scores_zero(spark):
    only = _results(spark, {"plugin:x": 50})
    assert scoring.overall_score(only).first().overall == 0


def test_equal_weights_are_symmetric(spark):
    from lintlake.schema import BARE_WEIGHTS

    one = scoring.overall_score(_results(spark, dict(security=100, accessibility=0)), BARE_WEIGHTS)
    two = scoring.overall_score(_results(spark, dict(security=0, accessibility=100)), BARE_WEIGHTS)
    assert one.first().overall == two.first().overall == 50


def test_trend(spark):
    rows = [("r", 1, 50), ("r", 2, 60), ("r", 3, 60), ("r", 4, 10)]
    got = scoring.score_trend(spark.createDataFrame(rows, "repo_id string, run_ts int, overall int"))
    assert [r.trend for r in got.orderBy("run_ts").collect()] == [
        "stable", "improving", "stable", "declining"
    ]


def test_versions(spark):
    rows = spark.createDataFrame(
        [("1.2.10", "1.2.9"), ("2.0.0", "2.0.0-rc.1"), ("^1.10", "~1.9.9"), ("v3", "2.9")],
        "hi string, lo string",
    )
    assert rows.where(version_key(F.col("hi")) > version_key(F.col("lo"))).count() == 4
    assert spark.range(1).select(version_key(F.lit("latest"))).first()[0] is None


def test_advisories_give_the_same_rows_broadcast_or_salted(spark, monkeypatch):
    deps = spark.createDataFrame(
        [(f"r{i}", "hot" if i % 3 else f"p{i}", f"1.{i}.0", False) for i in range(300)],
        "repo_id string, name string, range string, is_dev boolean",
    )
    table = spark.createDataFrame(
        [("hot", "1.50.0", "1.250.0", "high", None, None, True),
         ("p3", None, None, "low", None, None, None)], ADVISORY_SCHEMA,
    )
    small = match_advisories(deps, table).select("repo_id", "name").collect()
    monkeypatch.setattr(joins.lookup_join, "__defaults__", (None, 1))
    salted = match_advisories(deps, table).select("repo_id", "name").collect()
    want = [(f"r{i}", "hot") for i in range(50, 250) if i % 3] + [("r3", "p3")]
    assert sorted(map(tuple, small)) == sorted(map(tuple, salted)) == sorted(want)


def test_paths(spark):
    fold = lambda p: spark.range(1).select(fold_path(F.lit(p))).first()[0]
    assert fold("a/./b/../c") == "a/c" and fold("a/../../b") == "../b" and fold("./a") == "a"
    import re

    hit = lambda g, p: bool(re.match(glob_to_regex(g).replace(r"\z", r"\Z"), p))
    assert hit("**/dist/**", "dist/a.js") and hit("**/dist/**", "x/dist/y/a.js")
    assert hit("**/*.test.*", "a.test.ts") and not hit("**/*.test.*", "a.test/b.ts")
    assert hit("src/{a,b}/*", "src/b/c.ts") and not hit("src/{a,b}/*", "src/b/c/d.ts")


def _components(edges):
    """Brute force: nodes that reach each other."""
    nodes = {n for e in edges for n in e}
    reach = {n: {d for s, d in edges if s == n} for n in nodes}
    for k in nodes:
        for a in nodes:
            if k in reach[a]:
                reach[a] |= reach[k]
    out = {}
    for a in nodes:
        ring = {b for b in reach[a] if a in reach[b]}
        if ring:
            out[a] = min(ring)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [f"f{i:02d}" for i in range(18)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(24)}
    frame = spark.createDataFrame([("r", *e) for e in edges], graph.GRAPH_EDGE)
    got = {r.node: r.label for r in graph.strong_components(frame).collect()}
    assert got == _components(edges)


def test_cycles_need_real_files(make_files):
    files = make_files({
        "a/x.ts": "import y from './y.js'", "a/y.ts": "import z from '../b'",
        "b/index.ts": "import x from '../a/x'", "c.ts": "import me from './c'",
        "d.ts": "import x from './a/x'", "e.ts": "import no from './missing'",
    })
    got = {r.path: r.name for r in graph.import_cycles(files).collect()}
    assert got == {"a/x.ts": "a/x.ts → a/y.ts → … (3 files)", "c.ts": "c.ts → c.ts"}


def test_function_spans_ignore_braces_in_strings_and_comments(make_files):
    text = (
        "export async function one(a = '{') {\n  // }\n  return `}`;\n}\n"
        "const two = (x) => {\n  return x;\n};\nconst three = y => y + 1\nconst four = 4;\n"
    )
    spread = tokens.typed_sources(make_files({"a.ts": text}))
    got = [
        (r.kind, r.name, r.line_no, r.end_line)
        for r in tokens.function_spans(spread).orderBy("pos").collect()
    ]
    assert got == [
        ("function", "one", 1, 4), ("arrow", "anonymous", 5, 7), ("arrow", "anonymous", 8, 8)
    ]


def test_slashes_and_templates_are_told_apart(make_files):
    def cut(text):
        rows = tokens.tokens(tokens.typed_sources(make_files({"a.tsx": text}))).orderBy("pos").collect()
        return [r.tok for r in rows]

    assert cut("a = /['\"`{]/g.test(b)") == ["a", "=", "/['\"`{]/g", ".", "test", "(", "b", ")"]
    assert cut("return /\\/[/*]\n/i") == ["return", "/", "\\", "/", "[", "/", "*", "]", "/", "i"]
    assert cut("x.return / 2 / y") == ["x", ".", "return", "/", "2", "/", "y"]
    assert cut("(a + b) / 2 / c[0] / d") == list("(a+b)/2/c[0]/d")
    assert cut("<b>{x}</b>") == list("<b>{x}</b>")
    assert cut("x => /a\\/b/") == ["x", "=>", "/a\\/b/"]
    assert cut("[/a/, /[/]/u]") == ["[", "/a/", ",", "/[/]/u", "]"]
    assert cut("`a ${b ? `c ${'}'}` : {d: 1}} e` f") == ["`a ${b ? `c ${'}'}` : {d: 1}} e`", "f"]
    assert cut("`a ${b` c") == ["`a ${b`", "c"]
    assert cut("`\\`$` $") == ["`\\`$`", "$"]


def test_names_are_used_in_their_scope(make_files):
    def unused(text):
        rows = tokens.unused_evidence(make_files({"a.ts": text})).collect()
        return sorted(r.name for r in rows)

    assert unused("const a = 1;\nfunction f(a) { return a; }\nf();") == ["a"]
    assert unused("const a = 1;\nfunction f(b) { return a; }\nf();") == []
    assert unused("const a = 1;\nconst g = (x, ...a) => { return a; };\ng(1);") == ["a"]
    assert unused("const a = 1;\nconst g = (x = a) => { const a = 2; return a; };\ng(1);") == []
    assert unused("const a = 1;\nif (a) { go(); }") == []
    assert unused("const a = 1;\ntry { go(); } catch (a) { log(a); }") == ["a"]
    assert unused("const a = 1;\n{ let a = 2; log(a); }\nlog(a);") == []
    assert unused("const a = 1;\n{ { let a = 2; } log(a); }") == []
    assert unused("const a = 1;\nx.a = { a: 2, b: y?.a };\ntype T = { a?: U };") == ["a"]
    assert unused("const a = 1, b: T = 2;\nlog({ a }, ...b);") == []
    assert unused("const a = 1;\nlog(c ? a : 2);\nlog(c ? 1 : a)") == []
    assert unused("const a = 1;\nlog(`x ${y ? `${a}` : 1}`);") == []
    assert unused("const a = /b/;\nconst b = '/a/';") == ["a", "b"]
    assert unused("const a = 1;\nfunction f(a) {") == []


def test_long_template_does_not_overflow(make_files):
    text = "const t = `" + "a\\`" * 200_000 + "`;\nexport { t };"
    spread = tokens.typed_sources(make_files({"a.ts": text}))
    assert tokens.tokens(spread, ()).count() == 10
    for text in ("const t = `" + "${a} {" * 200_000 + "`;", "a = /" + "[/]\\/x" * 200_000 + "/;"):
        assert tokens.tokens(tokens.typed_sources(make_files({"a.ts": text}))).count() in (4, 5)


def test_fixes(make_files):
    files = make_files({
        "src/a.ts": "  console.log(1);\r\nx();\r\ndebugger;\n  debugger; y();",
        "b.html": "<img src=a><img src=b>\n<html>",
    })
    issues = file_issues(files)
    changes = fixes.build_fix_plan(issues, files)
    new = {r.path: r.content for r in fixes.apply_fixes(files, changes).collect()}
    assert new["src/a.ts"] == (
        "  // console.log(1); // TODO: use a proper logger\r\nx();\r\n\n   y();"
    )
    assert new["b.html"] == '<img alt="" src=a><img src=b>\n<html lang="en">'
    fixed = files.where("path = 'src/a.ts'").select(
        "repo_id", "path", F.lit(new["src/a.ts"]).alias("content")
    )
    back = fixes.revert_console_fix(fixed).first().content
    assert back == "  console.log(1);\r\nx();\r\n\n   y();"


def test_last_fix_of_a_line_wins(make_files):
    files = make_files({"a.ts": "console.log(1); debugger;"})
    changes = fixes.build_fix_plan(file_issues(files), files)
    assert changes.count() == 2
    assert fixes.apply_fixes(files, changes).first().content == "console.log(1);"
    summary = fixes.fix_summary(changes).first()
    assert (summary.issues_fixed, summary.distinct_lines) == (2, 1)


def test_replies(spark):
    rows = [(1, "x" * 600), (2, json.dumps({"overallSummary": "ok", "insights": []})), (3, "{}")]
    got = insights.parse_insights(spark.createDataFrame(rows, "k int, raw string")).collect()
    by = {r.k: r for r in got}
    assert by[1].raw == "x" * 600
    assert by[1].overall_summary == "x" * 500 and by[1].estimated_fix_time == "Unknown"
    assert by[2].overall_summary == "ok" and by[3].overall_summary == "No summary provided."


def test_plugins_are_isolated(make_files):
    files = make_files({"a.ts": "x", "node_modules/b.ts": "x"})
    good = lambda f: f.select("repo_id", F.col("path").alias("file"), F.lit("low").alias("severity"),
                              F.lit("t").alias("title"))
    plugins.register_scan("good", good)
    plugins.register_scan("bad", lambda f: f.select("nope"))
    plugins.register_scan(
        "late", lambda f: good(f).withColumn("title", F.raise_error(F.lit("boom")).cast("string"))
    )
    try:
        rows = plugins.run_plugins(files, isolate=True).collect()
        assert [(r.category, r.file) for r in rows] == [("plugin:good", "a.ts")]
        scores = plugins.plugin_scores(files, plugins.run_plugins(files, isolate=True), {"low": 5.0})
        assert {(r.category, r.score) for r in scores.collect()} == {
            ("plugin:good", 95.0), ("plugin:bad", 100.0), ("plugin:late", 100.0)
        }
    finally:
        for name in plugins.registered_scans():
            plugins.unregister_scan(name)


def test_read_files_and_sinks(spark, tmp_path):
    from lintlake.sources import read_files, read_issues

    for path, text in {"one/src/a b.ts": "debugger;\n", "two/x+y.js": "console.log('é');"}.items():
        target = tmp_path / "in" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf8")
    files = read_files(spark, str(tmp_path / "in"))
    got = {(r.repo_id, r.path): r.content for r in files.collect()}
    assert got == {("one", "src/a b.ts"): "debugger;\n", ("two", "x+y.js"): "console.log('é');"}
    run = audit(files)
    run.write(str(tmp_path / "out"))
    assert read_issues(spark, str(tmp_path / "out/issues")).count() == run.issues.count()
    reports = spark.read.json(str(tmp_path / "out/reports"))
    assert reports.count() == 2 and "apiKey" not in str(reports.schema)


def test_debounce_and_refresh(spark, tmp_path):
    from lintlake.schema import FILES_SCHEMA
    from lintlake.streaming import Refresh, debounce, stream_files, stream_refresh

    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    at = lambda ms: start + dt.timedelta(milliseconds=ms)
    source = str(tmp_path / "in")

    def send(rows):
        spark.createDataFrame(rows, FILES_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    batches = []

    def settle():
        batches.clear()
        debounce(
            stream_files(spark, source, max_files_per_trigger=1),
            lambda rows, _: batches.append(sorted((r.repo_id, r.path, r.content) for r in rows.collect())),
            str(tmp_path / "c1"), availableNow=True,
        ).awaitTermination()
        return batches

    refresh = Refresh(str(tmp_path / "state"))

    def update():
        stream_refresh(stream_files(spark, source), refresh, str(tmp_path / "c2")).awaitTermination()
        return sorted((r.file, r.rule) for r in refresh.issues(spark).collect()
                      if r.category == "quality")

    send([("r", "a.ts", "debugger", at(0)), ("r", "a.ts", "debugger;", at(200)),
          ("r", "b.ts", "ok()", at(10_000))])
    assert settle() == [[("r", "a.ts", "debugger;"), ("r", "b.ts", "ok()")]]
    assert update() == [("a.ts", "no-debugger")]
    before = refresh.scores(spark).first().overall
    send([("r", "a.ts", "fine()", at(20_000)), ("r", "b.ts", "console.log(1)", at(20_000)),
          ("r", "a.ts", "too late", at(5))])
    assert update() == [("b.ts", "no-console")]
    assert refresh.scores(spark).first().overall >= before
    fixed = spark.read.parquet(str(tmp_path / "state/fixed")).where("path = 'b.ts'").first()
    assert fixed.content == "// console.log(1) // TODO: use a proper logger"


def test_a_lagging_repository_loses_nothing(spark, tmp_path):
    """Batches of one file each: times that lie far behind are kept, and so is the last burst."""
    import datetime as dt

    from lintlake.schema import FILES_SCHEMA
    from lintlake.streaming import debounce, stream_files

    start = dt.datetime(2024, 1, 1)
    source, seen = str(tmp_path / "in"), []
    for repo, seconds in (("a", 300), ("a", 600), ("b", 50), ("a", 900), ("b", 1), ("c", 0)):
        row = (repo, "x.ts", f"{repo}{seconds}", start + dt.timedelta(seconds=seconds))
        spark.createDataFrame([row], FILES_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    debounce(
        stream_files(spark, source, max_files_per_trigger=1),
        lambda rows, _: seen.extend(r.content for r in rows.collect()),
        str(tmp_path / "state"), availableNow=True,
    ).awaitTermination()
    assert sorted(seen) == ["a300", "a600", "a900", "b1", "b50", "c0"]


def test_versions_in_order(spark):
    ordered = [
        "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2",
        "1.0.0-beta.10", "1", "1.0.0.1", "1.0.1", "1.2", "1.2.0.3", "1.10.0", "2.0.0-rc.1", "v2",
        "20240101120000.1.0", "20240101120000.1.0.1",
    ]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(ordered)], "k int, v string")
    assert [r.k for r in rows.orderBy(version_key(F.col("v"))).collect()] == list(range(len(ordered)))
    same = spark.createDataFrame([("1.2", "1.2.0.0"), ("^01.2", "1.2+build7")], "a string, b string")
    assert same.where(version_key(F.col("a")) == version_key(F.col("b"))).count() == 2


def test_ranges_match_by_each_alternative(spark):
    deps = spark.createDataFrame(
        [("r", "p", x, False) for x in (">=1.2 <2 || 3.x", "workspace:^1.5.0", "<2", ">= 0.5", "*")]
        + [("r", "alias", "npm:p@1.2.3", False), ("r", "other", "npm:@s/q@1.2.3", False)],
        "repo_id string, name string, range string, is_dev boolean",
    )
    table = spark.createDataFrame(
        [("p", "1.2.0", "1.3.0", "high", "a", None, True), ("p", "3", "3.0.1", "high", "b", None, True),
         ("p", None, "0.1", "low", "c", None, None), ("p", None, None, "low", "d", None, None),
         ("@s/q", "1", "2", "low", "e", None, None)], ADVISORY_SCHEMA,
    )
    got = {(r.range, r.title) for r in match_advisories(deps, table).collect()}
    want = {(">=1.2 <2 || 3.x", "a"), (">=1.2 <2 || 3.x", "b"), ("<2", "c"), ("npm:p@1.2.3", "a"),
            ("npm:@s/q@1.2.3", "e")}
    assert got == want | {(r.range, "d") for r in deps.where("name in ('p', 'alias')").collect()}


def test_plugin_issues_count_in_summary_and_gate(make_files):
    files = make_files({"a.ts": "fine()"})
    plugins.register_scan("late", lambda f: f.select(
        "repo_id", F.col("path").alias("file"), F.lit("critical").alias("severity"),
        F.raise_error(F.lit("fails in its rows")).cast("string").alias("title")))
    plugins.register_scan("good", lambda f: f.select(
        "repo_id", F.col("path").alias("file"), F.lit("critical").alias("severity"),
        F.lit("t").alias("title")))
    try:
        run = audit(files)
        own = run.issues.where("category like 'plugin:%'").collect()
        assert [r.category for r in own] == ["plugin:good"]
        bare = run.results.agg(F.sum("issues"), F.sum("critical")).first()
        summary = run.summary.first()
        assert summary.total_issues == bare[0] + 1 and summary.critical_issues == bare[1] + 1
        assert run.gate.first().audit_fails
    finally:
        for name in plugins.registered_scans():
            plugins.unregister_scan(name)


def test_malformed_bytes_and_a_root_that_recurs(spark, tmp_path):
    from lintlake.sources import read_files

    target = tmp_path / "src" / "r1" / "src" / "lib"
    target.mkdir(parents=True)
    (target / "a.ts").write_bytes(b"x\xff\xfey")
    rows = read_files(spark, str(tmp_path / "src")).collect()
    assert [(r.repo_id, r.path, r.content) for r in rows] == [("r1", "src/lib/a.ts", "x\ufffd\ufffdy")]
    with pytest.raises(ValueError):
        read_files(spark, str(tmp_path / "*"))


def test_the_last_of_repeated_names_counts(make_files):
    from lintlake.sources.files import extract_deps, parse_manifest

    text = '{"dependencies": {"a": "1", "b": "3", "a": "2"}, "devDependencies": {"c": "1", "c": "2"}}'
    rows = extract_deps(parse_manifest(make_files({"package.json": text}))).collect()
    assert sorted((r.name, r.range) for r in rows) == [("a", "2"), ("b", "3"), ("c", "2")]


def test_untested_files_without_a_limit(make_files):
    from lintlake.operators.rules import Options
    from lintlake.plans.auditing import run_scanner

    files = make_files({f"a{k:02d}.ts": "x" for k in range(25)})
    count = lambda o: run_scanner(files, "testing", options=o).where("severity = 'low'").count()
    assert (count(Options()), count(Options(first_untested=None))) == (20, 25)
