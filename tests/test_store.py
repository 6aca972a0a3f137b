"""The version store of a watch against rebuilds from scratch."""

import datetime as dt
import random

from lintlake.plans.auditing import collect_issues, score_audit
from lintlake.schema import FILES_SCHEMA
from lintlake.streaming import Refresh
from lintlake.streaming.watch import match_changed, outline

START = dt.datetime(2024, 1, 1)
TEXTS = (
    "debugger;\n", "console.log(1)\nok()", "import { a } from './m1'\nexport const b = a", "", None,
    "import x from \"./m2.js\";\nfunction f() { return eval(x) }\n", "export const c = 1;\n// TODO: more",
)


def _frame(spark, rows):
    return spark.createDataFrame(
        [(repo, path, text, START + dt.timedelta(seconds=s)) for repo, path, text, s in rows], FILES_SCHEMA
    )


def _read_bytes(spark):
    """Bytes that tasks have read so far, as Spark counts them."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalInputBytes()


def _issues(frame):
    return sorted((r.repo_id, r.id, r.description, str(r.ord)) for r in frame.collect())


def _check(spark, refresh, newest):
    rows = {k: v for k, v in newest.items()}
    files = _frame(spark, [(*k, *v) for k, v in rows.items()])
    got = {(r.repo_id, r.path): r.content for r in refresh.files(spark).collect()}
    assert got == {k: v[0] for k, v in rows.items()}
    issues = collect_issues(files, plugins=False)
    assert _issues(refresh.issues(spark)) == _issues(issues)
    want = score_audit(files, issues).scores.collect()
    assert sorted(map(tuple, refresh.scores(spark).collect())) == sorted(map(tuple, want))


def test_store_equals_rebuild(spark, tmp_path):
    """Random batches, late versions and merged segments: files, issues and scores are those of an
    audit of the newest versions; a batch that runs again changes nothing."""
    rng = random.Random(3)
    refresh = Refresh(str(tmp_path / "state"), buckets=3, max_segments=2)
    newest = {}
    for n in range(4):
        rows = []
        for _ in range(6):
            key = (f"r{rng.randint(0, 3)}", rng.choice(["m1.ts", "m2.js", "src/m3.ts", "package.json"]))
            text = rng.choice(TEXTS) if key[1] != "package.json" else '{"dependencies": {"moment": "1"}}'
            rows.append((*key, text, rng.randint(0, 1000)))
        batch = _frame(spark, rows)
        refresh(batch, n)
        refresh(batch, n)
        for repo, path, text, s in rows:
            order = lambda t, at: (at, t is not None, t or "")
            old = newest.get((repo, path))
            same = [r for r in rows if r[:2] == (repo, path)]
            best = max(same, key=lambda r: order(r[2], r[3]))
            if old is None or best[3] >= old[1]:
                newest[repo, path] = (best[2], best[3])
    _check(spark, refresh, newest)
    store = refresh.store
    head = store.head(spark)
    assert len(head.segments()) <= 2 and min(head.segments()) < 0
    named = {s for n in (2, 3) for s in store.head(spark, n).segments()}
    assert store._ids(spark, "heads") == [2, 3] and set(store._ids(spark, "versions")) <= named


def test_lost_batch_runs_again(spark, tmp_path):
    """A batch that stops before its head is written leaves the state as it was, and can be repeated."""
    refresh = Refresh(str(tmp_path / "state"), buckets=2)
    refresh(_frame(spark, [("r", "a.ts", "debugger;", 0)]), 0)
    second = _frame(spark, [("r", "a.ts", "ok()", 5), ("r", "b.ts", "console.log(1)", 5)])
    store = refresh.store
    # As much as a lost driver may leave behind: a segment and half of the state.
    store.write_segment(second, "versions", 1)
    store.write_segment(collect_issues(second, ("quality",), plugins=False), "file_issues", 1)
    assert {r.content for r in refresh.files(spark).collect()} == {"debugger;"}
    refresh(second, 1)
    _check(spark, refresh, {("r", "a.ts"): ("ok()", 5), ("r", "b.ts"): ("console.log(1)", 5)})
    refresh(_frame(spark, []), 2)
    assert store.head(spark).batch == 1


def test_tenth_batch_reads_as_much_as_the_second(spark, tmp_path, monkeypatch):
    """With few rules, as only what a batch reads is measured here."""
    from lintlake.operators import quality
    from lintlake.operators.issues import render
    from lintlake.operators.rules import apply_line_rules
    from lintlake.streaming import watch

    few = lambda files, **_: render(apply_line_rules(files, quality.LINE_RULES))
    monkeypatch.setattr(watch, "file_issues", few)
    monkeypatch.setattr(watch, "repo_issues", few)
    rng = random.Random(1)
    line = lambda: "".join(rng.choices("abcdefgh ", k=60))
    text = lambda: "debugger;\n" + "\n".join(line() for _ in range(400))
    refresh = Refresh(str(tmp_path / "state"), buckets=4)
    refresh(_frame(spark, [(f"r{k % 4}", f"src/f{k}.ts", text(), 0) for k in range(60)]), 0)
    read = []
    for n in range(1, 11):
        folder = str(tmp_path / f"in{n}")
        rows = [(f"r{k % 4}", f"src/f{k}.ts", text(), n) for k in range(12)]
        _frame(spark, rows).coalesce(1).write.parquet(folder)
        before = _read_bytes(spark)
        refresh(spark.read.schema(FILES_SCHEMA).parquet(folder), n)
        read.append(_read_bytes(spark) - before)
    assert len(refresh.store._ids(spark, "heads")) == 2
    # Same texts by size, other letters: the sizes of compressed files differ a little.
    assert read[9] <= read[1] * 1.02, read


def test_outline_serves_repository_scans(spark, make_files):
    files = make_files({
        "package.json": '{"dependencies": {"moment": "^1"}}', "src/a.ts": "import b from './b'\nfrom '../x'\n" * 3,
        "src/b.ts": "export * from \"./a.ts\"; // from", "c.js": None, "d.ts": "", "e.ts": "from nothing",
    })
    from lintlake.plans.auditing import repo_issues

    slim = files.withColumn("content", outline())
    assert _issues(repo_issues(slim)) == _issues(repo_issues(files))
    assert "import b" not in str(slim.collect())


def test_match_changed_equals_brute_force(spark, make_files):
    old = {("r", f"f{k}.ts"): TEXTS[k % len(TEXTS)] for k in range(20)} | {("s", "f1.ts"): "debugger;"}
    new = {k: (v + "\n// x" if v and i % 3 == 0 else v) for i, (k, v) in enumerate(old.items())}
    issues = collect_issues(make_files(old), plugins=False)
    changed = [k for k in old if old[k] != new[k]]
    frame = spark.createDataFrame(changed, "repo_id string, path string")
    want = [(r.repo_id, r.id) for r in issues.collect() if (r.repo_id, r.file) in set(changed)]
    assert want and sorted((r.repo_id, r.id) for r in match_changed(issues, frame).collect()) == sorted(want)


def test_only_files_that_rules_ask_for_are_opened(spark, tmp_path):
    """A large binary is a row and never read; facts on paths read no content at all."""
    from lintlake.operators.facts import repo_facts
    from lintlake.sources import read_files

    root = tmp_path / "in" / "one"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.ts").write_text("debugger;\n")
    (root / "src" / "long.ts").write_text("x" * 5000)
    (root / "README.md").write_text("hello")
    (root / "model.bin").write_bytes(bytes(30_000_000))
    files = read_files(spark, str(tmp_path / "in"))
    before = _read_bytes(spark)
    got = {r.path: r.content for r in files.collect()}
    assert _read_bytes(spark) - before < 1_000_000
    assert got == {"src/a.ts": "debugger;\n", "src/long.ts": "x" * 5000, "README.md": None, "model.bin": None}
    short = read_files(spark, str(tmp_path / "in"), max_bytes=100, extensions=None)
    assert {r.path: r.content for r in short.collect()} == {
        "src/a.ts": "debugger;\n", "src/long.ts": None, "README.md": "hello", "model.bin": None}
    every = read_files(spark, str(tmp_path / "in"), extensions=None).where("path <> 'model.bin'")
    assert {r.path for r in every.collect()} == {"src/a.ts", "src/long.ts", "README.md"}
    facts = repo_facts(files)
    assert facts.first().has_readme
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<" not in plan or "content" not in plan.split("ReadSchema: ", 1)[1]
