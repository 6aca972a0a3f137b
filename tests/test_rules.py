"""Rules on small files with known findings."""

import pytest

from lintlake.operators import frameworks
from lintlake.operators.issues import render
from lintlake.operators.rules import Options, apply_line_rules
from lintlake.plans.auditing import collect_issues, file_issues, run_scanner


def found(issues, *columns):
    return sorted(
        (tuple(r) for r in issues.select(*columns).collect()), key=lambda t: tuple(map(str, t))
    )


# One small text for each rule, with the findings that its definition gives: (rule, severity, line).
CASES = {
    "unused": ("let kept = 3, spare = 4;\nrun(kept);\nconst _quiet = 5;\n",
               [("no-unused-vars", "low", 1)]),
    "pattern": ("const { a, b: c, ...d } = load(), [e, f = 1] = a;\nlet g: Map<string, h> = e, i = g ? d : 2, j;\n",
                [("no-unused-vars", "low", 1), ("no-unused-vars", "low", 1), ("no-unused-vars", "low", 2),
                 ("no-unused-vars", "low", 2)]),
    "any": ("export type Bag = Map<string, any>;\nexport let some: any;\n",
            [("no-explicit-any", "low", 1), ("no-unused-vars", "low", 2)]),
    "switch": ("export function pick(k) {\n  switch (k) {\n"
               + "".join(f"    case {n}: go({n});\n" for n in range(11)) + "  }\n}\n",
               [("complexity", "medium", 1)]),
    "deep": ("export const f = [[{ a: { b: { c: { d: { e: 1 } } } } }]];\n",
             [("max-depth", "medium", None), ("no-unused-vars", "low", 1)]),
    "picture": ("export default () => <p><img src='b.svg' width='3' /></p>;\n",
                [("img-alt", "high", 1)]),
    "alert": ("debugger;\nconsole.log('x');\n", [("no-debugger", "medium", 1), ("no-console", "low", 2)]),
}


@pytest.mark.parametrize("name", CASES)
def test_small_texts(make_files, name):
    text, want = CASES[name]
    got = found(file_issues(make_files({f"{name}.tsx": text}), packs=("react", "node")),
                "rule", "severity", "line")
    assert got == sorted(want, key=lambda t: tuple(map(str, t)))


def test_scores_and_gate_of_one_repo(make_files):
    from lintlake import audit

    run = audit(make_files({"alert.ts": CASES["alert"][0]}))
    rows = {r.category: r for r in run.sub_scores.collect()}
    assert rows["quality"].score == 92  # 100 - 2 * (3 + 1) / 1
    assert rows["testing"].score == 0 and rows["accessibility"].score == 100
    assert run.scores.count() == 1 and run.stack.collect()[0].primary == "typescript"
    report = run.reports().collect()[0]
    assert report.score.categories["quality"].grade == rows["quality"].grade
    assert report.score.categories["quality"].weight == 0.2 and report.version == "1"


@pytest.mark.parametrize(
    "lines,severity", [(500, None), (501, "medium"), (1000, "medium"), (1001, "high")]
)
def test_file_size_limits(make_files, lines, severity):
    text = "\n".join(["x();"] * lines)
    got = found(run_scanner(make_files({"a.js": text}), "quality"), "rule", "severity")
    assert got == ([("max-file-size", severity)] if severity else [])


def test_empty_and_missing_content_counts_as_scanned(make_files):
    from lintlake.operators.facts import repo_facts

    files = make_files({"a.js": "", "b.js": None, "c.js": "debugger"})
    assert repo_facts(files).collect()[0].n_code == 3
    assert found(run_scanner(files, "quality"), "file", "rule") == [("c.js", "no-debugger")]


def test_inner_html_exemption(make_files):
    text = "a.innerHTML=''\na.innerHTML = ''\na.innerHTML=b\na.innerHTML ="
    got = found(run_scanner(make_files({"a.ts": text}), "security"), "line", "rule")
    assert got == [(2, "no-xss"), (3, "no-xss"), (4, "no-xss")]


def test_depth_clamps_at_zero(make_files):
    text = "}}}}}\n" + "{" * 5 + "}" * 5
    issue = run_scanner(make_files({"a.js": text}), "quality").collect()[0]
    assert issue.rule == "max-depth" and "depth of 5" in issue.description


def test_heading_window_is_twenty_lines(make_files):
    ok = "<h2>a</h2>\n" + "\n" * 19 + "<h3>b</h3>"
    far = "<h2>a</h2>\n" + "\n" * 20 + "<h3>b</h3>"
    got = found(run_scanner(make_files({"a.html": ok, "b.html": far}), "accessibility"),
                "file", "rule")
    assert got == [("b.html", "heading-order")]


def test_promise_window_is_five_lines(make_files):
    near = "a.then(b)\n\n\n\n.catch(c)"
    far = "a.then(b)\n\n\n\n\n.catch(c)"
    rows = apply_line_rules(make_files({"a.ts": near, "b.ts": far}), frameworks.NODE_LINE_RULES)
    assert found(render(rows), "file") == [("b.ts",)]


def test_duplicate_calls_stay_inside_a_file(make_files):
    twice = "fetch('/a'); fetch('/a');"
    once = "fetch('/b');"
    got = found(run_scanner(make_files({"a.jsx": twice, "b.jsx": once, "c.jsx": once}),
                            "performance"), "file", "rule")
    assert got == [("a.jsx", "no-duplicate-api-calls")]


def test_first_twenty_untested_files_count_critical_ones(make_files):
    names = [f"a{i:02d}.ts" for i in range(25)]
    names[3], names[7], names[11] = "a03auth.ts", "a07login.ts", "a11db.ts"
    got = found(run_scanner(make_files({n: "x" for n in names}), "testing"), "rule", "severity")
    assert got.count(("no-untested-critical", "high")) == 3
    assert got.count(("require-tests", "low")) == 17
    assert ("require-tests", "critical") in got and ("min-coverage", "high") in got


def test_heavy_dependency_prefix(make_files):
    files = make_files({"package.json": '{"dependencies": {"lodash-es": "1"}}'})
    got = found(run_scanner(files, "performance"), "title")
    assert got == [("Heavy Dependency: lodash",)]


def test_two_patterns_on_a_line_give_the_same_id_twice(make_files):
    text = "password = 'abcdef1'; db_password = 'abcdef1'"
    rows = run_scanner(make_files({"a.ts": text}), "security")
    assert rows.count() == 2
    eval_twice = run_scanner(
        make_files({"b.ts": "eval(x); setTimeout('y', 1)"}), "security"
    ).select("id")
    assert eval_twice.count() == 2 and eval_twice.distinct().count() == 1


def test_word_boundary_is_ascii(make_files):
    got = run_scanner(make_files({"a.js": "édebugger"}), "quality")
    assert got.count() == 1


def test_ignore_globs_and_dotfiles(make_files):
    files = make_files({"a.ts": "debugger", ".x/b.ts": "debugger", "dist/c.ts": "debugger"})
    assert found(run_scanner(files, "quality"), "file") == [("a.ts",)]
    assert run_scanner(files, "quality", options=Options(ignore=("**/*.ts",))).count() == 0
    with_dots = run_scanner(files, "quality", options=Options(include_dotfiles=True))
    assert found(with_dots, "file") == [(".x/b.ts",), ("a.ts",)]


def test_unknown_scanner_raises(make_files):
    with pytest.raises(ValueError):
        run_scanner(make_files({"a.ts": "x"}), "style")


def test_path_text_is_never_read_as_a_template(make_files):
    files = make_files({"{line}%s.js": "fetch('/x/{file}%1$s'); fetch('/x/{file}%1$s'); React"})
    issue = collect_issues(files, ("performance",)).collect()[0]
    assert issue.id == "r:perf-duplicate-api-{line}%s.js-/x/{file}%1$s"


def test_plans_stay_in_the_jvm_and_do_not_shuffle_texts(make_files):
    from lintlake.plans.auditing import text_evidence

    for frame in text_evidence(make_files({"a.ts": "x"}), packs=("react", "next", "node")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan
