"""Which files the fused pass folds over, and that line rules find the same wherever they run."""

from pyspark.sql import functions as F

from lintlake.operators import tokens
from lintlake.operators.fused import fused_evidence
from lintlake.operators.rules import apply_line_rules
from lintlake.plans import auditing

_PROSE = "/* let us see several constants\n" + "if a function is => long\n" * 60 + "*/\n"


def test_words_in_comments_open_no_fold(make_files):
    files = make_files({"a.ts": _PROSE + "use(several);\n", "b.ts": _PROSE + "const a = () => 1;\n"})
    rows = files.select("path", "repo_id", tokens.matches().alias("raw")).withColumn("code", tokens.code_of())
    found = {r[0]: (r[1], r[2]) for r in rows.select(
        "path", tokens.has_code(tokens.HEADS), tokens.has_code(tokens.DECLARING)
    ).collect()}
    assert found == {"a.ts": (False, False), "b.ts": (True, True)}


def test_long_texts_without_a_function_need_no_tokens(make_files):
    files = make_files({"a.ts": "if (a) go();\n" * 60, "b.ts": "function f() {\n" + "if (a) go();\n" * 60 + "}"})
    found = files.orderBy("path").select(tokens.may_hold_finding()).collect()
    assert [r[0] for r in found] == [False, True]


def test_fused_line_rules_find_what_the_plain_pass_finds(make_files):
    files = make_files({
        "src/a.tsx": "<h1>a</h1>\n<h3>b</h3>\n<img src=x>\nconsole.log(1); // TODO: x\ndebugger;\n",
        "src/b.js": "fs.readFileSync(p);\nel.innerHTML = x;\neval(y);\nconst password = 'hunter22';\n",
        "c.html": "<html>\n<button>\n<input name=a>\n", "src/d.ts": "plain();\n",
    })
    lines, _ = auditing._rules(tuple(auditing.LINE_RULES), (), ())
    columns = ["path", "entry", "line", "n", "name", "text", "k1", "k2"]
    rows = lambda found: sorted(map(repr, found.select(*columns).collect()))
    plain = rows(apply_line_rules(files, lines))
    assert len(plain) > 8 and rows(fused_evidence(files, lines)) == plain


def test_the_text_of_a_function_is_cut_out_once(make_files):
    body = "function f() {\n" + "if (a && b) go();\n" * 9 + "}\nconst g = (a) => a ?? 1;\n"
    rows = tokens._with_spans(tokens.typed_sources(make_files({"a.ts": body})), "content")
    found = rows.select(tokens.function_items().alias("found"))
    assert [(x["name"], x["n"]) for x in found.first()[0]] == [("f", 19)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("substring(content") == 1


def test_texts_with_few_marks_of_branches_hold_no_complex_function(make_files):
    """The patterns of COMPLEXITY are not run on a text whose marks cannot add up to a finding."""
    parts = ("else if (a) ", "? b : ", "?? ", "&&& ", "||| ", "do ", "ifs ", "for ", "a?.b ", "x_while ", "case\n", "catch ")
    texts = {
        f"{i}_{j}_{n}.ts": "() => { " + (a + b) * n + (a if j % 2 else "")
        for i, a in enumerate(parts) for j, b in enumerate(parts) for n in (1, 2, 3, 4, 5)
    }
    whole = tokens.complexity_of(F.col("content"))
    marks = F.regexp_count("content", F.lit(tokens.BRANCH_MARK))
    rows = make_files(texts).select(
        (whole > tokens.MAX_COMPLEXITY).alias("complex"), (1 + 2 * marks >= whole).alias("bound"),
        tokens.may_hold_finding().alias("may"),
    ).collect()
    assert all(r["bound"] and r["may"] == r["complex"] for r in rows)
    assert 100 < sum(r["may"] for r in rows) < len(rows) - 100
