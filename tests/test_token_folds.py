"""What the folds over tokens look at, and that leaving marks out changes no result."""

from pyspark.sql import functions as F

from lintlake.operators import tokens


def _marks(files, make):
    rows = tokens.typed_sources(files).select("repo_id", "path", tokens.matches().alias("raw"))
    rows = rows.select("repo_id", "path", "raw", tokens.code_of().alias("code"))
    return rows.select(F.size(make())).first()[0]


def test_calls_are_no_marks_of_the_folds(make_files):
    files = make_files({"a.ts": "const one = () => 1;\n" + "one();\n" * 500})
    assert _marks(files, tokens.function_marks) < 20
    assert _marks(files, tokens.name_marks) < 20


def test_token_table_adds_up_across_parts(make_files):
    text = "const a = 'é';\n/* two\nlines */ go(\n\n  a, [1]);\n" * 40
    rows = tokens.tokens(tokens.typed_sources(make_files({"a.ts": text}))).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows))) and len(rows) == 15 * 40
    for r in rows:
        assert text[r.start : r.start + r.size] == r.tok
        assert r.line_no == text[: r.start].count("\n") + 1


def test_brackets_keep_their_lines_behind_breaks_in_comments_and_strings(make_files):
    text = "f(/* a\n b */ `x\ny`, [\n1]) }\n{ g() "
    rows = tokens.match_brackets(tokens.typed_sources(make_files({"a.ts": text}))).collect()
    assert sorted((r.kind, r.open_line, r.close_line) for r in rows) == [
        ("(", 1, 4), ("(", 5, 5), ("[", 3, 4), ("{", 5, None),
    ]


def test_arrows_next_to_empty_and_filled_brackets(make_files):
    text = "const f = () => g(), h = (a, b) => (c(), d);\nuse([() => [], x => y()], z => z);"
    rows = tokens.function_spans(tokens.typed_sources(make_files({"a.ts": text}))).collect()
    assert sorted(text[r.start : r.stop].split("=>")[0].strip() for r in rows) == ["()", "()", "(a, b)", "x", "z"]
    assert all(r.kind == "arrow" and r.line_no == r.end_line for r in rows)


def test_uses_count_where_many_names_are_declared(make_files):
    names = [f"v{i}" for i in range(2 * tokens.FEW_NAMES)]
    for some in (names, names[:3]):
        text = "".join(f"const {n} = 1;\n" for n in some) + f"log({some[0]}, x.{some[1]});"
        rows = tokens.unused_evidence(make_files({"a.ts": text})).collect()
        assert sorted(r.name for r in rows) == sorted(some[1:])


def test_bare_brackets_by_an_arrow_or_its_type_stay_marks(make_files):
    """Calls without arguments make no marks; brackets that an arrow begins with or opens do."""
    text = (
        "const a = () => f();\nconst b = (): T => (g)();\nconst c = x => ();\nfunction d() { e(), h()[0](); }\n"
        "i(() => j(), [], k());\nconst l = async () : Promise => { m(); };\nn([]);\n"
    )
    spans = tokens.function_spans(tokens.typed_sources(make_files({"a.ts": text})))
    found = {(r.kind, r.name, text[r.start:min(r.stop, len(text))]) for r in spans.collect()}
    assert {f for f in found if f[0] == "function"} == {("function", "d", "function d() { e(), h()[0](); }")}
    arrows = {f[2] for f in found if f[0] == "arrow"}
    assert {"() => f()", "(): T => (g)", "x => ()", "() => j()", "() : Promise => { m(); }"} == arrows


def test_names_are_counted_alike_with_few_and_many_declarations(make_files):
    few = "const a = 1, b = 2;\nlet _c = 3, d;\nuse(a, o.b, { d: 1 });\n"
    many = few + "".join(f"let n{i} = {i}; use(n{i});\n" for i in range(tokens.FEW_COUNTED + 1))
    shaded = few + "function s(d) { return d; }\ns(s);\n"
    rows = tokens.unused_evidence(make_files({"a.ts": few, "b.ts": many, "c.ts": shaded})).collect()
    found = {p: sorted((r["name"], r["line"], r["k1"]) for r in rows if r["path"] == p) for p in ("a.ts", "b.ts", "c.ts")}
    assert [n for n, *_ in found["a.ts"]] == ["b", "d"] and found["b.ts"] == found["a.ts"] == found["c.ts"]
