"""Tokens of TypeScript sources, and the rules that need more than a pattern.

A file is cut into tokens by one native regex. Offsets, lines, bracket partners, function spans and
names come from folds over the token array inside the file's row: nothing is shuffled, and a text
meets only its own tokens.

A slash starts a regex literal where an operator, an opening bracket or a word such as `return`
stands before it. Limits: object types as return annotation, a regex literal behind a comment or at
the start of a statement without semicolon before it, and templates nested deeper than NESTED are read
as plain tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.folds import PART, fold, parts
from lintlake.functions.text import any_of, ecma, let
from lintlake.operators.catalogue import COMPLEXITY
from lintlake.operators.issues import evidence, found, union_all
from lintlake.operators.rules import Options
from lintlake.sources.files import has_content

NESTED = 3  # levels of `${...}`, braces in it included, that a template is followed into
_DOUBLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"


def _template(levels: int) -> str:
    if not levels:
        return r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
    return r"`(?:[^`\\$]++|\\[\s\S]|\$\{" + _hole(levels) + r"\}|\$)*+`"


def _hole(levels: int) -> str:
    """What stands between `${` and `}`. One that does not end counts as text of the template."""
    inner = rf"|\{{{_hole(levels - 1)}\}}" if levels > 1 else ""
    return rf"(?:[^{{}}`'\"]++|{_DOUBLE}|{_SINGLE}|{_template(levels - 1)}{inner})*+"


# What stands before a regex literal. `<`, `>` and `}` are not among them, as they stand before the
# slash of a tag; nor `)`, `]`, `+` and `-`, which stand before a division too.
BEFORE_REGEX = ("=>", *"(,=:[!&|?{;~^*%")
WORDS_BEFORE_REGEX = (
    "return", "typeof", "case", "in", "of", "delete", "void", "throw", "do", "else", "await", "yield",
)
_REGEX_PART = r"\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\]"
_REGEX = (
    r"/(?<=(?:=>|[(,=:\[!&|?{;~^*%]|(?<![\w$.])(?:" + "|".join(WORDS_BEFORE_REGEX) + r"))\s{0,32}/)"
    rf"(?:[^/*\\\[\n]|{_REGEX_PART})(?:[^/\\\[\n]|{_REGEX_PART})*+/[A-Za-z]*+"
)

# Alternatives in order: block comment, line comment, regex literal, three kinds of string, arrow,
# word, any other character. Each match takes the white space before it, so lengths add up to
# offsets. The loops are possessive: linear, and no recursion on long texts.
TOKEN = (
    r"\s*+(?:/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
    rf"|//[^\n]*+|{_REGEX}|{_DOUBLE}|{_SINGLE}|{_template(NESTED)}"
    r"|=>|[A-Za-z_$][A-Za-z0-9_$]*+|\S)"
)
ROW_PART = 16  # tokens of a part in the token table, where a token looks at those before it
MAX_FUNCTION_LINES = 50
MAX_COMPLEXITY = 10

_FILE = ("repo_id", "path")


def typed_sources(
    files: DataFrame, options: Options = Options(), keep: Column | None = None
) -> DataFrame:
    """TypeScript sources. `keep` drops files that cannot hold a finding, before tokens are cut."""
    chosen = options.walk(("ts", "tsx"), tests=False)
    chosen = chosen if keep is None else chosen & keep
    return files.where(has_content() & chosen).select(*_FILE, "content")


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


MARKS = ("/*", "//", "\"", "'", "`")
_BLANK = "' \\t\\n\\u000b\\u000c\\r'"


def _in(value: str, words: tuple[str, ...]) -> str:
    return f"{value} in (" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in words) + ")"


def _breaks(text: str) -> str:
    return f"if(contains({text}, '\\n'), length({text}) - length(replace({text}, '\\n', '')), 0)"


def matches() -> Column:
    """What the token pattern matches in a text, one piece after the other."""
    return F.regexp_extract_all("content", F.lit(TOKEN), 0)


def code_of() -> Column:
    """Tokens of the column `raw` without comments, as `(tok, pos)`; `pos` is the place in `raw`."""
    body = f"transform(raw, (x, i) -> struct(trim(LEADING {_BLANK} FROM x) as tok, i as pos))"
    return F.expr(f"filter({body}, t -> not startswith(t.tok, '//') and not startswith(t.tok, '/*'))")


def _rows(rows: DataFrame, found: str | Column, key: str, *keep: str) -> DataFrame:
    """The structs of an array as rows; `key` is a field that is never NULL.

    An outer generator, as Spark would give a plain one a filter on the size of the array and push
    that below the projections, where the folds would be computed again for every use of a column.
    """
    return rows.select(*_FILE, *keep, F.inline_outer(found)).where(F.col(key).isNotNull())


def tokens(sources: DataFrame, whole: tuple[str, ...] = MARKS) -> DataFrame:
    """`(repo_id, path, pos, tok, size, line_no, start)`; comments are single tokens.

    `start` is the 0-based character offset and `size` the length. Comments and strings not named
    in `whole` are cut to their first mark. A file becomes one row for each part of its tokens, with
    offset and line of the part, and then one for each token, which adds up what stands before it in
    its part: all but the sums of the parts is compiled code on rows.
    """
    rows = sources.select(*_FILE, matches().alias("raw")).select(*_FILE, F.expr(parts("raw", ROW_PART)).alias("parts"))
    rows = rows.select(*_FILE, "parts", F.expr(_offsets("parts")).alias("offsets"))
    rows = _rows(rows, F.expr(
        "transform(parts, (p, c) -> struct(c as part, get(offsets, c).off as off, get(offsets, c).line as line, p as pieces))"
    ), "part")
    rows = rows.select(*_FILE, "part", "off", "line", "pieces", F.posexplode_outer("pieces").alias("i", "x"))
    rows = rows.where("x is not null").select(
        *_FILE, "part", "off", "line", "i", "x", F.expr("array_join(slice(pieces, 1, i), '')").alias("before"),
        F.expr(f"trim(LEADING {_BLANK} FROM x)").alias("t"),
    )
    cut = "t"
    for mark in MARKS:
        if mark not in whole:
            shown = mark.replace("'", "\\'")
            cut = f"if(startswith(t, '{shown}'), '{shown}', {cut})"
    return rows.select(
        *_FILE, F.expr(f"part * {ROW_PART} + i").alias("pos"), F.expr(cut).alias("tok"), F.length("t").alias("size"),
        F.expr(f"1 + line + {_breaks('before')} + {_breaks('x')} - {_breaks('t')}").alias("line_no"),
        F.expr("off + length(before) + length(x) - length(t)").alias("start"),
    )


#: Bracket kinds: (opening, closing, state column of the open ones).
_KINDS = (("{", "}", "curly"), ("(", ")", "round"), ("[", "]", "square"))
_OPENS, _CLOSES = (tuple(k[i] for k in _KINDS) for i in (0, 1))


def _stacks(entry: str, kind: str) -> tuple[dict[str, str], dict[str, str], str]:
    """(first state, steps, top of the stack that a closing bracket closes) of one stack of open
    brackets for each kind; a bracket that nothing opened closes nothing."""
    state = {name: f"cast(array() as array<{kind}>)" for *_, name in _KINDS}
    step = {
        name: f"case when x.tok = '{o}' then array_append(a.{name}, {entry}) when x.tok = '{c}' "
              f"and size(a.{name}) > 0 then slice(a.{name}, 1, size(a.{name}) - 1) else a.{name} end"
        for o, c, name in _KINDS
    }
    top = "case " + " ".join(f"when x.tok = '{c}' then get(a.{name}, size(a.{name}) - 1)" for _, c, name in _KINDS) + " end"
    return state, step, top


def match_brackets(sources: DataFrame) -> DataFrame:
    """Every opening bracket with the position and line of its partner (NULL without one).

    The fold runs over brackets and line breaks alone; the line is a running sum.
    """
    entry = "struct(x.pos as pos, a.line + x.breaks as line)"
    state, step, top = _stacks(entry, "struct<pos:int,line:int>")
    state["line"], step["line"] = "1", "a.line + x.breaks"
    opened = {c: o for o, c, _ in _KINDS}
    kind = "case " + " ".join(f"when x.tok = '{c}' then '{o}'" for c, o in opened.items()) + " end"
    row = "struct<kind:string,open_pos:int,open_line:int,close_pos:int,close_line:int>"
    pair = (
        f"transform(array({top}), o -> struct({kind} as kind, o.pos as open_pos, o.line as open_line, "
        "x.pos as close_pos, a.line + x.breaks as close_line))"
    )
    open_still = ", ".join(
        f"transform(b.{name}, o -> struct('{o}' as kind, o.pos as open_pos, o.line as open_line, "
        "cast(null as int) as close_pos, cast(null as int) as close_line))"
        for o, _, name in _KINDS
    )
    found = fold("marks", state, step, row, f"if(({top}) is null, null, {pair})", f"concat({open_still})")
    bare = f"trim(LEADING {_BLANK} FROM x)"
    marks = F.expr(
        f"array_compact(transform(raw, (x, i) -> if(contains(x, '\\n') or {_in(bare, _OPENS + _CLOSES)}, "
        f"struct(i as pos, {bare} as tok, {_breaks('x')} as breaks), null)))"
    )
    rows = sources.select(*_FILE, matches().alias("raw")).select(*_FILE, marks.alias("marks"))
    return _rows(rows, F.expr(found), "kind")


# Words that may stand before `function` in a declaration, words that start a
# statement.
MODIFIERS = ("export", "default", "async")
STARTERS = (
    "const", "let", "var", "function", "export", "import", "class", "if", "for", "while",
    "return", "type", "interface", "switch", "throw", "try",
)
HEADS = ("=>", "function")
_NO_END = 2147483647
_WORD = "'^[A-Za-z_$]'"
_HEAD = "struct<kind:string,name:string,pos:int,first:int>"
_FOUND = "struct<kind:string,name:string,pos:int,first:int,last:int,closes:boolean>"


def has_code(words: tuple[str, ...]) -> Column:
    """Whether one of the words is a token of `code`; a text may hold it in a comment or a longer word."""
    return F.expr(f"exists(code, t -> {_in('t.tok', words)})")


def function_marks() -> Column:
    """Brackets, separators, heads and statement starts of `code`, with what the fold needs of their
    neighbours: the token before, and of a head the one that it begins with unless that is its
    parameters. Places are those in `raw`.

    A declaration starts at its first modifier and follows a finished statement. Marks that change
    nothing are left out: a separator right after another one or after an opening bracket finds nothing
    that still waits, but for a semicolon, which ends declarations; round or square brackets around
    nothing are of interest only next to an arrow.
    """
    b = lambda k: f"get(code, i - {k})"
    # Whether a line ends from the start of one token to that of a later one.
    broken = lambda x, y: (
        f"(contains({x}.tok, '\\n') or exists(sequence({x}.pos + 1, {y}.pos), k -> contains(get(raw, k), '\\n')))"
    )
    mod = lambda k: f"coalesce({_in(f'{b(k)}.tok', MODIFIERS)}, false)"
    used = f"case when {mod(1)} and {mod(2)} and {mod(3)} then 3 when {mod(1)} and {mod(2)} then 2 when {mod(1)} then 1 else 0 end"
    first, before = "get(code, i - u)", "get(code, i - u - 1)"
    finished = (
        f"({before} is null or {_in(f'{before}.tok', (';', '}'))} or "
        f"({before}.tok rlike '^(/.|[A-Za-z0-9_$)\\\\]\\'\"`])' and {broken(before, first)}))"
    )
    name = "if(get(code, i + 1).tok = '*', get(code, i + 2).tok, get(code, i + 1).tok)"
    named = f"if(coalesce({name} rlike {_WORD}, false), {name}, 'anonymous')"
    declared = (
        f"get(transform(array({used}), u -> if({finished}, struct('function' as kind, {named} as name, "
        f"t.pos as pos, {first}.pos as first), null)), 0)"
    )
    arrow = f"if(i > 0, struct('arrow' as kind, 'anonymous' as name, t.pos as pos, {b(1)}.pos as first), null)"
    closed = (
        f"{b(1)}.tok = ')' or ({b(1)}.tok rlike {_WORD} and {b(2)}.tok = ':' and {b(3)}.tok = ')')"
    )
    starts = f"({_in('t.tok', STARTERS)} and i > 0 and {broken(b(1), 't')})"
    mark = (
        "struct(t.tok as tok, t.pos as pos, "
        f"({_in('t.tok', (*_CLOSES, ',', ';'))} or {starts}) as ends, {b(1)}.pos as last, "
        f"if(t.tok = '=>', {arrow}, if(t.tok = 'function', {declared}, null)) as head, "
        f"t.tok = '=>' and coalesce({closed}, false) as closed, "
        f"t.tok = '=>' and coalesce({_in('get(code, i + 1).tok', ('{', '('))}, false) as block)"
    )
    wanted = f"{_in('t.tok', (*_OPENS, *_CLOSES, ',', ';', '=>', 'function'))} or {starts}"
    pure = lambda m: f"not {_in(f'{m}.tok', (*_OPENS, *_CLOSES, '=>', 'function'))}"
    near = lambda k: f"get(m, i {k}).tok"
    again = f"i > 0 and {pure('x')} and ({near('- 1')} = ';' or (x.tok <> ';' and ({pure('get(m, i - 1)')} or {near('- 1')} in ('(', '['))))"
    pair = lambda x, y: f"(({x} = '(' and {y} = ')') or ({x} = '[' and {y} = ']'))"
    apart = lambda x, y: f"coalesce({x} <> '=>', true) and coalesce({y} <> '=>', true)"
    empty = (
        f"coalesce(({pair('x.tok', near('+ 1'))} and {apart(near('- 1'), near('+ 2'))}) or "
        f"({pair(near('- 1'), 'x.tok')} and {apart(near('- 2'), near('+ 1'))}), false)"
    )
    # Such brackets that stand side by side, as calls without arguments have them, are left out before a
    # mark is made: those that an arrow follows, perhaps behind its type, or stands right before are kept.
    b_after = lambda k: f"get(code, i + {k})"
    kept = lambda x: f"coalesce({x} in ('=>', ':'), false)"
    closing = "if(t.tok = '(', ')', ']')"
    opening = "if(t.tok = ')', '(', '[')"
    bare = (
        f"if(t.tok in ('(', '['), coalesce({b_after(1)}.tok = {closing}, false) and not ({kept(f'{b(1)}.tok')} or "
        f"{kept(f'{b_after(2)}.tok')}), if(t.tok in (')', ']'), coalesce({b(1)}.tok = {opening}, false) and "
        f"not ({kept(f'{b(2)}.tok')} or {kept(f'{b_after(1)}.tok')}), false))"
    )
    # One look-up tells most tokens apart: a list of this length is a hash set to Spark.
    maybe = _in("t.tok", (*_OPENS, *_CLOSES, ",", ";", *HEADS, *STARTERS))
    marks = f"array_compact(transform(code, (t, i) -> if({maybe}, if({bare}, null, if({wanted}, {mark}, null)), null)))"
    for left_out in (again, empty, again):
        marks = f"transform(array({marks}), m -> filter(m, (x, i) -> not ({left_out})))[0]"
    return F.expr(marks)


def _found(head: str, last: str, closes: str) -> str:
    return (
        f"struct({head}.kind as kind, {head}.name as name, {head}.pos as pos, {head}.first as first, "
        f"{last} as last, {closes} as closes)"
    )


def function_fold() -> Column:
    """Functions in the column `marks` by their first and last token, in one fold with a stack of
    open brackets for each kind.

    An opening bracket carries the heads whose body it is: the arrow right before it, and for a
    brace outside all brackets the declarations that wait for one. Other arrows wait for the next
    separator, closing bracket or statement start at their depth; without one they go on to the
    end. A semicolon outside all brackets ends declarations without a body.
    """
    bodies = "if(a.depth = 0 and x.tok = '{', a.declared, slice(a.declared, 1, 0))"
    heads = f"concat(if(a.block is null, slice(a.declared, 1, 0), array(a.block)), {bodies})"
    state, step, top = _stacks(
        f"struct(x.pos as pos, {heads} as heads)", f"struct<pos:int,heads:array<{_HEAD}>>"
    )
    state |= {
        "depth": "0",
        "params": "cast(null as int)",  # opening partner of the mark before
        "block": f"cast(null as {_HEAD})",  # arrow whose block the next mark opens
        "declared": f"cast(array() as array<{_HEAD}>)",
        "waiting": f"cast(array() as array<struct<depth:int,head:{_HEAD}>>)",
    }
    head = (
        "if(x.closed and a.params is not null, struct(x.head.kind as kind, x.head.name as name, "
        "x.head.pos as pos, a.params as first), x.head)"
    )
    left = "if(x.ends and size(a.waiting) > 0, filter(a.waiting, w -> w.depth != a.depth), a.waiting)"
    step |= {
        "depth": f"a.depth + case when {_in('x.tok', _OPENS)} then 1 when {_in('x.tok', _CLOSES)} then -1 else 0 end",
        "params": f"({top}).pos",
        "block": f"if(x.block and x.head is not null, {head}, null)",
        "declared": (
            "case when a.depth != 0 then a.declared when x.tok in ('{', ';') then slice(a.declared, 1, 0) "
            "when x.tok = 'function' and x.head is not null then array_append(a.declared, x.head) else a.declared end"
        ),
        "waiting": (
            "case when x.tok = '=>' and not x.block and x.head is not null then "
            f"array_append(a.waiting, struct(a.depth as depth, {head} as head)) else {left} end"
        ),
    }
    none = f"cast(array() as array<{_FOUND}>)"
    ended = f"transform(filter(a.waiting, w -> w.depth = a.depth), w -> {_found('w.head', 'x.last', 'false')})"
    closed = f"transform(({top}).heads, h -> {_found('h', 'x.pos', 'true')})"
    out = (
        f"if(x.ends, concat(if(size(a.waiting) > 0, {ended}, {none}), "
        f"if({_in('x.tok', _CLOSES)}, coalesce({closed}, {none}), {none})), null)"
    )
    to_end = lambda h: _found(h, "-1", "false")
    open_still = ", ".join(
        f"flatten(transform(b.{name}, o -> transform(filter(o.heads, h -> h.kind = 'arrow'), h -> {to_end('h')})))"
        for *_, name in _KINDS
    )
    rest = (
        f"concat(transform(b.waiting, w -> {to_end('w.head')}), "
        f"if(b.block is null, {none}, array({to_end('b.block')})), {open_still})"
    )
    return F.expr(fold("marks", state, step, _FOUND, out, rest))


def _offsets(pieces: str) -> str:
    """Characters and line breaks before every part of an array of parts."""
    text = "array_join(p, '')"
    return (
        f"aggregate({pieces}, struct(0 as off, 0 as line, cast(array() as array<struct<off:int,line:int>>) as found), "
        f"(a, p) -> struct(a.off + length({text}) as off, a.line + {_breaks(text)} as line, "
        "array_append(a.found, struct(a.off as off, a.line as line)) as found), a -> a.found)"
    )


def offsets() -> Column:
    """Characters and line breaks before every PART-th piece of `raw`."""
    return F.expr(_offsets(parts("raw")))


def spans_of() -> Column:
    """Functions of the column `found` with character offsets and lines, from `raw` and `offsets`.

    A token's offset is that of its part and the lengths of the pieces before it in the part; only
    tokens that begin or end a function are looked up.
    """
    near = lambda p: (
        f"if({p} % {PART} = 0, '', array_join(transform(sequence({p} - {p} % {PART}, {p} - 1), k -> get(raw, k)), ''))"
    )
    base = lambda p: f"get(offsets, cast({p} div {PART} as int))"
    blank = lambda p: f"left(get(raw, {p}), length(get(raw, {p})) - length(trim(LEADING {_BLANK} FROM get(raw, {p}))))"
    text = lambda p: f"concat({near(p)}, {blank(p)})"
    line = lambda p: f"1 + {base(p)}.line + {_breaks(text(p))}"
    return F.expr(
        "transform(found, f -> struct(f.kind as kind, f.name as name, f.pos as pos, "
        f"{base('f.first')}.off + length({text('f.first')}) as start, "
        f"if(f.last < 0, {_NO_END}, {base('f.last')}.off + length({near('f.last')}) + length(get(raw, f.last))) as stop, "
        f"{line('f.first')} as line_no, "
        f"if(f.last < 0, {line('f.first')}, {line('f.last')}) as end_line))"
    )


def _with_spans(sources: DataFrame, *keep: str) -> DataFrame:
    """Sources with the array `spans`."""
    rows = sources.select(*_FILE, *keep, matches().alias("raw")).select("*", code_of().alias("code"))
    rows = rows.select(*_FILE, *keep, "raw", function_marks().alias("marks"))
    rows = rows.select(*_FILE, *keep, "raw", function_fold().alias("found"), offsets().alias("offsets"))
    return rows.select(*_FILE, *keep, spans_of().alias("spans"))


def function_spans(sources: DataFrame) -> DataFrame:
    """Top-level function declarations and all arrow functions with their extent.

    Columns: `repo_id, path, kind ('function'|'arrow'), name, pos, start, stop, line_no,
    end_line`; `[start, stop)` are character offsets.
    """
    return _rows(_with_spans(sources), "spans", "kind")


# One match at least for every two that the patterns of COMPLEXITY have together.
BRANCH_MARK = r"[?&|ifwdc](?:(?<=[?])|(?<=&)&|(?<=[|])[|]|(?<![A-Za-z0-9_].)(?:(?<=i)f|(?<=f)or|(?<=w)hile|(?<=d)o|(?<=c)(?:ase|atch))(?![A-Za-z0-9_]))"


def complexity_of(text: Column) -> Column:
    """One plus the number of branch words and operators in a function's text."""
    total = F.lit(1)
    for pattern in COMPLEXITY:
        total = total + F.regexp_count(text, F.lit(ecma(pattern)))
    return total


def may_hold_finding() -> Column:
    """Whether a file can hold a long or complex function at all.

    A function has no more lines and no more branches than its file, so other files need no tokens; nor
    do those without a head. The patterns of a branch run only on texts that hold so many marks of one
    that they can add up: a mark counts twice at most.
    """
    text = F.col("content")
    headed = any_of(*[F.contains(text, F.lit(w)) for w in HEADS])
    enough = 2 * F.regexp_count(text, F.lit(BRANCH_MARK)) >= MAX_COMPLEXITY
    return headed & ((_newlines(text) >= MAX_FUNCTION_LINES) | (enough & (complexity_of(text) > MAX_COMPLEXITY)))


def measured_functions(
    files: DataFrame, options: Options = Options(), keep: Column | None = None
) -> DataFrame:
    """Function spans with line count and complexity; the text is in the row with them."""
    text = F.expr("substring(content, start + 1, stop - start)")
    rows = _with_spans(typed_sources(files, options, keep), "content")
    return _rows(rows, "spans", "kind", "content").select(
        *_FILE, "kind", "name", "pos", "line_no", "end_line",
        (F.col("end_line") - F.col("line_no") + 1).alias("n_lines"),
        complexity_of(text).alias("complexity"),
    )


def function_items() -> Column:
    """Evidence of long and complex functions, from `spans` and `content`; declarations come before
    arrows in the emission order."""

    def items(span: Column) -> Column:
        n_lines = span["end_line"] - span["line_no"] + 1
        text = F.substring("content", span["start"] + 1, span["stop"] - span["start"])
        at = dict(
            line=span["line_no"], name=span["name"],
            k1=F.when(span["kind"] == "arrow", 1 << 30).otherwise(0) + span["pos"],
        )
        # The text is cut out once, not for every pattern.
        return let(let(text, complexity_of), lambda n: F.concat(
            found(n_lines > MAX_FUNCTION_LINES, evidence("max-lines-per-function", n=n_lines, **at)),
            found(n > MAX_COMPLEXITY, evidence("complexity", n=n, k2=1, **at)),
        ))

    return F.flatten(F.transform("spans", items))


def function_evidence(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Long and complex functions."""
    rows = _with_spans(typed_sources(files, options, may_hold_finding()), "content")
    return _rows(rows, function_items(), "entry")


IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"


_NAME = "struct<name:string,pos:int,declares:boolean,binds:boolean>"
_SHADOW = "struct<name:string,lo:int,hi:int>"
FEW_NAMES = 32  # up to so many declared names are looked up one by one at each token
FEW_COUNTED = 8  # up to so many declarations are counted one by one
DECLARING = ("const", "let", "var")
_BINDING = (*DECLARING, "function", "class")  # words before a name that a block declares
_CONTROL = ("if", "for", "while", "switch", "with")  # brackets after these are no parameters
_SPREAD = "(x.prev1 = '.' and x.prev2 = '.')"
_LISTED = f"(x.prev1 in ('(', ',') or {_SPREAD})"
# A member, a key, a label or a parameter with a type: not the variable of that name.
_LABEL = (
    "((x.prev1 = '.' and coalesce(x.prev2 != '.', true)) or (x.prev1 in ('{', ',', '(', ';') and "
    "(x.next1 = ':' or (x.next1 = '?' and x.next2 = ':'))))"
)


def _name_fold() -> str:
    """The names in the column `name_marks`, with whether each stands where a top-level variable is
    declared, and whether it may be one that a block or a parameter list declares. Other members,
    keys and labels are left out.

    The state tells the depth; whether a declaration or something else began last; whether the
    declarator is at its value or its type; and whether the open brackets are a pattern.
    """
    top = "a.depth = 0"
    inside = (
        f"case when {top} and {_in('x.tok', DECLARING)} then 'd' "
        f"when {top} and {_in('x.tok', (';', *STARTERS))} then 's' else a.inside end"
    )
    phase = (
        f"case when {top} and {_in('x.tok', (*DECLARING, '='))} then 'v' "
        f"when {top} and x.tok = ':' and {_in('x.prev2', (*DECLARING, ','))} then 't' else a.phase end"
    )
    starts = (
        f"coalesce({_in('x.prev1', DECLARING)} or (x.prev1 = ',' and ({inside}) = 'd' and a.phase = 'v'), false)"
    )
    pattern = f"case when {top} then if({_in('x.tok', ('{', '['))} and {starts}, 'p', 'x') else a.pattern end"
    bound = (
        f"(a.depth > 0 and a.pattern = 'p' and coalesce(x.next1 != ':', true) and "
        f"({_in('x.prev1', ('{', '[', ',', ':'))} or (x.prev1 = '.' and x.prev2 = '.')))"
    )
    declares = f"coalesce(({top} and {starts} and not {_in('x.tok', DECLARING)}) or {bound}, false)"
    binds = f"coalesce(a.depth > 0 and ({_in('x.prev1', _BINDING)} or {_LISTED}), false)"
    row = f"struct(x.tok as name, x.pos as pos, {declares} as declares, {binds} as binds)"
    state = {"depth": "0", "inside": "'s'", "phase": "''", "pattern": "'x'"}
    step = {
        "depth": f"a.depth + case when {_in('x.tok', _OPENS)} then 1 when {_in('x.tok', _CLOSES)} then -1 else 0 end",
        "inside": inside, "phase": phase, "pattern": pattern,
    }
    # A label may still be a declared name (`a = 1, b: T = 2`) or a parameter that hides one.
    counts = f"(coalesce(not {_LABEL}, true) or {declares} or {binds})"
    return fold("name_marks", state, step, _NAME, row, when=f"x.tok rlike {_WORD} and {counts}")


_NEXT_TO = {"x.prev1": "get(code, i - 1).tok", "x.prev2": "get(code, i - 2).tok",
            "x.next1": "get(code, i + 1).tok", "x.next2": "get(code, i + 2).tok", "x.tok": "t.tok"}


def _in_code(condition: str) -> str:
    """A condition on a mark `x` as one on the token `t` at place `i` of `code`."""
    for name, there in _NEXT_TO.items():
        condition = condition.replace(name, there)
    return condition


# Tokens that the fold over names looks at: those that change its state, but for brackets around
# nothing, and those right after which a name may be declared. Any other name is a use, whatever stands
# around it.
_EMPTY = " or ".join(f"(x.tok = '{o}' and x.next1 = '{c}') or (x.tok = '{c}' and x.prev1 = '{o}')" for o, c, _ in _KINDS)
# Two look-ups come first, as most tokens end there: lists of these lengths are hash sets to Spark.
_MARKED = (
    f"if(coalesce({_in('x.tok', (*_OPENS, *_CLOSES, ';', '=', ':', *STARTERS))} or "
    f"{_in('x.prev1', (*_BINDING, *_OPENS, ',', ':', '.'))}, false), "
    f"coalesce({_in('x.tok', (*_OPENS, *_CLOSES, ';', '=', *STARTERS))} or "
    f"{_in('x.prev1', (*_BINDING, *_OPENS, ',', ':'))} or {_SPREAD} or "
    f"(x.tok = ':' and {_in('x.prev2', (*DECLARING, ','))}), false) and not coalesce({_EMPTY}, false), false)"
)


def name_marks() -> Column:
    """Tokens of `code` that the fold over names needs, with their neighbours; of semicolons in a row
    the first."""
    mark = _in_code(
        "struct(x.tok as tok, t.pos as pos, x.prev1 as prev1, x.prev2 as prev2, x.next1 as next1, x.next2 as next2)"
    )
    marks = f"array_compact(transform(code, (t, i) -> if({_in_code(_MARKED)}, {mark}, null)))"
    return F.expr(
        f"transform(array({marks}), m -> filter(m, (x, i) -> x.tok <> ';' or coalesce(get(m, i - 1).tok <> ';', true)))[0]"
    )


def _template_names() -> str:
    """Names inside `${...}` of templates in `code`; they declare nothing. Of a template that holds
    templates all words count."""
    name = "struct(n as name, t.pos as pos, false as declares, false as binds)"
    return (
        "flatten(transform(filter(code, t -> startswith(t.tok, '`')), t -> "
        "if(length(t.tok) - length(replace(t.tok, '`', '')) > 2, "
        f"transform(regexp_extract_all(t.tok, '{IDENT}', 0), n -> {name}), "
        "flatten(transform(regexp_extract_all(t.tok, '\\\\$\\\\{([^}]*)\\\\}', 1), h -> "
        f"transform(regexp_extract_all(h, '{IDENT}', 0), n -> {name}))))))"
    )


def all_names() -> Column:
    """Uses and declarations of the names that `name_marks` declares, from these and `code`, as
    `(name, pos, declares, binds)`. Where many names are declared, others are among them."""
    mine = lambda name: f"(size(d) > {FEW_NAMES} or array_contains(d, {name}))"
    use = "struct(t.tok as name, t.pos as pos, false as declares, false as binds)"
    plain = _in_code(f"not ({_MARKED}) and x.tok rlike {_WORD} and coalesce(not {_LABEL}, true)")
    uses = f"array_compact(transform(code, (t, i) -> if({mine('t.tok')} and {plain}, {use}, null)))"
    none = f"cast(array() as array<{_NAME}>)"
    return F.expr(
        f"transform(array({_name_fold()}), c -> transform(array(array_distinct(transform(filter(c, n -> n.declares), "
        f"n -> n.name))), d -> if(size(d) = 0, {none}, "
        f"concat(filter(c, n -> {mine('n.name')}), {uses}, {_template_names()})))[0])[0]"
    )


def shadows() -> Column:
    """Where a block hides a top-level variable that it declares anew, as `(name, lo, hi)`, from
    `code` and `names`.

    A block declares the names after `const`, `let`, `var`, `function` and `class` right inside it, and
    those of the parameter list before it, between which and the block only an arrow may stand. One
    fold with a stack of all open brackets, and only for files that have such a name.
    """
    named = "struct<name:string,lo:int>"
    opened = f"struct<pos:int,curly:boolean,lists:boolean,names:array<{named}>>"
    last = "element_at(a.open, -1)"
    add = (
        f"transform(a.open, (o, i) -> if(i = size(a.open) - 1, struct(o.pos as pos, o.curly as curly, o.lists as "
        "lists, array_append(o.names, struct(x.tok as name, o.pos as lo)) as names), o))"
    )
    lists = f"(x.tok = '(' and coalesce(not {_in('x.prev1', _CONTROL)}, true))"
    body = (
        "coalesce(x.tok = '{' and a.list is not null and (x.prev1 = ')' or (x.prev1 = '=>' and x.prev2 = ')')), false)"
    )
    push = (
        f"array_append(a.open, struct(x.pos as pos, x.tok = '{{' as curly, {lists} as lists, "
        f"if({body}, a.list.names, cast(array() as array<{named}>)) as names))"
    )
    held = (
        f"x.tok rlike {_WORD} and size(a.open) > 0 and coalesce(({last}.curly and {_in('x.prev1', _BINDING)}) or "
        f"({last}.lists and {_LISTED}), false)"
    )
    step = {
        "open": (
            f"case when {_in('x.tok', _OPENS)} then {push} when {_in('x.tok', _CLOSES)} and size(a.open) > 0 "
            f"then slice(a.open, 1, size(a.open) - 1) when {held} then {add} else a.open end"
        ),
        "list": (
            f"case when x.tok = ')' and size(a.open) > 0 and {last}.lists then {last} "
            "when x.tok = '=>' then a.list end"
        ),
    }
    state = {"open": f"cast(array() as array<{opened}>)", "list": f"cast(null as {opened})"}
    out = (
        f"if(x.tok = '}}' and size(a.open) > 0 and {last}.curly, "
        f"transform({last}.names, n -> struct(n.name as name, n.lo as lo, x.pos as hi)), null)"
    )
    chosen = lambda flag: f"transform(filter(names, n -> n.{flag}), n -> n.name)"
    mark = _in_code("struct(x.tok as tok, t.pos as pos, x.prev1 as prev1, x.prev2 as prev2)")
    marks = (
        f"transform(array(array_intersect({chosen('binds')}, {chosen('declares')})), hidden -> "
        f"if(size(hidden) = 0, null, array_compact(transform(code, (t, i) -> if("
        f"{_in('t.tok', (*_OPENS, *_CLOSES, '=>'))} or array_contains(hidden, t.tok), {mark}, null)))))[0]"
    )
    return F.expr(
        f"transform(array({marks}), marks -> if(marks is null, cast(array() as array<{_SHADOW}>), "
        f"{fold('marks', state, step, _SHADOW, out)}))[0]"
    )


def declaring() -> Column:
    """Whether a text can declare a variable at all."""
    return any_of(*[F.contains("content", F.lit(w)) for w in DECLARING])


def unused_names() -> Column:
    """Declared names without another use, as `(name, pos)`, from `names` and `hidden`.

    Names and the places where a block hides them are sorted together by name and place; a use counts
    unless it lies before the farthest end of a hiding block that began before it. Where no block hides
    any of a few names, each is counted without that.
    """
    alone = "size(filter(names, y -> y.name = x.name)) = 1"
    quick = f"transform(filter(names, x -> x.declares and not startswith(x.name, '_') and {alone}), x -> struct(x.name as name, x.pos as pos))"
    few = f"size(hidden) = 0 and size(filter(names, x -> x.declares)) <= {FEW_COUNTED}"
    every = (
        "sort_array(concat(transform(names, n -> struct(n.name as name, n.pos as pos, -1 as hi, "
        "n.declares as declares)), transform(hidden, h -> struct(h.name as name, h.lo as pos, h.hi as hi, "
        "false as declares))))"
    )
    same = "(a.name = x.name)"
    counted = f"(x.hi < 0 and (x.declares or not {same} or a.cover < x.pos))"
    state = {"name": "''", "n": "0", "at": "-1", "cover": "-1"}
    step = {
        "name": "x.name",
        "n": f"if({same}, a.n, 0) + if({counted}, 1, 0)",
        "at": f"if(x.declares, x.pos, if({same}, a.at, -1))",
        "cover": f"if({same}, greatest(a.cover, x.hi), x.hi)",
    }
    one = lambda r: f"{r}.n = 1 and {r}.at >= 0 and not startswith({r}.name, '_')"
    item = lambda r: f"array(struct({r}.name as name, {r}.at as pos))"
    none = "cast(array() as array<struct<name:string,pos:int>>)"
    found = fold(
        "every", state, step, "struct<name:string,pos:int>",
        f"if(not {same} and {one('a')}, {item('a')}, null)", f"if({one('b')}, {item('b')}, {none})",
    )
    return F.expr(f"if({few}, {quick}, transform(array({every}), every -> {found})[0])")


def unused_items() -> Column:
    """Evidence of unused names, from `names`, `hidden` and `raw`; a line is counted for findings only."""
    before = lambda x: _newlines(F.array_join(F.slice("raw", 1, x["pos"] + 1), ""))
    return F.transform(unused_names(), lambda x: evidence(
        "no-unused-vars", line=before(x) + 1, name=x["name"], k1=x["pos"]
    ))


def unused_evidence(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Top-level variables that their file does not use.

    Every declarator of a statement counts, and every name that a destructuring pattern binds: names
    after `{`, `[`, `,`, `:` or `...` in the brackets of the pattern, but for keys before a colon and
    default values. Commas inside a type annotation declare nothing. Names inside `${...}` of a
    template count as uses. Members after a dot, keys, labels and typed parameters are no uses; nor are
    names in a block that declares them anew, itself or by its parameters. The parameters of an arrow
    without block hide nothing.
    """
    rows = typed_sources(files, options, declaring()).select(*_FILE, matches().alias("raw"))
    rows = rows.select(*_FILE, "raw", code_of().alias("code"))
    rows = rows.select(*_FILE, "raw", "code", name_marks().alias("name_marks"))
    rows = rows.select(*_FILE, "raw", "code", all_names().alias("names"))
    rows = rows.select(*_FILE, "raw", "names", shadows().alias("hidden"))
    return _rows(rows, unused_items(), "entry")


def any_items() -> Column:
    """Evidence of `any` in a type position, one finding per file at the first use, from `code` and
    `raw`."""

    def place(token: Column, k: Column) -> Column:
        prev, following = F.get("code", k - 1)["tok"], F.get("code", k + 1)["tok"]
        typed = (
            prev.isin(":", "<", "|", "&", "as", "=>", "is", "keyof", "extends", "satisfies")
            | ((prev == ",") & (following == ">"))
            | ((prev == "=") & following.isin(";", "[", "|"))
        )
        return F.when((token["tok"] == "any") & typed, token["pos"])

    def item(places: Column) -> Column:
        upto = F.array_join(F.slice("raw", 1, F.get(places, F.lit(0)) + 1), "")
        return found(F.size(places) > 0, evidence(
            "no-explicit-any", line=_newlines(upto) + 1, n=F.size(places)
        ))

    return let(F.array_compact(F.transform("code", place)), item)


def may_hold_any() -> Column:
    return F.contains("content", F.lit("any"))


def any_evidence(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Uses of `any` in a type position."""
    rows = typed_sources(files, options, may_hold_any()).select(*_FILE, matches().alias("raw"))
    return _rows(rows.select(*_FILE, "raw", code_of().alias("code")), any_items(), "entry")


def typed_evidence(files: DataFrame, options: Options = Options()) -> DataFrame:
    return union_all([
        function_evidence(files, options),
        unused_evidence(files, options),
        any_evidence(files, options),
    ])
