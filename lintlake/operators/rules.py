"""Line and file rules.

All line rules given to one call share one scan and one split of the text. Conditions are
unrolled with literal patterns (compiled once per task) and nothing is shuffled: neighbouring
lines come from the line array that the row already holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.functions.text import SPACE, any_of, split_lines
from lintlake.operators.catalogue import INDEX
from lintlake.operators.issues import evidence
from lintlake.sources.files import (
    CODE_EXTENSIONS, DEFAULT_EXTENSIONS, SECURITY_EXTENSIONS, TEMPLATE_EXTENSIONS, has_content,
    has_extension, is_test_file, walk_condition,
)


@dataclass(frozen=True)
class Options:
    """What a scan may be told: extra ignore globs, whether dotfiles count, and how many untested
    files of a repository are reported one by one (None: all). More of them lower its score."""

    ignore: tuple[str, ...] = ()
    include_dotfiles: bool = False
    first_untested: int | None = 20

    def walk(self, exts: Sequence[str], tests: bool = True) -> Column:
        return walk_condition(exts, self.ignore, tests, include_dotfiles=self.include_dotfiles)


def _secure(o: Options) -> Column:
    path = F.col("path")
    return o.walk(SECURITY_EXTENSIONS) & ~path.contains(".lock") & ~path.endswith(".min.js")


def _react(o: Options) -> Column:
    text = F.col("content")
    named = has_extension(("tsx", "jsx")) | text.contains("React") | text.contains("jsx")
    return o.walk(CODE_EXTENSIONS, tests=False) & named


def _markup(o: Options) -> Column:
    return o.walk(TEMPLATE_EXTENSIONS) | o.walk(("tsx", "jsx"), tests=False)


# Which files a rule looks at, as a condition on one file row.
SCOPES: dict[str, Callable[[Options], Column]] = {
    "code": lambda o: o.walk(CODE_EXTENSIONS, tests=False),
    "secure": _secure,
    "secrets": lambda o: _secure(o)
    & ~F.col("path").contains(".env.example")
    & ~F.col("path").contains(".env.sample"),
    "react": _react,
    "markup": _markup,
    "jsx": lambda o: o.walk(("tsx", "jsx"), tests=False),
    "node": lambda o: o.walk(("ts", "js"), tests=False),
    "tests": lambda o: is_test_file(),
    "walked": lambda o: o.walk(DEFAULT_EXTENSIONS),
}


@dataclass(frozen=True)
class LineRule:
    """A pattern on one line, with guards.

    `hint` holds literal words of which the text of a hit always contains one; lower-case words
    are compared with the lower-cased text when `fold` is set. Good words start with a rare byte.
    `near` looks at neighbours: it gets the line array and the 0-based index.
    """

    kind: str
    scope: str
    match: str
    hint: tuple[str, ...]
    unless: tuple[str, ...] = ()
    comments: tuple[str, ...] = ()
    near: Callable[[Column, Column], Column] | None = None
    count: Callable[[Column], Column] | None = None
    over: int | None = None
    name: Callable[[Column], Column] | None = None
    fold: bool = False
    k2: int = 0

    def possible(self) -> Column:
        """Whether a file can hold a hit at all: its path is in scope and a hint occurs."""
        text = F.col("folded") if self.fold else F.col("content")
        return F.col(f"in_{self.scope}") & any_of(*[F.contains(text, F.lit(w)) for w in self.hint])

    def condition(self, line: Column, lines: Column, i: Column) -> Column:
        out = F.col(f"on_{INDEX[self.kind]}") & line.rlike(self.match)
        for pattern in self.unless:
            out = out & ~line.rlike(pattern)
        if self.comments:
            out = out & ~line.rlike(f"^[{SPACE}]*(?:" + "|".join(self.comments) + ")")
        if self.over is not None:
            out = out & (self.count(line) > self.over)
        if self.near is not None:
            out = out & self.near(lines, i)
        return out


def apply_line_rules(
    files: DataFrame, rules: Sequence[LineRule], options: Options = Options()
) -> DataFrame:
    """Evidence rows of all given line rules, in one pass.

    Substring tests on the whole text decide per file which rules can hit; lines are cut only for
    files with such a rule, and only those rules run on them. The rules run inside a `transform`
    over the lines: dozens of patterns unrolled into one generated method would outgrow what the
    JVM compiles, and only lines with a finding become rows.
    """
    flags = [f"on_{INDEX[r.kind]}" for r in rules]
    # Scopes and folded text are columns of their own, so that each is computed once per file. No
    # filter on them: it would be pushed below and compute them twice.
    flagged = (
        files.where(has_content())
        .select(
            "repo_id", "path", "content",
            *[SCOPES[s](options).alias(f"in_{s}") for s in dict.fromkeys(r.scope for r in rules)],
            *([F.lower("content").alias("folded")] if any(r.fold for r in rules) else []),
        )
        .select("repo_id", "path", "content", *[r.possible().alias(f) for r, f in zip(rules, flags)])
        .withColumn("lines", F.when(any_of(*map(F.col, flags)), split_lines(F.col("content"))))
    )

    def on_line(line: Column, i: Column) -> Column:
        hits = F.array(*[
            F.when(r.condition(line, F.col("lines"), i), F.lit(INDEX[r.kind])) for r in rules
        ])
        return F.transform(
            F.array_compact(hits),
            lambda entry: F.struct(entry.alias("entry"), i.alias("i"), line.alias("line")),
        )

    rows = flagged.select("repo_id", "path", F.inline(F.flatten(F.transform("lines", on_line))))
    line, i = F.col("line"), F.col("i")
    entry = F.col("entry")
    pick = lambda attr, kind: by_entry(
        entry, {r.kind: getattr(r, attr)(line) for r in rules if getattr(r, attr)}, kind
    )
    k2 = by_entry(entry, {r.kind: F.lit(r.k2) for r in rules if r.k2}, "int")
    return rows.select(
        "repo_id", "path", "entry",
        (i + 1).alias("line"),
        pick("count", "bigint").alias("n"),
        pick("name", "string").alias("name"),
        line.alias("text"),
        (i + 1).alias("k1"),
        F.coalesce(k2, F.lit(0)).alias("k2"),
    )


def by_entry(entry: Column, values: dict[str, Column], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for key, value in values.items():
        out = F.when(entry == INDEX[key], value.cast(kind)).otherwise(out)
    return out


def lines_from(lines: Column, i: Column, count: int, sep: str) -> Column:
    """Text of the line and those after it, `count` lines in all."""
    return F.array_join(F.slice(lines, i + 1, F.lit(count)), sep)


def lines_before(lines: Column, i: Column, count: int, sep: str) -> Column:
    """Text of up to `count` lines before the line, the line itself excluded."""
    start = F.greatest(i - count, F.lit(0))
    return F.array_join(F.slice(lines, start + 1, i - start), sep)


def apply_window_rules(
    files: DataFrame, rules: Sequence[LineRule], options: Options = Options()
) -> DataFrame:
    """Line rules that look at neighbours; the same pass serves both kinds."""
    return apply_line_rules(files, rules, options)


@dataclass(frozen=True)
class FileRule:
    """A rule on the whole text: `find` turns a prepared file row into an evidence array.

    The row offers `path`, `content`, `lines` and one `in_<scope>` flag per scope used.
    """

    kinds: tuple[str, ...]
    scopes: tuple[str, ...]
    find: Callable[[], Column]
    prepare: dict[str, Callable[[], Column]] = field(default_factory=dict)


def apply_file_rules(
    files: DataFrame, rules: Sequence[FileRule], options: Options = Options()
) -> DataFrame:
    """Evidence rows of all given file rules, in one pass and without a shuffle."""
    scopes = dict.fromkeys(s for r in rules for s in r.scopes)
    rows = files.where(has_content()).select(
        "repo_id", "path", "content",
        *[SCOPES[s](options).alias(f"in_{s}") for s in scopes],
    ).where(any_of(*[F.col(f"in_{s}") for s in scopes]))
    rows = rows.withColumn("lines", split_lines(F.col("content")))
    prepared = {k: make for r in rules for k, make in r.prepare.items()}
    if prepared:
        rows = rows.withColumns({k: make() for k, make in prepared.items()})
    items = [r.find() for r in rules]
    return rows.select(
        "repo_id", "path", F.inline(F.concat(*items) if len(items) > 1 else items[0])
    )


def first_line(lines: Column, matches: Callable[[Column], Column]) -> Column:
    """1-based number of the first line that matches, 0 if none."""
    return F.array_position(F.transform(lines, matches), F.lit(True)).cast("int")


def apply_first_per_file(hits: DataFrame) -> DataFrame:
    """First finding per file and rule (`hits` has `repo_id`, `file`, `rule`, `line`).

    Spark limits each map task to one row per group before the shuffle.
    """
    w = Window.partitionBy("repo_id", "file", "rule").orderBy("line")
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def repeated(names: Column) -> Column:
    """Second occurrences in a sorted array of `(name, pos)`; the array must be a column."""
    same = lambda a, b: F.coalesce(a["name"] == b["name"], F.lit(False))

    def second(x: Column, i: Column) -> Column:
        before = F.get(names, i - 1)
        return (i > 0) & same(before, x) & ~((i > 1) & same(F.get(names, i - 2), x))

    return F.filter(names, second)


def sorted_names(found: Column) -> Column:
    """`(name, pos)` structs in order, from an array of names."""
    pairs = F.transform(found, lambda n, i: F.struct(n.alias("name"), i.alias("pos")))
    return F.sort_array(pairs)


def repeated_evidence(key: str, names: Column) -> Column:
    """One finding per name that occurs twice or more, in order of the second occurrence."""
    return F.transform(
        repeated(names), lambda x: evidence(key, name=x["name"], k1=x["pos"])
    )
