"""Removal of repeated passages of several lines, by content-defined chunks.

Lines that hold a word have a digest, and a hash rolls over each of them and the one before it. A chunk
begins where this hash is least among its neighbours, so boundaries depend on four lines around them
and return after an insertion; two are never adjacent, so a chunk has two lines or more, but for the
first and last of a text. Chunk digests are counted over all documents.

What whole chunks miss, the ends of passages and short ones in foreign surroundings, is found by the
rolling hash itself: every two neighbouring lines are looked up that lie in no chunk with an earlier
like. The first place of a passage never lies in such a chunk, so nothing is lost by that. Of chunks
and pairs whose digest repeats, the bytes are compared, and all but the first of equal ones are
removed. Together a line goes exactly if it and a neighbour stand together at an earlier place too;
a pair could only be missed where the digests of 128 bits of two different chunks are equal.

Only digests of all chunks and pairs are shuffled, and the passages of repeated ones. Counts combine
before the shuffle; a passage that very many documents share is a join key that adaptive execution
splits. Work in a text is linear in its lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lintlake.llm._store import keep, table

MIN_LINES = 2
_WHITE = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _numbers(first: Column, n: Column) -> Column:
    """`n` numbers from `first` on."""
    return F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))


def _full(line: Column) -> Column:
    return F.btrim(line, F.lit(_WHITE)) != ""


def _digests(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.xxhash64(line))


def _hash(digests: Column, first: Column, n: Column) -> Column:
    """Hash of `n` lines from `first` on."""
    return F.xxhash64(F.transform(_numbers(first, n), lambda k: F.get(digests, k)))


def _place(digests: Column, at: Column, n: Column) -> Column:
    """(at, n, h, g) of `n` lines; h and g are a digest of 128 bits."""
    return _let(
        F.transform(_numbers(at, n), lambda k: F.get(digests, k)),
        lambda d: F.struct(
            at.alias("at"), n.alias("n"), F.xxhash64(d).alias("h"), F.xxhash64(F.lit(1), d).alias("g")
        ),
    )


def chunk_starts(digests: Column) -> Column:
    """Numbers, from 0, of the lines at which chunks begin."""

    def rolling(d: Column) -> Column:
        return F.transform(
            d, lambda x, i: F.when(i > 0, F.xxhash64(F.get(d, i - 1), x)).otherwise(2**63 - 1)
        )

    def starts(hashes: Column) -> Column:
        before = lambda i: F.get(hashes, i - 1)
        after = lambda i: F.coalesce(F.get(hashes, i + 1), F.lit(2**63 - 1))
        marked = F.transform(
            hashes,
            lambda h, i: F.when((i == 0) | ((h < before(i)) & (h <= after(i))), i),
        )
        return F.filter(marked, lambda i: i.isNotNull())

    return _let(rolling(digests), starts)


def _chunks(digests: Column) -> Column:
    """Chunks of MIN_LINES or more as [(at, n, h, g)]."""

    def cut(starts: Column) -> Column:
        sizes = F.transform(
            starts,
            lambda at, i: F.struct(
                at.alias("at"), (F.coalesce(F.get(starts, i + 1), F.size(digests)) - at).alias("n")
            ),
        )
        return F.transform(
            F.filter(sizes, lambda c: c["n"] >= MIN_LINES),
            lambda c: _place(digests, c["at"], c["n"]),
        )

    return _let(chunk_starts(digests), cut)


def _pairs(digests: Column) -> Column:
    """Neighbouring lines as [(at, n, h, g)]."""
    return F.transform(
        _numbers(F.lit(0), F.size(digests) - (MIN_LINES - 1)),
        lambda k: _place(digests, k, F.lit(MIN_LINES)),
    )


def _places(texts: DataFrame, passages: Callable[[Column], Column]) -> DataFrame:
    """(id, t, at, n, h, g) of the passages of every text; places count lines with a word only, and t
    tells texts of one id apart."""
    found = _let(
        _digests(F.filter(F.split("text", "\n", -1), _full)),
        lambda d: F.struct(F.xxhash64(d).alias("t"), passages(d).alias("found")),
    )
    return texts.select("id", found.alias("p")).select("id", "p.t", F.inline("p.found"))


def _alike(places: DataFrame) -> DataFrame:
    """Places whose digest repeats, with `first`, the first place that has it."""
    often = places.groupBy("h", "g").agg(
        F.count("*").alias("times"), F.min(F.struct("id", "at")).alias("first")
    ).where("times > 1").drop("times")
    return places.join(often, ["h", "g"])


def _repeats(texts: DataFrame, alike: DataFrame) -> DataFrame:
    """Places (id, at, n, h) whose bytes are a place before them too."""
    found = alike.groupBy("id").agg(F.collect_set(F.struct("at", "n", "h")).alias("found"))

    def passages(lines: Column) -> Column:
        return F.transform(
            _own(lines, F.col("found")),
            lambda c: F.struct(c["at"], c["n"], c["h"], _joined(lines, c).alias("passage")),
        )

    lines = F.filter(F.split("text", "\n", -1), _full)
    repeated = keep(
        texts.hint("merge").join(found, "id").select("id", F.inline(_let(lines, passages))), "repeated"
    )
    firsts = repeated.groupBy("passage").agg(
        F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("times")
    ).where("times > 1").select("passage", "first")
    return repeated.join(firsts, "passage").where(F.struct("id", "at") != F.col("first")).select(
        "id", "at", "n", "h"
    )


def _joined(lines: Column, place: Column) -> Column:
    return F.array_join(
        F.transform(_numbers(place["at"], place["n"]), lambda k: F.get(lines, k)), "\n"
    )


def _own(lines: Column, places: Column) -> Column:
    """Places that hold for a text: an id may be repeated with another one."""
    return _let(_digests(lines), lambda d: F.filter(
        places,
        lambda c: (c["at"] + c["n"] <= F.size(d)) & (_hash(d, c["at"], c["n"]) == c["h"]),
    ))


def _without(lines: Column, cuts: Column) -> Column:
    """Numbers of the lines that stay; empty lines inside a cut go with it."""
    numbered = F.filter(
        F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: _full(y["x"])
    )

    def gone(full: Column) -> Column:
        ends = lambda c: F.sequence(
            F.get(full["i"], c["at"]), F.get(full["i"], c["at"] + c["n"] - 1)
        )
        return F.flatten(F.transform(_own(full["x"], cuts), ends))

    return F.array_except(
        F.sequence(F.lit(0), F.size(lines) - 1),
        _let(numbered, lambda y: _let(F.struct(
            F.transform(y, lambda z: z["x"]).alias("x"), F.transform(y, lambda z: z["i"]).alias("i")
        ), gone)),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its text cut, and with n_lines and n_removed (lines) behind its columns.

    Two neighbouring lines go if the same bytes are neighbours in a document with a smaller id, or
    earlier in the same one. Lines without a word stand between neighbours: they are no part of a
    passage, and go with one that goes on both sides of them. Lines end at "\\n"; what is left is joined by it. A null
    text stays null and has no lines; an empty text is one line. Rows without id are left as they
    are and remove nothing elsewhere. Rows that repeat an id and text remove nothing from each other.
    A column that is named like one of the two added is replaced. An empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(
        F.col("id").isNotNull() & F.contains("text", F.lit("\n"))
    )
    chunks = keep(_alike(_places(texts, _chunks)), "chunks")
    inside = chunks.where(F.struct("id", "at") != F.col("first")).select(
        "id", "t", F.explode(_numbers(F.col("at"), F.col("n") - (MIN_LINES - 1))).alias("at")
    )
    pairs = _alike(_places(texts, _pairs).join(inside, ["id", "t", "at"], "left_anti"))
    gone = _repeats(texts, chunks.unionByName(pairs))
    cuts = gone.groupBy("id").agg(F.collect_set(F.struct("at", "n", "h")).alias("_cuts"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    text = F.col("row").getField(text_col)
    result = _let(F.split(text, "\n", -1), lambda lines: _let(
        _without(lines, F.col("_cuts")),
        lambda left: F.struct(
            F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("text"),
            (F.size(lines) - F.size(left)).alias("n"),
        ),
    ))
    cut = docs.select(row).hint("merge").join(
        cuts, F.col("row").getField(id_col).cast("long") == F.col("id"), "left"
    ).select("row", F.when(F.col("_cuts").isNotNull() & text.isNotNull(), result).alias("cut"))
    n_lines = F.when(text.isNull(), 0).otherwise(
        F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    )
    added = {
        "n_lines": n_lines.cast("long"),
        "n_removed": F.coalesce("cut.n", F.lit(0)).cast("long"),
    }
    plain = [
        F.coalesce("cut.text", text).alias(c) if c == text_col else F.col("row").getField(c).alias(c)
        for c in docs.columns if c not in added
    ]
    return cut.select(*plain, *(c.alias(name) for name, c in added.items()))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents
        WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), f AS (
  SELECT *, sum("full"::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS "full" FROM l)
), p AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, k) > 1 AS gone
  FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS following FROM f WHERE "full")
  WHERE following IS NOT NULL
), g AS (
  SELECT f.*, coalesce(a.gone, FALSE) OR ("full" AND coalesce(b.gone, FALSE)) AS gone
  FROM f LEFT JOIN p a ON a.doc_id = f.doc_id AND a.k = f.k
         LEFT JOIN p b ON b.doc_id = f.doc_id AND b.k = f.k - 1
), o AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, CASE WHEN d.text IS NULL THEN 0 ELSE 1 END) AS n_lines,
       coalesce(n_removed, 0) AS n_removed, coalesce(o.text, d.text) AS text
FROM documents d LEFT JOIN o USING (doc_id)
"""
