"""The code corpus as a Spark plan and as SQL.

Repositories are blocks of 40 documents; every third block belongs to one large repository, so
that a third of all files share a key. Everything is a projection of the given tables, except the
root files, which need the list of repositories.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lintlake.session import ensure_checkpoint_dir
from verification.snippets import ADVISORIES, PAGE_TAILS, ROOT_FILES, SNIPPETS

BLOCK = 40
MONO_EVERY = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fill(text: Column) -> Column:
    for mark, shift in (("{id}", 0), ("{p1}", 1), ("{m1}", -1), ("{m2}", -2), ("{m3}", -3)):
        text = F.replace(text, F.lit(mark), (F.col("doc_id") + shift).cast("string"))
    return text


def _repo(block: Column) -> Column:
    return F.when(block % MONO_EVERY == 0, "mono").otherwise(
        F.concat(F.lit("r"), block.cast("string"))
    )


def session_folder(spark: SparkSession, name: str) -> str:
    """New folder for a table of this session, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_written: dict[tuple[str, str], str] = {}
PIECE = 2 << 20  # bytes of the given tables for each file of the file table


def pieces(spark: SparkSession, sf_dir: str) -> int:
    """How many files the file table is written in: a number that grows with the given tables. Left
    to adaptive execution there are as few as cores, or up to 64 MB of shuffled texts in each."""
    length = sum(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .load(f"{sf_dir}/{name}.parquet").agg(F.sum("length")).first()[0] or 0
        for name in ("documents", "pages")
    )
    return max(spark.sparkContext.defaultParallelism, -(-length // PIECE))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file table: derived once per session, then read back as Parquet, so that queries get a
    real scan with column pruning. It lies in the checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        folder = session_folder(spark, "files")
        derived = derive_files(spark, sf_dir)
        # Rows are spread anew at every size: a small input may come as one split.
        derived.repartition(pieces(spark, sf_dir), "repo_id", "path").write.parquet(folder)
        _written[key] = folder
    return spark.read.schema("repo_id string, path string, content string").parquet(_written[key])


def derive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [s.__dict__ for s in SNIPPETS]
    snippets = F.from_json(
        F.lit(json.dumps(rows)),
        "array<struct<directory:string,offset:int,ext:string,head:string,tail:string>>",
    )
    block = F.floor(F.col("doc_id") / BLOCK)
    docs = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text", F.get(snippets, (F.col("doc_id") % len(SNIPPETS)).cast("int")).alias("s"))
        .select(
            _repo(block).alias("repo_id"),
            F.concat("s.directory", F.lit("m"), (F.col("doc_id") + F.col("s.offset")).cast("string"),
                     "s.ext").alias("path"),
            F.concat(_fill(F.col("s.head")), F.lit("\n"), F.coalesce("text", F.lit("")),
                     F.lit("\n"), _fill(F.col("s.tail"))).alias("content"),
        )
    )
    roots = [dict(path=p, every=n, rest=r, content=c) for p, n, r, c in ROOT_FILES]
    root_rows = F.from_json(
        F.lit(json.dumps(roots)), "array<struct<path:string,every:int,rest:int,content:string>>"
    )
    root = (
        table(spark, sf_dir, "documents")
        .groupBy(_repo(block).alias("repo_id"))
        .agg(F.min(block).alias("block"))
        .select("repo_id", "block", F.inline(root_rows))
        .where(F.col("block") % F.col("every") == F.col("rest"))
        .select("repo_id", "path", "content")
    )
    tails = F.array(*map(F.lit, PAGE_TAILS))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("w"), F.floor(F.col("page_id") / 25).cast("string")).alias("repo_id"),
        F.concat(
            F.lit("site/p"), F.col("page_id").cast("string"),
            F.when(F.col("page_id") % 3 == 0, ".vue").otherwise(".html"),
        ).alias("path"),
        F.concat("html", F.get(tails, (F.col("page_id") % len(PAGE_TAILS)).cast("int")))
        .alias("content"),
    )
    return docs.unionByName(root).unionByName(pages)


def advisories(spark: SparkSession) -> DataFrame:
    from lintlake.operators.advisories import ADVISORY_SCHEMA

    return spark.createDataFrame(list(ADVISORIES), ADVISORY_SCHEMA)


# ---- the same in SQL --------------------------------------------------------------------------


def q(text: str | None) -> str:
    """SQL literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    one = lambda v: q(v) if v is None or isinstance(v, str) else str(v)
    return ",\n".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def _sql_fill(column: str) -> str:
    out = column
    for mark, shift in (("{id}", 0), ("{p1}", 1), ("{m1}", -1), ("{m2}", -2), ("{m3}", -3)):
        out = f"replace({out}, '{mark}', CAST(doc_id + ({shift}) AS VARCHAR))"
    return out


_SQL_REPO = (
    f"CASE WHEN (doc_id // {BLOCK}) % {MONO_EVERY} = 0 THEN 'mono' "
    f"ELSE 'r' || CAST(doc_id // {BLOCK} AS VARCHAR) END"
)

FILES_SQL = f"""
snippets(kind, directory, shift, ext, head, tail) AS (VALUES
{_values((k, s.directory, s.offset, s.ext, s.head, s.tail) for k, s in enumerate(SNIPPETS))}
),
root_rows(path, every, rest, content) AS (VALUES
{_values(ROOT_FILES)}
),
page_tails(k, tail) AS (VALUES
{_values(enumerate(PAGE_TAILS))}
),
files AS MATERIALIZED (
  SELECT {_SQL_REPO} AS repo_id,
         directory || 'm' || CAST(doc_id + shift AS VARCHAR) || ext AS path,
         {_sql_fill('head')} || chr(10) || coalesce(text, '') || chr(10) || {_sql_fill('tail')}
           AS content
  FROM documents JOIN snippets ON kind = doc_id % {len(SNIPPETS)}
  UNION ALL
  SELECT repo_id, path, content
  FROM (SELECT {_SQL_REPO} AS repo_id, min(doc_id // {BLOCK}) AS block
        FROM documents GROUP BY 1) b, root_rows
  WHERE block % every = rest
  UNION ALL
  SELECT 'w' || CAST(page_id // 25 AS VARCHAR), 'site/p' || CAST(page_id AS VARCHAR)
           || CASE WHEN page_id % 3 = 0 THEN '.vue' ELSE '.html' END,
         html || tail
  FROM pages JOIN page_tails ON k = page_id % {len(PAGE_TAILS)}
)"""

LINES_SQL = FILES_SQL + """,
lines AS MATERIALIZED (
  SELECT repo_id, path, line, CAST(line_no AS INTEGER) AS line_no
  FROM (SELECT repo_id, path, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
        FROM (SELECT repo_id, path, string_split(content, chr(10)) AS l
              FROM files WHERE content <> ''))
)"""

ADVISORIES_SQL = (
    "advisories(name, introduced, fixed, severity, title, url, fix_available) AS (VALUES\n"
    + _values(ADVISORIES).replace("True", "TRUE").replace("False", "FALSE") + "\n)"
)
