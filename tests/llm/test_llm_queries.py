"""The registered queries on the smallest tables: against SQL where there is some, and the pipeline
stage by stage against plain versions."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
import corpus_pipeline
from lintlake.llm import decontamination, source_mixing, toxicity
from lintlake.llm._store import keep
from lintlake.llm.queries import ORACLES, QUERIES
from test_llm_operators import _near, _targets, _without_repeated_lines, _words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")

COLUMNS = {
    "op1_exact_topk": {"query_id", "rank", "vec_id", "score"},
    "op2_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op4_source_mixing": {"doc_id", "size", "source_size", "target", "taken", "position", "again"},
    "op5_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op9_minhash_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    want = duck.sql(ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", COLUMNS)
def test_query_has_its_columns_and_all_rows(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(frame.columns)
    if "doc_id" in frame.columns:
        assert frame.count() == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert "pipeline" not in entry.oracle_sql()


def test_pipeline_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "toxicity" or docs.columns == columns
        docs = keep(stage(spark, docs, SF), name)
    mixed = docs.collect()
    ids = {name: list(rows) for name, rows in inputs.items()}

    start = spark.read.parquet(f"{SF}/documents.parquet")
    sample = toxicity.labelled_sample(start, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(start, sample).collect()}
    assert set(ids["line_dedup"]) == {k for k, s in score.items() if s < corpus_pipeline.TOXIC_SCORE}

    texts = {k: inputs["line_dedup"][k]["text"] for k in sorted(inputs["line_dedup"])}
    for k, (text, n) in _without_repeated_lines(texts).items():
        assert inputs["near_dedup"][k]["text"] == text
        if n:
            assert inputs["near_dedup"][k]["n_chars"] == len(text)

    near = _near({k: r["text"] for k, r in inputs["near_dedup"].items()}, 5, 80)
    assert set(ids["decontamination"]) == {k for k, (_, root) in near.items() if k == root}

    items = {r["item_id"]: _words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    holds = lambda words, item: any(
        words[p:p + len(item)] == item for p in range(len(words) - len(item) + 1))
    with_items = {k for k, r in inputs["decontamination"].items()
                  if any(holds(_words(r["text"]), i) for i in items.values() if len(i) >= decontamination.WINDOW)}
    gone = set(ids["decontamination"]) - set(ids["mixing"])
    assert with_items <= gone

    assert {r["doc_id"] for r in mixed} == set(ids["mixing"])
    sizes = {}
    for r in mixed:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = _targets(sizes, source_mixing.WEIGHTS)
    for source, target in want.items():
        assert abs(sum(r["taken"] for r in mixed if r["source"] == source) - target) <= 1
    placed = [r["position"] for r in mixed if r["position"] is not None]
    assert len(placed) == sum(r["taken"] > 0 for r in mixed)


def test_decontamination_stage_judges_rows_by_their_text(spark, tmp_path):
    item = "in which year did the first of the four bridges over the river open"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"quiz: {item}?", "en", "a", 80), (1, "a clean text", "en", "a", 12), (None, item, "en", "b", 70),
            (None, "clean and without id", None, None, None), (2, None, "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert {r["text"] for r in left.collect()} == {"a clean text", "clean and without id", None}


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, tmp_path, empty):
    """Nulls in every column, an empty text, repeated rows, a further column; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    rows = [] if empty else [
        (1, None, None, None, None, "s"), (None, "no id\nat all", "en", "a", 12, None), (2, "", "en", "b", 0, "x"),
        (3, "one two\nthree four\nfive six", "en", "a", 28, "y"), (3, "one two\nthree four\nfive six", "en", "a", 28, "y"),
        (4, "w " * 5000, "en", None, 10000, ""), (None, None, None, None, None, None),
    ]
    spark.createDataFrame([(1, "some item of more than eight words in all it is")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").limit(0 if empty else 3).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        before = docs.count()
        docs = keep(stage(spark, docs, str(tmp_path)), name)
        assert name == "mixing" or docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        assert docs.count() == before
    kept = keep(corpus_pipeline.drop_toxic(spark, spark.createDataFrame(rows, schema), str(tmp_path)), "toxicity")
    assert kept.columns == spark.createDataFrame([], schema).columns and kept.count() <= len(rows)
