"""Folders of many files are written and listed by few tasks, each with many of them."""

import os
import re

from pyspark.sql import functions as F

from lintlake.sources import read_files
from verification import queries


def test_one_file_per_row_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "FILES_A_TASK", 10)
    spark.range(60).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")
    ).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["read_files"](spark, str(tmp_path))
    tasks = {name.rsplit("part-", 1)[1].split("-")[0] for name in rows.inputFiles()}
    assert len(tasks) > 3
    got = sorted((r.repo_id, int(r.file), r.content) for r in rows.collect())
    assert got == sorted(
        (f"repo=r{k % 20}", k, ("�" if k % 7 == 0 else "") + f"text {k}\n") for k in range(60)
    )


def test_a_task_lists_many_folders_and_the_setting_comes_back(spark, tmp_path):
    for k in range(200):
        (tmp_path / "in" / "repo" / f"d{k}").mkdir(parents=True)
        (tmp_path / "in" / "repo" / f"d{k}" / "a.ts").write_text("x")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, group = spark.conf.get(key), "listing"
    spark.sparkContext.setJobGroup(group, group)
    files = read_files(spark, str(tmp_path / "in"), extensions=None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) < 50
    assert files.count() == 200 and spark.conf.get(key) == before


ODD = "repo string, file bigint, value binary"


def _tree(root):
    """Keys of each text file, and its lines."""
    paths = [f"{top}/{n}"[len(str(root)):] for top, _, names in os.walk(root) for n in names if n.endswith(".txt")]
    return sorted(
        (*re.search(r"^/repo=([^/]*)/(?:part-\d+/)?file=([^/.]*)[/.]", p).groups(),
         *sorted((root / p[1:]).read_bytes().split(b"\n"))) for p in paths
    )


def test_files_made_by_tasks_are_those_of_the_text_writer(spark, tmp_path):
    """Null and negative keys, keys that repeat, malformed bytes, null and empty texts."""
    rows = [("r1", k, f"text {k}".encode()) for k in range(-20, 20)] + [
        (None, None, b"no key"), ("r1", None, b"no file"), (None, 3, b"no repo"), ("r2", 1, None),
        ("r2", 2, b""), ("r2", 3, b"\xff\xfebad"), ("r2", 4, "é\r\nline".encode()),
        *[("r3", 5, f"again {k}".encode()) for k in range(30)], ("r3", 5, b"again 1"),
    ]
    frame = spark.createDataFrame(rows, ODD).withColumn("value", F.col("value").cast("string"))
    (tmp_path / "far").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.odd.link./far", f"file://{tmp_path}/far")
    queries._write_one_by_one(frame, "viewfs://odd/far/out")  # no local path: Spark's writer
    queries._write_one_by_one(frame, f"file:{tmp_path}/near")
    want = _tree(tmp_path / "far" / "out")
    assert len(want) == 48 and _tree(tmp_path / "near") == want
    queries._write_one_by_one(frame.limit(0), f"{tmp_path}/none")
    assert read_files(spark, f"{tmp_path}/none", path_glob="*.txt").count() == 0


def test_local_files_are_made_without_a_process_for_each(spark, tmp_path):
    """Hadoop runs chmod for each folder, file and checksum file that it makes on a local disk."""
    rows = spark.range(50).select(
        F.lit("r").alias("repo"), F.col("id").alias("file"), F.lit("text").alias("value")
    )
    queries._write_one_by_one(rows, f"{tmp_path}/out")
    made = [n for _, _, names in os.walk(tmp_path / "out") for n in names]
    assert len(made) == 50 and not [n for n in made if n.endswith(".crc")]


def test_a_task_reads_as_many_files_as_one_writes(spark, tmp_path):
    spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit("text").alias("text")
    ).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["read_files"](spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert rows.count() == 400
