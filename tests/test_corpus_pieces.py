"""The derived file table is written in pieces whose number grows with the given tables."""

from pyspark.sql import functions as F

from verification import corpus


def test_file_table_has_more_pieces_for_more_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "PIECE", 2000)
    counts = []
    for n in (100, 2000):
        folder = tmp_path / str(n)
        ids = spark.range(n)
        ids.select(
            F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")
        ).write.parquet(f"{folder}/documents.parquet")
        ids.limit(5).select(
            F.col("id").alias("page_id"), F.lit("<p>").alias("html")
        ).write.parquet(f"{folder}/pages.parquet")
        files = corpus.files(spark, str(folder))
        assert files.count() == corpus.derive_files(spark, str(folder)).count()
        counts.append(len(files.inputFiles()))
    assert counts[1] > 3 * counts[0]
