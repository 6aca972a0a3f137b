"""Removal of long repeated word sequences by level-wise doubling.

The first level looks at windows of half the wanted length. Of the half windows inside a full
window, the one with the least hash is chosen, so equal full windows choose equal half windows, and
about one position in thirteen is looked at. Only full windows whose chosen half occurs in two
documents go on to the second level, where all of them are hashed with 96 bits and matched. Longer
levels would change nothing: a longer repetition is covered by its windows of the wanted length.

Documents with the same word sequence are one representative, the smallest id, from the start.
Counts per hash combine before the shuffle, and a hash that very many documents share is a join key
that adaptive execution splits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm import _text
from lintlake.llm._store import keep, table

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _joined(c: _text.Chunk, row: int) -> bytes:
    return b" ".join(c.bytes_of(row).split())


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width]; beyond the end there is nothing."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        shifted = np.full(len(x), _TOP)
        shifted[: max(len(x) - step, 0)] = out[step:]
        out, have = np.minimum(out, shifted), have + step
    return out


def _chosen(words: np.ndarray, first: np.ndarray, length: int):
    """(hash of the chosen half window, start word, row) of every full window."""
    half = length // 2
    halves, _, row = _text.windows(words, first, half)
    least = _sliding_min(halves, length - half + 1)
    count = np.maximum(np.diff(first) - length + 1, 0)
    full_row = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(full_row)) - (np.cumsum(count) - count)[full_row]
    at = np.searchsorted(row, np.arange(len(count)))
    return least[at[full_row] + offset], first[:-1][full_row] + offset, full_row


def _profile(length: int):
    """Per document: number and digest of its words, and its chosen half windows."""

    def run(batches):
        for batch in batches:
            for c in _text.chunks(batch.column(1)):
                chosen, _, row = _chosen(c.word_hashes(), c.first, length)
                new = np.ones(len(chosen), bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
                chosen, row = chosen[new], row[new]
                cuts = np.searchsorted(row, np.arange(c.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(c.row, c.rows),
                    "n_words": pa.array(np.diff(c.first), pa.int64()),
                    "sha": pa.array([hashlib.sha256(_joined(c, k)).digest() for k in range(c.rows)]),
                    "halves": pa.ListArray.from_arrays(cuts, chosen.view(np.int64)),
                })

    return run


def _same(batches):
    """Rows whose text has the digest in the third column."""
    for batch in batches:
        hit = [
            hashlib.sha256(b" ".join((text.as_py() or "").encode().split())).digest() == sha.as_py()
            for text, sha in zip(batch.column(1), batch.column(2))
        ]
        yield batch.filter(pa.array(hit, pa.bool_())).select(["id", "text", "halves"])


def _full_windows(length: int):
    """Full windows whose chosen half is among those given: (h, g, id, position)."""

    def run(batches):
        for batch in batches:
            halves = batch.column(2)
            for c in _text.chunks(batch.column(1)):
                words = c.word_hashes()
                chosen, start, row = _chosen(words, c.first, length)
                at = np.searchsorted(row, np.arange(c.rows + 1))
                hit = np.zeros(len(row), bool)
                for k in range(c.rows):
                    if at[k] < at[k + 1]:
                        wanted = halves[c.row + k].values.to_numpy().view(np.uint64)
                        hit[at[k]:at[k + 1]] = np.isin(chosen[at[k]:at[k + 1]], wanted)
                h, _, _ = _text.windows(words, c.first, length)
                g, _, _ = _text.windows(c.word_hashes(seed=2), c.first, length, seed=8)
                ids = batch.column(0).slice(c.row, c.rows).to_numpy()
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(h[hit].view(np.int64)),
                    "g": pa.array((g[hit] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    "id": pa.array(ids[row[hit]], pa.int64()),
                    "at": pa.array((start - c.first[:-1][row])[hit], pa.int32()),
                })

    return run


def _spans(at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of covered words."""
    at = np.unique(at)
    cut = np.flatnonzero(np.diff(at) > length)
    begin = at[np.concatenate(([0], cut + 1))]
    end = at[np.concatenate((cut, [len(at) - 1]))] + length
    return list(zip(begin.tolist(), end.tolist()))


def _cut(length: int):
    """The words that no repeated window covers."""

    def run(batches):
        for batch in batches:
            out = {"id": [], "spans": [], "text": []}
            for key, text, at in zip(*(batch.column(k) for k in range(3))):
                words = (text.as_py() or "").encode().split()
                spans = _spans(at.values.to_numpy(), length)
                kept, to = [], 0
                for a, b in spans:
                    kept += words[to:a]
                    to = b
                out["id"].append(key.as_py())
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out["text"].append(b" ".join(kept + words[to:]).decode())
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(out["id"], pa.int64()),
                "spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                "text": pa.array(out["text"], pa.string()),
            })

    return run


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50
) -> tuple[DataFrame, DataFrame]:
    """(documents, changed): what repeats in each document, and the texts that lose words.

    `documents` has, per id, n_words, sha (SHA-256 of all words joined by one space) and first_id,
    the smallest id with the same word sequence. `changed` has id, spans (word offsets, end
    exclusive) and text (the kept words joined by one space) of every first_id that loses words
    but is no copy; a copy of at least `min_words` words loses all of them.

    A word is removed if a window of `min_words` words over it also starts in a document with a
    smaller id. A null text has no words. Rows without id take no part; rows that repeat an id are
    one document, and if their texts differ, that with the smallest digest counts. Other columns are
    ignored. An empty table gives empty tables.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.where("id is not null")
    profile = keep(
        texts.mapInArrow(
            _profile(min_words), "id long, n_words long, sha binary, halves array<long>"
        ),
        "profiles",
    )
    one = profile.groupBy("id").agg(F.min("sha").alias("sha"))
    named = profile.select("id", "sha", "n_words").distinct().join(one, ["id", "sha"])
    firsts = named.groupBy("sha").agg(F.min("id").alias("first_id"))
    documents = keep(named.join(firsts, "sha"), "documents")
    own = documents.where(f"id = first_id and n_words >= {min_words}").select("id", "sha")
    halves = profile.join(own, ["id", "sha"], "left_semi").select(
        "id", F.explode("halves").alias("half")
    )
    shared = halves.groupBy("half").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    hits = halves.join(shared.where("lo < hi").select("half"), "half")
    wanted = hits.groupBy("id").agg(F.collect_set("half").alias("halves")).join(own, "id")
    candidates = keep(
        texts.hint("merge").join(wanted, "id").select("id", "text", "sha", "halves")
        .mapInArrow(_same, "id long, text string, halves array<long>"),
        "candidates",
    )
    full = candidates.mapInArrow(_full_windows(min_words), "h long, g int, id long, at int")
    seen = full.groupBy("h", "g").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    later = full.join(seen.where("lo < hi").select("h", "g", "lo"), ["h", "g"]).where("id > lo")
    covered = later.groupBy("id").agg(F.collect_list("at").alias("at"))
    changed = candidates.select("id", "text").join(covered, "id").mapInArrow(
        _cut(min_words), "id long, spans array<struct<start:int,end:int>>, text string"
    )
    return documents, changed


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, changed = substring_dedup(table(spark, sf_dir, "documents"), min_words=50)
    cut = changed.select(
        F.col("id").alias("first_id"), F.sha2("text", 256).alias("cut_sha"),
        F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("cut"),
    ).dropDuplicates(["first_id"])
    copy = (F.col("id") != F.col("first_id")) & (F.col("n_words") >= 50)
    own = F.col("id") == F.col("first_id")
    return documents.join(cut, "first_id", "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("cut", F.lit(0))).otherwise(0)
        .cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256))
        .when(own & F.col("cut_sha").isNotNull(), F.col("cut_sha"))
        .otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
