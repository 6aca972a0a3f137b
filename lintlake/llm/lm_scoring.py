"""Perplexity under an interpolated modified Kneser-Ney bigram model counted in Spark.

Tasks count bigrams of their documents and send packed arrays to a shard by bigram hash, so a very
frequent word is spread over all shards. A shard merges its counts, writes its sorted hashes and
counts to the shared folder, and passes on what each word adds: tokens, distinct predecessors, and
distinct successors seen once, twice or more. A second shuffle adds these up by word and writes
sorted word arrays. Workers map the arrays into memory to score; nothing of the model passes
through the driver but its totals. A lost task writes the same file again.

The order is two: with more, a corpus has nearly as many n-grams as tokens, and the model outgrows
its input.
"""

from __future__ import annotations

import os
import time
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm import _text
from lintlake.llm._store import shared_folder, table

SHARD_BYTES = 24 << 20  # text for each shard of the model
MAX_TASKS = 16_384  # that merge shards; of more shards, a task merges several in turn
OPEN_FILES = 512  # mapped at a time by a worker
BUFFER = 1 << 21  # bigrams that a task holds before it merges them
_U = np.uint64
BEGIN, END = _U(0x1B873593CC9E2D51), _U(0x85EBCA6B27D4EB2F)  # markers of a text; no word's hash
UNIGRAM = np.dtype([("h", "<u8"), ("c", "<u8"), ("cont", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])
STATS = np.dtype([(name, UNIGRAM[name]) for name in UNIGRAM.names[1:]])


def _mounted(folder: str) -> str:
    """Path of a shared folder that workers can map into memory."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model folder must be mounted on all workers, not {folder}")
    return unquote(url.path)


def _tokens(c: _text.Chunk):
    """(previous, current) token hashes of all rows in turn, and the rows' bounds in them."""
    words = c.word_hashes()
    bounds = c.first + np.arange(c.rows + 1)
    current = np.insert(words, c.first[1:], END)
    previous = np.empty_like(current)
    previous[1:] = current[:-1]
    previous[bounds[:-1]] = BEGIN
    return previous, current, bounds


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _text.mix(v * _U(0x9E3779B97F4A7C15) + w)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return ((h >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _add_up(b, v, w, c):
    order = np.argsort(b)
    b, v, w, c = b[order], v[order], w[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, int)
    return b[at], v[at], w[at], np.add.reduceat(c, at) if len(at) else c


def _count(shards: int):
    """Bigram counts of a task: (shard, previous, current, count), packed."""

    def send(b, v, w, c):
        cuts = np.searchsorted(_shard(b, shards), np.arange(shards + 1))
        for k in range(shards):
            part = slice(cuts[k], cuts[k + 1])
            order = np.lexsort((w[part], v[part]))  # runs of one previous word compress well
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([k], pa.int32()),
                "v": pa.array([v[part][order].tobytes()], pa.binary()),
                "w": pa.array([w[part][order].tobytes()], pa.binary()),
                "c": pa.array([c[part][order].astype("<u4").tobytes()], pa.binary()),
            })

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for chunk in _text.chunks(batch.column(0), lower=True):
                v, w, _ = _tokens(chunk)
                held.append(_add_up(_pair(v, w), v, w, np.ones(len(v), np.int64)))
                size += len(held[-1][0])
                if size > BUFFER:
                    merged = _add_up(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [merged], len(merged[0])
                    if size > BUFFER // 2:
                        yield from send(*merged)
                        held, size = [], 0
        if held:
            yield from send(*_add_up(*(np.concatenate(x) for x in zip(*held))))

    return run


def _write(folder: str, name: str, array: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{os.getpid()}-{time.time_ns()}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, f"{folder}/{name}.npy")


def _read(folder: str, name: str) -> np.ndarray | None:
    try:
        return np.load(f"{folder}/{name}.npy", mmap_mode="r")
    except FileNotFoundError:
        return None


def _join(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


_NAMES = ("k1", "k2", "k3", "k4", "pairs", "tokens")


def _merge(folder: str, shards: int):
    """One shard of bigrams: its files, and what each word of it adds."""

    def run(group: pa.Table) -> pa.Table:
        k = group.column("shard")[0].as_py()
        v, w = _join(group.column("v"), "<u8"), _join(group.column("w"), "<u8")
        b = _pair(v, w)
        # No sorted copies of both words: only the first of equal pairs is looked up by its place.
        order = np.argsort(b)
        b = b[order]
        at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        b = b[at]
        c = np.add.reduceat(_join(group.column("c"), "<u4")[order], at, dtype=np.int64)
        order = order[at]
        v, w = v[order], w[order]
        del order, at
        _write(folder, f"pairs-{k}", b)
        _write(folder, f"counts-{k}", c.astype("<u4") if c.max() < 1 << 32 else c)
        words = np.union1d(v, w)
        out = np.zeros(len(words), UNIGRAM)
        out["h"] = words
        add = lambda where, weight: np.bincount(where, weight, len(words))
        place = np.searchsorted(words, w)
        out["c"], out["cont"] = add(place, c), add(place, None)
        place = np.searchsorted(words, v)
        for name, hit in (("n1", c == 1), ("n2", c == 2), ("n3", c > 2)):
            out[name] = add(place, hit)
        cuts = np.searchsorted(_shard(words, shards), np.arange(shards + 1))
        total = [int((c == n).sum()) for n in (1, 2, 3, 4)] + [len(c), int(c.sum())]
        full = [j for j in range(shards) if cuts[j] < cuts[j + 1]]
        return pa.table({
            "shard": pa.array(full, pa.int32()),
            **{
                name: pa.array(
                    [out[name][cuts[j]:cuts[j + 1]].tobytes() for j in full], pa.binary()
                ) for name in UNIGRAM.names
            },
            **{name: pa.array([x if not i else 0 for i in range(len(full))], pa.int64())
               for name, x in zip(_NAMES, total)},
        })

    return run


def _words(folder: str):
    """One shard of words: its file, and totals."""

    def run(group: pa.Table) -> pa.Table:
        k = group.column("shard")[0].as_py()
        h = _join(group.column("h"), "<u8")
        order = np.argsort(h)
        at = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))
        out = np.zeros(len(at), UNIGRAM)
        out["h"] = h[order][at]
        for name in UNIGRAM.names[1:]:
            out[name] = np.add.reduceat(_join(group.column(name), UNIGRAM[name].str)[order], at)
        _write(folder, f"hashes-{k}", out["h"].copy())
        _write(folder, f"words-{k}", out[list(UNIGRAM.names[1:])].astype(STATS))
        seen = out["cont"][out["c"] > 0]
        return pa.table({
            **{f"m{n}": pa.array([int((seen == n).sum())], pa.int64()) for n in (1, 2, 3, 4)},
            "types": pa.array([len(seen)], pa.int64()),
            **{name: pa.array([sum(group.column(name).to_pylist())], pa.int64()) for name in _NAMES},
        })

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts 1, 2 and 3 or more; fixed values where a corpus is too small to tell."""
    if min(n1, n2, n3, n4) == 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), found)]


def _lookup(read, shards: int, keys: np.ndarray, names: str, values: str) -> np.ndarray:
    """Values of sorted keys; of what is not there, zeros."""
    out = np.zeros(len(keys), np.int64 if values == "counts" else STATS)
    cuts = np.searchsorted(_shard(keys, shards), np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        part = keys[cuts[k]:cuts[k + 1]]
        hashes = read(f"{names}-{k}")
        if hashes is None or not len(hashes):
            continue
        at = np.minimum(np.searchsorted(hashes, part), len(hashes) - 1)
        hit = np.flatnonzero(hashes[at] == part)
        out[cuts[k] + hit] = read(f"{values}-{k}")[at[hit]]
    return out


def _score(folder: str, shards: int, total: dict):
    d = np.array([0.0, *_discounts(*(total[f"k{n}"] for n in (1, 2, 3, 4)))])
    e = np.array([0.0, *_discounts(*(total[f"m{n}"] for n in (1, 2, 3, 4)))])
    m3 = total["types"] - total["m1"] - total["m2"]
    pairs, types, tokens = total["pairs"], total["types"], total["tokens"]
    spare = (e[1] * total["m1"] + e[2] * total["m2"] + e[3] * m3) / pairs if pairs else 1.0
    even = spare / (types + 1)  # what an unknown word gets

    def run(batches):
        read = lru_cache(maxsize=OPEN_FILES)(lambda name: _read(folder, name))
        for batch in batches:
            for c in _text.chunks(batch.column(1), lower=True):
                v, w, bounds = _tokens(c)
                b, at_b = np.unique(_pair(v, w), return_inverse=True)
                n = _lookup(read, shards, b, "pairs", "counts")[at_b]
                u, at_u = np.unique(np.concatenate((v, w)), return_inverse=True)
                word = _lookup(read, shards, u, "hashes", "words")
                count, cont = word["c"].astype(float), word["cont"].astype(np.int64)
                lower = np.maximum(cont - e[np.minimum(cont, 3)], 0) / max(pairs, 1) + even
                # A context is followed as often as it occurs; the start occurs once in a text.
                seen = np.where(u == BEGIN, total["texts"], count)
                left = d[1] * word["n1"] + d[2] * word["n2"] + d[3] * word["n3"]
                gamma = np.where(seen > 0, left / np.maximum(seen, 1), 1.0)
                as_v, as_w = at_u[: len(v)], at_u[len(v):]
                p = np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(seen[as_v], 1)
                p += gamma[as_v] * lower[as_w]
                base = np.log10((count + 0.1) / (tokens + 0.1 * (types + 1)))[as_w]
                at = bounds[:-1]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(c.row, c.rows),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "n_known": pa.array(np.add.reduceat((count > 0)[as_w].astype(np.int64), at)),
                    "base_score": pa.array(np.add.reduceat(base, at)),
                    "score": pa.array(np.add.reduceat(np.log10(p), at)),
                })

    return run


def _by_shard(rows: DataFrame, shards: int):
    """Rows by shard, in one task each. Hashed to tasks, several shards would meet in one."""
    tasks = min(shards, MAX_TASKS)
    return rows.withColumn("task", F.col("shard") % tasks).repartitionById(
        tasks, F.col("task")
    ).groupBy("task", "shard")


def lm_scores(
    docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Scores of `docs` under a model of `training`: id, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability) and perplexity.

    Tokens are the words of the text, lower-cased A-Z, and one end. A null text is empty: its only
    token is the end. Rows without id are not scored; repeated rows are scored, and learnt, each
    time. Other columns are ignored. Without any training text every token is equally unlikely.
    Words are told apart by 64-bit hashes. Where `spark.checkpoint.dir` is no folder that workers
    can open, this raises.
    """
    spark = docs.sparkSession
    size = training.agg(
        F.sum(F.octet_length(text_col)).alias("bytes"), F.count("*").alias("texts")
    ).first()
    shards = max(1, -(-(size["bytes"] or 0) // SHARD_BYTES))
    folder = _mounted(shared_folder(spark, "model"))
    counts = training.select(text_col).mapInArrow(
        _count(shards), "shard int, v binary, w binary, c binary"
    )
    sums = ", ".join(f"{name} long" for name in _NAMES)
    merged = _by_shard(counts, shards).applyInArrow(
        _merge(folder, shards),
        "shard int, " + ", ".join(f"{name} binary" for name in UNIGRAM.names) + ", " + sums,
    )
    words = _by_shard(merged, shards).applyInArrow(
        _words(folder), "m1 long, m2 long, m3 long, m4 long, types long, " + sums
    )
    total = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in words.columns)).first()
    total = total.asDict() | {"texts": size["texts"]}
    scored = docs.select(F.col(id_col).cast("long").alias("id"), text_col).where("id is not null")
    return scored.mapInArrow(
        _score(folder, shards, total),
        "id long, n_tokens long, n_known long, base_score double, score double",
    ).select(
        F.col("id").alias(id_col), "n_tokens", "n_known",
        F.lit(total["tokens"]).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 10
    return lm_scores(docs, docs.where(remainder != 0)).withColumn("held_out", remainder == 0)
