"""Toxicity by compression distance: which of two zstandard dictionaries fits a text better.

Windows of WINDOW words, half overlapping, are compressed with a dictionary of ordinary text and
with one of toxic text. Both share their larger part, ordinary words, so a difference in length
comes from what only toxic text repeats. A logistic model, fitted on labelled texts that the
dictionaries have not seen, calibrates the distribution of the differences to a probability.

The sample is bounded: at most SAMPLE_TOXIC and SAMPLE_ORDINARY labelled texts of at most
SAMPLE_CHARS characters, those whose ids have the least digests. All texts are scored in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm import _text
from lintlake.llm._store import table

WINDOW = 16  # words
LEVEL = 9
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1500, 3000, 16_000
FOLDS = 2  # of the sample, for calibration on texts that a dictionary has not seen
MIN_CONTEXTS, MIN_SHARE = 4, 0.008  # neighbourhoods of a toxic segment, at least and by toxic text
MIN_RATIO = 20.0  # of its rate in toxic to that in ordinary text
SHARED_WORDS, OWN_BYTES = 2500, 16_384
CUTS = range(1, 8)  # bytes saved by the toxic dictionary
_U = np.uint64


def _windows(words: list[bytes]) -> list[bytes]:
    half = WINDOW // 2
    parts = [b" ".join(words[k:k + half]) for k in range(0, len(words), half)] or [b""]
    if len(parts) == 1:
        return [b" " + parts[0] + b" "]
    return [b" " + a + b" " + b + b" " for a, b in zip(parts, parts[1:])]


class _Compressors:
    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.pair = []
        for content in (ordinary, toxic):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False,
                write_dict_id=False,
            ).compress)

    def saved(self, words: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        ordinary, toxic = self.pair
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in _windows(words)])


def _features(saved: np.ndarray) -> list[float]:
    n = len(saved)
    out = []
    for cut in CUTS:
        hits = int((saved >= cut).sum())
        out += [np.log((hits + 0.25) / (n + 5)), min(hits, 3)]
    worse = int((saved <= -1).sum())
    return [*out, np.log((worse + 0.25) / (n + 5)), np.log(n + 1), saved.max(), saved.mean()]


def _contexts(texts: list[str]) -> tuple[dict[int, int], dict[int, bytes], int]:
    """In how many different neighbourhoods (word before, word after) each word occurs. Copies of a
    text repeat neighbourhoods and add nothing."""
    keys, names = [np.zeros((0, 2), _U)], {}
    for c in _text.chunks(pa.array(texts, pa.large_string())):
        h = c.word_hashes()
        before = np.insert(h, 0, 0)[:-1]
        before[c.first[:-1][c.first[:-1] < len(h)]] = 0
        after = np.append(h, 0)[1:].astype(_U)
        after[c.first[1:][c.first[1:] > 0] - 1] = 0
        near = _text.mix(_text.mix(before.astype(_U)) * _U(3) + h * _U(5) + after)
        keys.append(np.stack([near, h], 1))
        for x, k in zip(*np.unique(h, return_index=True)):
            if x not in names:
                names[int(x)] = c.buf[c.starts[k]:c.ends[k]].tobytes()
    rows = np.concatenate(keys)
    _, at = np.unique(rows[:, 0], return_index=True)
    word, count = np.unique(rows[at, 1], return_counts=True)
    return dict(zip(word.tolist(), count.tolist())), names, len(at)


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Dictionary contents, most frequent segments last, where zstandard finds them cheapest."""
    bad, names, n_bad = _contexts(toxic)
    good, good_names, n_good = _contexts(ordinary)
    common = sorted(good, key=lambda w: (good[w], good_names[w]))
    ratio = MIN_RATIO * max(n_bad, 1) / max(n_good, 1)
    least = max(MIN_CONTEXTS, MIN_SHARE * len(toxic))
    own = [w for w in bad if bad[w] >= least and bad[w] >= ratio * (good.get(w, 0) + 0.5)]
    own.sort(key=lambda w: (bad[w], names[w]))
    pack = lambda words: b" " + b"  ".join(words) + b" "
    shared = pack([good_names[w] for w in common[-SHARED_WORDS:]])
    toxic_part = pack([names[w] for w in own])[-OWN_BYTES:]
    # The ordinary dictionary is as long: its own part are the next words of ordinary text.
    ordinary_part = pack([good_names[w] for w in common[:-SHARED_WORDS]])[-len(toxic_part):]
    return ordinary_part + shared, toxic_part + shared


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the intercept last), by Newton steps with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = a.T @ (a * (p * (1 - p))[:, None]) + np.eye(len(w))
        w -= np.linalg.solve(hess, a.T @ (p - y) + w)
    return mean, scale, w


def fit(sample: list[tuple[str, int]]) -> dict | None:
    """Model from labelled texts, in order of choice; None if either label is missing.

    Each of FOLDS parts is measured with dictionaries of the other parts, so the calibration sees
    texts as they will come; the dictionaries that stay are those of the whole sample.
    """
    sides = [[t for t, y in sample if y == label] for label in (1, 0)]
    if not all(sides):
        return None
    x, y = [], []
    for fold in range(FOLDS):
        rest = [[t for k, t in enumerate(s) if k % FOLDS != fold] or s for s in sides]
        pair = _Compressors(*_dictionaries(*rest))
        for label, side in zip((1.0, 0.0), sides):
            for text in side[fold::FOLDS]:
                x.append(_features(pair.saved(text.encode().split())))
                y.append(label)
    mean, scale, weights = _logistic(np.array(x), np.array(y))
    ordinary, toxic = _dictionaries(*sides)
    return {"ordinary": ordinary, "toxic": toxic, "mean": mean, "scale": scale, "weights": weights}


def _score(model: dict | None):
    def run(batches):
        pair = _Compressors(model["ordinary"], model["toxic"]) if model else None
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if pair:
                data, at = _text.text_buffers(batch.column(1))
                for k in range(batch.num_rows):
                    words = data[at[k]:at[k + 1]].tobytes().split()
                    x = (np.array(_features(pair.saved(words))) - model["mean"]) / model["scale"]
                    z = x @ model["weights"][:-1] + model["weights"][-1]
                    out[k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "score": pa.array(out)})

    return run


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> list[tuple[str, int]]:
    """The bounded sample: texts with their labels, in the order of their ids' digests. An id with
    both labels has the larger one."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(
        F.col(id_col).cast("long").alias("id")
    ).agg(F.max(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fit_for = texts.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("id")
    order = F.xxhash64("id")
    marked = marked.join(fit_for, "id", "left_semi").withColumn("order", order)
    chosen = marked.where("y = 1").orderBy("order", "id").limit(SAMPLE_TOXIC).unionByName(
        marked.where("y = 0").orderBy("order", "id").limit(SAMPLE_ORDINARY)
    )
    rows = texts.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y", "order").agg(F.min("text").alias("text")).orderBy("order", "id")
    return [(r["text"], r["y"]) for r in rows.collect()]


def toxicity_scores(
    docs: DataFrame, sample: list[tuple[str, int]], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, score): the probability of the toxic label, 0 to 1, for every row.

    A null text is empty and is scored like any other text. Rows without id have a null id; repeated
    rows are scored each. Without texts of both labels every score is 0. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_score(fit(sample)), "id long, score double")
    return scored.withColumnRenamed("id", id_col)


def _passes(model: dict | None, limit: float, text: int):
    score = _score(model)

    def run(batches):
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(text), batch.column(text)], ["id", "text"])
            (found,) = score([pair])
            yield batch.filter(pa.array(found.column(1).to_numpy() < limit))

    return run


def drop_toxic(
    docs: DataFrame, sample: list[tuple[str, int]], limit: float, text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` whose score is below `limit`, with all their columns, in one pass."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(_passes(fit(sample), limit, at), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    sample = labelled_sample(docs.where(remainder != 2), table(spark, sf_dir, "labels"))
    return toxicity_scores(docs, sample).select(
        "doc_id", (remainder == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
