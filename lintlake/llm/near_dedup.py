"""Near-duplicate documents by a multi-index Hamming join on b-bit MinHash signatures.

A document is the set of its distinct word shingles. Its signature holds `symbols` MinHash values
of 16 bits. The signature is split into chunks of CHUNK_SYMBOLS; two signatures that differ in at
most `2 * chunks - 1` symbols have, by the pigeonhole principle, a chunk in which at most one symbol
differs. Every chunk is therefore indexed under each of its forms with one symbol masked, and all
pairs under that distance meet under a common key.

Equal sets are one representative from the start. Keys that several representatives share give a
forest of candidate links, not pairs; its components hold every link. Sets are shuffled once, to
their component, and links are confirmed there on the full sets. A pair already connected is not
compared again, so a component costs a spanning forest of confirmed links and its failed trials.
Components too large for a task are dealt into blocks: first each block by itself, then, by the
labels that this gave, only members outside the largest class against all members, block by block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm import _text
from lintlake.llm._components import components
from lintlake.llm._store import keep, table

CHUNK_SYMBOLS = 4
BUCKET = 512  # buckets above this are joined as a whole; a superset of the links is enough there
BLOCK_BYTES = 8 << 20  # sets worked on in one task
BLOCK_ROWS = 1024
_U = np.uint64


def _shingles(column: pa.Array, k: int):
    """(first row, [sorted distinct shingle hashes of each row]) by chunk."""
    for c in _text.chunks(column, lower=True):
        words = c.word_hashes()
        hashes, _, row = _text.windows(words, c.first, k)
        at = np.searchsorted(row, np.arange(c.rows + 1))
        short = _text.whole_rows(words, c.first)
        count = np.diff(c.first)
        sets = []
        for r in range(c.rows):
            if count[r] >= k:
                h = np.sort(hashes[at[r]:at[r + 1]])
                sets.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
            else:
                sets.append(short[r:r + 1] if count[r] else short[:0])
        yield c.row, sets


def _signatures(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """16 bits of the least hash under each permutation; rows without shingles stay zero."""
    out = np.zeros((len(sets), symbols), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[k] for k in full])
    size = np.array([len(sets[k]) for k in full])
    at = np.cumsum(size) - size
    rng = np.random.default_rng(20240229)
    seeds = rng.integers(1, 1 << 63, (2, symbols), dtype=np.int64).astype(_U)
    for j in range(symbols):
        x = (flat ^ seeds[0, j]) * (seeds[1, j] | _U(1))
        x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
        out[full, j] = (np.minimum.reduceat(x, at) & _U(0xFFFF)).astype(np.uint16)
    return out


def _profile(k: int, symbols: int):
    def run(batches):
        for batch in batches:
            for row, sets in _shingles(batch.column(1), k):
                sig = _signatures(sets, symbols)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(row, len(sets)),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array([
                        hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets
                    ], pa.binary()),
                    "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
                })

    return run


def _index(symbols: int):
    """One key for each chunk and masked symbol."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
            sig = sig.reshape(-1, symbols).astype(_U)
            ids = batch.column(0).to_numpy()
            for at in range(0, symbols, CHUNK_SYMBOLS):
                for masked in range(at, at + CHUNK_SYMBOLS):
                    key = np.full(len(sig), at << 8 | masked, _U)
                    for j in range(at, at + CHUNK_SYMBOLS):
                        if j != masked:
                            key = _text.mix(key * _U(0x9E3779B97F4A7C15) + sig[:, j])
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(key.view(np.int64)), "rep": pa.array(ids, pa.int64()),
                    })

    return run


def _groups(batches, keys: int):
    """Runs of rows with the same leading columns, over batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is None or last != tuple(c[0] for c in cols)
        cuts = np.flatnonzero(change)
        if len(cuts) and held and cuts[0] == 0:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [*([0] if not len(cuts) or cuts[0] else []), *cuts, batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, symbols)


def _pairs_out(a: list, b: list):
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _near_signatures(symbols: int, distance: int):
    """Candidate forest of small buckets: rows (key, rep, sig), sorted by key."""

    def forest(key, ids, sig):
        """Edges within the buckets of one stretch of rows; buckets of two rows go all at once."""
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(cuts, len(key)))
        two = cuts[size == 2]
        two = two[(sig[two] != sig[two + 1]).sum(1) <= distance]
        a, b = [ids[two]], [ids[two + 1]]
        for at, n in zip(cuts[size > 2], size[size > 2]):
            own, mine = ids[at:at + n], sig[at:at + n]
            root = np.arange(n)
            for i in range(n - 1):
                near = (mine[i + 1:] != mine[i]).sum(1) <= distance
                for j in np.flatnonzero(near & (root[i + 1:] != root[i])) + i + 1:
                    if root[j] != root[i]:
                        a.append(own[i:i + 1])
                        b.append(own[j:j + 1])
                        root[root == root[j]] = root[i]
        return _pairs_out(np.concatenate(a), np.concatenate(b))

    def run(batches):
        held = None  # rows of the last bucket, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (
                batch.column(0).to_numpy(), batch.column(1).to_numpy(),
                np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, symbols),
            )
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows))
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            held = tuple(x[cut:] for x in rows)
            if cut:
                yield forest(*(x[:cut] for x in rows))
        if held is not None:
            yield forest(*held)

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (small + large - common)


def _confirm(symbols: int, distance: int, percent: int, keys: int):
    """Spanning forest of confirmed links. Rows: `keys` grouping columns, then rep, sig, hashes,
    label and side. Members of one label are connected already; where there are two sides, only
    pairs across them are tried."""

    def run(batches):
        a: list[int] = []
        b: list[int] = []
        for group in _groups(batches, keys):
            ids, sig_c, set_c, label, side = (group.column(keys + k) for k in range(5))
            ids, side = ids.to_numpy(), side.to_numpy()
            if len(ids) < 2:
                continue
            sig = _matrix(sig_c, symbols)
            sets = [np.frombuffer(s, _U) for s in set_c.to_pylist()]
            size = np.array([len(s) for s in sets])
            root = np.unique(label.to_numpy(), return_inverse=True)[1]
            two = side.min() != side.max()
            for i in range(len(ids) - 1):
                rest = slice(i + 1, None)
                open_ = root[rest] != root[i]
                if two:
                    open_ &= side[rest] != side[i]
                open_ &= 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
                where = np.flatnonzero(open_) + i + 1
                if not len(where):
                    continue
                apart = (sig[where] != sig[i]).sum(1)
                where, apart = where[apart <= distance], apart[apart <= distance]
                for j in where[np.argsort(apart, kind="stable")]:
                    if root[j] != root[i] and _linked(sets[i], sets[j], percent):
                        a.append(ids[i])
                        b.append(ids[j])
                        root[root == root[j]] = root[i]
            if len(a) > 20_000:
                yield _pairs_out(a, b)
                a, b = [], []
        if a:
            yield _pairs_out(a, b)

    return run


def _sets(k: int):
    """(id, set_key, hashes) of the given texts."""

    def run(batches):
        for batch in batches:
            for row, sets in _shingles(batch.column(1), k):
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(row, len(sets)),
                    "set_key": pa.array([
                        hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets
                    ], pa.binary()),
                    "hashes": pa.array([s.tobytes() for s in sets], pa.binary()),
                })

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
    percent: int = 80, symbols: int = 48,
) -> DataFrame:
    """Per document: its id, n_shingles, component_id (smallest id that links reach) and kept.

    Documents are linked if `100 * intersection >= percent * union` of their distinct shingles of
    `shingle` words, lower-cased A-Z. A text of fewer words is one shingle; a text without words, or
    null, has none and is linked with nothing. Rows without id take no part. Rows that repeat an id
    and a text are one document; further columns are ignored. An empty table gives an empty one.
    A pair at exactly the threshold escapes the signature distance with a probability of about 3e-6
    (48 symbols, 80 %) or 2e-7 (40 symbols, 85 %); closer pairs far less.
    """
    if symbols % CHUNK_SYMBOLS:
        raise ValueError(f"symbols must be a multiple of {CHUNK_SYMBOLS}")
    distance = 2 * (symbols // CHUNK_SYMBOLS) - 1
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.where("id is not null")
    profile = keep(
        texts.mapInArrow(_profile(shingle, symbols), "id long, n long, set_key binary, sig binary"),
        "profiles",
    )
    reps = keep(
        profile.where("n > 0").groupBy("set_key")
        .agg(F.min("id").alias("rep"), F.min("sig").alias("sig"), F.min("n").alias("n")),
        "representatives",
    )
    labels = _links(texts, reps, shingle, percent, symbols, distance)
    classes = reps.select("set_key", "rep").join(
        labels.select(F.col("node").alias("rep"), "root"), "rep", "left"
    ).select("set_key", F.coalesce("root", "rep").alias("root"))
    return (
        profile.select("id", "n", "set_key").distinct().join(classes, "set_key", "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.coalesce("root", "id").alias("component_id"),
        )
        .withColumn("kept", F.col(id_col) == F.col("component_id"))
    )


def _links(texts, reps, shingle, percent, symbols, distance) -> DataFrame:
    """(node, root) over representatives, by confirmed links."""
    keys = reps.select("rep", "sig").mapInArrow(_index(symbols), "key long, rep long")
    shared = keep(
        keys.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("low"))
        .where("members > 1"),
        "buckets",
    )
    large = keys.join(shared.where(f"members > {BUCKET}"), "key").select(
        F.col("rep").alias("a"), F.col("low").alias("b")
    )
    small = (
        keys.join(shared.where(f"members <= {BUCKET}").select("key"), "key")
        .join(reps.select("rep", "sig"), "rep").select("key", "rep", "sig")
        .repartition("key").sortWithinPartitions("key", "rep")
        .mapInArrow(_near_signatures(symbols, distance), "a long, b long")
    )
    found = components(large.unionByName(small).distinct())
    group = found.select(F.col("node").alias("rep"), F.col("root").alias("grp")).unionByName(
        found.select(F.col("root").alias("rep"), F.col("root").alias("grp")).distinct()
    )
    members = keep(group.join(reps, "rep"), "members")
    sizes = members.groupBy("grp").agg(F.count("*").alias("rows"), F.sum("n").alias("hashes"))
    parts = F.greatest(
        F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("hashes") * 8 / BLOCK_BYTES)
    ).cast("int")
    dealt = members.join(sizes.select("grp", parts.alias("parts")), "grp").select(
        "rep", "set_key", "sig", "grp", "parts",
        F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("block"),
    )
    # Texts are shuffled at every size: no plan that changes with the number of candidates.
    full = keep(
        texts.hint("merge").join(dealt.select(F.col("rep").alias("id")), "id")
        .select("id", "text").mapInArrow(_sets(shingle), "id long, set_key binary, hashes binary")
        .join(dealt.withColumnRenamed("rep", "id"), ["id", "set_key"])
        .select("grp", "block", F.col("id").alias("rep"), "sig", "hashes", "parts"),
        "sets",
    )

    def confirm(rows: DataFrame, *by: str) -> DataFrame:
        rows = rows.select(*by, "rep", "sig", "hashes", "label", "side")
        return rows.repartition(*by).sortWithinPartitions(*by, "rep").mapInArrow(
            _confirm(symbols, distance, percent, len(by)), "a long, b long"
        )

    alone = full.withColumn("label", F.col("rep")).withColumn("side", F.lit(0))
    within = keep(confirm(alone, "grp", "block"), "links")
    labels = components(within)
    spread = full.where("parts > 1").drop("label")
    if spread.isEmpty():
        return labels
    known = spread.join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        *spread.columns, F.coalesce("root", "rep").alias("label")
    )
    known = keep(known, "labelled")
    votes = known.groupBy("grp", "label").agg(F.count("*").alias("votes"))
    most = votes.groupBy("grp").agg(
        F.max(F.struct("votes", "label"))["label"].alias("most"), F.sum("votes").alias("all")
    )
    rest = known.join(most, "grp").where(F.col("label") != F.col("most"))
    strips = rest.groupBy("grp").agg(F.count("*").alias("rows")).select(
        "grp", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("strips")
    )
    left = (
        rest.join(strips, "grp")
        .withColumn("strip", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("strips")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("side", F.lit(1))
    )
    right = (
        known.join(strips, "grp")
        .withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
        .withColumn("side", F.lit(2))
    )
    cols = ["grp", "block", "strip", "rep", "sig", "hashes", "label", "side"]
    across = confirm(left.select(cols).unionByName(right.select(cols)), "grp", "block", "strip")
    return components(within.unionByName(across))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(
        table(spark, sf_dir, "documents"), shingle=3, percent=85, symbols=40
    ).withColumn("n_shingles", F.col("n_shingles").cast("long"))
