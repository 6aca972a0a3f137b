"""Documents that hold benchmark items, also with other numbers, names or units.

Words become template tokens: numbers, names (capitalised words) and units are typed placeholders,
all else the word in lower case without the punctuation around it. A second form of each window is
blind to case: its names are words in lower case. Windows of WINDOW tokens of either form, or of the
words in lower case where fewer than LITERALS tokens of the second form are literal, are joined by
hash with those of the items. Windows of a document and an item that lie on one diagonal, or in order on
diagonals at most SHIFT apart, are one alignment: a word more or less, or a value of another number
of words, moves what follows to a neighbouring diagonal. An alignment counts as a find if it covers
COVERAGE of the item's windows and its slots are consistent: every value of the item stands for one
value of the document, as it does in a copy and in a question with new parameters. Where the
diagonal changes, the words between the two are compared by their tokens.

Items are sent to the tasks in parts of at most PART_WINDOWS windows, of which the driver holds one at
a time; each part is one more scan of the documents, so a benchmark of any size is compared in full.
No text is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm import _text
from lintlake.llm._store import keep, table

WINDOW, LITERALS = 8, 4
COVERAGE, CONSISTENCY = 0.5, 0.8
SHIFT = WINDOW  # words that one change may add or drop
PART_WINDOWS = 1 << 20
UNITS = (
    "kg g mg lb lbs oz ton tons tonne tonnes gram grams kilogram kilograms pound pounds ounce ounces "
    "km m cm mm nm mile miles meter meters metre metres foot feet inch inches yard yards "
    "l ml liter liters litre litres gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent degree degrees celsius fahrenheit kelvin mph kmh volt volts watt watts joule joules "
    "dollar dollars euro euros cent cents usd eur gbp"
).split()
_U = np.uint64
NUMBER, NAME, UNIT = _U(1), _U(2), _U(3)
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    return np.concatenate([c.word_hashes() for c in _text.chunks(pa.array([" ".join(words)]))])


_unit_hashes = np.sort(_hash_words(UNITS))


def _fold(c: _text.Chunk) -> _text.Chunk:
    """A chunk without case. It has the same words, but some may have another length."""
    if not (c.buf >= 128).any():
        return _text.Chunk(c.row, _text.lower_ascii(c.buf), c.starts, c.ends, c.first)
    touching = c.starts[1:][c.starts[1:] == c.ends[:-1]]  # words of two rows
    buf = np.insert(c.buf, touching, 32)
    text = buf.tobytes().decode(errors="surrogateescape").casefold()
    buf = np.frombuffer(text.encode(errors="surrogateescape"), np.uint8)
    solid = np.concatenate(([False], ~_text._SPACE[buf], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return _text.Chunk(c.row, buf, edges[::2], edges[1::2], c.first)


def _bare(c: _text.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends without punctuation around words; a word of it alone keeps its last sign."""
    starts, ends = c.starts.copy(), c.ends.copy()
    for _ in range(4):
        starts += _PUNCT[c.buf[starts]] & (starts < ends - 1)
        ends -= _PUNCT[c.buf[ends - 1]] & (starts < ends - 1)
    return starts, ends


def template(c: _text.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, _text.Chunk]:
    """Token of every word, a placeholder or the hash of the plain word; the same with names as
    words; the hashes of all words; and the chunk without case."""
    if not len(c.starts):
        return (*(np.zeros(0, _U),) * 3, c)
    buf, folded = c.buf, _fold(c)
    starts, ends = _bare(c)
    digits = np.concatenate(([0], np.cumsum((buf >= 48) & (buf <= 57))))
    head = buf[starts]
    after = buf[np.minimum(starts + 1, len(buf) - 1)]
    # A-Z, and the capitals of Latin-1 in UTF-8
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    words = _text.Chunk(c.row, folded.buf, *_bare(folded), c.first).word_hashes()
    blind = words.copy()
    blind[np.isin(blind, _unit_hashes)] = UNIT
    number = digits[ends] > digits[starts]
    blind[number] = NUMBER
    tokens = blind.copy()
    tokens[capital & ~number] = NAME
    return tokens, blind, words, folded


def _windows(tokens: np.ndarray, blind: np.ndarray, words: np.ndarray, first: np.ndarray):
    """(hash, start, row) of all windows in the form that is blind to case, then of those that differ
    with names as placeholders. Where too few tokens are literal, a template would match anything of
    its shape; there the words themselves count, and there is no form with names."""
    def literal(tokens):
        sums = np.concatenate(([0], np.cumsum(tokens > UNIT)))
        return sums[start + WINDOW] - sums[start] >= LITERALS

    plain, start, row = _text.windows(blind, first, WINDOW)
    exact, _, _ = _text.windows(words, first, WINDOW, seed=11)
    named, _, _ = _text.windows(tokens, first, WINDOW)
    more = np.flatnonzero(literal(tokens) & (named != plain))
    return (
        np.concatenate((np.where(literal(blind), plain, exact), named[more])),
        np.concatenate((start, start[more])), np.concatenate((row, row[more])),
    )


class Items:
    """Windows of some items, sorted by hash, and the items' words in lower case for their slots."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [k for k, _ in items]
        hashes, where, at = [], [], []
        self.tokens: list[np.ndarray] = []
        self.words: list[list[bytes]] = []
        for c in _text.chunks(pa.array([t for _, t in items], pa.large_string())):
            tokens, blind, words, folded = template(c)
            h, start, row = _windows(tokens, blind, words, c.first)
            hashes.append(h)
            where.append(row + c.row)
            at.append(start - c.first[:-1][row])
            for k in range(c.rows):
                self.tokens.append(tokens[c.first[k]:c.first[k + 1]])
                self.words.append(folded.bytes_of(k).split())
        h, where, at = np.concatenate(hashes), np.concatenate(where), np.concatenate(at)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.at = h[order], where[order], at[order]
        self.windows = np.array([max(len(t) - WINDOW + 1, 0) for t in self.tokens])

    def match(self, tokens: np.ndarray, words: list[bytes], found: list[tuple[int, int]]):
        """(item, matched, coverage, consistency, first word, last word) of each item that a
        document holds; `found` are its windows (hash position, start) among the items'."""
        hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for h, start in found:
            for k in range(*np.searchsorted(self.hashes, (h, h + _U(1)))):
                hits[int(self.item[k])].add((start, int(self.at[k])))
        best: dict[int, tuple] = {}
        for item, pairs in hits.items():
            least = COVERAGE * self.windows[item]
            if len({at for _, at in pairs}) < least:
                continue
            for path in _alignments(pairs, least):
                slots = self._slots(item, path, tokens, words)
                total = sum(sum(c.values()) for c in slots.values())
                same = sum(max(c.values()) for c in slots.values())
                consistency = same / total if total else 1.0
                coverage = len(path) / self.windows[item]
                row = (coverage, consistency, len(path), path[0][0], path[-1][0] + WINDOW)
                if consistency >= CONSISTENCY and (item not in best or row > best[item]):
                    best[item] = row
        return [
            (self.ids[k], n, cov, con, a, b) for k, (cov, con, n, a, b) in sorted(best.items())
        ]

    def _slots(self, item: int, path: list[tuple[int, int]], tokens: np.ndarray, words: list[bytes]):
        """How often each value of the item stands for each value of the document."""
        own, values = self.tokens[item], self.words[item]
        slots: dict[bytes, Counter] = defaultdict(Counter)
        place: dict[int, int] = {}  # word of the item: word of the document
        for start, at in path:
            for j in range(WINDOW):
                place.setdefault(at + j, start + j)
        covered = sorted(place)
        for a, b in zip(covered, covered[1:]):
            if place.get(a, a) - a == place.get(b, b) - b or a not in place or b not in place:
                continue
            # A value beside the change may go on behind it, so it is taken as a whole.
            while own[a] <= UNIT and a - 1 in place:
                del place[a]
                a -= 1
            while own[b] <= UNIT and b + 1 in place:
                del place[b]
                b += 1
            x, y = place[a] + 1, place[b]
            if x <= y:
                _gap(own[a + 1:b], tokens[x:y], values[a + 1:b], words[x:y], slots)
        for k, word in place.items():
            if own[k] <= UNIT:
                slots[values[k]][words[word]] += 1
        return slots


def _runs(tokens) -> list[tuple[int, int]]:
    """Spans of words; those of one placeholder in a row are one, as "Mary Jane" for "Tom"."""
    cuts = [k for k, t in enumerate(tokens) if not k or t > UNIT or t != tokens[k - 1]]
    return list(zip(cuts, [*cuts[1:], len(tokens)]))


def _gap(own, other, values: list[bytes], words: list[bytes], slots: dict[bytes, Counter]) -> None:
    """Slots between two diagonals, where a value may have another number of words."""
    a, b = _runs(own), _runs(other)
    matcher = SequenceMatcher(
        None, [int(own[x]) for x, _ in a], [int(other[x]) for x, _ in b], autojunk=False
    )
    for i, j, n in matcher.get_matching_blocks():
        for (p, q), (x, y) in zip(a[i:i + n], b[j:j + n]):
            if own[p] > UNIT:
                continue
            if q - p == y - x:
                for value, word in zip(values[p:q], words[x:y]):
                    slots[value][word] += 1
            else:
                slots[b" ".join(values[p:q])][b" ".join(words[x:y])] += 1


def _alignments(pairs: set[tuple[int, int]], least: float) -> list[list[tuple[int, int]]]:
    """Alignments of at least `least` windows (start in the document, at in the item): each diagonal
    alone, and the longest chain that ends on it. A chain ascends in both and changes the diagonal
    by at most SHIFT at a time."""
    starts: dict[int, list[int]] = defaultdict(list)  # diagonal: its hits, in order
    chains: dict[int, list[tuple[int, tuple[int, int] | None]]] = defaultdict(list)
    for start, at in sorted(pairs):
        shift = start - at
        length, before = 0, None
        if shift in starts:
            length, before = chains[shift][-1][0], (shift, len(starts[shift]) - 1)
        for near in range(shift - SHIFT, shift + SHIFT + 1):
            if near != shift and near in starts:
                k = bisect_left(starts[near], min(start, at + near)) - 1
                if k >= 0 and chains[near][k][0] > length:
                    length, before = chains[near][k][0], (near, k)
        starts[shift].append(start)
        chains[shift].append((length + 1, before))
    out = []
    for shift, own in starts.items():
        if len(own) >= least:
            out.append([(s, s - shift) for s in own])
        if chains[shift][-1][0] >= least and chains[shift][-1][0] > len(own):
            path, place = [], (shift, len(own) - 1)
            while place is not None:
                diagonal, k = place
                path.append((starts[diagonal][k], starts[diagonal][k] - diagonal))
                place = chains[diagonal][k][1]
            out.append(path[::-1])
    return out


_COLUMNS = ("id", "item_id", "matched", "coverage", "consistency", "first_word", "end_word")
_SCHEMA = (
    "id long, item_id long, matched long, coverage double, consistency double, "
    "first_word long, end_word long"
)


def _matches(items: Items, texts: pa.Array) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that hold items, with their matches."""
    for c in _text.chunks(texts):
        tokens, blind, words, folded = template(c)
        h, start, row = _windows(tokens, blind, words, c.first)
        at = np.minimum(np.searchsorted(items.hashes, h), max(len(items.hashes) - 1, 0))
        hit = np.flatnonzero(items.hashes[at] == h) if len(items.hashes) else []
        by_row = defaultdict(list)
        for k in hit:
            by_row[row[k]].append((h[k], int(start[k] - c.first[row[k]])))
        for k, found in by_row.items():
            part = slice(c.first[k], c.first[k + 1])
            rows = items.match(tokens[part], folded.bytes_of(k).split(), found)
            if rows:
                yield c.row + int(k), rows


def _find(items: Items):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            rows = [(ids[k].as_py(), *x) for k, found in _matches(items, batch.column(1)) for x in found]
            kinds = (pa.int64(),) * 3 + (pa.float64(),) * 2 + (pa.int64(),) * 2
            yield pa.RecordBatch.from_pydict({
                name: pa.array([r[k] for r in rows], kind)
                for k, (name, kind) in enumerate(zip(_COLUMNS, kinds))
            })

    return run


def _without(items: Items, text: int):
    """Rows that hold none of the items."""

    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for k, _ in _matches(items, batch.column(text)):
                clean[k] = False
            yield batch.filter(pa.array(clean))

    return run


def _parts(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[Items]:
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("long"), F.col(item_text_col)
    )
    part: list[tuple[int, str]] = []
    room = PART_WINDOWS
    for item in rows.toLocalIterator():
        part.append((item[0], item[1]))
        room -= len(item[1]) // 2 + 1  # more than it has words
        if room <= 0:
            yield Items(part)
            part, room = [], PART_WINDOWS
    if part:
        yield Items(part)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, item_id, matched windows, coverage, consistency, first_word, end_word): one row for each
    document and item in it, by its best place.

    Null texts have no words. Items of fewer than WINDOW words cannot be told from chance and are
    not looked for; items without id neither. Of items that repeat an id each is looked for.
    Documents without id take no part; repeated documents give repeated rows. Other columns are
    ignored; an empty table or benchmark gives an empty one. The finds of all parts of a benchmark but the
    last are written as they are found.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).where("id is not null")
    out, last = docs.sparkSession.createDataFrame([], _SCHEMA), None
    for part in _parts(benchmark, item_col, item_text_col):
        if last is not None:
            out = out.unionByName(keep(last, "finds"))
        last = rows.mapInArrow(_find(part), _SCHEMA)
    out = out if last is None else out.unionByName(last)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns, in one pass over each part of the
    benchmark; what a part leaves is written before the next one.

    Every row is judged by its own text: rows without id too, and of rows that repeat an id only those
    that hold an item go. A null text holds nothing.
    """
    at, left = docs.columns.index(text_col), None
    for part in _parts(benchmark, item_col, item_text_col):
        docs = docs if left is None else keep(left, "clean")
        left = docs.mapInArrow(_without(part, at), docs.schema)
    return docs if left is None else left


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
