"""Personal data in texts: four patterns, and a linear-chain conditional random field.

The field labels words (begin and inside of KINDS, or outside). Its features are word shapes: the
core in lower case, the compressed and the exact shape, digits, signs and case, of the word and its
neighbours. It is trained on the driver from a small labelled table (`pii_table`, about 700
sentences, or any other), by gradient steps on the penalised likelihood, and a few hundred kilobytes
of weights go to the tasks.

Tasks compute features of whole buffers in numpy. A word can be inside a span only if it lies in
some run of words whose best scores of one kind outweigh "outside", whatever stands beside the run;
sums over runs are read off running minima and maxima of prefix sums, so all other words are set
aside without loss. What is left is decoded exactly by Viterbi, many runs at a time.

Spans that the field finds are confirmed by an exact check of their kind (Luhn, number of digits,
address parts, check digits) and come beside those of the patterns, which always stay.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm import _text
from lintlake.llm._store import table
from lintlake.llm.pii_table import KINDS, labelled_rows

# The base patterns. Possessive repeats match the same and cannot backtrack.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")  # behind the sign of an e-mail address
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
ORDER = (*BASE, *(f"crf_{k}" for k in KINDS))

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BLOCK, OVERLAP = 1 << 20, 512  # words
_NEVER = -1e4  # a transition that cannot be
COMMON = 3  # rows of the labelled table that a word must be in to be known by itself
RIDGE, STEPS, RATE = 0.3, 150, 0.25
_U = np.uint64


# ---- features ---------------------------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.uint8)  # byte: shape character
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("a"):ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
_SOLID = np.isin(_CLASS, np.frombuffer(b"Aa0", np.uint8))
_TAIL = np.full(256, 4, np.int64)  # classes of the sign behind a word's core
for _k, _signs in enumerate((b",;", b".!?", b":=", b")]}")):
    _TAIL[list(_signs)] = (1, 2, 3, 5)[_k]
_LEAD = np.full(256, 1, np.int64)
_LEAD[list(b"+")], _LEAD[list(b"([{")], _LEAD[list(b"\"'")] = 2, 3, 4
_DIGITS = np.concatenate([np.arange(12), np.full(4, 12), [13], np.full(3, 14), [15]])  # 0 to 20

#: field: offsets of the neighbours that it is looked at.
FIELDS = {
    "core": (-2, -1, 0, 1, 2), "shape": (-1, 0, 1), "exact": (-1, 0, 1), "digits": (-1, 0, 1),
    "signs": (-1, 0, 1),
}
_HASHED = ("core", "shape", "exact")  # fields looked up in what the labelled table holds
_DIRECT = {"digits": 16 * 6, "signs": 5 * 4 * 2 * 2}


def _within(flag: np.ndarray, c: _text.Chunk) -> np.ndarray:
    """How many bytes of every word have the flag."""
    sums = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=sums[1:])
    return sums[c.ends] - sums[c.starts]


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, c: _text.Chunk, seed: int):
    return _text.Chunk(c.row, buf, starts, ends, c.first).word_hashes(seed)


def cores(c: _text.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Every word from its first to its last letter or digit; the whole word if it has none."""
    solid = np.flatnonzero(_SOLID[c.buf])
    if not len(solid):
        return c.starts, c.ends
    a = np.searchsorted(solid, c.starts)
    b = np.searchsorted(solid, c.ends) - 1
    some = b >= a
    begin = np.where(some, solid[np.minimum(a, len(solid) - 1)], c.starts)
    return begin, np.where(some, solid[np.maximum(b, 0)] + 1, c.ends)


def features(c: _text.Chunk) -> dict[str, np.ndarray]:
    """One number per word and field."""
    n = len(c.starts)
    if not n:
        return {f: np.zeros(0, _U if f in _HASHED else np.int64) for f in FIELDS}
    kinds = _CLASS[c.buf]
    begin, end = cores(c)
    upper, digit = kinds == ord("A"), kinds == ord("0")
    n_digit, n_upper = _within(digit, c), _within(upper, c)
    n_solid = _within(_SOLID[c.buf], c)
    # The shape repeats no character: Aa for Name, 0-0 for 12-34.
    fresh = np.ones(len(kinds), bool)
    fresh[1:] = kinds[1:] != kinds[:-1]
    fresh[c.starts] = True
    at = np.zeros(len(kinds) + 1, np.int64)
    np.cumsum(fresh, out=at[1:])
    shape = _hashes(kinds[fresh], at[c.starts], at[c.ends], c, 3)
    exact = np.zeros(n, _U)
    told = np.flatnonzero((n_digit > 0) | (_within(kinds == ord("@"), c) > 0))
    if len(told):
        own = _text.Chunk(c.row, kinds, c.starts[told], c.ends[told], c.first)
        exact[told] = own.word_hashes(5)
    lead = np.where(begin > c.starts, _LEAD[c.buf[c.starts]], 0)
    tail = np.where(end < c.ends, _TAIL[c.buf[np.minimum(end, len(c.buf) - 1)]], 0)
    first = np.select([kinds[begin] == ord("A"), kinds[begin] == ord("a"), kinds[begin] == ord("0")], [1, 2, 3], 0)
    inner = (end - begin > 0) & (n_solid < end - begin)
    capitals = (n_upper > 1) & (n_upper == n_solid)
    return {
        "core": _hashes(_text.lower_ascii(c.buf), begin, end, c, 1),
        "shape": shape,
        "exact": exact,
        "digits": _DIGITS[np.minimum(n_digit, 20)] * 6 + tail,
        "signs": ((lead * 4 + first) * 2 + inner) * 2 + capitals,
    }


# ---- model ------------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of every field and offset, by known value (row 0: no neighbour, row 1: unknown)."""

    known: dict[str, np.ndarray]  # sorted hashes
    weights: dict[tuple[str, int], np.ndarray]
    moves: np.ndarray  # from label to label

    def rows(self, field: str, values: np.ndarray) -> np.ndarray:
        if field in _DIRECT:
            return values + 2
        known = self.known[field]
        if not len(known):
            return np.ones(len(values), np.int64)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[at] == values, at + 2, 1)

    def move_bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By kind: what the step to a span's first word, a step inside and the step out of it add
        at most against staying outside, next to any labels."""
        moves, rest = self.moves, self.moves[0, 0]
        begin, inside = np.arange(1, len(LABELS), 2), np.arange(2, len(LABELS), 2)
        enter = (moves[:, begin] - moves[:, :1]).max(0)
        step = np.maximum(moves[begin, inside], moves[inside, inside]) - rest
        onward = [0, *begin]  # labels that may follow a span
        leave = np.array([(moves[np.ix_([x, y], onward)] - moves[0, onward]).max() for x, y in zip(begin, inside)])
        return enter, step, leave


def _neighbours(rows: np.ndarray, row_of: np.ndarray, offset: int) -> np.ndarray:
    """rows of the words `offset` further in the same text, 0 where there is none."""
    if not offset:
        return rows
    out = np.zeros_like(rows)
    k = abs(offset)
    if len(rows) > k:
        same = row_of[k:] == row_of[:-k]
        if offset > 0:
            out[:-k] = np.where(same, rows[k:], 0)
        else:
            out[k:] = np.where(same, rows[:-k], 0)
    return out


def _lookups(model: Model, c: _text.Chunk):
    """(row of every word in the chunk, {(field, offset): rows of weights})."""
    row_of = np.repeat(np.arange(c.rows), np.diff(c.first))
    found = features(c)
    out = {}
    for field, offsets in FIELDS.items():
        rows = model.rows(field, found[field])
        for o in offsets:
            out[field, o] = _neighbours(rows, row_of, o)
    return row_of, out


def _tags(rows) -> tuple[_text.Chunk, np.ndarray]:
    """The labelled rows as one chunk, and the label of every word."""
    column = pa.array([t for t, _ in rows], pa.large_string())
    size = sum(len(t.encode()) for t, _ in rows) + 1
    if size > _text.CHUNK:
        raise ValueError("the labelled table is to be small: at most 1 MiB of text")
    chunk = next(_text.chunks(column))
    labels = np.zeros(len(chunk.starts), np.int64)
    offset = 0
    for k, (text, spans) in enumerate(rows):
        own = slice(chunk.first[k], chunk.first[k + 1])
        for a, b, kind in spans:
            a, b = (offset + len(text[:x].encode()) for x in (a, b))
            inside = np.flatnonzero((chunk.starts[own] < b) & (chunk.ends[own] > a)) + own.start
            labels[inside] = LABELS.index(f"I-{kind}")
            labels[inside[:1]] = LABELS.index(f"B-{kind}")
        offset += len(text.encode())
    return chunk, labels


def _legal() -> np.ndarray:
    out = np.ones((len(LABELS), len(LABELS)), bool)
    for i, to in enumerate(LABELS):
        if to[0] == "I":
            out[:, i] = [f[1:] == to[1:] for f in LABELS]
    return out


def _likelihood(scores: np.ndarray, labels: np.ndarray, real: np.ndarray, moves: np.ndarray):
    """Gradient of the log likelihood by label of each word and by transition. Rows of `scores` are
    texts padded to one length, with outside before and behind each."""
    texts, length, n = scores.shape
    jump = np.exp(moves)
    top = scores.max(2, keepdims=True)
    local = np.exp(scores - top)
    ahead = np.zeros_like(local)
    for t in range(length):
        ahead[:, t] = local[:, t] * (jump[0] if t == 0 else ahead[:, t - 1] @ jump)
        total = ahead[:, t].sum(1, keepdims=True)
        ahead[:, t] /= total
    back = np.zeros_like(local)
    counts = np.zeros((n, n))
    last = real.sum(1) - 1
    for t in range(length - 1, -1, -1):
        ends = last == t
        if t + 1 < length:
            onward = local[:, t + 1] * back[:, t + 1]
            back[:, t] = onward @ jump.T
        back[ends, t] = jump[:, 0]
        back[:, t] /= np.maximum(back[:, t].max(1, keepdims=True), 1e-300)
        if t + 1 < length:
            alive = last > t
            pair = ahead[alive, t][:, :, None] * jump * onward[alive][:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            counts -= pair.sum(0)
    share = ahead * back
    share /= np.maximum(share.sum(2, keepdims=True), 1e-300)
    share *= real[:, :, None]
    gold = np.zeros_like(share)
    np.put_along_axis(gold, labels[:, :, None], 1.0, 2)
    gold *= real[:, :, None]
    at = np.arange(texts)
    counts[0] -= share[:, 0].sum(0)
    counts[:, 0] -= share[at, last].sum(0)
    np.add.at(counts, (0, labels[:, 0]), 1)
    np.add.at(counts, (labels[at, last], 0), 1)
    both = real[:, 1:]
    np.add.at(counts, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    return gold - share, counts


def train(rows, ridge: float = RIDGE, steps: int = STEPS, rate: float = RATE) -> Model:
    """A model from (text, [(start, end, kind)]) rows, at most 1 MiB of text; kinds are of KINDS.

    Words are known by themselves only if COMMON rows hold them. Texts without words are left out;
    without any row nothing is ever found. The same rows give the same model.
    """
    rows = [r for r in rows if r[0] and r[0].split()]
    legal = _legal()
    moves = np.where(legal, 0.0, _NEVER)
    n = len(LABELS)
    if not rows:
        empty = {f: np.zeros(0, _U) for f in _HASHED}
        weights = {(f, o): np.zeros((_DIRECT.get(f, 0) + 2, n)) for f, os in FIELDS.items() for o in os}
        for w in weights.values():
            w[:, 0] = 1.0
        return Model(empty, weights, moves)
    chunk, labels = _tags(rows)
    row_of = np.repeat(np.arange(chunk.rows), np.diff(chunk.first))
    known = {}
    for field, values in features(chunk).items():
        if field in _HASHED:
            pairs = np.unique(np.stack([values, row_of.astype(_U)], 1), axis=0)[:, 0]
            value, count = np.unique(pairs, return_counts=True)
            known[field] = value[count >= COMMON]
    model = Model(known, {}, moves)
    _, lookups = _lookups(model, chunk)
    base, size, flat = {}, 0, []
    for key, at in lookups.items():
        base[key] = size
        flat.append(at + size)
        size += len(known[key[0]]) + 2 if key[0] in known else _DIRECT[key[0]] + 2
    flat = np.stack(flat, 1)
    order = np.argsort(flat, axis=None, kind="stable")
    used, begins = np.unique(flat.ravel()[order], return_index=True)
    word_of = order // flat.shape[1]
    # Texts as rows of one length.
    lengths = np.diff(chunk.first)
    keep = lengths > 0
    place = np.arange(len(row_of)) - chunk.first[:-1][row_of]
    lines = np.cumsum(keep)[row_of] - 1
    shape = (int(keep.sum()), int(lengths.max()))
    real = np.zeros(shape, bool)
    real[lines, place] = True
    gold = np.zeros(shape, np.int64)
    gold[lines, place] = labels
    w = np.zeros((size, n))
    w_sum, m_sum = np.full((size, n), 1e-8), np.full((n, n), 1e-8)
    penalty = ridge
    for _ in range(steps):
        scores = np.zeros((*shape, n))
        scores[lines, place] = w[flat].sum(1)
        by_word, by_move = _likelihood(scores, gold, real, moves)
        step = np.zeros_like(w)
        step[used] = np.add.reduceat(by_word[lines, place][word_of], begins, axis=0)
        step -= penalty * w
        by_move = np.where(legal, by_move - penalty * np.where(legal, moves, 0), 0)
        w_sum += step**2  # each weight has a rate of its own, as in AdaGrad
        m_sum += by_move**2
        w += rate * step / np.sqrt(w_sum)
        moves = np.where(legal, moves + rate * by_move / np.sqrt(m_sum), _NEVER)
    model.moves = moves
    for key, at in base.items():
        rows_of = len(known[key[0]]) + 2 if key[0] in known else _DIRECT[key[0]] + 2
        model.weights[key] = w[at:at + rows_of]
    return model


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the labelled table."""
    return train(labelled_rows())


# ---- decoding ---------------------------------------------------------------------------------


def emissions(model: Model, c: _text.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row of every word in the chunk, its score by label).

    Words share few combinations of all fields but the core, so those fields are added up once for
    each combination.
    """
    row_of = np.repeat(np.arange(c.rows), np.diff(c.first))
    found = features(c)
    code = np.zeros(len(row_of), np.int64)
    fields = [f for f in FIELDS if f != "core"]
    for f in fields:
        code = code * len(model.weights[f, 0]) + model.rows(f, found[f])
    codes, which = np.unique(code, return_inverse=True)
    scores = np.zeros((len(row_of), len(LABELS)), np.float32)
    for o in FIELDS["shape"]:
        weights, rest = np.zeros((len(codes) + 1, len(LABELS))), codes
        for f in reversed(fields):
            w = model.weights[f, o]
            rest, rows = np.divmod(rest, len(w))
            weights[0] += w[0]
            weights[1:] += w[rows]
        scores += weights.astype(np.float32)[_neighbours(which + 1, row_of, o)]
    core = model.rows("core", found["core"])
    for o in FIELDS["core"]:
        scores += model.weights["core", o].astype(np.float32)[_neighbours(core, row_of, o)]
    return row_of, scores


def candidates(model: Model, scores: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Words that may be inside a span of the best labels.

    A span of a kind from s to e gains at most begin[s] + inside[s + 1] + ... + inside[e] and the
    bounds of its transitions. Where the best one through a word gains nothing, no span of that kind
    goes through it. With prefix sums the best begin and the best end are running maxima.
    """
    out = np.zeros(len(row_of), bool)
    text = np.cumsum(np.r_[False, row_of[1:] != row_of[:-1]][: len(row_of)])
    for k, bounds in enumerate(zip(*model.move_bounds())):
        enter, step, leave = bounds
        begin = scores[:, 2 * k + 1].astype(np.float64) - scores[:, 0] + enter
        inside = scores[:, 2 * k + 2].astype(np.float64) - scores[:, 0] + step
        sums = np.cumsum(inside)
        # No span goes from one text to the next: a step between them that nothing outweighs.
        wall = text * (2 * np.abs(inside).sum() + 2 * np.abs(begin).max(initial=0) + 1)
        before = np.maximum.accumulate(begin - sums + wall) - wall
        behind = np.maximum.accumulate((sums - wall)[::-1])[::-1] + wall
        out |= before + behind + leave >= -1e-3
    return out


def _decode(scores: np.ndarray, runs: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of every run, outside before and behind it. runs[k]: (begin, end) in scores."""
    out = np.zeros(len(scores), np.int64)
    length = runs[:, 1] - runs[:, 0]
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        # Runs of nearly one length, at most 2**20 words with padding.
        most = max(8, int(length[order[at]] * 1.5))
        to = int(np.searchsorted(length[order], most, "right"))
        to = max(at + 1, min(to, at + max(1, (1 << 20) // most)))
        part = order[at:to]
        size = length[part]
        longest = int(size[-1])
        n = len(part)
        place = np.minimum(runs[part, 0][:, None] + np.arange(longest), len(scores) - 1)
        via = np.zeros((longest, n, len(moves)), np.int8)
        best = moves[0] + scores[place[:, 0]]
        last = best + moves[:, 0]
        for t in range(1, longest):
            step = best[:, :, None] + moves
            via[t] = step.argmax(1)
            best = step.max(1) + scores[place[:, t]]
            alive = size > t
            last[alive] = best[alive] + moves[:, 0]
        label = last.argmax(1)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            alive = size > t
            out[place[alive, t]] = label[alive]
            label = np.where(alive, via[t, rows, label], label)
        at = to
    return out


def _label(model: Model, c: _text.Chunk) -> np.ndarray:
    row_of, scores = emissions(model, c)
    labels = np.zeros(len(row_of), np.int64)
    maybe = np.flatnonzero(candidates(model, scores, row_of))
    if len(maybe):
        cut = np.flatnonzero((np.diff(maybe) > 1) | (np.diff(row_of[maybe]) > 0)) + 1
        runs = np.stack([np.r_[0, cut], np.r_[cut, len(maybe)]], 1)
        labels[maybe] = _decode(scores[maybe].astype(np.float64), runs, model.moves)
    return labels


def label_words(model: Model, c: _text.Chunk) -> np.ndarray:
    """The best labels of all words of a chunk, as places in LABELS. A text of more than BLOCK words
    is decoded in blocks that share OVERLAP words, twice as many as a confirmed span can have."""
    n = len(c.starts)
    if n <= BLOCK:
        return _label(model, c)
    labels = np.zeros(n, np.int64)
    for at in range(0, n, BLOCK - OVERLAP):
        to = min(n, at + BLOCK)
        first = np.clip(c.first, at, to) - at
        part = _label(model, _text.Chunk(c.row, c.buf, c.starts[at:to], c.ends[at:to], first))
        skip = OVERLAP // 2 if at else 0
        labels[at + skip:to] = part[skip:]
        if to == n:
            break
    return labels


# ---- checks -----------------------------------------------------------------------------------

_DIGIT = re.compile("[0-9]")
_TITLES = {"Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Sra."}
_SPELLED = re.compile(  # name at host dot com, in any brackets
    r"[\w.+-]+[ ]?[(\[{<]?[ ]?(?:@|at)[ ]?[)\]}>]?[ ]?\w[\w-]*"
    r"(?:(?:\.|[ ]?[(\[{<]?[ ]?dot[ ]?[)\]}>]?[ ]?)\w[\w-]*)+", re.IGNORECASE
)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return sum(
        int(twice[int(d)]) if k % 2 else int(d) for k, d in enumerate(reversed(digits))
    ) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def confirmed(kind: str, text: str) -> bool:
    """Whether a span of the field can be what its label says."""
    digits = "".join(_DIGIT.findall(text[:400]))
    if kind == "card":
        return len(text) <= 40 and 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return len(text) <= 40 and 7 <= len(digits) <= 15
    if kind == "ip":
        try:
            ipaddress.ip_address(text)
        except ValueError:
            return False
        return True
    if kind == "id":
        plain = text.replace(" ", "")
        if _IBAN.fullmatch(plain):
            return int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1
        return 5 <= len(digits) and len(text) <= 40
    if kind == "person":
        words = text.split()
        # A sign ends a name, but for that of an initial or a title.
        whole = all(w[-1] not in ".,!?:;|" or len(w) == 2 and w[1] == "." or w in _TITLES for w in words[:-1])
        return (
            1 < len(words) <= 6 and not digits and whole and len(set(words)) == len(words)
            and all(w[0].isupper() for w in words)
        )
    if kind == "address":
        return bool(digits) and len(text) <= 120 and any(x.isalpha() for x in text)
    return len(text) <= 254 and _SPELLED.fullmatch(text) is not None  # email


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns; a match that fails its test is gone with all it covers."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            begin = at
            while begin > last and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at:
                last = domain.end()
                out.append((begin, last, "email"))
        at = text.find("@", at + 1)
    out += [(*m.span(), "ip") for m in IP.finditer(text) if _octets(m[0])]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = "".join(_DIGIT.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text)
                if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


_OPENS = np.isin(np.arange(256), list(b"+("))


def field_spans(model: Model, c: _text.Chunk) -> list[tuple[int, int, int, str]]:
    """(row in the chunk, start, end, kind) of what the field finds, in code points of the row."""
    labels = label_words(model, c)
    begins = np.flatnonzero(labels % 2 == 1)  # LABELS alternates B and I behind O
    if not len(begins):
        return []
    begin, end = cores(c)
    row_of = np.searchsorted(c.first, begins, "right") - 1
    points = np.zeros(len(c.buf) + 1, np.int64)
    np.cumsum((c.buf & 0xC0) != 0x80, out=points[1:])
    out = []
    for w, row in zip(begins.tolist(), row_of.tolist()):
        kind = LABELS[labels[w]][2:]
        to, limit = w + 1, int(c.first[row + 1])
        while to < limit and labels[to] == labels[w] + 1:
            to += 1
        a, b = int(begin[w]), int(end[to - 1])
        while kind == "phone" and a > c.starts[w] and _OPENS[c.buf[a - 1]]:
            a -= 1
        out.append((row, int(points[a]), int(points[b]), kind))
    return out


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(model: Model):
    def run(batches):
        for batch in batches:
            base, more = [], []
            column = batch.column(1)
            for c in _text.chunks(column):
                data, at = _text.text_buffers(column.slice(c.row, c.rows))
                points = np.zeros(len(c.buf) + 1, np.int64)
                np.cumsum((c.buf & 0xC0) != 0x80, out=points[1:])
                first = points[at - at[0]]  # code points before each row
                told = np.zeros(len(c.buf) + 1, np.int64)
                np.cumsum(np.isin(c.buf, np.frombuffer(b"@0123456789", np.uint8)), out=told[1:])
                tells = np.diff(told[at - at[0]]) > 0
                found: dict[int, list] = {}
                for row, a, b, kind in field_spans(model, c):
                    found.setdefault(row, []).append((a - int(first[row]), b - int(first[row]), kind))
                for k in range(c.rows):
                    if not tells[k] and k not in found:
                        base.append([])
                        more.append([])
                        continue
                    text = data[at[k]:at[k + 1]].tobytes().decode()
                    own = base_spans(text)
                    base.append([{"kind": x, "start": a, "end": b} for a, b, x in own])
                    free = _beside(own)
                    more.append([
                        {"kind": x, "start": a, "end": b} for a, b, x in found.get(k, ())
                        if free(a, b) and confirmed(x, text[a:b])
                    ])
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "base": pa.array(base, SPAN), "field": pa.array(more, SPAN),
            })

    return run


def _beside(spans: list[tuple[int, int, str]]):
    """Whether [a, b) meets none of the spans, which may overlap each other."""
    starts, ends = [], []
    for a, b, _ in sorted(spans):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b) - 1  # the last one that begins before b
        return k < 0 or ends[k] <= a

    return free


def find_personal_data(
    docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: its id, base (spans of the patterns) and field (confirmed spans of the field that
    meet none of those), as arrays of (kind, start, end).

    Offsets count code points, the end is exclusive. A null text is empty; every row is scanned
    whole, repeated ones each; a null id stays null; other columns are ignored.
    """
    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(
        _scan(model or trained()), f"id long, base {span}, field {span}"
    ).withColumnRenamed("id", id_col)


def _written(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (ORDER.index(s[2]), s[0], s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in ordered)


def _digest(batches):
    for batch in batches:
        out = {k: [] for k in ("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans")}
        for key, base, more in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own = [(s["start"], s["end"], s["kind"]) for s in base]
            kinds = [s[2] for s in own]
            out["doc_id"].append(key)
            for kind in BASE:
                out[f"n_{kind}"].append(kinds.count(kind))
            out["base_sha256"].append(hashlib.sha256(_written(own).encode()).hexdigest())
            out["spans"].append(_written(own + [(s["start"], s["end"], f"crf_{s['kind']}") for s in more]))
        yield pa.RecordBatch.from_pydict({
            k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64())
            for k, v in out.items()
        })


def op11_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents")).mapInArrow(
        _digest,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )
