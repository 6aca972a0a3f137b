"""Secrets in texts: three patterns, and strings whose sliding-window entropy is high.

A candidate is a run of at least MIN_LENGTH characters of A-Z a-z 0-9 + / _ = -. Each class of
characters (lower-case hex, upper-case hex, lower case with digits, upper case with digits, base 64)
has a window and two thresholds. The window moves over each run of the class inside the candidate;
its Shannon entropy is kept by adding and taking away the counts of the one character that enters
and the one that leaves. The lower threshold is a quantile of random keys, and holds for windows that
mix letters, digits and cases as nearly all random ones do; the upper one holds for any window of a
run with digits. Such windows join to spans of kind entropy_<class>. An allow-list takes UUIDs,
alphabets and words that name a placeholder out of a candidate; what stands beside them is scanned.
It never suppresses what a pattern found.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm._store import table

# The base patterns and their shortest lengths.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # runs of [0-9a-f]+ of 32 or more
ASSIGN_LENGTH, ACCESS_LENGTH = 8, 16
KINDS = (
    "assign", "access", "hex",
    "entropy_hex", "entropy_HEX", "entropy_lower", "entropy_upper", "entropy_base64",
)

MIN_LENGTH = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: kind: (characters of the class, window, bits a character of a mixed window and of any window).
#: 0.5 % of random windows of the class have fewer bits than a mixed one needs.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9a-f]{20,}"), 20, 2.82, 3.0),
    "entropy_HEX": (re.compile(r"[0-9A-F]{20,}"), 20, 2.82, 3.0),
    "entropy_lower": (re.compile(r"[a-z0-9]{20,}"), 20, 3.34, 3.9),
    "entropy_upper": (re.compile(r"[A-Z0-9]{20,}"), 20, 3.34, 3.9),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.58, 3.9),
}
BOTH_CASES, BOTH_CASES_ALONE = 2, 5  # letters of either case in a base 64 window, and without digits
CHANGES = 7  # from one of A-Z, a-z, 0-9 and the signs to another, in a base 64 window
_rest = lambda s: f"(?:{s[0]}{_rest(s[1:])})?" if s else ""
ALLOWED = re.compile(
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    rf"|abcdefghij{_rest('klmnopqrstuvwxyz')}|0123456789",
    re.IGNORECASE | re.ASCII,
)
#: Such a word stands for all letters and digits that it is written together with.
PLACEHOLDER = re.compile(r"example|placeholder|changeme|x{6}", re.IGNORECASE | re.ASCII)
_WORD = re.compile(r"[A-Za-z0-9]+")
_DIGIT = re.compile(r"[0-9]")
_TERM = [0.0] + [n * math.log2(n) for n in range(1, 129)]


def windows_above(
    text: str, width: int, bits: float, also: Callable[[int, int], bool] = lambda a, b: True
) -> list[tuple[int, int]]:
    """Spans of the windows of `width` characters whose entropy is at least `bits` and which `also`
    takes, joined where they touch. With counts c of a window of w characters the entropy is log2 w - sum(c log2 c) / w,
    so a step changes only the terms of two characters."""
    if len(text) < width:
        return []
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[list[int]] = []
    most = width * (math.log2(width) - bits) + 1e-9
    for k, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if k >= width:
            n = counts[old := text[k - width]]
            counts[old] = n - 1
            total += _TERM[n - 1] - _TERM[n]
        if k >= width - 1 and total <= most and also(k - width + 1, k + 1):
            begin = k - width + 1
            if spans and begin <= spans[-1][1]:
                spans[-1][1] = k + 1
            else:
                spans.append([begin, k + 1])
    return [tuple(s) for s in spans]


def _mixed(kind: str, text: str) -> Callable[[int, int], bool]:
    """Whether text[a:b] mixes characters as a random key of the class does. Prose has hardly any
    digits, and few capitals in its words; names in code change their case at the words only."""
    def count(own):
        return [0, *accumulate(map(own, text))]

    digits, upper, lower = count(str.isdigit), count(str.isupper), count(str.islower)
    sort = [c.isdigit() + 2 * c.isupper() + 3 * c.islower() for c in text]
    changes = [0, *accumulate(x != y for x, y in zip(sort, sort[1:]))]

    def mixed(a: int, b: int) -> bool:
        n, up, low = digits[b] - digits[a], upper[b] - upper[a], lower[b] - lower[a]
        if kind != "entropy_base64":
            return n > 0 and up + low > 0
        if changes[b - 1] - changes[a] < CHANGES:
            return False
        return min(up, low) >= (BOTH_CASES if n else BOTH_CASES_ALONE)

    return mixed


def _keys(kind: str, text: str) -> list[tuple[int, int]]:
    _, width, bits, any_bits = CLASSES[kind]
    spans = windows_above(text, width, bits, _mixed(kind, text))
    if _DIGIT.search(text):
        spans += windows_above(text, width, any_bits)
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanned(run: str) -> list[tuple[int, str]]:
    """(offset, text) of what the allow-list leaves of a candidate."""
    allowed = [m.span() for m in ALLOWED.finditer(run)]
    if PLACEHOLDER.search(run):
        allowed += [m.span() for m in _WORD.finditer(run) if PLACEHOLDER.search(m[0])]
    out, at = [], 0
    for a, b in sorted(allowed):
        if a > at:
            out.append((at, run[at:a]))
        at = max(at, b)
    return [*out, (at, run[at:])]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text)
                if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)
                if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    out = set()
    for candidate in CANDIDATE.finditer(text):
        for offset, text in _scanned(candidate[0]):
            has_digit = _DIGIT.search(text) is not None
            taken: list[tuple[int, int]] = []
            for kind, (pattern, *_) in CLASSES.items():
                if not has_digit and kind != "entropy_base64":
                    continue
                for part in pattern.finditer(text):
                    for a, b in _keys(kind, part[0]):
                        at = candidate.start() + offset + part.start()
                        # A narrower class explains a span that it covers.
                        if not any(x <= at + a and at + b <= y for x, y in taken):
                            out.add((at + a, at + b, kind))
                            taken.append((at + a, at + b))
    return sorted(out)


def _written(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in ordered)


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches):
    for batch in batches:
        base, more = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base.append([{"kind": k, "start": a, "end": b} for a, b, k in base_spans(text)])
            more.append([{"kind": k, "start": a, "end": b} for a, b, k in entropy_spans(text)])
        yield pa.RecordBatch.from_pydict({
            "id": batch.column(0), "base": pa.array(base, SPAN), "entropy": pa.array(more, SPAN),
        })


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, base (spans of the patterns) and entropy (spans of the method).

    Offsets count code points, the end is exclusive. A null text is empty; every row is scanned
    whole, repeated ones each; a null id stays null; other columns are ignored.
    """
    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(
        _scan, f"id long, base {span}, entropy {span}"
    ).withColumnRenamed("id", id_col)


def _digest(batches):
    for batch in batches:
        out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for key, base, more in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own = [(s["start"], s["end"], s["kind"]) for s in base]
            kinds = [s[2] for s in own]
            out["doc_id"].append(key)
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(kinds.count(kind))
            out["base_sha256"].append(hashlib.sha256(_written(own).encode()).hexdigest())
            out["spans"].append(_written(own + [(s["start"], s["end"], s["kind"]) for s in more]))
        yield pa.RecordBatch.from_pydict({
            k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64())
            for k, v in out.items()
        })


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).mapInArrow(
        _digest,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
