"""Personal data: patterns against plain `re`, the field against plain Viterbi and enumeration."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa

from lintlake.llm import _text, pii_crf
from lintlake.llm.pii_table import labelled_rows

# The patterns as the contract writes them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x // 10 + x % 10
    return total % 10 == 0


def _plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and _luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return out


def _texts():
    rng = random.Random(3)
    pieces = [
        "4111 1111 1111 1111", "4111111111111111", "+1 (171) 555-2028", "10.0.0.1", "1.2.3.4.5.6.7.8",
        "256.1.1.1", "a.b@c.de", "@x.y", "a@b@c.d", "a@b.c@d.e", ".@d.e", "a@b..c", "+12", "+1 2 ",
        "0001.02.3.4", "12-34", "9", "++49 30 123456", "é", "😀", "x@y.z.", "- ", " ", "\n", "Mr. Ann Lee",
    ]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(1500)]
    texts += ["".join(rng.choices("0123456789 .-+()@ab", k=rng.randint(1, 40))) for _ in range(3000)]
    return texts


def test_patterns_equal_plain_ones():
    for text in _texts():
        assert sorted(pii_crf.base_spans(text)) == sorted(_plain_spans(text)), text


def test_patterns_are_linear_in_hostile_texts():
    for text in ("1" * 300_000, "1." * 200_000, "a" * 300_000 + "@", "@" * 300_000, "+1" + " " * 300_000,
                 "a@" + "b" * 300_000, "a@b." * 50_000 + "!"):
        assert pii_crf.base_spans(text) is not None


def _best(scores, moves):
    """Plain Viterbi of one text: outside before and behind it."""
    n = len(moves)
    best, via = [moves[0][k] + scores[0][k] for k in range(n)], []
    for row in scores[1:]:
        step = [max(range(n), key=lambda a: best[a] + moves[a][b]) for b in range(n)]
        best = [best[step[b]] + moves[step[b]][b] + row[b] for b in range(n)]
        via.append(step)
    label = max(range(n), key=lambda a: best[a] + moves[a][0])
    out = [label]
    for step in reversed(via):
        label = step[label]
        out.append(label)
    return out[::-1]


def _chunk(texts):
    return next(_text.chunks(pa.array(texts, pa.large_string())))


def test_set_aside_words_change_nothing():
    """Pruned and batched decoding gives what plain Viterbi over every word gives."""
    model = pii_crf.trained()
    rng = random.Random(8)
    rows = [t for t, _ in labelled_rows(2, seed=5)]
    texts = [" ".join(rng.sample(rows, 3)) for _ in range(60)] + ["", "one", "Of Of Of Of Of"]
    c = _chunk(texts)
    row_of, scores = pii_crf.emissions(model, c)
    labels = pii_crf.label_words(model, c)
    assert (labels > 0).any()
    for k in range(c.rows):
        own = slice(c.first[k], c.first[k + 1])
        if c.first[k] < c.first[k + 1]:
            want = _best(scores[own].astype(float).tolist(), model.moves.tolist())
            assert labels[own].tolist() == want


def test_random_scores_decode_like_plain_viterbi():
    rng = np.random.default_rng(4)
    moves = pii_crf.trained().moves
    lengths = [1, 1, 2, 3, 5, 8, 30, 31, 200]
    scores = rng.normal(0, 2, (sum(lengths), len(moves)))
    ends = np.cumsum(lengths)
    runs = np.stack([ends - lengths, ends], 1)
    found = pii_crf._decode(scores, runs, moves)
    for a, b in runs:
        assert found[a:b].tolist() == _best(scores[a:b].tolist(), moves.tolist())


def test_gradient_equals_enumeration():
    """Expected labels and transitions of all label sequences of two short texts, added up."""
    rng = np.random.default_rng(2)
    n, lengths = 3, [3, 2]
    moves = rng.normal(size=(n, n))
    scores, real = rng.normal(size=(2, 3, n)), np.array([[True] * 3, [True, True, False]])
    gold = np.array([[0, 1, 2], [1, 1, 0]])
    by_word, by_move = pii_crf._likelihood(scores, gold, real, moves)
    want_word, want_move = np.zeros_like(by_word), np.zeros_like(by_move)
    for k, length in enumerate(lengths):
        paths = list(itertools.product(range(n), repeat=length))
        weight = []
        for path in paths:
            whole = [0, *path, 0]
            weight.append(np.exp(sum(scores[k, t, y] for t, y in enumerate(path))
                                 + sum(moves[a, b] for a, b in zip(whole, whole[1:]))))
        total = sum(weight)
        for path, w in [*zip(paths, [-x / total for x in weight]), (tuple(gold[k, :length]), 1.0)]:
            whole = [0, *path, 0]
            for t, y in enumerate(path):
                want_word[k, t, y] += w
            for a, b in zip(whole, whole[1:]):
                want_move[a, b] += w
    assert np.allclose(by_word, want_word) and np.allclose(by_move, want_move)


def test_labels_of_sentences_that_were_not_trained_on():
    rows = labelled_rows(6, seed=99)
    c, labels = pii_crf._tags(rows)
    found = pii_crf.label_words(pii_crf.trained(), c)
    spans = labels > 0
    assert (found == labels)[spans].mean() > 0.95
    assert ((found > 0) & ~spans).sum() <= 0.002 * (~spans).sum()


def test_finds_what_the_patterns_miss():
    text = "Please contact Jorun Vastel at jorun (at) mailer (dot) org or (030) 555-7312. 4539578763621486 4485275742308327"
    c = _chunk([text])
    found = {(kind, text[a:b]) for _, a, b, kind in pii_crf.field_spans(pii_crf.trained(), c)}
    assert {("person", "Jorun Vastel"), ("phone", "(030) 555-7312"), ("card", "4539578763621486"),
            ("card", "4485275742308327")} <= found
    assert not pii_crf.confirmed("card", "4539578763621487")
    assert pii_crf.confirmed("email", "jorun (at) mailer (dot) org") and not pii_crf.confirmed("email", "at for for")
    assert pii_crf.confirmed("person", "Dr. A. Lee") and not pii_crf.confirmed("person", "Then. Lee")


def test_training_is_repeatable_and_takes_no_rows():
    rows = labelled_rows(2)
    a, b = pii_crf.train(rows, steps=5), pii_crf.train(rows, steps=5)
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights) and (a.moves == b.moves).all()
    nothing = pii_crf.train([("", []), (" \n", [])])
    assert not pii_crf.label_words(nothing, _chunk(["My name is Ann Lee", ""])).any()


SCHEMA = "doc_id long, text string, source string, base string, id long, field int"


def test_query_on_odd_rows(spark, tmp_path):
    long = "é " * 600_000 + "Please contact Jorun Vastel at a@b.de " + "9" * 70_000
    texts = [None, "", " \n", "+1 (171) 555-2028 4539578763621486", "ü a@b.de 10.0.0.1", long, "😀 a.b@c.de"]
    rows = [(k, t, "s", "x", -1, 0) for k, t in enumerate(texts)]
    rows += [rows[4], (None, "x@y.zz", None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = [r.asDict() for r in pii_crf.op11_pii_crf(spark, str(tmp_path)).collect()]
    assert len(found) == len(rows)
    texts_of = {k: t or "" for k, t, *_ in rows}
    order = list(PLAIN)
    for r in found:
        # The long text has its data in the last part; `9...` is a digit run that is no card.
        shift = max(0, len(texts_of[r["doc_id"]]) - 72_000)
        text = texts_of[r["doc_id"]][shift:][:3000]
        spans = sorted(_plain_spans(text), key=lambda s: (order.index(s[2]), s[0]))
        written = ",".join(f"{k}:{a + shift}:{b + shift}" for a, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), r
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[2] == k for s in spans) for k in PLAIN]
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))
    by_id = {r["doc_id"]: r["spans"] for r in found}
    assert "crf_phone:0:17" in by_id[3] and "crf_card:18:34" in by_id[3]
    at = long.index("Jorun")
    assert f"crf_person:{at}:{at + 12}" in by_id[5]
    nothing = spark.createDataFrame([], SCHEMA)
    assert pii_crf.find_personal_data(nothing).count() == 0


def test_blocks_of_a_text_equal_the_whole(monkeypatch):
    rng = random.Random(1)
    c = _chunk([" ".join(rng.choice(labelled_rows(1, seed=3))[0] for _ in range(900))])
    whole = pii_crf.label_words(pii_crf.trained(), c)
    monkeypatch.setattr(pii_crf, "BLOCK", 2000)
    assert len(whole) > 4000 and (pii_crf.label_words(pii_crf.trained(), c) == whole).all()
