"""Every training-data operator against a plain version of its definition, on small tables with
nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lintlake.llm import (
    decontamination, line_dedup, lm_scoring, near_dedup, secret_scan, source_mixing,
    substring_dedup, token_count, topk_search, toxicity,
)
from lintlake.llm._components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words long, id long, label string, row int"


def _texts():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["The", "Éa", "x y", "ñ"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = say(70), say(120).split()
    texts = [None, "", " \n\t", "one", "two words", "Two  words", say(3000)]
    for _ in range(12):
        texts.append(say(40))
        texts.append(say(30) + "\n" + passage + "  " + say(20))
    for k in range(12):  # near copies of one text, some linked only through others
        words = list(base)
        for at in rng.sample(range(len(words)), k % 4 * 2):
            words[at] = f"new{k}x{at}"
        texts.append(" ".join(words))
    texts += [texts[-1], texts[-1], texts[6]]
    lines = [say(6) for _ in range(9)]
    texts += ["\n".join([say(5), *lines[:k], say(4)]) for k in (9, 9, 5)] + ["\n".join(lines)] * 2
    return texts


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 5 == 0 else f"s{k % 4}", -1, -2, "z", 3) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[9], (None, "no id here", "s1", 0, 0, "", 0)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return WORD.findall((text or "").encode())


def _lower(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def test_components_of_paths_stars_and_repeated_edges(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)]
    edges += [(9, 9), (7, 8), (8, 7), (7, 8)]
    rng.shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    want = {k: 100 for k in range(101, 161)} | {k: 500 for k in range(501, 560)} | {8: 7}
    assert {r["node"]: r["root"] for r in found} == want


# ---- 1 ----------------------------------------------------------------------------------------


def test_top_k_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(-3, 4, 3).tolist()) for k in range(400)]
    rows += [(k, [1, 1, 1]) for k in range(400, 500)]
    rows += [(None, [1, 1, 1]), (600, None), (601, [1, 1]), (620, [2, 2]), (602, [1, 0]), rows[3]]
    frame = spark.createDataFrame(rows, "id long, v array<long>")
    found = topk_search.top_k(frame, topk_search.F.col("id") % 20 == 0, k=7).collect()
    want = []
    known = {k: v for k, v in rows if k is not None and v is not None}
    for q in (k for k in known if k % 20 == 0):
        scores = [(-sum(a * b for a, b in zip(known[q], v)), k)
                  for k, v in known.items() if k != q and len(v) == len(known[q])]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(sorted(scores)[:7])]
    assert sorted(map(tuple, found)) == sorted(want)


def test_top_k_of_wide_scores_and_of_nothing(spark):
    frame = spark.createDataFrame([(k, [k * 10**7, -k]) for k in range(50)], "id long, v array<long>")
    found = topk_search.top_k(frame, topk_search.F.col("id") == 40, k=3).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(found)] == [(1, 49), (2, 48), (3, 47)]
    assert topk_search.top_k(frame.limit(0), topk_search.F.lit(True)).count() == 0


# ---- 2 ----------------------------------------------------------------------------------------


def _cut(texts, length):
    first, out = {}, {}
    for k, words in texts.items():
        for p in range(len(words) - length + 1):
            first.setdefault(tuple(words[p:p + length]), k)
    for k, words in texts.items():
        gone = set()
        for p in range(len(words) - length + 1):
            if first[tuple(words[p:p + length])] < k:
                gone.update(range(p, p + length))
        out[k] = [w for at, w in enumerate(words) if at not in gone]
    return out


@pytest.mark.parametrize("length", [50, 7])
def test_substring_dedup_equals_brute_force(docs, length):
    documents, changed = substring_dedup.substring_dedup(docs, min_words=length)
    texts = {k: _words(t) for k, t in enumerate(TEXTS)}
    want = _cut(texts, length)
    cut = {r["id"]: r["text"].encode().split() for r in changed.collect()}
    rows = {r["id"]: r for r in documents.collect()}
    assert set(rows) == set(texts)
    for k, r in rows.items():
        copy = k != r["first_id"] and r["n_words"] >= length
        assert ([] if copy else cut.get(k, texts[k])) == want[k]
        assert r["sha"] == hashlib.sha256(b" ".join(texts[k])).digest()


def test_substring_dedup_of_nothing(empty):
    documents, changed = substring_dedup.substring_dedup(empty)
    assert documents.count() == changed.count() == 0


# ---- 3 ----------------------------------------------------------------------------------------


def _without_repeated_lines(texts):
    """Per key of `texts`, in order, (text, number of lines that go): a line with a word goes if it and
    a neighbour, lines without words left out, stand together at an earlier place; one without a word
    goes if the lines around it go together."""
    seen, out = set(), {}
    for key, text in texts.items():
        if text is None:
            out[key] = (None, 0)
            continue
        lines, gone = text.split("\n"), set()
        full = [i for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
        for i, j in zip(full, full[1:]):
            if (lines[i], lines[j]) in seen:
                gone.update(range(i, j + 1))
            seen.add((lines[i], lines[j]))
        out[key] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_line_dedup_equals_brute_force(docs):
    want = _without_repeated_lines(dict(enumerate(TEXTS)))
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["text"], r["n_removed"]) == want[r["doc_id"]]
            assert r["n_lines"] == (0 if TEXTS[r["doc_id"]] is None else TEXTS[r["doc_id"]].count("\n") + 1)
    assert any(n for _, n in want.values())


def test_line_dedup_finds_short_passages_and_odd_lines(spark):
    """Passages of 2, 3, 4 and 8 lines in foreign surroundings all go but for their first place, and
    lines around them stay; blank lines, a line over and over, passages that overlap or repeat in
    one text, long words and texts of one line as brute force has them."""
    rng = random.Random(11)
    fresh = iter(range(10**9))
    line = lambda: f"line {next(fresh)} " + " ".join(rng.choices("abcdefgh", k=5))
    passages = [[line() for _ in range(n)] for n in (2, 3, 4, 8) for _ in range(15)]
    texts, planted = [], 0
    for k in range(2):
        for p in passages:
            texts.append("\n".join([*(line() for _ in range(4)), *p, *(line() for _ in range(4))]))
            planted += k * len(p)
    want = _without_repeated_lines(dict(enumerate(texts)))
    assert sum(n for _, n in want.values()) == planted
    a, b, c, d = (line() for _ in range(4))
    texts += [
        "\n".join(x) for x in (
            [a, "", b, " \t", c], [d, a, b, c, "", d], ["", a, "\r", b, "", "", d], [c] * 7, [c, "", c, c],
            [a, b, line(), a, b, c, line(), b, c, d], ["", "", ""], ["x" * 70000, a, b], ["x" * 70000, a, d], [d],
            [a, "b c"], [a + "\n" + "b c", d],
        )
    ]
    texts += ["\n".join(rng.choices([a, b, c, d, "", line()], k=40)) for _ in range(30)]
    want = _without_repeated_lines(dict(enumerate(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.line_dedup(rows).collect()}
    assert got == want


def test_line_dedup_of_repeated_ids(spark):
    """Rows of one id are cut only where they hold the passage; equal rows remove nothing from each other."""
    rows = [(1, "a a\nb b\nc c"), (2, "x\na a\nb b\ny"), (2, "x\nq\nr\ny"), (3, "k k\nl l"), (3, "k k\nl l")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [
        (1, "a a\nb b\nc c"), (2, "x\nq\nr\ny"), (2, "x\ny"), (3, "k k\nl l"), (3, "k k\nl l")]


def test_line_dedup_is_linear_in_the_lines_of_a_text(spark):
    """Two copies of a text of over a million characters."""
    text = "\n".join(f"{k} some words of a line" for k in range(64000))
    rows = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.line_dedup(rows).collect()}
    assert got == {1: (text, 0), 2: ("", 64000)}
    assert time.time() - start < 30


def test_line_dedup_replaces_clashing_columns(docs, empty):
    out = line_dedup.line_dedup(docs.withColumnRenamed("row", "n_removed").withColumnRenamed("id", "_id"))
    assert out.columns.count("n_removed") == 1 and "_id" in out.columns
    assert line_dedup.line_dedup(empty).count() == 0


# ---- 4 ----------------------------------------------------------------------------------------


def _targets(sizes, weights):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        open_ -= over
    return target


def test_mixing_meets_targets(docs):
    rows = source_mixing.mix_sources(docs, keep_columns=True).collect()
    again = source_mixing.mix_sources(docs.repartition(5), keep_columns=True).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["position"] or -1)
    assert sorted(rows, key=key) == sorted(again, key=key)
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(_words(r["text"]))
        sizes[r["source"]] += r["size"]
    want = _targets(sizes, source_mixing.WEIGHTS)
    for source, target in want.items():
        own = [r for r in rows if r["source"] == source]
        assert all(r["target"] == pytest.approx(target) for r in own)
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"] + 0.5)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert all(r["source_size"] == sizes[source] for r in own)
    for r in rows:
        assert (r["position"] is not None) == (r["taken"] > 0)
        assert r["again"] is None or r["again"] > r["position"]


def test_positions_follow_the_schedule(spark):
    """The share of a source that is due by a time is the integral of its schedule."""
    schedule = ((0.0, 0.0), (0.5, 2.0), (1.0, 0.0))
    due = [0.0, 0.125, 0.5, 0.875, 1.0]
    frame = spark.createDataFrame([(x,) for x in due], "due double")
    found = [r[0] for r in frame.select(source_mixing._inverse(schedule, frame["due"])).collect()]
    assert found == pytest.approx([0.0, 0.25, 0.5, 0.75, 1.0])


def test_positions_of_rows_equal_integrals_of_the_schedules(docs):
    """By a position, a source's schedule has let through the words that stand before the document."""
    by_source = {}
    for r in source_mixing.mix_sources(docs).select("*").collect():
        by_source.setdefault(r["source_size"], []).append(r)
    sources = Counter()
    for r in docs.collect():
        sources[r["source"]] += len(_words(r["text"]))
    order = sorted(sources, key=lambda s: (s is None, s))
    for nth, source in enumerate(order):
        if list(sources.values()).count(sources[source]) > 1 or not sources[source]:
            continue
        schedule = source_mixing.SCHEDULES[nth % len(source_mixing.SCHEDULES)]
        budget = math.floor(by_source[sources[source]][0]["target"] + 0.5)

        def due(time):
            total = done = 0.0
            for (u0, a), (u1, b) in zip(schedule, schedule[1:]):
                total += (u1 - u0) * (a + b) / 2
                u = min(max(time, u0), u1) - u0
                done += u * a + u * u * (b - a) / (u1 - u0) / 2
            return done / total

        places = sorted(
            (r[k], r["size"]) for r in by_source[sources[source]] for k in ("position", "again")
            if r[k] is not None
        )
        ahead = 0
        for at, size in places:
            assert due(at) * budget == pytest.approx(ahead, abs=1e-6 * budget + 1e-6)
            ahead += size
        assert ahead >= budget


def test_rows_without_id_are_told_apart_by_their_texts(spark):
    """Rows without id lie in many buckets, and rerunning places them alike."""
    rows = spark.createDataFrame(
        [(None if k % 2 else 7, f"text {k} " * (k % 5 + 1), "a") for k in range(300)],
        "doc_id long, text string, source string",
    )
    one, two = (
        sorted((r["text"], r["position"], r["again"] or 0) for r in source_mixing.mix_sources(x, keep_columns=True).collect())
        for x in (rows, rows.repartition(7))
    )
    assert one == two
    assert len({position for _, position, _ in one}) == 300


def test_mixing_of_nothing_and_of_empty_texts(spark, empty):
    assert source_mixing.mix_sources(empty).count() == 0
    rows = source_mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


# ---- 5 ----------------------------------------------------------------------------------------

KEY = "9f8a7b6c5d4e3f2a1b0c" + "0f1e2d3c4b5a69788796"
SECRETS = [
    None, "", "nothing", "é password = 'abc12345' x", "PassWord:short", "api_key=\"" + "Zz9+" * 3 + "\"",
    "apikey: x secret=abcdefgh.token=12345678", "AKIA" + "ABCDEFGH1234", "AKIA" + "SHORT", "x" + KEY + "z",
    "f" * 31 + " " + "0" * 32, "ſecret=abcdefgh1", "say " + "Q7x/Lk2+Pz9_Wm4-Ba8vYt5R" + " end",
    "thewordthatneverendsinprose andmore", "123e4567-e89b-12d3-a456-426614174000", "token==abcdefgh1",
]


def _base(text):
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
    assign = re.compile(f"""({names})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_secrets_equal_the_patterns():
    for text in SECRETS:
        found = sorted((a, secret_scan.KINDS.index(k), b, k) for a, b, k in secret_scan.base_spans(text or ""))
        assert found == _base(text or "")


def test_entropy_windows_equal_direct_computation():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choices("abcdef01", k=rng.randint(0, 60)))
        want = set()
        for p in range(len(text) - 19):
            counts = Counter(text[p:p + 20])
            if -sum(c / 20 * math.log2(c / 20) for c in counts.values()) >= 2.7 - 1e-9:
                want.update(range(p, p + 20))
        found = {k for a, b in secret_scan.windows_above(text, 20, 2.7) for k in range(a, b)}
        assert found == want


def test_entropy_finds_keys_and_spares_prose_and_ids():
    kinds = lambda t: [k for _, _, k in secret_scan.entropy_spans(t)]
    assert kinds("say Q7x/Lk2+Pz9_Wm4-Ba8vYt5R end") == ["entropy_base64"]
    assert kinds("id " + KEY) == ["entropy_hex"]
    for text in (SECRETS[13], SECRETS[14], "x" * 40, "EXAMPLE" + KEY):
        assert kinds(text) == []


def test_entropy_finds_nearly_all_random_keys():
    rng = random.Random(8)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for letters in (low + up + digits + "+/", low + digits, up + digits, "abcdef" + digits, "ABCDEF" + digits):
        for length, most in ((20, 15), (24, 5), (32, 0)):
            keys = ["".join(rng.choices(letters, k=length)) for _ in range(1000)]
            assert sum(not secret_scan.entropy_spans(f"k {key} z") for key in keys) <= most
    for text in ("getElementsByClassName", "some/path/to-a/very_long-file/name", "A" * 10 + "SCREAMINGCASEOFWORDS",
                 "HTTPDefaultErrorHandlerOfAll", (low + up + digits) * 3):
        assert secret_scan.entropy_spans(text) == []


def test_allow_list_spares_the_key_beside_it():
    key = "Q7x/Lk2+Pz9_Wm4-Ba8vYt5R"
    for mark in ("123e4567-e89b-12d3-a456-426614174000/", "example/", "xxxxxxxx-", "abcdefghijklmnop=", "0123456789/", "changeme_"):
        (a, b, kind), = secret_scan.entropy_spans(f"é {mark}{key}/example")
        assert kind == "entropy_base64" and a <= 2 + len(mark) and b >= 2 + len(mark) + len(key)
        assert a >= 2 + len(mark) - 1 and b <= 2 + len(mark) + len(key) + 1


def test_secret_query_columns(spark, tmp_path):
    spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in secret_scan.op5_secret_scan(spark, str(tmp_path)).collect():
        base = _base(SECRETS[r["doc_id"]] or "")
        written = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(
            sum(x[3] == k for x in base) for k in ("assign", "access", "hex"))
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))


# ---- 6 ----------------------------------------------------------------------------------------


def test_token_counts_equal_the_tokenizer(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = token_count.read_vocabulary(token_count.VOCABULARY)
    pieces = [("<unk>", 0.0), *vocabulary, *((f"<0x{k:02X}>", 0.0) for k in range(256))]
    own = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, byte_fallback=True))
    own.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(
        replacement=token_count.SPACE, prepend_scheme="always", split=True)
    texts = [*TEXTS, *SECRETS, " ", "  a", "a  b ", "▁x", "日本語 𝔘𝔘", "\n\na\n b", "a" * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(frame, vocabulary).collect()}
    want = {k: len(e.ids) for k, e in enumerate(own.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert found == want
    assert token_count.count_tokens(docs, vocabulary).count() == docs.count()


def test_token_count_ties_and_unknown_runs():
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = [("▁", -2.0), ("a", -2.0), ("aa", -4.0), ("ab", -3.0), ("b", -1.0), ("▁a", -4.0), ("aaa", -6.0)]
    own = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *vocabulary], 0))
    own.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_count.Counter(vocabulary, byte_pieces=False)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices("aab cé", k=rng.randint(1, 14)))
        got = sum(counter.count(p)[0] for p in token_count.stretches(text))
        assert got == len(own.encode(text, add_special_tokens=False).ids), text


# ---- 7 ----------------------------------------------------------------------------------------


def _kneser_ney(training, texts):
    tokens = lambda t: [_lower(w) for w in _words(t)] + [None]
    pairs, count = Counter(), Counter()
    for t in training:
        before = "begin"
        for x in tokens(t):
            pairs[before, x] += 1
            count[x] += 1
            before = x
    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 1, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0] + [d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), raw)]
    d = discounts(pairs.values())
    cont = Counter(w for _, w in pairs)
    e = discounts(cont.values())
    spare = sum(e[min(c, 3)] for c in cont.values()) / max(len(pairs), 1) if pairs else 1.0
    lower = lambda w: max(cont[w] - e[min(cont[w], 3)], 0) / max(len(pairs), 1) + spare / (len(count) + 1)
    total, left = Counter(), Counter()
    for (v, _), n in pairs.items():
        total[v] += n
        left[v] += d[min(n, 3)]
    n_all, v_all = sum(count.values()), len(count)
    out = []
    for t in texts:
        base = score = 0.0
        before = "begin"
        for x in tokens(t):
            base += math.log10((count[x] + 0.1) / (n_all + 0.1 * (v_all + 1)))
            n = pairs[before, x]
            p = lower(x)
            if total[before]:
                p = (max(n - d[min(n, 3)], 0) + left[before] * p) / total[before]
            score += math.log10(p)
            before = x
        out.append((len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n_all, base, score))
    return out


def test_shards_are_merged_in_one_task_each(spark):
    rows = spark.range(64).selectExpr("cast(id % 16 as int) as shard", "id as v")
    by_task = lambda g: g.select(["shard"]).slice(0, 1)
    merged = lm_scoring._by_shard(rows, 16).applyInArrow(by_task, "shard int")
    placed = merged.select("shard", lm_scoring.F.spark_partition_id().alias("p")).collect()
    assert sorted(r["shard"] for r in placed) == list(range(16)) and len({r["p"] for r in placed}) == 16
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_lm_scores_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 2000)
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    learn = [t for k, t in enumerate(TEXTS) if zlib.crc32(str(k).encode()) % 10]
    remainder = lm_scoring.F.crc32(known["doc_id"].cast("string")) % 10
    rows = lm_scoring.lm_scores(known, known.where(remainder != 0)).collect()
    want = _kneser_ney(learn, TEXTS)
    assert len(rows) == len(TEXTS)
    for r in rows:
        got = (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert got == pytest.approx(want[r["doc_id"]], abs=1e-6)


def test_lm_without_training(docs, empty):
    rows = lm_scoring.lm_scores(docs, empty).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)
    assert lm_scoring.lm_scores(empty, docs).count() == 0


# ---- 8 ----------------------------------------------------------------------------------------

ITEM = "A train leaves Boston at 9 and travels 120 miles in 3 hours; how many miles does the train travel in an hour"
OTHER = "Mix the flour with two eggs and slowly stir in the warm milk until the batter is smooth again"


def test_contamination_is_found_also_with_new_parameters(spark, empty):
    changed = ITEM.replace("Boston", "Denver").replace("120", "455").replace("9", "11").replace("miles", "km").replace("hours", "days").replace("hour", "day")
    broken = ITEM.replace("120 miles", "120 km")  # one unit stands for two
    mixed = "so " + ITEM.upper().lower() + " he said"
    texts = [None, "", ITEM, "He asked: " + changed + " Then they left.", OTHER, mixed, "words of no interest " * 30,
             ITEM[:60], broken]
    rows = [(k, t, "x", 0, 0, "y", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, ITEM, "", 0, 0, "", 0)], SCHEMA)
    items = spark.createDataFrame(
        [(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "too short"), (None, ITEM)], "item_id long, text string")
    found = decontamination.find_contamination(docs, items).collect()
    hits = {(r["doc_id"], r["item_id"]) for r in found}
    assert {(2, 1), (3, 1), (4, 2)} <= hits and not {k for k, _ in hits} & {0, 1, 6, 7}
    assert all(i == 1 or k == 4 for k, i in hits)
    assert next(r for r in found if r["doc_id"] == 3)["consistency"] == 1.0
    assert decontamination.find_contamination(empty, items).count() == 0
    assert decontamination.find_contamination(docs, items.limit(0)).count() == 0


def test_inconsistent_slots_are_no_question_with_new_parameters(spark):
    item = "from town 5 to town 5 and back to town 5 over the hill and down to town 5 by noon"
    turns = iter("6 7 8 9".split())
    doc = re.sub("5", lambda _: next(turns), item)
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    items = frame([(1, item)], "item_id long, text string")
    docs = frame([(1, doc), (2, item.replace("5", "8"))], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.find_contamination(docs, items).collect()] == [2]


def test_item_is_found_with_a_word_more_or_less(spark):
    words = [f"w{k}" for k in "abcdefghijklmnopqrstuvwxyzéüñø"]
    item = " ".join([*words[:15], "Tom", *words[16:]])
    texts = [item.replace("Tom", "Mary Jane"), " ".join([*words[:15], *words[16:]]),
             " ".join([*words[:15], "Tom", "and", *words[16:]]), "so on " + item + " and on",
             " ".join([*words[16:], "Tom", *words[:15]]),  # not in order
             " ".join([*words[:15], *["far"] * 40, *words[16:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.find_contamination(docs, items).collect()}
    assert set(found) == {0, 1, 2, 3}
    assert [found[k]["matched"] for k in (0, 1, 3)] == [17, 15, 23]
    assert found[0]["consistency"] == 1.0 and (found[0]["first_word"], found[0]["end_word"]) == (0, 31)
    made, doc = decontamination.Items([(1, item)]), decontamination.Items([(0, texts[0])])
    path = [(k, k) for k in range(9)] + [(k + 1, k) for k in range(15, 23)]
    assert made._slots(0, path, doc.tokens[0], doc.words[0]) == {b"tom": {b"mary jane": 1}}


def test_items_are_found_in_any_case(spark):
    items = [ITEM, OTHER, "Élise and Ødegård Met In Zürich On A Monday. Then Äpfel und große Öl: ΣΟΦΙΑ Говорит"]
    texts = [case(x) for x in items for case in (str, str.lower, str.upper, str.title)]
    texts += ["The Train Of Nine Was Late And Nobody Knew", " ".join("Aa Bb Cc Dd Ee Ff Gg Hh Ii Jj".split() * 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontamination.find_contamination(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k // 4) for k in range(12)}
    assert all(r["coverage"] == r["consistency"] == 1.0 for r in found)
    # In lower case and with another number at once
    docs = spark.createDataFrame([(1, ITEM.lower().replace("120", "455"))], "doc_id long, text string")
    assert [r["coverage"] for r in decontamination.find_contamination(docs, bench).collect()] == [14 / 16]


def test_benchmark_in_parts_gives_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, TEXTS[k]) for k in range(7, 31)], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.find_contamination(docs, items).collect()))
    monkeypatch.setattr(decontamination, "PART_WINDOWS", 300)
    assert sorted(map(tuple, decontamination.find_contamination(docs, items).collect())) == whole
    assert {(k, k) for k in range(7, 31)} <= {r[:2] for r in whole}



def _plain_matches(text, item):
    """Places (start in the text, at in the item) where windows agree in one of their forms, word by word."""
    strip = "".join(chr(k) for k in range(33, 127) if not chr(k).isalnum())

    def forms(t):
        words = (t or "").split()
        bare = [w.strip(strip) or w[-1] for w in words]
        low = [b.casefold() for b in bare]
        blind = [
            "#" if any(c.isdigit() for c in b) else "U" if lo in decontamination.UNITS else ("w", lo)
            for b, lo in zip(bare, low)
        ]
        named = ["N" if b[0].isupper() and x != "#" else x for b, x in zip(bare, blind)]
        out = []
        for k in range(len(words) - 7):
            literal = sum(isinstance(x, tuple) for x in blind[k:k + 8]) >= 4
            found = {tuple(blind[k:k + 8]) if literal else ("exact", *low[k:k + 8])}
            if sum(isinstance(x, tuple) for x in named[k:k + 8]) >= 4:
                found.add(tuple(named[k:k + 8]))
            out.append(found)
        return out, low, named

    (doc, low, _), (own, values, tokens) = forms(text), forms(item)
    pairs = [(s, a) for s, x in enumerate(doc) for a, y in enumerate(own) if x & y]
    sure = possible = False
    for shift in {s - a for s, a in pairs}:
        path = [(s, a) for s, a in pairs if s - a == shift]
        if len(path) >= decontamination.COVERAGE * len(own):
            slots = {}
            for k in sorted({a + j for _, a in path for j in range(8)}):
                if not isinstance(tokens[k], tuple):
                    slots.setdefault(values[k], Counter())[low[k + shift]] += 1
            total = sum(sum(c.values()) for c in slots.values())
            same = sum(max(c.values()) for c in slots.values())
            sure |= not total or same / total >= decontamination.CONSISTENCY
    chain = []
    for s, a in pairs:
        chain.append(1 + max((n for n, (x, y) in zip(chain, pairs)
                              if x < s and y < a and abs((x - y) - (s - a)) <= decontamination.SHIFT), default=0))
    possible = bool(chain) and max(chain) >= decontamination.COVERAGE * len(own)
    return sure, possible


def test_contamination_lies_between_plain_versions(spark):
    """All that one diagonal alone shows word by word is found, and nothing whose longest chain of equal
    windows, by comparing all pairs, is too short; copies and far texts fall on either side."""
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu", "me") for b in ("na", "lo", "ve", "shi", "dor", "pa")]
    filler = lambda: rng.choice([rng.choice(plain)] * 6 + [str(rng.randint(1, 99)), rng.choice(("Tom", "Ann", "Bo")), "kg"])
    items = {k: " ".join(filler() for _ in range(rng.randint(8, 40))) for k in range(25)}
    docs = {}
    for k in range(160):
        words = items[rng.randrange(25)].split()
        kind = rng.randrange(5)
        if kind == 1:
            words = words[:rng.randint(1, len(words))]
        elif kind == 2:
            swap = {w: str(rng.randint(100, 999)) for w in words if w.isdigit()} | {"Tom": "Eve", "Ann": "Kim", "Bo": "Al"}
            words = [swap.get(w, w) for w in words]
        elif kind == 3:
            words = [filler() if rng.random() < 0.12 else w for w in words]
        elif kind == 4:
            words = [w for w in words if rng.random() > 0.06]
        docs[k] = " ".join([filler() for _ in range(rng.randint(0, 15))] + words + [filler() for _ in range(rng.randint(0, 15))])
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(frame, bench).collect()}
    verdicts = {(d, i): _plain_matches(docs[d], items[i]) for d in docs for i in items}
    sure = {k for k, (x, _) in verdicts.items() if x}
    possible = {k for k, (_, y) in verdicts.items() if y}
    assert len(sure) > 60 and len(verdicts) - len(possible) > 3000
    assert sure <= found <= possible


def test_clean_rows_stay_by_their_own_text(spark, monkeypatch):
    """Also where ids repeat or lack; the same in one part of the benchmark and in many."""
    item = "a train leaves the station at 9 and drives 60 miles in one hour to Paris"
    rows = [(1, item, "x"), (1, "something clean", "y"), (None, f"so {item} ok", "z"), (None, None, None),
            (2, "clean too " * 50, None), (2, item.upper(), "c"), (3, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, f"{w} {item}") for k, w in enumerate(("if", "when", "as"))], "item_id long, text string")
    want = sorted((rows[k] for k in (1, 3, 4, 6)), key=repr)
    for size in (decontamination.PART_WINDOWS, 1):
        monkeypatch.setattr(decontamination, "PART_WINDOWS", size)
        left = decontamination.drop_contaminated(docs, bench)
        assert left.schema == docs.schema
        assert sorted(map(tuple, left.collect()), key=repr) == want
        found = decontamination.find_contamination(docs, bench).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(d, i) for d in (1, 2) for i in range(3)]
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


# ---- 9 ----------------------------------------------------------------------------------------


def _near(texts, k, percent):
    sets = {}
    for at, t in texts.items():
        w = [_lower(x) for x in _words(t)]
        sets[at] = {tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {at: at for at in texts}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {at: (len(sets[at]), find(at)) for at in texts}


@pytest.mark.parametrize("k, percent, symbols", [(3, 85, 40), (5, 80, 48)])
@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_equal_brute_force(docs, monkeypatch, k, percent, symbols, small):
    if small:  # large buckets and blocks, on a small table
        monkeypatch.setattr(near_dedup, "BUCKET", 2)
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    rows = near_dedup.near_duplicates(docs, shingle=k, percent=percent, symbols=symbols).collect()
    want = _near(dict(enumerate(TEXTS)), k, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert len(rows) == len(TEXTS)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


# ---- 10 ---------------------------------------------------------------------------------------


def _toxic_corpus(n):
    rng = random.Random(4)
    plain = [a + b + c for a in ("th", "er", "on") for b in ("an", "in", "es", "or") for c in ("ed", "ly", "s", "")]
    bad = ["grumbleface", "slimebrain", "rotskull"]
    rows = []
    for k in range(n):
        words = rng.choices(plain, k=rng.randint(30, 90))
        toxic = k % 5 == 0
        for at in rng.sample(range(len(words)), 4) if toxic else ():
            words[at] = rng.choice(bad)
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out(spark):
    rows = _toxic_corpus(600)
    model = rows[:400]
    docs = spark.createDataFrame([(k, t, "y") for k, (t, _) in enumerate(rows[400:])], "doc_id long, text string, score string")
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, model).collect()}
    right = [(found[k] >= 0.3) == bool(y) for k, (_, y) in enumerate(rows[400:])]
    assert len(found) == 200 and all(0 <= s <= 1 for s in found.values()) and np.mean(right) > 0.95
    kept = toxicity.drop_toxic(docs, model, 0.3)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, s in found.items() if s < 0.3}


def test_toxicity_without_labels_and_of_odd_texts(spark, docs, empty):
    assert {r["score"] for r in toxicity.toxicity_scores(docs, []).collect()} == {0.0}
    assert {r["score"] for r in toxicity.toxicity_scores(docs, [("a", 1)]).collect()} == {0.0}
    scores = toxicity.toxicity_scores(docs, _toxic_corpus(60)).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.toxicity_scores(empty, _toxic_corpus(60)).count() == 0


def test_labelled_sample_is_bounded_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 3)
    monkeypatch.setattr(toxicity, "SAMPLE_ORDINARY", 4)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)] + [(1, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(k, 1, k % 2) for k in range(60)] + [(4, 0, 0), (5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels)
    assert Counter(y for _, y in sample) == {1: 3, 0: 4}
    assert sample == toxicity.labelled_sample(docs.repartition(3), labels.repartition(2))
    assert all(int(t.split()[1]) % 2 == y for t, y in sample)
