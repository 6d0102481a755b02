"""Winnowing, whitening and ranked search against plain versions, and near copies under repeated ids."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

jaccard_join = pytest.importorskip("quillstone.llm.jaccard_join")
from quillstone.llm import lexical_search, whitening, winnowing  # noqa: E402

LOW = {c: c + 32 for c in range(65, 91)}


# -- winnowing ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    """{(place, hash)} of every window's smallest, rightmost hash."""
    if not text:
        return []
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]{1,16}", text.replace("K", "ĸ").lower()) or [text]
    hashes = []
    for i in range(max(1, len(words) - winnowing.K + 1)):
        h = 42
        for w in words[i : i + winnowing.K]:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        hashes.append(h - (1 << 64) if h >> 63 else h)
    wide, chosen = min(winnowing.W, len(hashes)), set()
    for s in range(len(hashes) - wide + 1):
        i = -min((hashes[i] >> 31, -i) for i in range(s, s + wide))[1]
        chosen.add((i, hashes[i] >> 32 & 0xFFFFFFFF))
    return sorted(chosen)


def as_text(found):
    return "".join(f"{h:08x}{i - (found[k - 1][0] if k else 0):x}" for k, (i, h) in enumerate(found))


def alike(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def odd_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß漢😀") for _ in range(rng.randrange(1, 5)))
    texts = [None, "", " ", "!?", "one", "Two words", "a b c d", "a b c d e f g h i j", "same " * 300, "x" * 1000, "KK İstanbul 7", "漢字" * 40]
    texts += [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(30)]
    return [*texts, " ".join(word() for _ in range(20_000))]


def test_fingerprints_of_odd_texts(spark):
    texts = odd_texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[20], "y", 2), (3, texts[21], "y", 2), (3, texts[21], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string, h int")
    hashed = lambda t: xxhash.xxh64((t or "").encode(), seed=42).intdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(hashed(r[1]))))
    expected = []
    for k, (i, text, *_) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, new, other = map(plain_fingerprint, (text, changed, following))
        digest = hashlib.sha256(changed.encode()).hexdigest()
        expected.append((i, len(text), digest, as_text(own), as_text(new), alike(own, new), alike(own, other)))
    for many in (1, 5):  # one run of neighbours, and runs that hand their first rows on
        got = [tuple(r) for r in winnowing.edited(docs.repartition(many)).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert winnowing.edited(docs.limit(0)).collect() == []
    alone = winnowing.edited(docs.filter("doc_id = 7")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b c d e a b c d e").hexdigest()
    places = {r.doc_id: [tuple(e) for e in r.fingerprint] for r in winnowing.fingerprints(docs.filter("bucket = 'x'")).collect()}
    assert places == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_shared_runs_share_a_fingerprint():
    """K + W - 1 words in a row, wherever they stand, give both texts one choice at least; fewer than K give none."""
    rng = random.Random(7)
    for _ in range(200):
        run = [f"r{rng.randrange(1000)}" for _ in range(winnowing.K + winnowing.W - 1)]
        around = lambda x: [f"{x}{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
        a, b = (" ".join(around(x) + run + around(x)) for x in "ab")
        assert {h for _, h in plain_fingerprint(a)} & {h for _, h in plain_fingerprint(b)}
        short = run[: winnowing.K - 1]
        a, b = (" ".join([*around(x), "c" + x, *short, "d" + x, *around(x)]) for x in "ab")
        assert not {h for _, h in plain_fingerprint(a)} & {h for _, h in plain_fingerprint(b)}


# -- whitening ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 300, 1 << 30, 1 << 62])
def test_limb_products_are_exact(most):
    rng = np.random.default_rng(most % 97)
    x = rng.integers(-most, most + 1, (9000 if most < 1000 else 40, 5))
    x[:4] = [[most] * 5, [-most] * 5, [0] * 5, [most, -most, 1, -1, 0]]
    n, sums = len(x), [int(v) for v in x.astype(object).sum(0)]
    exact = x.astype(object) * n - np.array(sums, object)
    y = whitening.centred(x, n, sums)
    assert (y == exact).all() and (whitening.gram(y) == exact.T @ exact).all()


def test_whitening_against_a_plain_version(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) / 4).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(vectors)]
    rows += [(1000 + i, [float(c) for c in vectors[0]], 1) for i in range(200)]  # copies count once
    rows += [(2000, None, 1), (2001, [], 1), (2002, [1.0, None], 1), (2003, [math.inf] * 6, 1), (2004, [math.nan] * 6, 1)]
    rows += [(3000, [2.0], 1), (3001, [0.5], 1), (3002, [0.5], 1), (None, [0.25], 1), (4000, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").withColumn("x", F.lit("clash"))
    got = whitening.whiten(df).collect()
    x = np.floor(256 * vectors.astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    y = [[Fraction(int(v) * n - int(s), n) for v, s in zip(row, sums)] for row in fit]
    V = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(6)] for i in range(6)])
    values, axes = np.linalg.eigh(V)
    values, axes = values[::-1], axes[:, ::-1]
    z = (x - sums / n) @ axes[:, :4] / np.sqrt(values[:4])
    own = {(r.vec_id, r.component): r for r in got if r.n == n}
    assert len(own) == 500 * 4 and len({r.identity_error for r in own.values()}) == 1
    sign = [np.sign(own[0, c + 1].whitened * z[0, c]) for c in range(4)]
    for (i, c), r in own.items():
        k = i if i < 1000 else 0
        assert abs(r.whitened - sign[c - 1] * z[k, c - 1]) < 1e-9 and abs(r.explained - values[c - 1] / np.trace(V)) < 1e-12
        assert r.deviation == sum((int(v) * n - int(s)) ** 2 for v, s in zip(x[k], sums)) and 0 <= r.identity_error < 1e-9
    single = {(r.vec_id, r.component): (r.n, r.deviation, r.explained) for r in got if r.n != n}
    # 512, 128 and 64: n = 3, the sum is 704; the lone vector of two has no component.
    assert single == {(i, 1): (3, (3 * v - 704) ** 2, 1.0) for i, v in ((3000, 512), (3001, 128), (3002, 128), (None, 64))}
    assert whitening.whiten(df.limit(0)).collect() == []


def test_whitening_beyond_longs(spark):
    df = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df, components=1).collect()
    assert {r.vec_id: r.deviation is None for r in rows} == {1: True, 2: True, 3: False}
    assert all(abs(abs(r.whitened) - (0 if r.vec_id == 3 else math.sqrt(1.5))) < 1e-9 for r in rows)


# -- ranked search -----------------------------------------------------------------------------------


def plain_search(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    held = [(i, terms(t)) for i, t in docs]
    N, L = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, t in held:
            if t:
                m = 50 + 50 * len(t) * N // L
                score = sum(
                    math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 20 * m)) for w in set(terms(text)) & set(t)
                )
                if score > 0:
                    scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def search_tables(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["Été", "straße", "漢字", "A1"]
    text = lambda most: "-".join(rng.choice(words) for _ in range(rng.randrange(1, most)))
    docs = [(i, text(30)) for i in range(150)] + [(200 + i, "w1 w2 W2 a1") for i in range(70)]  # ties beyond the limit
    docs += [(300, None), (301, ""), (302, "?!"), (303, text(20_000)), (303, "w3"), (None, "w3 w4"), (5, docs[5][1])]
    items = [(i, text(12)) for i in range(12)] + [(20, None), (21, ""), (22, "..."), (23, "unknown"), (24, "W1 w1 w2"), (24, "w3"), (None, "w5")]
    make = lambda rows, key: spark.createDataFrame([(*r, "z") for r in rows], f"{key} long, text string, term string")
    return docs, items, make(docs, "doc_id"), make(items, "item_id")


def test_search_against_a_plain_version(spark, monkeypatch):
    docs, items, documents, benchmark = search_tables(spark)
    expected = plain_search(docs, items)
    schema = [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    found = lexical_search.search(documents.repartition(3), benchmark)
    assert found.dtypes == schema and sorted(map(tuple, found.collect()), key=str) == expected
    # Blocks of a few documents, and items in several groups.
    monkeypatch.setattr(lexical_search, "BLOCK", 600)
    monkeypatch.setattr(lexical_search, "ITEMS", 7)
    parts = lexical_search.search(documents.repartition(2), benchmark)
    assert sorted(map(tuple, parts.collect()), key=str) == expected
    for a, b in ((documents.limit(0), benchmark), (documents, benchmark.limit(0)), (documents.filter("text = '?!'"), benchmark)):
        assert lexical_search.search(a, b).collect() == [] and lexical_search.search(a, b).dtypes == schema


def test_terms_as_often_as_they_stand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a a b")], "item_id long, text string")
    once, often = ({r.doc_id: r.score for r in lexical_search.search(docs, item, once=x).collect()} for x in (True, False))
    assert once[2] == often[2] and often[1] > once[1]


# -- near copies under repeated ids ------------------------------------------------------------------


@pytest.mark.parametrize("most", [0, 1000])
def test_rows_of_one_id_stay_by_their_own_texts(spark, monkeypatch, most):
    """(2, A) is a copy of (1, A); (2, B) is a copy of nothing. Keys are joined with the texts either way."""
    monkeypatch.setattr(jaccard_join, "BROADCAST", most)
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, c), (4, None), (None, a), (5, b), (2, None)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(docs, 5, Fraction(4, 5)).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (3, c), (3, c), (4, None), (None, a), (2, None)], key=str)
