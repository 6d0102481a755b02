"""Near-duplicate operators, archives and the pipeline against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import embedding_dedup, jaccard_join, warc
from quillstone.llm._components import components
from quillstone.llm._text import Words, shingle_sets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(shape)
    n = 300
    ids = list(range(n))
    rng.shuffle(ids)
    pairs = {
        "path": list(zip(ids, ids[1:150])),
        "star": [(ids[0], x) for x in ids[1:200]],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(200)],
        "none": [],
    }[shape]
    df = spark.createDataFrame(pairs + pairs[:3] + [(b, a) for a, b in pairs[:5]], "a long, b long").repartition(4)
    got = {r.node: r.component for r in components(df).collect()}
    expected = union(n, pairs)
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: expected[x] for x in touched}


def near_texts(seed=1, n=120):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice((2, 3, 5, 12, 40, 150)))] for _ in range(n // 6)]
    texts = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(rng.choice((" ", "  ", "\n")).join(t).upper() if rng.random() < 0.2 else " ".join(t))
    return texts + [None, "", " \n", "one", "One", "one two", "a b c", "a b c"]


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append(frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    return out


def brute_links(sets, threshold=Fraction(9, 10)):
    near = lambda a, b: threshold.denominator * len(a & b) >= threshold.numerator * len(a | b)
    return [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and near(sets[a], sets[b])]


@pytest.mark.parametrize("seed", range(4))
def test_local_join_finds_all_links(seed):
    texts = near_texts(seed)
    sets = shingle_sets(Words(pa.array(texts)), 3)
    keep = [i for i, s in enumerate(sets) if len(s)]
    links = {tuple(sorted((keep[a], keep[b]))) for a, b in jaccard_join.join_sets([sets[i] for i in keep], Fraction(9, 10))}
    assert links == set(brute_links(sets_of(texts)))
    half = len(keep) // 2
    cross = {tuple(sorted((keep[a], keep[b]))) for a, b in jaccard_join.join_sets([sets[i] for i in keep], Fraction(9, 10), half)}
    place = {k: i for i, k in enumerate(keep)}
    assert cross == {(a, b) for a, b in links if (place[a] < half) != (place[b] < half)}


@pytest.mark.parametrize("threshold", [Fraction(9, 10), Fraction(4, 5)])
def test_linked_sets_share_a_signature_of_either_kind(threshold):
    rng = np.random.default_rng(5)
    kinds = jaccard_join.Order(rng.integers(0, 50, 1 << jaccard_join.BITS), threshold), jaccard_join.Parts(threshold)
    for n in [*range(1, 60), 99, 100, 101, 300, 1000]:
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(4):
            drop, add = rng.integers(0, n // 5 + 1, 2)
            t = np.unique(np.concatenate((rng.permutation(s)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
            inter = len(np.intersect1d(s, t))
            if len(t) and inter >= threshold * (len(s) + len(t) - inter) and inter < max(len(s), len(t)):
                for of in kinds:
                    assert set(of(s).tolist()) & set(of(t).tolist())


@pytest.mark.parametrize("threshold", [Fraction(9, 10), Fraction(4, 5)])
def test_candidate_groups_hold_all_links(spark, threshold):
    """Over all texts, and then over the sets of one group by the other signatures."""
    texts = near_texts(3, 300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = shingle_sets(Words(pa.array(texts)), 3)
    nodes = [jaccard_join.node_of(s) for s in found]
    links = [(a, b) for a, b in brute_links(sets_of(texts), threshold) if nodes[a] != nodes[b]]
    rows = {n: (7, n, len(s), s.tobytes()) for n, s in zip(nodes, found) if len(s)}
    sets = spark.createDataFrame(list(rows.values()), "comp long, node long, size long, shingles binary").repartition(3)
    for groups in (jaccard_join.candidate_groups(df, 3, threshold), jaccard_join.parted(sets, threshold)):
        group = {r.node: r.component for r in groups.collect()}
        assert len(links) > 40 and all(group[nodes[a]] == group[nodes[b]] for a, b in links)
        assert len(set(group.values())) > 5


def test_shared_passages_do_not_chain_texts_when_shingles_outgrow_the_table(spark, monkeypatch):
    """Texts of 40 words of their own and two of twenty passages: the table of counts grows until passages stand out."""
    monkeypatch.setattr(jaccard_join, "BITS", 4)
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(0, 1 << 40)}"
    passages = [[word() for _ in range(12)] for _ in range(20)]
    texts = []
    for _ in range(300):
        a, b = rng.choice(20, 2, replace=False)
        texts.append(" ".join([*passages[a], *[word() for _ in range(40)], *passages[b]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def largest():
        sizes = jaccard_join.candidate_groups(df, 3, Fraction(4, 5), 300 * 62).groupBy("component").count().collect()
        return max((r["count"] for r in sizes), default=0)

    assert largest() < 30
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 4)  # a table that stays small
    assert largest() > 100


def test_sketches_lose_no_link_and_part_what_a_loaded_table_chains(spark, monkeypatch):
    """The same chains of texts that share passages: no set of theirs is sent, as their sketches differ by more than links let them."""
    rng = np.random.default_rng(5)
    for threshold in (Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)):
        sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) for n in (3, 8, 31, 64, 200, 255, 256, 700)]
        sets += [np.unique(rng.permutation(s)[: max(1, int(len(s) * share))]) for s in sets for share in (0.97, 0.91, 0.81, 0.6)]
        sets.append(np.arange(2000, dtype=np.uint64))  # all in one range
        sets.append(np.arange(1900, dtype=np.uint64))
        both = lambda a, b: len(np.intersect1d(a, b))
        links = {(i, j) for i in range(len(sets)) for j in range(i) if (n := both(sets[i], sets[j])) >= threshold * (len(sets[i]) + len(sets[j]) - n)}
        sketches = [np.frombuffer(jaccard_join.sketch_of(s), np.uint8) for s in sets]
        for split in (None, len(sets) // 2):
            found = {(max(x), min(x)) for x in jaccard_join.may_link(sketches, threshold, split)}
            assert {x for x in links if split is None or (x[0] < split) != (x[1] < split)} <= found
    monkeypatch.setattr(jaccard_join, "BITS", 4)
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 4)
    monkeypatch.setattr(jaccard_join, "SKETCH_BLOCK", 50)
    word = lambda: f"w{rng.integers(0, 1 << 40)}"
    passages = [[word() for _ in range(12)] for _ in range(20)]
    texts = []
    for _ in range(300):
        a, b = rng.choice(20, 2, replace=False)
        texts.append(" ".join([*passages[a], *[word() for _ in range(40)], *passages[b]]))
    texts.append(texts[7] + " x")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes = jaccard_join._node_rows(df, 3).cache()
    wanted = jaccard_join.candidate_groups(df, 3, Fraction(4, 5)).join(nodes, "node").selectExpr("key", "node", "component AS comp", "n_shingles AS size")
    assert wanted.count() > 100
    left = jaccard_join.by_sketches(df, wanted, 3, Fraction(4, 5)).join(nodes.select("node", "doc_id"), "node")
    found = {r.doc_id for r in left.collect()}
    assert found >= {7, 300} and len(found) < 30
    assert [r.doc_id for r in jaccard_join.keep_one(df, 3, Fraction(4, 5)).orderBy("doc_id").collect()] == list(range(300))


@pytest.mark.parametrize(("block", "threshold"), [(1024, Fraction(9, 10)), (4, Fraction(9, 10)), (4, Fraction(4, 5))])
def test_jaccard_components(spark, monkeypatch, block, threshold):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = near_texts(7)
    sets = sets_of(texts)
    expected = union(len(texts), brute_links(sets, threshold))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 3, threshold).collect()}
    assert got == {i: (len(s), expected[i]) for i, s in enumerate(sets)}
    if block > 4:
        kept = jaccard_join.keep_one(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if expected[i] == i]
        assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (4, text), (4, text + " x"), (2, "other words here"), (None, "alone with no id")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_join.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string"),
    ).collect())
    assert got == sorted([("None", "4"), ("4", "4"), ("4", "4"), ("2", "2"), ("None", "None")])


def test_jaccard_of_rows_without_ids_and_with_repeated_ones(spark, monkeypatch):
    """Ids are null or all the same: every text still stands for itself, and no row meets all others."""
    monkeypatch.setattr(jaccard_join, "HEAVY", 4)
    texts = near_texts(11, 150)
    sets = sets_of(texts)
    sizes = sorted(len(s) for s in sets)
    for same in (None, 7):
        df = spark.createDataFrame([(same, t) for t in texts], "doc_id long, text string").repartition(3)
        got = jaccard_join.jaccard_components(df).collect()
        assert sorted(r.n_shingles for r in got) == sizes and {r.component_id for r in got} == {same}
    # Every text twice, under two ids: components are those of the texts.
    df = spark.createDataFrame([(i + 1000 * k, t) for i, t in enumerate(texts) for k in (0, 1)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    expected = union(len(texts), brute_links(sets))
    assert got == {i + 1000 * k: expected[i] if sets[i] else i + 1000 * k for i in range(len(texts)) for k in (0, 1)}


def test_jaccard_of_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long), (2, long + " more"), (3, long[: len(long) // 2]), (4, "w1 w2 w3")]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


# -- embeddings -------------------------------------------------------------------------------------


def brute_cosine(rows, threshold=0.93):
    good, n = {}, len(rows)
    for i, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, float) / np.abs(v).max()
            good[i] = v / np.linalg.norm(v)
    pairs = [(a, b) for b in good for a in good if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and float(good[a] @ good[b]) >= threshold]
    links = [0] * n
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, union(n, pairs)


@pytest.mark.parametrize("reach", [1.0, 0.7])
def test_embedding_links(spark, reach):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        c = centres[rng.integers(12)] if i % 3 else rng.normal(size=16)
        rows.append((i, [float(x) for x in c + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25, 0.4])], int(rng.integers(3))))
    rows += [
        (400, None, 1),
        (401, [0.0] * 16, 1),
        (402, [float("nan")] * 16, 1),
        (403, rows[1][1], None),
        (404, [None] + [1.0] * 15, 1),
        (405, [float("inf")] * 16, 1),
        (406, [], 1),
    ]
    rows += [(410 + k, rows[1][1], rows[1][2]) for k in range(20)]
    links, groups = brute_cosine(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, point int")
    exact = spark.createDataFrame(
        [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, l) for i, v, l in rows],
        "vec_id long, embedding array<double>, label int",
    )
    got = {r.vec_id: r for r in embedding_dedup.cosine_links(exact if reach == 1 else df, reach=reach, per_cell=40).collect()}
    assert len(got) == len(rows)
    found = sum(got[r[0]].n_links for r in rows)
    if reach == 1:
        assert [got[r[0]].n_links for r in rows] == links
        assert [got[r[0]].component_id for r in rows] == [rows[g][0] for g in groups]
    else:
        assert 0.9 * sum(links) <= found <= sum(links) + 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.cosine_links(df.limit(0)).count() == 0


def near_vectors(n, width, groups, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    X = centres[rng.integers(groups, size=n)] + rng.normal(size=(n, width)) * spread
    twins = X[rng.integers(n, size=n // 2)]
    return np.concatenate((X, twins + rng.normal(size=twins.shape) * 0.25 * np.linalg.norm(twins, axis=1)[:, None] / width**0.5))


@pytest.mark.parametrize(("width", "groups", "cells"), [(64, 1, 1), (8, 5, 5), (16, 25, 25), (3, 100, 100), (64, 100, 100)])
def test_every_planted_link_is_found_at_any_number_of_cells(width, groups, cells):
    """Recall against brute force is 1, each link counted once, whatever the vectors and the cells."""
    X = embedding_dedup._unit(near_vectors(600, width, groups, cells, 0.6))
    own = embedding_dedup.Cells(embedding_dedup.spherical_kmeans(X, cells) if cells > 1 else np.zeros((1, width)), 0.93, 1.0)
    home, near = own.of(X)
    links = np.zeros(len(X), int)
    for c in range(cells):
        rows = np.flatnonzero(near[:, c])
        for b1, b2 in ((0, 0), (0, 1), (1, 1)):
            some = [i for i in rows if i % 2 in (b1, b2)]
            if len(some):
                frame = embedding_dedup.pd.DataFrame(
                    {
                        "cell": c,
                        "b1": b1,
                        "b2": b2,
                        "block": [i % 2 for i in some],
                        "home": home[some],
                        "cells": [np.flatnonzero(near[i]).astype("<i8").tobytes() for i in some],
                        "point": some,
                        "copies": 1,
                        "unit": [X[i].tobytes() for i in some],
                    },
                )
                out = embedding_dedup.compared(frame, 0.93)
                links[out.a[out.links > 0]] += out.links[out.links > 0]
    expected = (X @ X.T >= 0.93).sum(1) - 1
    assert expected.sum() > 300 and (links == expected).all()


def test_cells_are_as_many_as_part_the_vectors():
    parted = embedding_dedup._unit(near_vectors(3000, 16, 64, 1, 0.05))
    even = embedding_dedup._unit(np.random.default_rng(2).normal(size=(3000, 64)))
    for X, least, most in ((parted, 16, 1024), (even, 1, 16)):
        own = embedding_dedup.fit_cells(X, 1024, 0.93, 1.0, 1.0)
        assert least <= len(own.centres) <= most and own.of(X)[1].sum() < 2 * len(X)


def test_vectors_of_several_lengths_and_sizes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1e-200 * x for x in (1.0, 2.0, 3.0 + i / 50)], 1) for i in range(5)] + [(10 + i, [1e200, 2e200 + i * 1e199], 1) for i in range(3)]
    rows += [(20 + i, rng.normal(size=5).tolist(), 1) for i in range(20)] + [
        (None, rows[0][1], 1),
        (None, None, 1),
        (50, [5e-324, 0.0], 2),
        (51, [1.0, 0.0], 2),
        (52, [1.0, 2.0], None),
    ]
    links, groups = brute_cosine(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(embedding_dedup.cosine_links(df, per_cell=2).collect(), key=str)
    smallest = {}
    for r, g in zip(rows, groups):
        smallest[g] = min((x for x in (smallest.get(g), r[0]) if x is not None), default=None)
    assert [(r.vec_id, r.n_links, r.component_id) for r in got] == sorted(
        ((r[0], n, smallest[g]) for r, n, g in zip(rows, links, groups)),
        key=lambda x: f"Row(vec_id={x[0]}, n_links={x[1]}, component_id={x[2]}",
    )
    empty = df.filter("vec_id is null and embedding is null")
    assert [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.cosine_links(empty).collect()] == [(None, 0, None)]


# -- archives -----------------------------------------------------------------------------------------


def test_archives(spark):
    big, other = "x" * 999 + "é", "<p>" * 500
    rows = [
        (1, "u1", big),
        (2, "u2", big),
        (3, None, big),
        (4, "u4", other),
        (5, "u5", ""),
        (6, "u6", None),
        (7, "u7", "short"),
        (8, "u8", "short"),
        (9, "u\n9", "\x1f\x8b\x08" * 700),
        (10, "u", "\r\n\r\nWARC/1.1\r\n" * 100),
        (3, None, big),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, revisit int").repartition(3)
    archives = warc.write_archives(df)
    for split in (64, 1000, 1 << 20):
        got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(archives, split).collect())
        assert len(got) == len(rows)
        types = {}
        for p, n, t, ref in got:
            types.setdefault(p, []).append((t, ref))
            assert n == len((next(r[2] for r in rows if r[0] == p) or "").encode())
        assert types[1] == [("revisit", 3)] and types[2] == [("revisit", 3)] and sorted(types[3], key=str) == [("response", None), ("revisit", 3)]
        assert all(types[p] == [("response", None)] for p in (4, 5, 6, 7, 8, 9, 10))
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


# -- pipeline -----------------------------------------------------------------------------------------


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts)
    spoken = [i for i in order if any(map(str.isalpha, texts[i]))]
    groups = union(len(spoken), brute_links(sets_of([texts[i] for i in spoken])))
    firsts = {spoken[k] for k, g in enumerate(groups) if g == k}
    assert set(out) <= firsts
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {i for i in firsts if any(x in " ".join(re.findall(r"\w+", texts[i].lower())) for x in items)}
    assert held.isdisjoint(out) and len(firsts - held - set(out)) <= 2
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in out.values():
        assert r.round_trip and ("[SECRET]" in m.decode(r.ids)) == bool(re.search(r"[0-9a-f]{24}|token = ", texts[r.doc_id]))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "benchmark_decontamination", "secret_scan", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns


def test_archives_of_long_records_and_pages_without_ids(spark):
    """Records longer than a range, and than a step of the reader; null ids; every range is a task of its own."""
    rng = random.Random(3)
    noise = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(400_000))
    rows = [(1, "u", noise), (2, "u", noise), (None, "u", noise), (None, "u", "short"), (5, None, noise[:300_000]), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("x")).withColumn("d", F.lit(1))
    archives = warc.write_archives(df.coalesce(1))
    size = archives.first().size
    for split in (20_000, 1 << 20):
        records = warc.read_archives(archives, split)
        assert records.rdd.getNumPartitions() >= min(4, -(-size // split))
        got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in records.collect()), key=str)
        n = len(noise.encode())
        expected = [
            (1, n, "revisit", 2),
            (2, n, "response", None),
            (None, n, "revisit", 2),
            (None, 5, "response", None),
            (5, len(noise[:300_000].encode()), "response", None),
            (None, 0, "response", None),
        ]
        assert got == sorted(expected, key=str)
    digests = {r.payload_digest for r in warc.read_archives(archives).filter("page_id = 1").collect()}
    import hashlib

    assert digests == {hashlib.sha1(noise.encode()).hexdigest()}


def test_stages_of_the_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and no rows: every stage to its end."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    prose = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars > 400").orderBy("doc_id").limit(6).collect()
    t = [r.text for r in prose]
    rows = [
        (1, t[0], "en", None),
        (2, t[0], None, "s"),
        (2, t[0], None, "s"),
        (None, t[0], "en", "s"),
        (3, None, "en", "s"),
        (4, "", "en", "s"),
        (5, "123 456", None, None),
    ]
    rows += [(6, " ".join(t[1:5]) * 8, "de", "s"), (7, t[5], None, None), (7, t[5], None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    for table in ("benchmark",):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    seen, empty, counts = docs, docs.limit(0), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, seen, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        assert stage(spark, empty, str(tmp_path)).collect() == []
        if name != pipeline.STAGES[-1][0]:
            assert seen.columns == docs.columns
            counts.append(sorted((r.doc_id for r in seen.collect()), key=str))
    assert counts[0] == [1, 2, 2, 6, 7, 7, None] and counts[1] == [1, 6, 7, 7, None]
    assert all(r.round_trip for r in seen.collect())


def test_the_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    """Row for row: near copies at 0.8 over five words, benchmark passages out, secrets marked, all else kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.identify_language(spark, docs, sf).collect()
    order = sorted(kept, key=lambda r: r.doc_id)
    sets = []
    for r in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(LOW))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    firsts = [order[k] for k, g in enumerate(union(len(order), links)) if g == k]
    found = pipeline.join_near_copies(spark, pipeline.identify_language(spark, docs, sf), sf)
    assert sorted(r.doc_id for r in found.collect()) == [r.doc_id for r in firsts]
    # Every letter is of a known language, so the first stage keeps them all.
    spoken = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text))}
    assert {r.doc_id for r in kept} == spoken
