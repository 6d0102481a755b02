"""Hierarchical clusters and communities in rounds against their plain forms on one machine."""

import numpy as np
import pytest

from quillstone.operators import clustering, graph, hierarchy


def frame(spark, X, keys=None):
    keys = range(len(X)) if keys is None else keys
    rows = [(int(k), [float(v) for v in x], 7) for k, x in zip(keys, X)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int").repartition(3)


def partition(labels):
    return np.unique(np.asarray(labels), return_inverse=True)[1].tolist()


def found(df):
    return [r.cluster for r in df.orderBy("vec_id").collect()]


def blobs(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width)) * 2
    X = centres[rng.integers(0, 7, n)] + rng.normal(size=(n, width)) * 0.4
    X[5], X[9] = X[2], X[2]  # copies
    X[11] = 0  # like no other by cosine
    return X


def reach(metric):
    return {"cosine": 0.05, "euclidean": 0.9}[metric]


@pytest.mark.parametrize("metric,linkage", sorted(hierarchy.OFFERED - {("cosine", "single"), ("euclidean", "single")}))
def test_mutual_pairs_make_the_same_tree(metric, linkage):
    """2,000 rows: the rounds that one task takes to the end, against merging the nearest two over and over."""
    X = blobs(2000, 6, 1)
    D = clustering.distances(X, metric)
    means = hierarchy.unit(X) if metric == "cosine" else X
    for count, until in ((9, None),) if linkage == "ward" else ((None, 4 * reach(metric)),):
        merges = hierarchy.merge_locally(np.arange(2000), np.ones(2000), means, np.zeros(2000), metric, linkage, until or np.inf)
        if count:
            merges = sorted(merges, key=lambda m: (m[2], m[3]))[: len(merges) - count + 1]
        own = np.arange(2000)
        for a, b, *_ in sorted(merges, key=lambda m: m[3]):
            own[own == b] = a
        assert partition(own) == clustering.link(D, linkage, n_clusters=count, distance_threshold=until).tolist()


@pytest.mark.parametrize("metric,linkage", sorted(hierarchy.OFFERED))
def test_trees_in_rounds_and_blocks(spark, monkeypatch, metric, linkage):
    monkeypatch.setattr(hierarchy, "LOCAL", 90)
    monkeypatch.setattr(hierarchy, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(hierarchy, "TILE", 50)
    X = blobs(150, 5, 2)
    df, D = frame(spark, X), clustering.distances(X, metric)
    kind = {"n_clusters": 5} if linkage == "average" or (metric, linkage) == ("euclidean", "single") else {"distance_threshold": reach(metric)}
    assert found(clustering.agglomerative(df, metric=metric, linkage=linkage, **kind)) == clustering.link(D, linkage, **kind).tolist()


def test_narrow_vectors_are_dealt_over_all_cores():
    """100,000 vectors of 64 numbers filled four blocks by their bytes, ten tasks; more cores have more pairs of blocks."""
    many = hierarchy.blocks_of(100_000, 64, 12)
    assert many * (many + 1) // 2 >= 36 and hierarchy.blocks_of(100, 64, 12) == 1


@pytest.mark.parametrize("metric,linkage", [("cosine", "average"), ("euclidean", "ward")])
def test_a_block_of_clusters_merges_without_all_distances(metric, linkage):
    X = blobs(700, 6, 3)
    X = hierarchy.unit(X) if metric == "cosine" else X
    for until in (np.inf, 2 * reach(metric)):
        rows = np.arange(700), np.ones(700), X, np.zeros(700), metric, linkage, until
        trees = [{(a, b, round(h, 9)) for a, b, h, _ in f(*rows)} for f in (hierarchy.merge_locally, hierarchy.merge_in_block)]
        assert trees[0] == trees[1]


@pytest.mark.parametrize("metric,linkage", sorted(hierarchy.OFFERED))
@pytest.mark.parametrize("far", [1.0, 1e25, 1e-25])
def test_nearest_by_rough_distances_are_the_exact_ones(metric, linkage, far):
    """Single precision only leaves pairs out: copies, ties, long offsets and lengths beyond it included. Few pairs are measured twice."""
    rng = np.random.default_rng(4)
    X = np.concatenate((blobs(500, 16, 6), blobs(300, 16, 6)[:200]))
    X = hierarchy.unit(X) if metric == "cosine" else (X + 50) * far
    size = rng.integers(1, 9, len(X)) if linkage == "ward" else np.ones(len(X), np.int64)
    D = hierarchy.gaps(X, size, X, size, metric, linkage)
    np.fill_diagonal(D, np.inf)
    until = float(np.quantile(D.min(1), 0.7))
    rough = hierarchy.Rough(X, size, X, size, metric, linkage)
    own = np.arange(100, 300)
    tile = rough.tile(own)
    tile[np.arange(len(own)), own] = np.inf
    for axis, exact in ((1, D[own]), (0, D[own].T)):
        for most in (np.inf, until):
            place, gap = rough.leasts(tile, own, axis, most)
            told = exact.min(1) < most
            assert np.allclose(gap[told], exact.min(1)[told], rtol=1e-9, atol=1e-6 * far)
            assert np.allclose(exact[np.arange(len(exact)), place][told], exact.min(1)[told], rtol=1e-9, atol=1e-6 * far)
    assert tile.dtype == np.float32


def test_trees_of_few_rows(spark):
    one = frame(spark, [[1.0, 2.0]], [4])
    assert found(clustering.agglomerative(one, n_clusters=1)) == [0]
    assert clustering.agglomerative(one.limit(0), n_clusters=2).collect() == []
    same = frame(spark, [[1.0, 0.0]] * 5 + [[0.0, 1.0]], [10, 11, 12, 13, 14, 3])
    assert found(clustering.agglomerative(same, distance_threshold=0.5)) == [0, 1, 1, 1, 1, 1]
    assert found(clustering.agglomerative(same, n_clusters=20)) == list(range(6))
    with pytest.raises(ValueError):
        clustering.agglomerative(same, n_clusters=2, linkage="complete", most=4)


@pytest.mark.parametrize("threshold,least", [(0.55, 3), (0.9, 1), (0.9, 3)])
def test_communities_in_rounds(spark, monkeypatch, least, threshold):
    monkeypatch.setattr(hierarchy, "LOCAL", 0)
    monkeypatch.setattr(hierarchy, "BLOCK_BYTES", 2000)
    rng = np.random.default_rng(int(least * 10 + threshold * 100))
    X = rng.normal(size=(160, 3))
    X[20:40] = X[:20]  # ties
    X[50] = 0
    expected = clustering.communities(X, threshold, least).tolist()
    got = clustering.community_detection(frame(spark, X), threshold, least)
    assert found(got) == expected


@pytest.mark.parametrize("deciding,pairs", [(7, 4_000_000), (50, 30), (4096, 1)])
def test_communities_by_few_rows_at_a_time(spark, monkeypatch, deciding, pairs):
    """Few rows decide in a round, few pairs go to a task, and rows with more neighbours than that decide by themselves."""
    for name, value in (("LOCAL", 0), ("BLOCK_BYTES", 2000), ("DECIDING", deciding), ("PAIRS", pairs)):
        monkeypatch.setattr(hierarchy, name, value)
    X = np.random.default_rng(3).normal(size=(60, 3))
    X[20:30] = X[:10]
    assert found(clustering.community_detection(frame(spark, X), 0.8, 3)) == clustering.communities(X, 0.8, 3).tolist()


def test_numbers_and_components(spark):
    rng = np.random.default_rng(4)
    values = rng.permutation(1000).tolist()
    df = spark.createDataFrame([(v, str(v)) for v in values], "v long, s string").repartition(5)
    assert [(r.v, r.s, r.i) for r in graph.numbered(df, ["v"], "i").collect() if r.v != r.i or r.s != str(r.v)] == []
    edges = rng.integers(0, 300, (220, 2)).tolist() + [[k, k + 1] for k in range(1000, 1100)]
    own = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            own[a] = own[b] = min(own[a], own[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in own.items() if x in got} and {x for e in edges for x in e if e[0] != e[1]} == set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
