"""Isomap on a swiss roll against a plain version with all pairs."""

import numpy as np
import pytest

from quillstone.operators import clustering, hierarchy, isomap


def roll(n, seed):
    rng = np.random.default_rng(seed)
    t, height = 1.5 * np.pi * (1 + 2 * rng.uniform(size=n)), 12 * rng.uniform(size=n)
    return np.stack([t * np.cos(t), height, t * np.sin(t)], axis=1)


def plain_paths(X, k):
    D = np.linalg.norm(X[:, None] - X[None], axis=2)
    G = np.full(D.shape, np.inf)
    for i in range(len(X)):
        near = np.argsort(np.where(np.arange(len(X)) == i, np.inf, D[i]), kind="stable")[:k]
        G[i, near] = D[i, near]
    G = np.minimum(G, G.T)
    np.fill_diagonal(G, 0)
    for m in range(len(X)):
        G = np.minimum(G, G[:, m : m + 1] + G[m : m + 1])
    return G


def residual(G, Y):
    far = np.linalg.norm(Y[:, None] - Y[None], axis=2)
    return 1 - np.corrcoef(G.ravel(), far.ravel())[0, 1] ** 2


def laid_out(spark, X, **options):
    df = spark.createDataFrame([(i, [float(v) for v in x], "n") for i, x in enumerate(X)], "vec_id long, embedding array<double>, id string").repartition(3)
    rows = clustering.reduce_dimensions(df, 2, "isomap", **options).orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(X)))
    return np.array([r.embedding for r in rows])


@pytest.mark.parametrize("n", [120, 300])
def test_swiss_roll(spark, monkeypatch, n):
    monkeypatch.setattr(hierarchy, "BLOCK_BYTES", 4000)
    X = roll(n, n)
    G = plain_paths(X, 8)
    assert np.isfinite(G).all()
    B = G * G
    B = -0.5 * (B - B.mean(0) - B.mean(1)[:, None] + B.mean())
    values, axes = np.linalg.eigh(B)
    exact = axes[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    if n == 120:
        Y = laid_out(spark, X, neighbours=8, landmarks=n)
        assert np.allclose(np.abs(Y), np.abs(exact), atol=1e-6)
    else:
        Y = laid_out(spark, X, neighbours=8, landmarks=40)
        assert residual(G, Y) < residual(G, exact) + 0.02


def test_query(spark):
    """The registered query's map of all embeddings, against the plain one with the same landmarks: every row is one."""
    from quillstone.plans import catalogue

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    G = plain_paths(np.array([r.embedding for r in rows], float), 8)
    assert len(rows) <= isomap.LANDMARKS and np.isfinite(G).all()
    mean, matrix = isomap.scaled(G, 2)
    expected = (G * G - mean[None]) @ matrix
    found = {r.vec_id: (r.x, r.y) for r in catalogue.queries()["isomap"](spark, sf).collect()}
    assert np.allclose(np.abs(expected), np.abs([found[r.vec_id] for r in rows]), atol=1e-6)


def test_parts_are_tied(spark):
    """Two clumps far apart: the shortest way between them joins their graphs, so both are laid out, apart."""
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(size=(15, 2)), rng.normal(size=(15, 2)) + [100, 0]])
    Y = laid_out(spark, X, neighbours=3, landmarks=30)
    apart = np.linalg.norm(Y[:15].mean(0) - Y[15:].mean(0))
    assert 80 < apart < 120


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r.embedding for r in clustering.reduce_dimensions(df, 2, "isomap").collect()] == [[0.0, 0.0]]
    assert clustering.reduce_dimensions(df.limit(0), 2, "isomap").collect() == []
    assert isomap.scaled(np.zeros((3, 3)), 2)[1].tolist() == [[0.0, 0.0]] * 3
    with pytest.raises(ValueError):
        clustering.reduce_dimensions(df, 1, "umap")


def test_paths_by_tasks_are_those_by_joins(spark, monkeypatch):
    """Tasks that read the links, with several landmarks or one each, against links joined with distances."""
    from quillstone.session import settled

    X = roll(150, 9)
    near = [(i, j, float(np.linalg.norm(X[i] - X[j]))) for i in range(150) for j in range(150) if i != j and np.linalg.norm(X[i] - X[j]) < 6]
    edges = settled(spark.createDataFrame(near, "a long, b long, gap double"), "graph")
    sources = [3, 149, 0, 77, 20]

    def found():
        return {(r.id, r["first"] + n): x for r in isomap.shortest_paths(edges, sources, 150).collect() for n, x in enumerate(r.far) if np.isfinite(x)}

    monkeypatch.setattr(isomap, "LINKS", 0)
    joined = found()
    monkeypatch.setattr(isomap, "LINKS", 1 << 20)
    assert len(joined) > 400 and found() == joined
    monkeypatch.setattr(isomap, "STATE_BYTES", 1)
    assert found() == joined


def test_nearest_rows_over_blocks(spark, monkeypatch):
    """Copies and ties: the k nearest, of equals the smaller ids, over many pairs of blocks."""
    monkeypatch.setattr(hierarchy, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(hierarchy, "TILE", 16)
    X = np.round(roll(200, 4) / 2)
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "vec_id long, embedding array<double>").repartition(3)
    rows, width = hierarchy.vector_rows(df, "vec_id", "embedding", "euclidean")
    got = {}
    for r in isomap.nearest_rows(rows, width, 8).collect():
        got.setdefault(r.id, set()).add(r.nb)
    D = np.round(np.linalg.norm(X[:, None] - X[None], axis=2), 12)
    np.fill_diagonal(D, np.inf)
    assert got == {i: set(np.lexsort((np.arange(200), D[i]))[:8].tolist()) for i in range(200)}
