"""Queries that SQL cannot express, held against plain versions on the smallest tables."""

import itertools
import math
import re
from html import unescape

import numpy as np
import pytest

from quillstone.functions import metrics as M
from quillstone.functions import similarity as S
from quillstone.functions import text as X
from quillstone.operators import clustering
from quillstone.plans import catalogue
from quillstone.plans.catalogue_models import _lists

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: catalogue.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def lists(spark):
    return {r.review_id: (list(r.p), list(r.r)) for r in _lists(spark, SF).collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])


def beta_by_sums(x: float, a: float, b: float, n: int = 20_000) -> float:
    """The incomplete beta function by the midpoint rule, over substituted steps that bring both ends in."""
    def area(upto):
        u = (np.arange(n) + 0.5) / n * upto
        return float(((u**4) ** (a - 1) * (1 - u**4) ** (b - 1) * 4 * u**3).sum() * upto / n)

    return area(x**0.25) / area(1.0)


def rescaled(c: float) -> float:
    first = beta_by_sums(min(1, max(0, c)), 1.3492828476735637, 1.6475489724420649)
    return beta_by_sums(first, 14.715846019280558, 3.3380276739903016)


def test_rescaled_cosines(run, vectors):
    ids, V, labels = vectors
    place = {k: i for i, k in enumerate(ids)}
    got = run("rescaled_cosines")
    assert len(got) == sum(int((labels == labels[place[k]]).sum()) for k in ids if k % 50 == 0)
    for r in sorted(got, key=lambda r: -r.sim)[:25]:
        a, b = V[place[r.a]], V[place[r.b]]
        assert r.sim == pytest.approx(rescaled(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), abs=2e-4)


def plain_similarity(a: str, b: str) -> float:
    return rescaled(float(np.dot(S.hashed_ngrams(a), S.hashed_ngrams(b))))


def test_list_metrics(run, lists):
    """Each pair of phrases compared for itself."""
    checked = 0
    for r in sorted(run("list_metrics"), key=lambda r: r.review_id):
        p, g = lists[r.review_id]
        if not p or not g:
            assert r.custom_mean_f1 == float(not p and not g) == r.custom_weighted_mean_f1
            continue
        if checked < 6:
            checked += 1
            sim = np.array([[plain_similarity(x, y) for y in g] for x in p])
            own = [1 - np.mean([plain_similarity(x, y) for y in p]) for x in p] if len(p) > 1 else [1.0]
            precision, recall = sim.max(1).mean(), sim.max(0).mean()
            assert r.custom_mean_precision == pytest.approx(precision, abs=1e-3) and r.custom_mean_recall == pytest.approx(recall, abs=1e-3)
            assert r.custom_mean_f1 == pytest.approx(2 * precision * recall / (precision + recall), abs=1e-3)
            assert r.custom_weighted_mean_precision == pytest.approx(np.dot(own, sim.max(1)) / sum(own), abs=1e-3)
            low = sim.max(1).min(), sim.max(0).min()
            assert r.custom_min_f1 == pytest.approx(2 * low[0] * low[1] / sum(low) if sum(low) else 0, abs=2e-3)
    assert checked == 6


def test_word_movers(run, lists):
    """Transport between two or one phrase a side has one free number; its ends hold the least cost."""
    got = {r.review_id: r.score for r in run("word_movers")}
    sim = M.Phrases()
    checked = 0
    for key, (p, g) in lists.items():
        if not p or not g:
            assert got[key] == float(not p and not g)
        elif len(p) <= 2 and len(g) <= 2 or len(p) == 1 or len(g) == 1:
            far = lambda x, y: np.array([[0.0 if a == b else max(0, -math.log(max(1e-6, s))) for b, s in zip(y, row)] for a, row in zip(x, sim(x, y))])
            mass = lambda x: (lambda d: d / d.sum() if len(x) > 1 and d.sum() > 0 else np.full(len(x), 1 / len(x)))(far(x, x).sum(1))
            a, b, C = mass(p), mass(g), far(p, g)
            if len(p) == 1 or len(g) == 1:
                cost = float((np.outer(a, b) * C).sum())
            else:
                ends = (max(0.0, a[0] - b[1]), min(a[0], b[0]))
                cost = min(f * C[0, 0] + (a[0] - f) * C[0, 1] + (b[0] - f) * C[1, 0] + (b[1] - a[0] + f) * C[1, 1] for f in ends)
            assert got[key] == pytest.approx(math.exp(-cost), abs=1e-5)
            checked += 1
    assert len(got) == len(lists)


def test_stems_and_permutations(run, lists, spark):
    for r in run("option_permutations"):
        assert sorted(r.target.split("; ")) == sorted(lists[r.review_id][0]) or not lists[r.review_id][0]
    counts = {}
    for r in run("option_permutations"):
        counts.setdefault(r.review_id, set()).add(r.target)
    assert {k: len(v) for k, v in counts.items()} == {k: math.factorial(len(p)) for k, (p, _) in lists.items()}
    one = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in run("stem_phrases"):
        words = sorted({w for w in one[r.doc_id].lower().split() if len(w) >= 8})[:5]
        assert r.stems == ";".join(X.porter_stem(w) for w in words)


def test_html_to_text(run, spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in run("html_to_text"):
        html = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", unescape(pages[r.page_id] or ""))
        assert "".join(r.review_body.split()) == "".join(re.sub(r"(?s)</?[A-Za-z!][^>]*>", " ", html).split())


def test_clusters(run, vectors):
    ids, V, _ = vectors
    rows = {r.vec_id: r for r in run("kmeans_assign")}
    own = np.array([rows[k].cluster for k in ids])
    C = np.stack([V[own == c].mean(0) for c in range(10)])
    far = ((V[:, None] - C[None]) ** 2).sum(2)
    assert (far.argmin(1) == own).mean() > 0.95  # the centres are those of the last round but one
    assert {rows[k].cluster for k in ids if rows[k].is_centroid} == set(range(10)) and sum(r.is_centroid for r in rows.values()) == 10
    # Communities: each member is near its founder, and no two founders are left that could be joined.
    U = V / np.linalg.norm(V, axis=1, keepdims=True)
    near = U @ U.T >= 0.35
    found = {r.vec_id: r.cluster for r in run("communities")}
    groups = [[i for i, k in enumerate(ids) if found[k] == c] for c in range(max(found.values()) + 1)]
    assert groups and all(len(g) >= 2 and any(near[i][g].all() for i in g) for g in groups)
    alone = [i for i, k in enumerate(ids) if found[k] < 0]
    assert all(near[i][alone].sum() < 2 for i in alone)
    # Agglomerative: ten clusters, by average linkage on a few rows against the definition.
    assert len({r.cluster for r in run("agglomerative")}) == 10
    D = clustering.distances(V[:25], "cosine")
    parts = [[i] for i in range(25)]
    while len(parts) > 6:
        a, b = min(itertools.combinations(range(len(parts)), 2), key=lambda ab: D[np.ix_(parts[ab[0]], parts[ab[1]])].mean())
        parts = [p for k, p in enumerate(parts) if k not in (a, b)] + [parts[a] + parts[b]]
    labels = clustering.link(D, "average", n_clusters=6)
    assert sorted(map(sorted, parts)) == sorted(sorted(np.flatnonzero(labels == c).tolist()) for c in range(6))
    axes = np.linalg.svd(V - V.mean(0), full_matrices=False)[2][:2]
    got = {r.vec_id: (r.x, r.y) for r in run("pca")}
    assert np.allclose(np.abs((V - V.mean(0)) @ axes.T), np.array([got[k] for k in ids]), atol=1e-5)


def test_significance(run, spark):
    d = np.array([r.d for r in catalogue._paired(spark, SF).collect()])
    means = np.array([r["mean"] for r in run("bootstrap_means")])
    error = d.std(ddof=1) / len(d) ** 0.5
    assert len(means) == 9_999 and abs(means.mean() - d.mean()) < 4 * error / 9_999**0.5 + 1e-3 and 0.9 < means.std() / error < 1.1
    found = {r.test: r for r in run("significance_tests")}
    t = d.mean() / error
    assert found["ttest"].statistic == pytest.approx(t)
    n = len(d) - 1
    u = (np.arange(400_000) + 0.5) / 400_000 * math.pi / 2  # x = sqrt(n) tan(u)
    density = np.cos(u) ** (n - 1)
    assert found["ttest"].p == pytest.approx(density[np.sqrt(n) * np.tan(u) >= abs(t)].sum() / density.sum(), abs=1e-4)
    rng = np.random.default_rng(1)
    swapped = (rng.choice([-1, 1], (20_000, len(d))) * d).mean(1)
    assert found["permutation"].p == pytest.approx((np.abs(swapped) >= abs(d.mean()) - 1e-12).mean(), abs=0.03)
    size = np.abs(d[d != 0]).round(12)
    ranks = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
    plus = ranks[d[d != 0] > 0].sum()
    assert found["wilcoxon"].statistic == pytest.approx(min(plus, ranks.sum() - plus))
