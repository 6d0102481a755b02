"""Exact signed ranks and resampling against plain versions."""

import itertools
import random

import numpy as np
import pytest

from quillstone.operators import significance


def pairs(spark, values, parts=3):
    rows = [(str(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "review_id string, d double").repartition(parts)


def ranks_of(values):
    size = [abs(v) for v in values]
    return [sum(x < v for x in size) + (sum(x == v for x in size) + 1) / 2 for v in size]


def test_signed_ranks_equal_enumeration():
    rng = random.Random(3)
    for n in range(1, 13):
        for values in ([rng.uniform(-1, 2) for _ in range(n)], [rng.choice([-2, -1, 1, 2, 3]) for _ in range(n)]):
            ranks = ranks_of(values)
            plus = sum(r for r, v in zip(ranks, values) if v > 0)
            sums = [sum(s) for s in itertools.product(*[(0, r) for r in ranks])]
            less, greater = (sum(op(s) for s in sums) / len(sums) for op in (lambda s: s <= plus, lambda s: s >= plus))
            got = {a: significance.signed_rank_tail(ranks, plus, a) for a in significance.ALTERNATIVES}
            assert got == pytest.approx({"less": less, "greater": greater, "two-sided": min(1, 2 * min(less, greater))})


def test_small_samples_are_exact(spark):
    six = significance.wilcoxon(pairs(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, None]))
    assert six == {"n": 6, "statistic": 0.0, "p": pytest.approx(2 / 64)}
    with_zero = significance.wilcoxon(pairs(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.0]))
    assert with_zero["n"] == 6 and with_zero["p"] == pytest.approx(0.0277, abs=1e-3)
    rng = np.random.default_rng(2)
    values = rng.normal(0.2, 1, 50).round(1) + 0.05
    exact = significance.wilcoxon(pairs(spark, values), "greater")["p"]
    beyond = significance.wilcoxon(pairs(spark, [*values, 0.0]), "greater")["p"]
    assert exact == pytest.approx(beyond, abs=0.01) and exact != beyond
    assert np.isnan(significance.wilcoxon(pairs(spark, [0.0, 0.0]))["p"])


def plain_bca(values, replicates, seed):
    rng = np.random.default_rng(seed)
    means = values[rng.integers(0, len(values), (replicates, len(values)))].mean(1)
    from statistics import NormalDist

    normal, n = NormalDist(), len(values)
    bias = normal.inv_cdf(((means < values.mean()).mean() + (means <= values.mean()).mean()) / 2)
    left_out = np.array([np.delete(values, i).mean() for i in range(n)])
    u = (n - 1) * (left_out.mean() - left_out)
    a = (u**3).sum() / n**3 / (6 * ((u**2).sum() / n**2) ** 1.5)
    z = [bias + normal.inv_cdf(s) for s in (0.025, 0.975)]
    return np.quantile(means, [normal.cdf(bias + x / (1 - a * x)) for x in z]), means


def test_bca_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    values = rng.exponential(1, 300) ** 1.5 - 1.0  # skewed, so the correction shows
    got = significance.bootstrap(pairs(spark, values))
    (low, high), means = plain_bca(values, 40_000, 1)
    error = means.std()
    assert abs(got["low"] - low) < 0.12 * error and abs(got["high"] - high) < 0.12 * error
    plain = significance.bootstrap(pairs(spark, values), method="percentile")
    assert got["low"] > plain["low"] + 0.05 * error and got["high"] > plain["high"] + 0.05 * error
    assert got["rejected"] == (got["low"] > 0 or got["high"] < 0)
    assert significance.bootstrap(pairs(spark, [0.5] * 9)) == {"low": 0.5, "high": 0.5, "rejected": True}
    assert not significance.bootstrap(pairs(spark, []))["rejected"]
    with pytest.raises(ValueError):
        significance.bootstrap(pairs(spark, values), method="studentised")


def test_draws_depend_on_no_partition(spark):
    values = np.random.default_rng(6).normal(size=500)
    one, many = (
        {r["replicate"]: r["mean"] for r in significance.bootstrap_means(pairs(spark, values, parts), 300, 4).collect()} for parts in (1, 7)
    )
    assert one == pytest.approx(many, abs=1e-12) and len(one) == 300
    other = {r["replicate"]: r["mean"] for r in significance.bootstrap_means(pairs(spark, values), 300, 5).collect()}
    assert other != pytest.approx(one, abs=1e-3)
    plan = significance.bootstrap_means(pairs(spark, values), 300)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_draws_have_their_distribution():
    keys = np.arange(2000, dtype=np.uint64) * np.uint64(77)
    bits = significance.random_bits(keys, np.arange(500))
    drawn = significance.poisson(bits)
    assert abs(drawn.mean() - 1) < 0.005 and abs(drawn.var() - 1) < 0.01 and abs((drawn == 0).mean() - np.exp(-1)) < 0.003
    assert abs(significance.coin(bits).mean() - 0.5) < 0.003
    assert np.abs(np.corrcoef(drawn[:, :40].T) - np.eye(40)).max() < 0.12  # 2,000 rows: 0.022 is one standard error


def test_permutations_against_a_plain_version(spark):
    rng = np.random.default_rng(8)
    n = 60
    a, b = rng.uniform(size=n), rng.uniform(size=n) * 0.9
    a_ref, b_ref = rng.uniform(size=n) < 0.6, rng.uniform(size=n) < 0.5
    rows = [(str(i), float(a[i]), float(b[i]), float(a[i] - b[i]), bool(a_ref[i]), bool(b_ref[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "review_id string, a double, b double, d double, a_ref boolean, b_ref boolean")

    def harmonic(x, ref):
        p, q = x[ref].mean() if ref.any() else 1.0, x[~ref].mean() if (~ref).any() else 1.0
        return 2 * p * q / (p + q) if p + q else 0.0

    keep = rng.uniform(size=(20_000, n)) < 0.5
    swapped = np.where(keep, a - b, b - a).mean(1)
    gaps = np.array([harmonic(np.where(k, a, b), np.where(k, a_ref, b_ref)) - harmonic(np.where(k, b, a), np.where(k, b_ref, a_ref)) for k in keep[:4000]])
    for alternative in significance.ALTERNATIVES:
        for test, found, observed in (
            (significance.permutation, swapped, (a - b).mean()),
            (significance.permutation_harmonic, gaps, harmonic(a, a_ref) - harmonic(b, b_ref)),
        ):
            got = test(df, alternative)
            side = {"greater": found >= observed, "less": found <= observed, "two-sided": abs(found) >= abs(observed)}[alternative]
            assert got["statistic"] == pytest.approx(observed) and got["p"] == pytest.approx(side.mean(), abs=0.03)


def test_the_interval_of_the_query(spark):
    from quillstone.plans import catalogue

    sf = "/root/testdata/sf0.001"
    values = np.array([r.d for r in catalogue._paired(spark, sf).collect()])
    got = catalogue.queries()["bootstrap_interval"](spark, sf).first()
    (low, high), means = plain_bca(values, 20_000, 2)
    assert abs(got.low - low) < 0.12 * means.std() and abs(got.high - high) < 0.12 * means.std()
    assert got.rejected == (got.low > 0 or got.high < 0)
