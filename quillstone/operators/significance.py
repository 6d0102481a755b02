"""Tests of whether one label scores better than another, on paired differences.

Everything that depends on the number of reviews is aggregated by Spark; the driver sees moments,
and resampling replicates as a few numbers each. A replicate's random numbers are computed from the row's id and the replicate's
number, so they depend on no partition; tasks multiply them with their rows and pass on one sum a replicate.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.numeric import normal_tail, t_tail
from quillstone.operators.graph import before

ALTERNATIVES = ("two-sided", "less", "greater")
#: Resamples where nothing else is asked for, and the most differences whose ranks get an exact distribution.
REPLICATES = 9_999
EXACT = 50


def paired(scores: DataFrame, first: str, second: str, metric_id: str) -> DataFrame:
    """(review_id, a, b, d) of reviews scored for both labels; the best reference of each counts."""
    from quillstone.operators.scoring import best_reference

    best = best_reference(scores.filter(F.col("metric_id") == metric_id))
    side = lambda label, name: best.filter(F.col("label_id") == label).select("review_id", F.col("score").alias(name), F.col("ref_pos").alias(f"{name}_ref"))
    return side(first, "a").join(side(second, "b"), "review_id").withColumn("d", F.col("a") - F.col("b"))


def t_statistic(pairs: DataFrame) -> DataFrame:
    """One row: n, mean, std and t of d."""
    one = pairs.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"))
    return one.withColumn("t", F.try_divide(F.col("mean"), F.col("std") / F.sqrt("n")))


def t_test(pairs: DataFrame, alternative: str = "two-sided") -> dict[str, float]:
    r = t_statistic(pairs).first()
    t = math.nan if r.t is None else r.t
    return {"n": r.n, "statistic": t, "p": t_tail(t, r.n - 1, alternative)}


def _ranked(pairs: DataFrame) -> DataFrame:
    """(rank, c, u): the mean rank of each distinct |d| but 0, how many have it, and how many of these are positive."""
    kept = pairs.filter("d <> 0").select(F.round(F.abs("d"), 12).alias("m"), (F.col("d") > 0).alias("up"))
    counts = kept.groupBy("m").agg(F.count("*").alias("c"), F.count_if("up").alias("u"))
    return before(counts, ["m"], F.col("c"), "smaller").select((F.col("smaller") + (F.col("c") + 1) / 2).alias("rank"), "c", "u")


def _signed_ranks(ranked: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return ranked.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        total(F.col("rank") * F.col("u")).alias("w_plus"),
        total(F.col("rank") * (F.col("c") - F.col("u"))).alias("w_minus"),
        total(F.col("c").cast("double") * (F.col("c") * F.col("c") - 1)).alias("ties"),
    )


def wilcoxon_statistic(pairs: DataFrame) -> DataFrame:
    """One row: n, ranks of positive and of negative differences, and the tie term; ties share the mean rank, zeros go.

    Ranks come from counts of each distinct |d|, added up range by range.
    """
    return _signed_ranks(_ranked(pairs))


def signed_rank_tail(ranks: list[float], w_plus: float, alternative: str) -> float:
    """The chance of positive ranks as extreme as w_plus, if each rank is as likely positive as negative: all sums of ranks are
    counted, one rank after another. Ranks are whole or half."""
    counts = [1]
    for r in ranks:
        step = round(2 * r)
        counts = [a + b for a, b in zip(counts + [0] * step, [0] * step + counts)]
    at, all_of_them = round(2 * w_plus), 2 ** len(ranks)
    less, greater = sum(counts[: at + 1]) / all_of_them, sum(counts[at:]) / all_of_them
    return {"less": less, "greater": greater, "two-sided": min(1.0, 2 * min(less, greater))}[alternative]


def wilcoxon(pairs: DataFrame, alternative: str = "two-sided") -> dict[str, float]:
    """Signed-rank test: exact for up to EXACT differences none of which is 0, by the normal approximation beyond."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"no alternative is called {alternative}")
    ranked = _ranked(pairs)
    r = _signed_ranks(ranked).first()
    n = r.n
    if not n:
        return {"n": 0, "statistic": 0.0, "p": math.nan}
    statistic = min(r.w_plus, r.w_minus) if alternative == "two-sided" else r.w_plus
    if n <= EXACT and pairs.filter("d = 0").isEmpty():
        ranks = [x.rank for x in ranked.collect() for _ in range(x.c)]  # EXACT at most
        return {"n": n, "statistic": statistic, "p": signed_rank_tail(ranks, r.w_plus, alternative)}
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - r.ties / 48)
    z = (r.w_plus - n * (n + 1) / 4) / spread if spread else 0.0
    return {"n": n, "statistic": statistic, "p": normal_tail(z, alternative)}


# -- resampling ----------------------------------------------------------------------------------

_U = np.uint64
#: Chances of a Poisson variable of mean 1 to be at most 0, 1, ... 17, as 64-bit numbers.
_POISSON = [_U(min(2**64 - 1, int(2**64 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))))) for k in range(18)]
#: Random numbers that a task holds at once.
_AT_ONCE = 1 << 20


def random_bits(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """64 random bits for each key and number: a row of the result a key. They are a function of both alone (splitmix)."""
    x = keys[:, None] + (numbers.astype(np.uint64)[None] + _U(1)) * _U(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    return x ^ (x >> _U(31))


def poisson(bits: np.ndarray) -> np.ndarray:
    """How often a row is drawn: Poisson variables of mean 1."""
    out = np.zeros(bits.shape)
    for bar in _POISSON:
        more = bits >= bar
        if not more.any():
            break
        out += more
    return out


def coin(bits: np.ndarray) -> np.ndarray:
    return (bits >> _U(63)).astype(float)


def replicate_sums(rows: DataFrame, key: Column, columns: list[Column], draw, replicates: int, seed: int) -> DataFrame:
    """(replicate, sums): of every replicate the sum over rows of draw(bits) times each column. Rows with a null column are left out.

    A task multiplies its rows' draws with their columns and yields one matrix of replicates; groups of tasks add theirs up, and
    one task the groups' sums, so no task reads more than about the square root of their number."""
    width = len(columns)
    names = [f"c{i}" for i in range(width)]
    kept = rows.select(F.xxhash64(F.lit(seed), key).alias("key"), *[c.cast("double").alias(n) for c, n in zip(columns, names)]).na.drop("any", subset=names)

    def multiply(frames):
        total, numbers = np.zeros((replicates, width)), np.arange(replicates)
        step = max(1, _AT_ONCE // max(1, replicates))
        for frame in frames:
            keys, X = frame["key"].to_numpy().astype(np.int64).view(np.uint64), frame[names].to_numpy(float)
            for lo in range(0, len(X), step):
                total += draw(random_bits(keys[lo : lo + step], numbers)).T @ X[lo : lo + step]
        yield pd.DataFrame({"sums": [total.tobytes()]})

    matrix = lambda cells: np.frombuffer(cells, np.float64).reshape(replicates, width)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [sum(map(matrix, frame["sums"])).tobytes()]})

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"replicate": np.arange(replicates), "sums": list(sum(map(matrix, frame["sums"])))})

    groups = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = kept.mapInPandas(multiply, "sums binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups)))
    return parts.groupBy("g").applyInPandas(add, "sums binary").groupBy().applyInPandas(last, "replicate long, sums array<double>")


def bootstrap_means(pairs: DataFrame, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(replicate, mean): each row drawn as often as a Poisson variable of mean 1 says, which is a resample at any size."""
    sums = replicate_sums(pairs, F.col("review_id"), [F.col("d"), F.lit(1.0)], poisson, replicates, seed)
    return sums.select("replicate", F.try_divide(F.get("sums", F.lit(0)), F.get("sums", F.lit(1))).alias("mean"))


def accelerated(means: np.ndarray, observed: float, skew: float, shares: tuple[float, ...]) -> list[float]:
    """Quantiles of replicate means at the given shares, corrected for bias and acceleration; skew: the sum of cubed deviations over
    the sum of squared ones to the power 3/2, as the leave-one-out means have it."""
    normal = NormalDist()
    below = ((means < observed).sum() + (means <= observed).sum()) / (2 * len(means))
    if not 0 < below < 1:
        return [math.nan] * len(shares)
    bias, out = normal.inv_cdf(below), []
    for share in shares:
        z = bias + normal.inv_cdf(share)
        out.append(float(np.quantile(means, normal.cdf(bias + z / (1 - skew / 6 * z)))))
    return out


def bootstrap(
    pairs: DataFrame,
    confidence: float = 0.95,
    alternative: str = "two-sided",
    replicates: int = REPLICATES,
    seed: int = 0,
    method: str = "BCa",
) -> dict:
    """Two-sided interval of the mean difference ("BCa", or "percentile"), and whether it lies beyond 0 in the tested direction."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"no alternative is called {alternative}")
    if method not in ("BCa", "percentile"):
        raise ValueError(f"no method is called {method}")
    means = np.array([r["mean"] for r in bootstrap_means(pairs, replicates, seed).collect() if r["mean"] is not None])
    one = pairs.agg(F.count("d").alias("n"), F.avg("d").alias("mean")).first()
    if not one.n or not len(means):
        return {"low": math.nan, "high": math.nan, "rejected": False}
    off = F.col("d") - F.lit(one["mean"])
    moments = pairs.agg(F.sum(off * off).alias("two"), F.sum(off * off * off).alias("three")).first()
    shares = ((1 - confidence) / 2, (1 + confidence) / 2)
    if method == "percentile" or not moments.two:  # equal differences have no spread to correct
        low, high = (float(q) for q in np.quantile(means, shares))
    else:
        low, high = accelerated(means, one["mean"], moments.three / moments.two**1.5, shares)
    rejected = (alternative != "less" and low > 0) or (alternative != "greater" and high < 0)
    return {"low": low, "high": high, "rejected": bool(rejected)}


def _extreme(found: np.ndarray, observed: float, alternative: str) -> float:
    test = {
        "greater": found >= observed - 1e-12,
        "less": found <= observed + 1e-12,
        "two-sided": np.abs(found) >= abs(observed) - 1e-12,
    }[alternative]
    return (int(test.sum()) + 1) / (len(found) + 1)


def permutation(pairs: DataFrame, alternative: str = "two-sided", replicates: int = REPLICATES, seed: int = 0) -> dict[str, float]:
    """Mean difference under random swaps of the two labels within reviews."""
    one = pairs.agg(F.count("d").alias("n"), F.sum("d").alias("sum")).first()
    n, total = max(1, one.n), one["sum"] or 0.0
    # A row that is not swapped counts d, one that is -d: twice the kept ones' sum, less the whole.
    kept = replicate_sums(pairs, F.col("review_id"), [F.col("d")], coin, replicates, seed).collect()
    found = np.array([2 * r.sums[0] - total for r in kept]) / n
    return {"statistic": total / n, "p": _extreme(found, total / n, alternative)}


def _harmonic_gap(sums: np.ndarray) -> np.ndarray:
    """Difference of the labels' harmonic means over positive and negative references, from rows of sums and counts."""

    def harmonic(up, n_up, down, n_down):
        p, n = (np.where(k > 0, s / np.maximum(k, 1), 1.0) for s, k in ((up, n_up), (down, n_down)))
        return np.where(p + n == 0, 0.0, 2 * p * n / np.where(p + n == 0, 1.0, p + n))

    return harmonic(*sums[:, :4].T) - harmonic(*sums[:, 4:].T)


def permutation_harmonic(pairs: DataFrame, alternative: str = "two-sided", replicates: int = REPLICATES, seed: int = 0) -> dict[str, float]:
    """As permutation, of the difference of harmonic means over positive and negative references."""
    pairs = pairs.filter("a is not null and b is not null and a_ref is not null and b_ref is not null")

    def features(x: str, y: str) -> list[Column]:
        up = lambda c: F.col(f"{c}_ref").cast("double")
        return [f for c in (x, y) for f in (F.col(c) * up(c), up(c), F.col(c) * (1 - up(c)), 1 - up(c))]

    own, swapped = features("a", "b"), features("b", "a")
    totals = pairs.agg(*[F.sum(f).alias(f"s{i}") for i, f in enumerate([*own, *swapped])]).first()
    totals = np.array([x or 0.0 for x in totals]).reshape(2, 8)
    # All swapped, and for each kept row what it has instead.
    change = replicate_sums(pairs, F.col("review_id"), [x - y for x, y in zip(own, swapped)], coin, replicates, seed).collect()
    found = _harmonic_gap(totals[1] + np.array([r.sums for r in change]).reshape(-1, 8))
    observed = float(_harmonic_gap(totals[:1])[0])
    return {"statistic": observed, "p": _extreme(found, observed, alternative)}


def hypothesis_test(
    scores: DataFrame,
    first: str,
    second: str,
    metric_id: str,
    kind: str = "permutation_harmonic",
    alternative: str = "greater",
    confidence: float = 0.95,
) -> dict[str, dict]:
    """One test, or all of them (kind "all")."""
    pairs = paired(scores, first, second, metric_id).cache()
    tests = {
        "ttest": lambda: t_test(pairs, alternative),
        "wilcoxon": lambda: wilcoxon(pairs, alternative),
        "bootstrap": lambda: bootstrap(pairs, confidence, alternative),
        "permutation": lambda: permutation(pairs, alternative),
        "permutation_harmonic": lambda: permutation_harmonic(pairs, alternative),
    }
    names = ["ttest", "wilcoxon", "bootstrap", "permutation"] if kind == "all" else [kind]
    return {n: tests[n]() for n in names}
