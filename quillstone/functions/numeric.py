"""Numbers that Spark has no function for: incomplete beta, distribution tails, transport, Wilcoxon ranks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shapes of the two beta distributions that rescale a cosine.
BETA_FIRST = (1.3492828476735637, 1.6475489724420649)
BETA_SECOND = (14.715846019280558, 3.3380276739903016)


def beta_cdf(x, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz), over arrays; numbers whose fraction
    has settled are worked on no further."""
    x = np.atleast_1d(np.asarray(x, np.float64))
    inside = np.clip(x, 0, 1)
    swap = inside > (a + 1) / (a + b + 2)
    z = np.where(swap, 1 - inside, inside)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    out = np.zeros_like(z)
    open_ = np.flatnonzero(z > 0)  # the others are 0 or, swapped, 1
    out[open_] = _fraction(z[open_], p[open_], q[open_])
    norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    zo, po, qo = z[open_], p[open_], q[open_]
    out[open_] *= np.exp(norm + po * np.log(zo) + qo * np.log1p(-zo)) / po
    out = np.where(swap, 1 - out, out)
    return np.where(np.isnan(x), np.nan, np.clip(out, 0, 1))


def _fraction(z: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    out, left, tiny = np.empty_like(z), np.arange(len(z)), 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        for step in (even, odd):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        settled = np.abs(d * c - 1) < 1e-15
        if settled.all():
            break
        if m % 4 == 0 and settled.sum() * 4 > len(settled):
            out[left[settled]] = h[settled]
            rest = ~settled
            left, z, p, q, c, d, h = (v[rest] for v in (left, z, p, q, c, d, h))
    out[left] = h
    return out


def rescaled_cosine(cosine) -> np.ndarray:
    """A cosine clamped to [0, 1] and put through both beta distributions."""
    return beta_cdf(beta_cdf(np.clip(cosine, 0, 1), *BETA_FIRST), *BETA_SECOND)


@F.pandas_udf(T.DoubleType())
def cosine_relu(cosine: pd.Series) -> pd.Series:
    return pd.Series(rescaled_cosine(cosine.to_numpy(np.float64))) if len(cosine) else cosine.astype("float64")


def t_tail(t: float, df: float, alternative: str = "two-sided") -> float:
    """p-value of a t statistic."""
    if math.isnan(t):
        return math.nan
    upper = 0.5 * float(beta_cdf(df / (df + t * t), df / 2, 0.5)[0])
    greater = upper if t > 0 else 1 - upper
    return {"greater": greater, "less": 1 - greater, "two-sided": 2 * min(greater, 1 - greater)}[alternative]


def normal_tail(z: float, alternative: str = "two-sided") -> float:
    greater = 0.5 * math.erfc(z / math.sqrt(2))
    return {"greater": greater, "less": 1 - greater, "two-sided": min(1.0, 2 * min(greater, 1 - greater))}[alternative]


def transport_cost(supply, demand, cost: np.ndarray) -> float:
    """Least cost of moving supply to demand (equal totals): shortest augmenting paths with node potentials."""
    supply, demand = np.array(supply, float), np.array(demand, float)
    n, m = cost.shape
    if n == 1 or m == 1:  # there is one way only
        return float((np.outer(supply, demand) * cost).sum() / (supply.sum() if n == 1 else demand.sum()))
    flow = np.zeros((n, m))
    u, v = np.zeros(n), np.zeros(m)  # potentials
    left, open_ = supply.copy(), demand.copy()
    eps = 1e-12
    while left.max(initial=0) > eps and open_.max(initial=0) > eps:
        reduced = np.maximum(cost + u[:, None] - v[None], 0)
        dr, dc = np.where(left > eps, 0.0, np.inf), np.full(m, np.inf)
        from_row, from_col = np.full(n, -1), np.full(m, -1)
        rows, cols = np.zeros(n, bool), np.zeros(m, bool)
        for _ in range(n + m):
            i = int(np.where(rows, np.inf, dr).argmin())
            j = int(np.where(cols, np.inf, dc).argmin())
            a, b = (np.inf if rows[i] else dr[i]), (np.inf if cols[j] else dc[j])
            if a == b == np.inf:
                break
            if a <= b:
                rows[i] = True
                better = dr[i] + reduced[i] < dc - 1e-15
                dc[better] = dr[i] + reduced[i][better]
                from_col[better] = i
            else:
                cols[j] = True
                back = (flow[:, j] > eps) & (dc[j] < dr - 1e-15)  # an arc that carries flow has no reduced cost
                dr[back] = dc[j]
                from_row[back] = j
        end = int(np.where(open_ > eps, dc, np.inf).argmin())
        path, j = [], end
        while True:
            i = int(from_col[j])
            path.append((i, j, 1))
            if from_row[i] < 0:
                break
            j = int(from_row[i])
            path.append((i, j, -1))
        amount = min([left[path[-1][0]], open_[end], *[flow[i, j] for i, j, s in path if s < 0]])
        for i, j, s in path:
            flow[i, j] += s * amount
        left[path[-1][0]] -= amount
        open_[end] -= amount
        far = dc[end]
        u += np.minimum(np.where(np.isfinite(dr), dr, far), far)
        v += np.minimum(np.where(np.isfinite(dc), dc, far), far)
    return float((flow * cost).sum())


def energy_kwh(watts: list[float], seconds: float) -> float:
    """Mean power over a time; none without power figures or time."""
    return sum(watts) / len(watts) * seconds / 3600 / 1000 if watts and seconds else 0.0


def prompt_cost(prompt_words: int, review_words: int = 50, output_words: int = 15, price_per_1000: float = 0.02) -> float:
    """Price of one request, three quarters of a word a token."""
    return (prompt_words + review_words + output_words) / 0.75 * price_per_1000 / 1000


def break_even(fixed: float, per_request: float, other_per_request: float) -> int | None:
    """The first number of requests at which a fixed cost and a cheaper request cost less than dearer requests."""
    gain = other_per_request - per_request
    return math.floor(fixed / gain) + 1 if gain > 0 else None


def break_even_table(costs):
    """Adds break_even to rows of (fixed, per_request, other_per_request), as break_even has it; null where it never comes."""
    gain = F.col("other_per_request") - F.col("per_request")
    return costs.withColumn("break_even", F.when(gain > 0, F.floor(F.col("fixed") / gain) + 1))
