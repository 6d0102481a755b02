"""Exploratory statistics: describe, correlations, group sizes, histograms, gaps, power sets."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators import graph

#: Upper bounds of the gap classes, in seconds.
DAY = 86400
GAP_EDGES = (-0.001, 0, DAY, 2 * DAY, 3 * DAY, 4 * DAY, 5 * DAY, 6 * DAY)
#: Names and word counts of the length classes.
LENGTHS = (("very short", 0, 15), ("short", 16, 25), ("medium", 26, 40), ("long", 41, 90), ("very long", 91, 100000))


#: Buckets into which a round of exact_quantiles parts an interval.
BUCKETS = 1024


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column, by counting: values are counted in BUCKETS parts of their range, and the parts that hold
    a wanted rank are parted again, until a part holds a single value. All columns share a round's pass; a round's state is a few
    thousand counts, however many values differ. Nulls don't count, nan is above all numbers; None without a value."""
    value = lambda c: F.col(c).cast("double")
    inf, finite = float("inf"), lambda c: F.abs(value(c)) < float("inf")
    firsts = [
        F.struct(
            F.count(value(c)).alias("n"),
            F.count_if(value(c) == -inf).alias("below"),
            F.count_if(finite(c)).alias("finite"),
            F.count_if(value(c) == inf).alias("above"),
            F.min(F.when(finite(c), value(c))).alias("low"),
            F.max(F.when(finite(c), value(c))).alias("high"),
        )
        for c in columns
    ]
    known: dict[tuple[int, int], float] = {}  # (column, rank from 0): value
    parts: list[tuple[int, float, float, int, list[int]]] = []  # column, range, values before it, ranks wanted in it
    sizes = []
    for i, r in enumerate(df.agg(*[x.alias(f"c{i}") for i, x in enumerate(firsts)]).first()):
        sizes.append(r.n)
        ranks = sorted({k for s in shares for k in (math.floor(s * (r.n - 1)), math.ceil(s * (r.n - 1)))}) if r.n else []
        inside = [k for k in ranks if r.below <= k < r.below + r.finite]
        known |= {(i, k): -inf if k < r.below else inf if k < r.below + r.finite + r.above else math.nan for k in ranks if k not in inside}
        if inside:
            parts.append((i, r.low, r.high, r.below, inside))
    while parts:
        known |= {(i, k): low for i, low, high, _, ranks in parts if low == high for k in ranks}
        parts = [p for p in parts if p[1] < p[2]]
        if not parts:
            break
        place = F.lit(None).cast("long")
        for number, (i, low, high, _, _) in enumerate(parts):
            # Halves, as a range may be wider than the greatest number.
            at = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS
            own = F.least(F.floor(at), F.lit(BUCKETS - 1)) + number * BUCKETS
            place = F.when((F.col("c") == i) & F.col("v").between(low, high), own).otherwise(place)
        used = sorted({p[0] for p in parts})
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), value(columns[i]).alias("v")) for i in used])).alias("x")
        counted = df.select(cells).select("x.*").select(place.alias("place"), "v").filter("place is not null")
        found: dict[int, list] = {}
        for r in counted.groupBy("place").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("place").collect():
            found.setdefault(r.place // BUCKETS, []).append(r)
        rest = []
        for number, (i, _, _, before, ranks) in enumerate(parts):
            for r in found[number]:
                if own := [k for k in ranks if before <= k < before + r.n]:
                    rest.append((i, r.low, r.high, before, own))
                before += r.n
        parts = rest

    def quantile(i: int, share: float) -> float | None:
        if not sizes[i]:
            return None
        at = share * (sizes[i] - 1)
        low, high = math.floor(at), math.ceil(at)
        a, b = known[i, low], known[i, high]
        return a if low == high or a == b else (high - at) * a + (at - low) * b

    return {c: [quantile(i, s) for s in shares] for i, c in enumerate(columns)}


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row a column (and group): count, mean, std (n - 1), min, quartiles, max.

    Exact quartiles of whole columns are counted out in a few passes; those of groups keep each distinct value of a group.
    Approximate ones are of bounded size, for groups of very many distinct values.
    """
    shares = (0.25, 0.5, 0.75)
    if approximate:
        quartiles = lambda c: F.percentile_approx(c, list(shares), 100_000)
    elif by:
        quartiles = lambda c: F.percentile(c, F.array(*map(F.lit, shares)))
    else:
        found = exact_quantiles(df, columns, shares)
        quartiles = lambda c: F.array(*[F.lit(x).cast("double") for x in found[c]])

    def stats(c: str) -> Column:
        moments = [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")]
        return F.struct(
            F.lit(c).alias("column_name"),
            *moments,
            F.min(c).cast("double").alias("min"),
            quartiles(c).alias("q"),
            F.max(c).cast("double").alias("max"),
        )

    keys = by or []
    one = df.groupBy(*keys).agg(F.array(*[stats(c) for c in columns]).alias("s")).select(*keys, F.inline("s"))
    cuts = [F.get("q", F.lit(i)).cast("double").alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
    return one.select(*keys, "column_name", "count", "mean", "std", "min", *cuts, "max")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each unordered pair of columns, in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("s"))
    return one.select(F.inline("s"))


def group_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows a group; groups with a null key are left out."""
    return df.na.drop("any", subset=columns).groupBy(*columns).agg(F.count("*").alias("count"))


def count_of_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """How many keys have each number of non-null values."""
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(value).alias("size"))
    return per.groupBy("size").agg(F.count("*").alias("keys"))


def busiest_day_counts(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """How many keys have each largest number of values on one day."""
    per = df.filter(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(day, key).agg(F.count(value).alias("n"))
    return per.groupBy(key).agg(F.max("n").alias("most")).groupBy("most").agg(F.count("*").alias("keys"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"n_{c}") for c in columns])


def tail_sums(sizes: DataFrame, over: tuple[int, ...] = (5000, 1000), below: int = 2, size: str = "size", keys: str = "keys") -> DataFrame:
    """Of a count of counts: the values held by keys with more than each bound, and by those below one."""
    total = F.col(size) * F.col(keys)
    sums = [F.sum(F.when(F.col(size) > b, total).otherwise(0)).alias(f"over_{b}") for b in over]
    return sizes.agg(*sums, F.sum(F.when(F.col(size) < below, total).otherwise(0)).alias(f"below_{below}"))


def power_set(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates for every non-empty subset of the keys in one pass; subset is the bit mask of the keys left out."""
    out = df.cube(*keys).agg(F.grouping_id().alias("subset"), *aggregates)
    return out.filter(F.col("subset") < (1 << len(keys)) - 1)


def yearly_totals(df: DataFrame, date: str, value: Column) -> DataFrame:
    return df.groupBy(F.year(F.to_date(date)).alias("year")).agg(value.alias("total"))


def value_share(df: DataFrame, value: str, within: list[str] | None = None) -> DataFrame:
    """Percentage of each value, of all rows or within a group."""
    keys = within or []
    counts = df.na.drop("any", subset=[*keys, value]).groupBy(*keys, value).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(*keys)))


def gaps(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Adds seconds since the key's previous row (null for its first); ties in time go by `tie`. A key of very many rows is split."""
    if graph.has_hot_key(df, [key]):
        rows = graph.previous(df, [key], [time, tie], time, "_before")
    else:
        rows = df.withColumn("_before", F.lag(time).over(Window.partitionBy(key).orderBy(time, tie)))
    return rows.withColumn("gap", F.timestamp_diff("MICROSECOND", F.col("_before"), F.col(time)) / F.lit(1e6)).drop("_before")


def equal_frequency_counts(counts: DataFrame, n: int, value: str = "size", weight: str = "keys") -> DataFrame:
    """Weights summed over n buckets whose edges are quantiles of the distinct values (right-closed, the first also left-closed)."""
    quantiles = F.percentile(value, F.array(*[F.lit(k / n) for k in range(n + 1)]))
    edges = counts.select(value).distinct().agg(F.array_sort(F.array_distinct(quantiles)).alias("edges"))
    tagged = counts.crossJoin(F.broadcast(edges))  # edges: one row
    inner = F.filter("edges", lambda e: e < F.col(value))
    bucket = F.greatest(F.size(inner), F.lit(1))
    out = tagged.withColumn("bucket", bucket)
    return out.groupBy(
        "bucket",
        F.get("edges", F.col("bucket") - 1).alias("low"),
        F.get("edges", F.col("bucket")).alias("high"),
    ).agg(F.sum(weight).alias("total"))


def fixed_bucket(value: Column, edges: tuple[float, ...] = GAP_EDGES) -> Column:
    """Number of the right-closed bucket between edges, the last one open; null below the first edge."""
    out = F.when(value <= edges[0], None)
    for k, edge in enumerate(edges[1:]):
        out = out.when(value <= edge, k)
    return out.when(value > edges[-1], len(edges) - 1)


def length_class(n: Column) -> Column:
    out = F.when(n.isNull(), None)
    for name, low, high in LENGTHS:
        out = out.when((n >= low) & (n <= high), name)
    return out


def class_order(value: Column, order: list) -> Column:
    """Place of a value in a custom order, to sort by."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), value)


def busy_rows(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Rows of keys with more than a number of rows: a semi-join with the counts."""
    busy = df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)
    return df.join(busy, key, "left_semi")


def loss_statistics(
    log: DataFrame,
    mode: str = "training",
    keys: tuple[str, ...] = ("review_id", "source_id"),
    epochs: list[int] | None = None,
) -> DataFrame:
    """Mean and std of exp(-loss) per example: how sure and how steady a model was."""
    rows = log.filter(F.col("mode") == mode)
    if epochs is not None:
        rows = rows.filter(F.col("epoch").isin(*epochs))
    return rows.withColumn("p", F.exp(-F.col("loss"))).groupBy(*keys).agg(
        F.avg("p").alias("confidence"),
        F.stddev_samp("p").alias("variability"),
        F.count("*").alias("n"),
    )


def token_length_statistics(df: DataFrame, length: str, limit: int) -> DataFrame:
    """Mean, upper median, least, most, and rows over a limit. The median counts rows a length, which are few."""
    counts = df.groupBy(F.col(length).alias("_length")).agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_length"))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    at = (F.col("_upto") > F.floor(F.col("_all") / 2)) & (F.col("_upto") - F.col("_n") <= F.floor(F.col("_all") / 2))
    over = F.sum(F.when(F.col("_length") > limit, F.col("_n")).otherwise(0))
    return ranked.agg(
        (F.sum(F.col("_length") * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.max(F.when(at, F.col("_length"))).alias("median"),
        F.min("_length").alias("least"),
        F.max("_length").alias("most"),
        over.alias("over"),
    )


def dataset_metadata(df: DataFrame, label: str, has_usage: str) -> DataFrame:
    """Rows, and the share with a usage rounded half-even to 3 places, of each label."""
    return df.groupBy(label).agg(F.count("*").alias("num_reviews"), F.bround(F.avg(F.col(has_usage).cast("double")), 3).alias("usage_share"))
