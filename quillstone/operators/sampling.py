"""Exact, reproducible sampling and splitting.

Rows are ordered by md5(seed, id), so a draw does not depend on partitions and sizes are exact.
Ranks are taken within strata and ranges of the hash, 65,536 of them, and added up, so no single task ranks a table or a stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators import graph

#: Rows that a task may keep as the first ones of an order; more are found by ranks.
TOP = 10_000


def draw(seed: int, id_column: str) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_column).cast("string")))


def _rank(df: DataFrame, order: list[Column], by: list[str]) -> DataFrame:
    """Adds _rank (from 1) and _size, within groups of `by`. The first order column is an md5."""
    hashed = df.withColumn("_bucket", F.substring(order[0], 1, 4))
    sizes = hashed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = sizes.withColumn("_before", F.sum("_n").over(group.orderBy("_bucket")) - F.col("_n")).withColumn("_size", F.sum("_n").over(group))
    inside = hashed.withColumn("_inside", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    keys = [*by, "_bucket"]
    right = before.select(*[F.col(k).alias(f"_r{k}") for k in keys], "_before", "_size")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    joined = inside.join(right, same)
    return joined.withColumn("_rank", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_bucket", *[f"_r{k}" for k in keys])


def _cut_size(n: Column, fraction: float) -> Column:
    return F.least(n - 1, F.greatest(F.lit(1), F.floor(n * F.lit(fraction))))


def split(df: DataFrame, fraction: float, seed: int, id_column: str, by: list[str] | None = None) -> DataFrame:
    """Adds in_first: a random part of each stratum, of the stated fraction; both parts have a row if the stratum has two.

    Fractions 0 and 1 leave one side empty; others outside [0, 1] are an error.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction lies between 0 and 1")
    if fraction in (0, 1):
        return df.withColumn("in_first", F.lit(fraction == 1))
    ranked = _rank(df, [draw(seed, id_column), F.col(id_column)], by or [])
    return ranked.withColumn("in_first", F.col("_rank") <= _cut_size(F.col("_size"), fraction)).drop("_rank", "_size")


def sample_n(df: DataFrame, n: int, seed: int, id_column: str) -> DataFrame:
    """Exactly n rows (all, if there are as many); n below 1 is an error."""
    if n < 1:
        raise ValueError("a sample has a row at least")
    if n <= TOP:
        return df.orderBy(draw(seed, id_column), id_column).limit(n)
    ranked = _rank(df, [draw(seed, id_column), F.col(id_column)], [])
    return ranked.filter(F.col("_rank") <= n).drop("_rank", "_size")


def sample_per_group(df: DataFrame, by: list[str], n: int, seed: int, id_column: str) -> DataFrame:
    """n rows of each group, drawn by hash (all of a smaller one)."""
    if n < 1:
        raise ValueError("a sample has a row at least")
    return _rank(df, [draw(seed, id_column), F.col(id_column)], by).filter(F.col("_rank") <= n).drop("_rank", "_size")


def train_test_val(
    df: DataFrame,
    strata: list[str],
    id_column: str,
    train: float = 0.7,
    test: float = 0.2,
    val: float = 0.1,
    exact: bool = True,
) -> DataFrame:
    """Adds part: train, test or val, by position within each stratum. Rows with a null stratum vanish.

    exact: cuts at the decimal fractions; else at those of doubles.
    """
    if abs(train + test + val - 1) > 1e-9:
        raise ValueError("the fractions add up to 1")
    rows = df.na.drop("any", subset=strata)
    if graph.has_hot_key(rows, strata):  # a stratum's rows are numbered along with all others, and stand from its first number on
        rows = graph.numbered(rows, [*strata, id_column], "_number")
        sizes = rows.groupBy(*strata).agg(F.min("_number").alias("_start"), F.count("*").alias("_size"))
        rows = rows.join(sizes, strata).withColumn("_place", F.col("_number") - F.col("_start"))
    else:
        one = Window.partitionBy(*strata)
        rows = rows.withColumn("_place", F.row_number().over(one.orderBy(id_column)) - 1).withColumn("_size", F.count("*").over(one))
    upto = lambda f: F.floor(F.col("_size") * (F.lit(round(f * 10**9)).cast("long")) / F.lit(10**9)) if exact else F.floor(F.col("_size") * F.lit(f))
    part = F.when(F.col("_place") < upto(train), "train").when(F.col("_place") < upto(train + test), "test").otherwise("val")
    return rows.withColumn("part", part).select(*df.columns, "part")


def reduce_to_share(df: DataFrame, flag: str, share: float, seed: int, id_column: str) -> DataFrame:
    """Rows such that the flag's share is as stated: the side that is too small stays whole, the other is drawn from."""
    sizes = df.agg(F.sum(F.col(flag).cast("long")).alias("yes"), F.sum((~F.col(flag)).cast("long")).alias("no")).first()
    yes, no = sizes.yes or 0, sizes.no or 0
    if not 0 < share < 1:
        raise ValueError("the share lies between 0 and 1")
    # Which side is drawn from: the one of which there is more than the share asks for.
    keep_yes = min(yes, round(no / (1 - share) * share))
    keep_no = min(no, round(yes / share * (1 - share)))
    want = F.when(F.col(flag), F.lit(keep_yes)).otherwise(F.lit(keep_no))
    ranked = _rank(df, [draw(seed, id_column), F.col(id_column)], [flag])
    return ranked.filter(F.col("_rank") <= want).drop("_rank", "_size")


def two_level_size(n: int, levels: tuple[int, int], equal_first: bool, equal_second: bool, total: Column, first: Column, both: Column) -> Column:
    """Rows to draw from a cell of two nested strata: alike over the first, the second, both or neither level."""
    a, b = levels
    if equal_first and equal_second:
        return F.lit(n // (a * b))
    if equal_first:
        return F.floor(F.lit(n) / a * both / first)
    if equal_second:
        return F.floor(F.lit(n) * first / total / b)
    return F.floor(F.lit(n) * both / total)


def sample_two_level(
    df: DataFrame,
    n: int,
    first: str,
    second: str,
    seed: int,
    id_column: str,
    equal_first: bool = True,
    equal_second: bool = True,
    levels: tuple[int, int] = (28, 5),
) -> DataFrame:
    ranked = _rank(df, [draw(seed, id_column), F.col(id_column)], [first, second])
    sizes = df.groupBy(first, second).agg(F.count("*").alias("_both"))
    sizes = sizes.withColumn("_first", F.sum("_both").over(Window.partitionBy(first))).withColumn("_total", F.sum("_both").over(Window.partitionBy()))
    wanted = ranked.join(sizes, [first, second])
    size = two_level_size(n, levels, equal_first, equal_second, F.col("_total"), F.col("_first"), F.col("_both"))
    return wanted.filter(F.col("_rank") <= size).drop("_rank", "_size", "_both", "_first", "_total")


def array_split(df: DataFrame, parts: int, order: list[Column]) -> DataFrame:
    """Adds part: 1 to parts, of nearly equal sizes in the order; the first ones are the larger. order[0] is an md5."""
    ranked = _rank(df, order, [])
    small, more = F.floor(F.col("_size") / parts), F.col("_size") % parts
    big = more * (small + 1)
    place = F.col("_rank") - 1
    part = F.when(place < big, F.floor(place / (small + 1))).otherwise(more + F.floor((place - big) / F.greatest(small, F.lit(1)))) + 1
    return ranked.withColumn("part", part.cast("long")).drop("_rank", "_size")


def within_budget(groups: DataFrame, share: float, size: str = "size", key: str = "cluster") -> DataFrame:
    """Whole groups, smallest first, as long as those before hold less than the share of all rows. groups: one row a group."""
    order = Window.orderBy(size, key).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(size).over(Window.partitionBy())
    return groups.withColumn(
        "_before",
        F.coalesce(F.sum(size).over(order), F.lit(0)),
    ).withColumn("_all", total).filter(F.col("_before") / F.col("_all") < share).drop("_before", "_all")
