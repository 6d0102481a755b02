"""Numbering of rows, the rows before others, and connected components, as Spark jobs over tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import discard, settled


def before(df: DataFrame, order: list[str | Column], amount: Column, name: str) -> DataFrame:
    """df with a column `name`: the sum of `amount` over all rows before this one in the given order. Rows are added up inside ranges,
    and a range starts with the sums of the ranges before it, so no task sees more than its range. The result is a written table."""
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_amount", amount).repartitionByRange(many, *order).withColumn("_part", F.spark_partition_id())
    dealt = settled(dealt, "ranges")
    sums = sorted((r["_part"], r["s"]) for r in dealt.groupBy("_part").agg(F.sum("_amount").alias("s")).collect())  # a row a range
    starts, total = {}, 0
    for part, s in sums:
        starts[part], total = total, total + s
    inside = F.sum("_amount").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.element_at(F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]), F.col("_part")) if starts else F.lit(0)
    out = settled(dealt.withColumn(name, start + F.coalesce(inside, F.lit(0))).drop("_part", "_amount"), "running")
    discard(dealt)
    return out


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with a column `name`: 0, 1, ... in the given order, a long."""
    return before(df, order, F.lit(1).cast("long"), name)


#: Rows of one key that one task may take in a window; beyond that a key's rows are split.
ROWS_OF_A_KEY = 1_000_000


def has_hot_key(df: DataFrame, keys: list[str]) -> bool:
    """Whether some key has more rows than a task should take. Counts are added up before they are shuffled."""
    return (df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > ROWS_OF_A_KEY


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with a column `name`: `value` of the row before, among rows of equal keys (nulls are a key) in the given order. Rows are dealt
    in ranges of key and order, so a key's rows are split like any others, and the last row of each range is handed on to the
    next. The result is made of a written table."""
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(many, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    last = F.max_by(F.struct(*keys, F.col(value).alias("_value")), F.struct(*keys, *order))
    ends = sorted(dealt.groupBy("_part").agg(last.alias("end")).collect(), key=lambda r: r["_part"])  # a row a range
    schema = "_to int, _known boolean, " + ", ".join(f"_end{i} {dict(df.dtypes)[c]}" for i, c in enumerate([*keys, value]))
    handed = df.sparkSession.createDataFrame([(b["_part"], True, *a["end"]) for a, b in zip(ends, ends[1:])], schema)
    inside = Window.partitionBy("_part").orderBy(*keys, *order)
    both = dealt.withColumn("_first", F.row_number().over(inside) == 1)
    here, there = F.lit(True), F.col("_known")
    for i, k in enumerate(keys):
        here, there = here & F.col(k).eqNullSafe(F.lag(k).over(inside)), there & F.col(k).eqNullSafe(F.col(f"_end{i}"))
    both = both.withColumn("_lag", F.when(here & ~F.col("_first"), F.lag(value).over(inside)))
    both = both.join(F.broadcast(handed), F.col("_part") == F.col("_to"), "left")  # as many rows as ranges
    return both.withColumn(name, F.when(F.col("_first") & there, F.col(f"_end{len(keys)}")).otherwise(F.col("_lag"))).select(*df.columns, name)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of an edge (a, b) with the smallest node that edges lead to.

    Every round a node is tied to its smallest neighbour, and its other neighbours to that one too, until nothing changes. A
    round's links are written and the last round's deleted."""
    links = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        tied = both.join(least.hint("merge"), "a").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b"))
        new = settled(tied.unionByName(least.select("a", F.col("low").alias("b"))).filter("a <> b").distinct(), "links")
        state = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        discard(links)
        links = new
        if state == before:
            break
        before = state
    # Stars are left: every node is linked with its component's smallest alone.
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
