"""Connected components of an edge table, distributed: no list of nodes or links meets on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._io import cut, forget


def local_forest(pairs) -> list[tuple[int, int]]:
    """(node, smallest node of its tree) of the given links, without the smallest ones."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in parent]


def _contract(batches):
    for batch in batches:
        rows = local_forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an edge with the smallest node reachable from it.

    Edges may repeat, run either way or be loops; rows with a null end are left out. Each round
    every node takes its smallest neighbour, its other neighbours move to that one, and parents
    are replaced by their own parents, so path lengths at least halve. Each round's edges
    are written to the shared folder and the last round's deleted; a round's state is its edges, never more than the first.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    e = cut(e.mapInArrow(_contract, "u long, v long").distinct(), "links")
    state = None
    while True:
        least = e.groupBy("u").agg(F.min("v").alias("p"))
        moved = e.join(least, "u").filter("v <> p").select(F.greatest("v", "p").alias("u"), F.least("v", "p").alias("v"))
        before = e
        e = least.select("u", F.col("p").alias("v")).unionByName(moved).distinct()
        up = e.groupBy("u").agg(F.min("v").alias("p"))
        jumped = e.join(up.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("p", "v").alias("v"))
        e = cut(jumped.unionByName(up.select("u", F.col("p").alias("v"))).filter("u <> v").distinct(), "links")
        forget(before)
        row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
