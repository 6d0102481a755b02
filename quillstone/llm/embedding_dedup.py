"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products in them, one kept per group.

Centres are fitted on a bounded sample; every vector is assigned. A vector belongs to its nearest
cell and is lent to cells that are nearly as near. With x at home in cell i and y in cell j, the arc from x
to y crosses the plane halfway between the two centres, so the angles of x and y to that plane add up
to no more than the angle between x and y: one of the two is within half of the threshold's angle of it.
Lending every vector over planes that are so near therefore brings each pair above the threshold
together in the home cell of one of them, and no link is lost (below `reach` 1 some can be). Where both are
lent to the other's home, the pair counts in the cell of the smaller number only. Links are
counted and chained in blocks, never listed.

The number of cells is the largest power of two for which the sample's vectors are lent to fewer than
`most_lent` cells each on average (and cells keep `per_cell` of a label's vectors): where cells can't part the vectors
there are few, and lent copies never grow faster than the vectors. Vectors of each length, and each label, have cells
of their own size; labels are never compared.

Equal vectors (of one label) are one point with a multiplicity throughout, so a large group
of copies costs one row. Vectors are compared only where labels are equal and not null.
Vectors that are null, empty, zero, or hold null or non-finite components link with nothing
and are kept. Components are scaled by the largest one first, so very small and very large ones neither vanish
nor overflow. A row without vec_id takes part in links and gets a null component if it is alone. No rows give no
rows. Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._components import components, local_forest
from quillstone.llm._io import cut, forget

#: Bytes of unit vectors in a block; two blocks are compared at once.
BLOCK_BYTES = 4 << 20
#: Points drawn to fit the centres.
SAMPLE = 20_000


def spherical_kmeans(X: np.ndarray, k: int, rounds: int = 8, seed: int = 4) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    C = X[rng.choice(len(X), k, replace=False)].copy()
    for _ in range(rounds):
        own = (X @ C.T).argmax(1)
        sums = np.zeros_like(C)
        np.add.at(sums, own, X)
        norm = np.linalg.norm(sums, axis=1)
        C[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return C


def _unit(vectors) -> np.ndarray:
    X = np.array(vectors, np.float64)
    X /= np.abs(X).max(1)[:, None]
    return X / np.sqrt((X * X).sum(1))[:, None]


class Cells:
    """Centres of vectors of one length, and to which cells a vector is lent."""

    def __init__(self, centres: np.ndarray, threshold: float, reach: float):
        self.centres = centres
        # The sine of half the threshold's angle, times the distance of two centres; a little more for rounding.
        self.apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) * reach * np.sqrt((1 - threshold) / 2) + 1e-9

    def of(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home of each vector, whether it is in each cell)."""
        S = X @ self.centres.T
        home = S.argmax(1)
        near = (S[np.arange(len(X)), home][:, None] - S) <= self.apart[home]
        near[np.arange(len(X)), home] = True
        return home, near


def fit_cells(X: np.ndarray, most: int, threshold: float, reach: float, most_lent: float) -> Cells:
    """The most cells, a power of two and no more than `most`, to which X is lent less than most_lent times on average."""
    best = Cells(np.zeros((1, X.shape[1])), threshold, reach)
    k = 2
    while k <= min(most, len(X) // 4):
        tried = Cells(spherical_kmeans(X, k), threshold, reach)
        if sum(int(tried.of(X[lo : lo + 1000])[1].sum()) for lo in range(0, len(X), 1000)) >= (1 + most_lent) * len(X):
            break
        best, k = tried, 2 * k
    return best


def cosine_links(
    vectors: DataFrame,
    threshold: float = 0.93,
    reach: float = 1.0,
    per_cell: int = 256,
    most_cells: int = 1024,
    most_lent: float = 1.0,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    )
    rows = rows.withColumn("good", F.coalesce(good & F.coalesce(finite, F.lit(False)), F.lit(False)))
    # -0.0 and 0.0 are one value; a point is a distinct vector of a label.
    rows = rows.withColumn("embedding", F.when(F.col("good"), F.transform("embedding", lambda x: x + F.lit(0.0))))
    rows = rows.withColumn("point", F.when(F.col("good"), F.xxhash64("label", "embedding")))
    points = cut(rows.filter("good").groupBy("label", "embedding", "point").agg(F.count("*").alias("copies")), "points")
    # One short row a length of vectors; cells are as many as the largest label asks, for labels are never compared.
    by_label = points.groupBy(F.size("embedding").alias("width"), "label").agg(F.count("*").alias("n"))
    many = {r.width: r for r in by_label.groupBy("width").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    n = sum(r.n for r in many.values())
    drawn = points.select("embedding", "point").filter(
        F.pmod(F.xxhash64(F.lit(9), "point"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 20)),
    )
    sample = [r.embedding for r in drawn.limit(2 * SAMPLE).collect()]
    schema = "vec_id long, n_links long, component_id long, kept boolean"
    alone = rows.filter("not good").select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    if not n:
        return spark.createDataFrame([], schema).unionByName(alone)
    # (first cell, cells) by length; a length that the sample misses has one cell.
    cells, taken = {}, 0
    for width, seen in sorted(many.items()):
        own = [v for v in sample if len(v) == width]
        most = int(max(1, min(most_cells, seen.most // per_cell)))
        cells[width] = taken, fit_cells(_unit(own) if own else np.zeros((0, width)), most, threshold, reach, most_lent)
        taken += len(cells[width][1].centres)

    def assign(batches):
        for batch in batches:
            widths = pc.list_value_length(batch.column("embedding"))
            for width in pc.unique(widths).to_pylist():
                part = batch.filter(pc.equal(widths, width))
                start, own = cells[width]
                X = _unit(part.column("embedding").to_pylist())
                home, near = own.of(X)
                row, cell = np.nonzero(near)
                at, units = pa.array(row), [x.tobytes() for x in X]
                also = [(start + np.flatnonzero(x)).astype("<i8").tobytes() for x in near]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label").take(at),
                        pa.array(start + cell.astype(np.int64)),
                        pa.array(start + home[row].astype(np.int64)),
                        pa.array([also[i] for i in row], pa.binary()),
                        part.column("point").take(at),
                        part.column("copies").take(at),
                        pa.array([units[i] for i in row], pa.binary()),
                    ],
                    ["label", "cell", "home", "cells", "point", "copies", "unit"],
                )

    columns = "label string, cell long, home long, cells binary, point long, copies long, unit binary"
    lent = cut(points.mapInArrow(assign, columns), "lent")
    # Sizes are one short row a cell and label; cells are at most most_cells for each length.
    sizes = lent.groupBy("label", "cell").agg(
        F.sum(F.length("unit")).alias("bytes"),
        F.sum((F.col("home") == F.col("cell")).cast("long")).alias("homes"),
    )
    blocks = lent.join(sizes.filter("homes > 0"), ["label", "cell"]).withColumn("blocks", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    # A block goes to every task of its cell: with itself and with each other block.
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "label",
        "cell",
        F.least("block", "other").alias("b1"),
        F.greatest("block", "other").alias("b2"),
        "block",
        "home",
        "cells",
        "point",
        "copies",
        "unit",
    )

    def products(frame: pd.DataFrame) -> pd.DataFrame:
        return compared(frame, threshold)

    found = cut(dealt.groupBy("label", "cell", "b1", "b2").applyInPandas(products, "a long, b long, links long"), "found")
    forget(lent)
    counts = found.filter("a = b").groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("a <> b"))
    named = points.select("point", "copies").join(counts, "point", "left").join(joined.withColumnRenamed("node", "point"), "point", "left")
    named = cut(named.select(
        "point",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "point").alias("component"),
    ), "named")
    own = rows.filter("good").select("vec_id", "point")
    own = cut(own.join(named, "point").select("vec_id", "n_links", "component"), "own")
    least = own.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = own.join(least, "component").select(
        "vec_id",
        "n_links",
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
    return linked.unionByName(alone)


def compared(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one block of a cell, or of two: (a, a, links) of every vector with links, and a forest of the links as (a, b, 0)."""
    frame = frame.sort_values("point")
    b1, b2 = frame.b1.iloc[0], frame.b2.iloc[0]
    cell = int(frame.cell.iloc[0])
    left = np.flatnonzero(frame.block.to_numpy() == b1)
    right = left if b1 == b2 else np.flatnonzero(frame.block.to_numpy() == b2)
    units = np.frombuffer(b"".join(frame.unit), np.float64).reshape(len(frame), -1)
    point, copies, home = frame.point.to_numpy(), frame.copies.to_numpy(), frame.home.to_numpy()
    # Homes other than this cell, as numbers; of which of them each vector is in the cell as well.
    homes, number = np.unique(home, return_inverse=True)
    inside = np.zeros((len(frame), len(homes)), bool)
    for i, cells in enumerate(frame.cells):
        at = np.searchsorted(homes, own := np.frombuffer(cells, "<i8"))
        at = at[(at < len(homes)) & (homes[at.clip(0, len(homes) - 1)] == own)]
        inside[i, at] = True
    own, counts, pairs = home == cell, np.zeros(len(frame), np.int64), []
    for lo in range(0, len(left), 256):
        a = left[lo : lo + 256]
        near = units[a] @ units[right].T >= threshold
        i, j = np.nonzero(near)
        i, j = a[i], right[j]
        if b1 == b2:
            i, j = i[i < j], j[i < j]
        # Two that are both lent here meet in one of their homes. One at home and one lent here meet in the other's home,
        # too, if the first is lent there; then the cell of the smaller number counts.
        here = own[i] & own[j]
        for x, y in ((i, j), (j, i)):
            here |= own[x] & ~own[y] & (~inside[x, number[y]] | (cell < home[y]))
        i, j = i[here], j[here]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        pairs += local_forest(zip(point[i].tolist(), point[j].tolist()))
    forest = local_forest(pairs)
    some = np.flatnonzero(counts)
    a = np.concatenate((point[some], np.array([x for x, _ in forest], np.int64)))
    b = np.concatenate((point[some], np.array([y for _, y in forest], np.int64)))
    return pd.DataFrame({"a": a, "b": b, "links": np.concatenate((counts[some], np.zeros(len(forest), np.int64)))})
