"""Isomap of any number of vectors: distances along a neighbour graph, laid out from landmarks.

Every row's nearest neighbours are found exactly, block against block. From the landmarks, shortest paths run through the graph in
rounds: a round extends only the distances that the last one shortened, and keeps those that are shorter than what is
known. So the state is a distance a row and landmark, never one a pair of rows; a task takes the landmarks whose distances it can hold. The landmarks, whose number the caller bounds, are laid
out by classical scaling on the driver; every other row is placed by its distances to them (triangulation). With every row a
landmark that is the exact map. Parts of the graph that hang on nothing are tied by the shortest ways between them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import hierarchy
from quillstone.operators.graph import components
from quillstone.session import discard, settled

#: Landmarks where nothing else is asked for: the driver holds their square.
LANDMARKS = 512


def nearest_rows(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(id, nb, gap): the k nearest other rows of every row by Euclidean distance, of equals the smaller ids."""

    def run(first: pd.DataFrame, second: pd.DataFrame, same: bool) -> pd.DataFrame:
        (ids, X), (others, Y) = ((f["id"].to_numpy(), np.frombuffer(b"".join(f["mean"]), np.float64).reshape(-1, width)) for f in (first.sort_values("id"), second.sort_values("id")))
        rough = hierarchy.Rough(X, np.ones(len(X)), Y, np.ones(len(Y)), "euclidean", "single")
        slack, here, there = np.float32(2 * rough.unit), [], []
        best = np.full((k, len(Y)), np.inf, np.float32)  # of what tiles told of each column, the k smallest
        for lo in range(0, len(X), hierarchy.TILE):
            own = np.arange(lo, min(len(X), lo + hierarchy.TILE))
            D = rough.tile(own)
            if same:
                D[np.arange(len(own)), own] = np.inf
            i, j = np.divmod(np.flatnonzero(D <= _kth(D, k)[:, None] + slack), D.shape[1])
            here.append(_shortest(own[i], j, rough.exact(own[i], j), k))
            if not same:
                best = np.partition(np.concatenate((best, _strips(D.T, k).T)), k - 1, axis=0)[:k]
                i, j = np.divmod(np.flatnonzero(D <= best[k - 1][None] + slack), D.shape[1])
                there.append((j, own[i], D[i, j]))
        told = [(ids, others, here)]
        if there:
            j, i, far = (np.concatenate(x) for x in zip(*there))
            near = far <= best[k - 1][j] + slack
            j, i = j[near], i[near]
            told.append((others, ids, [_shortest(j, i, rough.exact(i, j), k)]))
        frames = [pd.DataFrame({"id": [], "nb": [], "gap": []})]
        for one, other, found in told:
            for own, nb, gap in found:
                finite = np.isfinite(gap)
                own, nb, gap = one[own[finite]], other[nb[finite]], gap[finite]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
                frames.append(pd.DataFrame({"id": own[starts], "nb": np.split(nb, starts[1:]) if len(own) else [], "gap": np.split(gap, starts[1:]) if len(own) else []}))
        return pd.concat(frames)

    # A row a row and pair of blocks, with k neighbours.
    found = hierarchy.in_blocks(rows.select("id", "mean"), width, run, "id long, nb array<long>, gap array<double>")
    best = found.groupBy("id").agg(F.flatten(F.collect_list(F.arrays_zip("gap", "nb"))).alias("near"))
    return best.select("id", F.explode(F.slice(F.sort_array("near"), 1, k)).alias("e")).select("id", "e.nb", "e.gap")


def _strips(D: np.ndarray, k: int) -> np.ndarray:
    """Of each row the least of k or more sets of its entries (all entries where there are few)."""
    strips = max(k, D.shape[1] // 32)
    deep = D.shape[1] // strips if D.shape[1] >= 2 * strips else 1
    if deep == 1:
        return D
    whole = D[:, : deep * strips].reshape(len(D), deep, strips)
    return whole.min(1)


def _kth(D: np.ndarray, k: int) -> np.ndarray:
    """Of each row a number that k entries or more, or all, do not exceed: near the k-th smallest."""
    least = _strips(D, k)
    return np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] >= k else np.full(len(D), np.finfo(np.float32).max)


def _shortest(own: np.ndarray, other: np.ndarray, gap: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs the k shortest of each own place, of equals the smaller other ones; by own place."""
    order = np.lexsort((other, gap, own))
    own, other, gap = own[order], other[order], gap[order]
    start = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(len(own)), 0)) if len(own) else own
    kept = np.arange(len(own)) - start < k
    return own[kept], other[kept], gap[kept]


def neighbour_graph(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(a, b, gap) in both directions, connected: a row's nearest ones, and the shortest links between what these leave apart."""
    near = settled(nearest_rows(rows, width, k), "neighbours")
    both = near.select(F.col("id").alias("a"), F.col("nb").alias("b"), "gap").unionByName(near.select(F.col("nb").alias("a"), F.col("id").alias("b"), "gap"))
    named = components(both.select("a", "b"))
    if named.select("component").distinct().limit(2).count() > 1:
        grouped = rows.join(named.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id", "left").withColumn("grp", F.coalesce("grp", "id"))
        ties = hierarchy.forest(grouped, width, "euclidean", float("inf")).select("a", "b", F.col("height").alias("gap"))
        both = both.unionByName(ties).unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap"))
    out = settled(both.groupBy("a", "b").agg(F.min("gap").alias("gap")), "graph")
    discard(near)
    return out


#: Bytes of the distances of a task, and links and rows that a task's graph may have: some 16 bytes a link.
STATE_BYTES, LINKS, ROWS = 64 << 20, 16_000_000, 8_000_000


def shortest_paths(edges: DataFrame, sources: list[int], rows: int) -> DataFrame:
    """(id, first, far), written: the lengths of the shortest paths from the sources number first, first + 1, ... to every row that these
    reach. Rows are numbered from 0, edges are a written table.

    A task takes some sources, as many as their distances to all rows fit STATE_BYTES, and reads the links from the shared folder. With
    more than LINKS links or ROWS rows, distances are rows instead, and links are joined with them."""
    spark = edges.sparkSession
    if rows > ROWS or edges.count() > LINKS:
        return _paths_by_joins(edges, sources)
    step = max(1, min(STATE_BYTES // (8 * max(1, rows)), -(-len(sources) // spark.sparkContext.defaultParallelism)))
    place = edges.settled_at

    def run(frames):
        graph = None
        for frame in frames:
            for first in frame["first"]:
                graph = graph or _graph(place, rows)
                yield from _relaxed(graph, sources[first : first + step], rows, int(first))

    groups = spark.range(0, len(sources), step, -(-len(sources) // step)).select(F.col("id").alias("first"))
    return settled(groups.mapInPandas(run, "id long, first long, far array<double>"), "paths")


def _graph(place: str, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, gap) of a written table, by a."""
    from pyarrow import dataset, fs

    files, path = fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)
    table = dataset.dataset(path, filesystem=files, format="parquet").to_table(columns=["a", "b", "gap"])
    a, b = (table.column(c).to_numpy().astype(np.int32) for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    return a[order], b[order], table.column("gap").to_numpy()[order]


def _relaxed(graph, sources: list[int], rows: int, first: int):
    a, b, gap = graph
    far = np.full((rows, len(sources)), np.inf)
    far[sources, np.arange(len(sources))] = 0.0
    moved = np.zeros(rows, bool)
    moved[sources] = True
    while moved.any():
        links = np.flatnonzero(moved[b])
        moved = np.zeros(rows, bool)
        most = max(1, (8 << 20) // (8 * len(sources)))
        for lo in range(0, len(links), most):
            some = links[lo : lo + most]
            starts = np.flatnonzero(np.r_[True, a[some][1:] != a[some][:-1]])
            to = a[some][starts]
            new = np.minimum.reduceat(far[b[some]] + gap[some][:, None], starts, axis=0)
            old = far[to]
            moved[to[(new < old).any(1)]] = True
            far[to] = np.minimum(old, new)
    for lo in range(0, rows, 65536):
        ids = lo + np.flatnonzero(np.isfinite(far[lo : lo + 65536]).any(1))
        yield pd.DataFrame({"id": ids, "first": first, "far": list(far[ids])})


def _paths_by_joins(edges: DataFrame, sources: list[int]) -> DataFrame:
    table = edges.sparkSession.createDataFrame([(i, n) for n, i in enumerate(sources)], "id long, source long")
    known = settled(table.select("id", "source", F.lit(0.0).alias("far")), "paths")
    front = known
    while not front.isEmpty():
        longer = front.join(edges.withColumnRenamed("a", "id"), "id").select(F.col("b").alias("id"), "source", (F.col("far") + F.col("gap")).alias("far"))
        reached = longer.groupBy("id", "source").agg(F.min("far").alias("new"))
        both = settled(known.join(reached, ["id", "source"], "full"), "paths")
        shorter = F.col("new").isNotNull() & (F.col("far").isNull() | (F.col("new") < F.col("far")))
        discard(known)
        known, front = settled(both.select("id", "source", F.least("far", "new").alias("far")), "paths"), both.filter(shorter).select("id", "source", F.col("new").alias("far"))
        front = settled(front, "front")
        discard(both)
    return known.select("id", F.col("source").alias("first"), F.array("far").alias("far"))


def scaled(D: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Classical scaling of distances D: the mean squared distance of each landmark, and a matrix that takes squared distances, less
    these means, to k coordinates."""
    squared = D * D
    mean = squared.mean(0)
    B = -0.5 * (squared - mean[None] - mean[:, None] + squared.mean())
    values, axes = np.linalg.eigh(B)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0) < 0, -1.0, 1.0)
    kept = values > values[0] * len(D) * np.finfo(float).eps if len(values) and values[0] > 0 else np.zeros(len(values), bool)
    return mean, np.where(kept, -0.5 * axes / np.sqrt(np.where(kept, values, 1.0)), 0.0)


def isomap(df: DataFrame, k: int, neighbours: int = 5, landmarks: int = LANDMARKS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, map): k coordinates of every row; rows by md5 order are the landmarks. Rows without a vector are left out."""
    rows, width = hierarchy.vector_rows(df.filter(F.col(column).isNotNull()), key, column, "euclidean")
    chosen = [r.id for r in rows.select("id").orderBy(F.md5(F.col("id").cast("string"))).limit(landmarks).collect()]  # a bounded number
    if len(chosen) < 2:
        return rows.select(key, F.array(*[F.lit(0.0)] * k).alias("map"))
    graph = neighbour_graph(rows, width, neighbours)
    paths = shortest_paths(graph, chosen, rows.count())
    place = {i: n for n, i in enumerate(chosen)}
    D = np.zeros((len(chosen), len(chosen)))
    among = paths.filter(F.col("id").isin(chosen))
    for r in among.toLocalIterator():  # a number a pair of landmarks
        D[place[r.id], r["first"] : r["first"] + len(r.far)] = r.far
    mean, matrix = scaled((D + D.T) / 2, k)
    k_of = matrix.shape[1]
    columns = [f"x{c}" for c in range(k_of)]

    def placed(frames):
        for frame in frames:
            for first, some in frame.groupby("first"):
                far = np.stack(some["far"])
                at = slice(first, first + far.shape[1])
                yield pd.DataFrame({"id": some["id"]} | dict(zip(columns, ((far * far - mean[at]) @ matrix[at]).T)))

    told = paths.mapInPandas(placed, ", ".join(["id long", *[f"{c} double" for c in columns]]))
    found = told.groupBy("id").agg(*[F.sum(c).alias(c) for c in columns])
    coordinates = F.array(*[F.col(f"x{c}") for c in range(k_of)], *[F.lit(0.0)] * (k - k_of))
    return rows.select(key, "id").join(found, "id").select(key, coordinates.alias("map"))
