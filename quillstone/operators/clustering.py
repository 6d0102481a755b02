"""Clusters of phrase vectors: k-means, agglomerative, communities, quality, outliers.

All are distributed; the silhouette, communities and hierarchical clusters compare all pairs, block by block, at any size
(see `hierarchy`). Only complete linkage, and average linkage by Euclidean distance, need every single distance: they hold these
in one task and refuse more than `most` rows. `link` and `communities` are the plain forms on one machine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import similarity as S
from quillstone.operators import hierarchy, isomap
from quillstone.operators.sampling import within_budget

MOST = 20_000


def usage_frame(df: DataFrame, strategy, embed=S.embed_hashed) -> DataFrame:
    """review_id, pos, usage_option, product_id, product_category, embedding of the first selected label's options."""
    from quillstone.operators.labels import first_label

    one = df.select(
        "review_id",
        "product_id",
        "product_category",
        F.posexplode(first_label(F.col("labels"), strategy)["usageOptions"]).alias("pos", "usage_option"),
    )
    one = one.filter(F.col("usage_option").isNotNull() & (F.col("usage_option") != ""))
    return S.embed_phrases(one.withColumn("_low", F.lower("usage_option")), "_low", embedder=embed).drop("_low")


def reduce_dimensions(df: DataFrame, k: int, method: str = "pca", column: str = "embedding", key: str = "vec_id", **options) -> DataFrame:
    """The vectors on their first k principal axes, centred ("pca"), or laid out by distances along their neighbour graph
    ("isomap", with neighbours and landmarks as options; keys are unique)."""
    if method == "isomap":
        found = isomap.isomap(df, k, key=key, column=column, **options)
        return df.drop(column).join(found.withColumnRenamed("map", column), key)
    if method != "pca":
        raise ValueError(f"{method} is not offered; pca and isomap are")
    size = F.size(column)
    mean = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i")
    centre = [r.m for r in mean.collect()]  # one number a dimension
    shifted = df.withColumn(
        "_v",
        array_to_vector(F.zip_with(F.col(column).cast("array<double>"), F.array(*[F.lit(float(m)) for m in centre]), lambda x, m: x - m)),
    )
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(shifted.filter(size == len(centre)))
    return model.transform(shifted).withColumn(column, vector_to_array("_p")).drop("_v", "_p")


def kmeans(df: DataFrame, k: int, seed: int = 42, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Adds cluster, and is_centroid: the row of a cluster nearest to its centre (then the smallest key)."""
    tagged = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(tagged)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(tagged).drop("_v")
    far = F.aggregate(F.zip_with(F.col(column), F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("_d", far)
    nearest = out.groupBy("cluster").agg(F.min_by(key, F.struct("_d", key)).alias("_c"))
    return out.join(F.broadcast(nearest), "cluster").withColumn("is_centroid", F.col(key) == F.col("_c")).drop("_c", "_d")  # k rows


def distances(X: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        n = np.linalg.norm(X, axis=1, keepdims=True)
        U = np.divide(X, n, out=np.zeros_like(X), where=n > 0)
        D = np.clip(1 - U @ U.T, 0, 2)
    else:
        sq = (X * X).sum(1)
        D = np.sqrt(np.maximum(0, sq[:, None] + sq[None] - 2 * X @ X.T))
    np.fill_diagonal(D, 0)
    return D


def link(D: np.ndarray, linkage: str, n_clusters: int | None = None, distance_threshold: float | None = None) -> np.ndarray:
    """Agglomerative labels by repeated merging of the two nearest clusters, distances kept by the Lance-Williams rule."""
    if (n_clusters is None) == (distance_threshold is None):
        raise ValueError("state either a number of clusters or a distance")
    n = len(D)
    D = (D * D if linkage == "ward" else D).copy()
    np.fill_diagonal(D, np.inf)
    size, own, alive = np.ones(n), np.arange(n), n
    while alive > (n_clusters or 1):
        i, j = np.unravel_index(int(D.argmin()), D.shape)
        d = D[i, j]
        if distance_threshold is not None and (np.sqrt(d) if linkage == "ward" else d) >= distance_threshold:
            break
        a, b = D[i].copy(), D[j].copy()
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.where(np.isinf(a) | np.isinf(b), np.inf, np.maximum(a, b))
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        elif linkage == "ward":
            new = ((size[i] + size) * a + (size[j] + size) * b - size * d) / (size[i] + size[j] + size)
        else:
            raise ValueError(f"no linkage is called {linkage}")
        new[[i, j]] = np.inf
        D[i], D[:, i] = new, new
        D[j], D[:, j] = np.inf, np.inf
        size[i] += size[j]
        own[own == j] = i
        alive -= 1
    return np.unique(own, return_inverse=True)[1]


def communities(X: np.ndarray, threshold: float, least: int = 1) -> np.ndarray:
    """Greedy neighbourhoods of cosine at or above a threshold, the largest first; -1 where none holds a row."""
    near = 1 - distances(X, "cosine") >= threshold
    np.fill_diagonal(near, True)
    out = np.full(len(X), -1)
    order = sorted(range(len(X)), key=lambda i: (-int(near[i].sum()), i))
    number = 0
    for i in order:
        free = near[i] & (out < 0)
        if out[i] < 0 and free.sum() >= least:
            out[free] = number
            number += 1
    return out


def _few(df: DataFrame) -> bool:
    """Few enough rows that one task takes them all, with the same result as many tasks in rounds."""
    return df.limit(hierarchy.LOCAL + 1).count() <= hierarchy.LOCAL


def _whole(df: DataFrame, key: str, column: str, most: int, schema: str, function) -> DataFrame:
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"this compares all pairs and takes {most} rows at most")
    rows = df.select(F.col(key), F.col(column).cast("array<double>").alias("_v")).withColumn("_g", F.lit(0))
    return rows.groupBy("_g").applyInPandas(function, schema)


def agglomerative(
    df: DataFrame,
    key: str = "vec_id",
    column: str = "embedding",
    metric: str = "cosine",
    linkage: str = "average",
    n_clusters: int | None = None,
    distance_threshold: float | None = None,
    most: int = MOST,
) -> DataFrame:
    """(key, cluster): clusters are numbered by the smallest keys in them."""
    if (n_clusters is None) == (distance_threshold is None):
        raise ValueError("state either a number of clusters or a distance")
    if (metric, linkage) in hierarchy.OFFERED and not _few(df):
        return hierarchy.tree(df, key, column, metric, linkage, n_clusters, distance_threshold)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        return pd.DataFrame({key: frame[key], "cluster": link(distances(np.stack(frame["_v"]), metric), linkage, n_clusters, distance_threshold)})

    return _whole(df, key, column, most, f"{key} {dict(df.dtypes)[key]}, cluster long", run)


def community_detection(df: DataFrame, threshold: float, least: int = 1, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, cluster): greedy neighbourhoods of cosine at or above a threshold, the largest first; -1 where none holds a row."""
    if not _few(df):
        return hierarchy.greedy_communities(df, threshold, least, key, column)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        return pd.DataFrame({key: frame[key], "cluster": communities(np.stack(frame["_v"]), threshold, least)})

    return _whole(df, key, column, hierarchy.LOCAL, f"{key} {dict(df.dtypes)[key]}, cluster long", run)


def _far_sums(df: DataFrame, key: str, width: int, block: int | None = None) -> DataFrame:
    """(key, own, others): of every row the sums of its distances to each cluster's rows, as a map by cluster, in a row for each block
    that it was compared with. A pair is measured once for both of its rows."""
    kinds = dict(df.dtypes)
    rows = df.filter("cluster is not null").select(F.col(key).alias("id"), "cluster", "_v")

    def sums(X: np.ndarray, clusters: np.ndarray, Y: np.ndarray, others: np.ndarray, same: bool):
        """Rows lie by cluster: sums of X's rows over Y's clusters, and unless both are the same, of Y's rows over X's."""
        ends, back = (np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) for c in (others, clusters))
        there, here = np.empty((len(X), len(ends))), np.zeros((len(Y), len(back)))
        lengths = (Y * Y).sum(1)[None]
        for k, lo in enumerate(back):
            hi = back[k + 1] if k + 1 < len(back) else len(X)
            for at in range(lo, hi, hierarchy.TILE):
                x = X[at : min(hi, at + hierarchy.TILE)]
                D = x @ Y.T
                D *= -2
                D += (x * x).sum(1)[:, None]
                D += lengths
                np.sqrt(np.maximum(0, D, out=D), out=D)
                if same:  # a row's distance to itself is nothing but rounding
                    D[np.arange(len(x)), at + np.arange(len(x))] = 0
                there[at : at + len(x)] = np.add.reduceat(D, ends, axis=1)
                here[:, k] += D.sum(0)
        return there, others[ends], here, clusters[back]

    def run(first: pd.DataFrame, second: pd.DataFrame, same: bool) -> pd.DataFrame:
        first, second = (f.sort_values(["cluster", "id"]) for f in (first, second))
        X, Y = (np.stack(f["_v"]).astype(float) if len(f) else np.zeros((0, width)) for f in (first, second))
        if not len(X) or not len(Y):
            return pd.DataFrame({"key": [], "own": [], "others": [], "far": []})
        there, others, here, clusters = sums(X, first["cluster"].to_numpy(), Y, second["cluster"].to_numpy(), same)
        told = [(first, others, there)] if same else [(first, others, there), (second, clusters, here)]
        return pd.concat([
            pd.DataFrame({"key": f["id"].to_numpy(), "own": f["cluster"].to_numpy(), "others": [names] * len(f), "far": list(values)}) for f, names, values in told
        ])

    schema = f"key {kinds[key]}, own {kinds['cluster']}, others array<{kinds['cluster']}>, far array<double>"
    found = hierarchy.in_blocks(rows, width, run, schema, block)
    each = found.select("key", "own", F.explode(F.arrays_zip("others", "far")).alias("x"))
    return each.groupBy("key", "own", F.col("x.others").alias("other")).agg(F.sum("x.far").alias("far"))


def cluster_quality(df: DataFrame, key: str = "vec_id", column: str = "embedding", block: int | None = None) -> DataFrame:
    """(measure, value) of clustered rows (key, column, cluster): silhouette, Davies-Bouldin, Calinski-Harabasz, mean similarity
    within clusters (a row with itself counted), mean similarity to their centres, and the clusters of most and least of the former.

    All but the silhouette come from sums of vectors; the number of clusters, not of rows, is held at once. block: rows of a block, where
    these are to be fewer than `hierarchy` says.
    """
    rows = df.select(key, "cluster", F.col(column).cast("array<double>").alias("_v"))
    width = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    unit = F.transform("_v", lambda x: F.coalesce(F.try_divide(x, F.col("_n")), F.lit(0.0)))
    rows = rows.withColumn("_n", S.norm(F.col("_v"))).withColumn("_u", unit)
    means = lambda c: F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(width)])
    centres = rows.groupBy("cluster").agg(F.count("*").alias("n"), means("_v").alias("c"), means("_u").alias("u"))
    near = rows.join(centres.select("cluster", "n", "c"), "cluster")
    apart = F.aggregate(F.zip_with("_v", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    to_centre = F.coalesce(S.cosine(F.col("_v"), F.col("c")), F.lit(0.0))
    own = near.groupBy("cluster").agg(F.sum(apart).alias("within"), F.avg(F.sqrt(apart)).alias("scatter"), F.avg(to_centre).alias("centre_sim"))
    table = [r.asDict() for r in centres.join(own, "cluster").orderBy("cluster").collect()]  # a row a cluster
    k, n = len(table), sum(r["n"] for r in table)
    far = _far_sums(rows, key, width, block).join(centres.select(F.col("cluster").alias("other"), "n"), "other")
    mine = F.max(F.when(F.col("own") == F.col("other"), F.col("far") / F.greatest(F.lit(1), F.col("n") - 1)))
    size = F.max(F.when(F.col("own") == F.col("other"), F.col("n")))
    nearest = F.min(F.when(F.col("own") != F.col("other"), F.col("far") / F.col("n")))
    each = far.groupBy("key").agg(mine.alias("a"), nearest.alias("b"), size.alias("size"))
    value = F.when(F.col("size") > 1, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(F.lit(0.0))
    silhouette = 0.0
    if k > 1:  # rows without a cluster count as 0
        total, some = each.agg(F.sum(value), F.count("*")).first()
        silhouette = total / (some + rows.filter("cluster is null").count())
    sizes, C = np.array([r["n"] for r in table], float), np.array([r["c"] for r in table], float).reshape(k, -1)
    between = distances(C, "euclidean") if k else np.zeros((0, 0))
    np.fill_diagonal(between, np.inf)
    scatter, within = np.array([r["scatter"] for r in table]), sum(r["within"] for r in table)
    spread = float((sizes * ((C - (sizes[:, None] * C).sum(0) / max(n, 1)) ** 2).sum(1)).sum()) if k else 0.0
    sims = np.array([float(np.dot(r["u"], r["u"])) for r in table])
    out = {"silhouette": silhouette}
    out["davies_bouldin"] = float(((scatter[:, None] + scatter[None]) / between).max(1).mean()) if k > 1 else 0.0
    out["calinski_harabasz"] = float(spread / (k - 1) / (within / (n - k))) if 1 < k < n and within > 0 else 0.0
    out["sim_in_cluster"] = float(sims.mean()) if k else 0.0
    out["sim_to_centroid"] = float(np.mean([r["centre_sim"] for r in table])) if k else 0.0
    if k:
        out |= {"best": float(table[int(sims.argmax())]["cluster"]), "worst": float(table[int(sims.argmin())]["cluster"])}
    return df.sparkSession.createDataFrame([(m, float(v)) for m, v in out.items()], "measure string, value double")


def sweep(n_clusters: list[int] | None = None, distance_thresholds: list[float] | None = None, n_rows: int | None = None) -> list[dict]:
    """Arguments for one clustering each."""
    if bool(n_clusters) == bool(distance_thresholds):
        raise ValueError("state either numbers of clusters or distances")
    if n_clusters and n_rows is not None and max(n_clusters) > n_rows:
        raise ValueError("fewer rows than clusters")
    return [{"n_clusters": k} for k in n_clusters or []] + [{"distance_threshold": d} for d in distance_thresholds or []]


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(F.count("*").alias("size"))


def remove_outliers(reviews: DataFrame, phrases: DataFrame, share: float, distance_threshold: float = 0.5) -> DataFrame:
    """Reviews without those that own a phrase of the smallest clusters, which together hold about `share` of the phrases.
    phrases: (review_id, usage_option, embedding)."""
    if share == 0:
        return reviews
    distinct = phrases.groupBy("usage_option").agg(F.first("embedding").alias("embedding"))
    clusters = agglomerative(distinct, "usage_option", distance_threshold=distance_threshold)
    tagged = phrases.select("review_id", "usage_option").join(clusters, "usage_option", "left")
    small = within_budget(cluster_sizes(tagged), share)
    gone = tagged.join(small.select("cluster"), "cluster", "left_semi").select("review_id").distinct()
    return reviews.join(gone, "review_id", "left_anti")


def spectral(X: np.ndarray, k: int, gamma: float = 1.0, seed: int = 42):
    """A function from points to clusters: the normalised neighbourhoods exp(-gamma d^2) of the landmarks X are laid on their
    first k axes, other points by their neighbourhoods with the landmarks, and k-means parts the axes."""
    affinity = lambda a, b: np.exp(-gamma * distances_between(a, b) ** 2)
    K = affinity(X, X)
    degree = np.sqrt(K.sum(1))
    values, axes = np.linalg.eigh(K / degree[:, None] / degree[None])
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    scale = (axes / degree[:, None]) / values
    unit = lambda E: E / np.maximum(1e-300, np.linalg.norm(E, axis=1, keepdims=True))
    lay = lambda P: unit(affinity(P, X) @ scale)
    E, rng = lay(X), np.random.Generator(np.random.PCG64(seed))
    C = E[[int(rng.integers(len(E)))]]
    while len(C) < k:  # the farthest point from the centres so far
        C = np.concatenate((C, E[[int(distances_between(E, C).min(1).argmax())]]))
    for _ in range(50):
        own = distances_between(E, C).argmin(1)
        C = np.stack([E[own == c].mean(0) if (own == c).any() else C[c] for c in range(k)])
    return lambda P: distances_between(lay(P), C).argmin(1)


def distances_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


#: Landmarks of spectral clusters, drawn by hash; the driver holds their square.
LANDMARKS = 1500


def loss_map_clusters(
    statistics: DataFrame,
    k: int = 3,
    seed: int = 42,
    method: str = "spectral",
    gamma: float = 1.0,
    landmarks: int = LANDMARKS,
) -> DataFrame:
    """Clusters of examples by (confidence, variability): spectral ones, exact for up to `landmarks` examples and by a sample of
    so many beyond that, or k-means."""
    kept = statistics.na.drop("any", subset=["confidence", "variability"])
    point = F.array(F.col("confidence").cast("double"), F.col("variability").cast("double"))
    if method == "kmeans":
        tagged = kept.withColumn("_v", array_to_vector(point))
        return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(tagged).transform(tagged).drop("_v")
    if method != "spectral":
        raise ValueError(f"{method} is not offered; spectral and kmeans are")
    sample = [list(r[0]) for r in kept.select(point.alias("p")).orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(landmarks).collect()]
    if len(sample) <= k:
        return kept.withColumn("cluster", F.lit(0))
    own = spectral(np.array(sample, float), k, gamma, seed)

    @F.pandas_udf("int")
    def assign(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(own(np.stack((x, y), axis=1)).astype("int32") if len(x) else [], dtype="int32")

    return kept.withColumn("cluster", assign(F.col("confidence").cast("double"), F.col("variability").cast("double")))
