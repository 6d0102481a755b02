"""Similarity of vectors and phrases."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.numeric import cosine_relu

#: Similarity classes and what they stand for.
CLASS_VALUES = {
    "named_v1": {"identical": 1.0, "very similar": 0.9, "somewhat similar": 0.5, "dissimilar": 0.0},
    "scale_v1": {"0": 0.0, "1": 0.1, "2": 0.2, "3": 0.3, "4": 0.4, "5": 0.5, "6": 0.6, "7": 0.7, "8": 0.8, "9": 0.9, "10": 1.0},
}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """1 - |a - b| / 2 of the vectors brought to length 1."""
    return 1 - F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine(a, b))) / 2


def similarity(name: str, a: Column, b: Column) -> Column:
    kinds = {"cosine": cosine, "cosine_relu": lambda x, y: cosine_relu(cosine(x, y)), "euclidean": euclidean_similarity}
    if name not in kinds:
        raise ValueError(f"no similarity is called {name}")
    return kinds[name](a, b)


def class_value(kind: str, name: Column) -> Column:
    """The number that a class stands for; 0 for other names."""
    table = F.create_map(*[F.lit(x) for kv in CLASS_VALUES[kind].items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.lit(0.0))


def pair_similarity(pairs: DataFrame, known: DataFrame, kind: str, a: str = "a", b: str = "b") -> DataFrame:
    """Adds similarity from a table (a, b, class) that holds each unordered pair once; pairs not in it count 0."""
    keyed = known.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"), F.col("class").alias("_class"))
    tagged = pairs.withColumn("_x", F.least(a, b)).withColumn("_y", F.greatest(a, b))
    return tagged.join(keyed, ["_x", "_y"], "left").withColumn("similarity", class_value(kind, F.col("_class"))).drop("_x", "_y", "_class")


def distance(sim: Column) -> Column:
    return 1 - sim


def log_distance(sim: Column, a: Column, b: Column) -> Column:
    return F.when((a == b) | (sim >= 1), F.lit(0.0)).otherwise(-F.log(F.greatest(F.lit(1e-6), sim)))


def most_similar(scored: Column, threshold: float = 0.0) -> Column:
    """Of array<struct<option, sim>>: struct<sim, option> of the greatest at or above the threshold; of equals the last. None: (0, null)."""
    start = F.struct(F.lit(None).cast("double").alias("sim"), F.lit(None).cast("string").alias("option"))
    best = F.aggregate(
        scored,
        start,
        lambda acc,
        x: F.when(
            x["sim"] >= F.greatest(F.coalesce(acc["sim"], F.lit(threshold)), F.lit(threshold)),
            F.struct(x["sim"].alias("sim"), x["option"].alias("option")),
        ).otherwise(acc),
    )
    return F.struct(F.coalesce(best["sim"], F.lit(0.0)).alias("sim"), best["option"].alias("option"))


def best_of(pairs: DataFrame, by: list[str], option: str, sim: str, threshold: float = 0.0) -> DataFrame:
    """by, option, sim: the most similar option of each group at or above the threshold; of equals the greatest option.
    Groups are never held: one row a group is kept while pairs stream by."""
    near = pairs.filter(F.col(sim) >= threshold)
    best = near.groupBy(*by).agg(F.max(F.struct(sim, option)).alias("_best"))
    return best.select(*by, F.col(f"_best.{option}").alias(option), F.col(f"_best.{sim}").alias(sim))


# -- phrase vectors ------------------------------------------------------------------------


def hashed_ngrams(phrase: str, size: int = 256) -> np.ndarray:
    """A unit vector of hashed character 3-grams: stands in for a model where there is none."""
    text = f"  {phrase.lower()} "
    v = np.zeros(size)
    for k in range(len(text) - 2):
        h = zlib.crc32(text[k : k + 3].encode())
        v[h % size] += 1 if h >> 31 else -1
    length = np.linalg.norm(v)
    return v / length if length else v


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed_hashed(phrases: pd.Series) -> pd.Series:
    return phrases.map(lambda p: None if p is None else hashed_ngrams(p))


def embed_phrases(df: DataFrame, phrase: str, table: DataFrame | None = None, embedder=embed_hashed) -> DataFrame:
    """Adds embedding: from a table (phrase, embedding), or computed once per distinct phrase."""
    keyed = table if table is not None else df.select(F.col(phrase).alias("phrase")).filter(F.col(phrase).isNotNull()).distinct().withColumn("embedding", embedder("phrase"))
    return df.join(keyed.withColumnRenamed("phrase", "_p"), F.col(phrase) == F.col("_p"), "left").drop("_p")
