"""Slices of arrays."""

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import augmentation


def test_words_are_split_once_a_row_not_once_a_slice(spark):
    df = spark.createDataFrame([("a b c d e",), ("",), (None,)], "t string").select(augmentation.chunks(X.words(F.col("t")), 2).alias("c"))
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert [r.c for r in df.collect()] == [[["a", "b"], ["c", "d"], ["e"]], [], []]
