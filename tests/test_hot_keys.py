"""Time differences and stratified parts with a key that holds most rows, split over ranges, against plain windows."""

import random
from datetime import datetime, timedelta

import pytest

from quillstone.operators import graph, sampling
from quillstone.operators import statistics as A


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    keys = ["a"] * 300 + ["b"] * 40 + [None] * 40 + [f"k{i}" for i in range(30)]
    rows = [(i, k, None if i % 97 == 5 else start + timedelta(seconds=rng.randrange(500))) for i, k in enumerate(rng.sample(keys, len(keys)))]
    return spark.createDataFrame(rows, "id long, key string, ts timestamp").repartition(3)


@pytest.mark.parametrize("many", ["1", "7"])
def test_gaps_of_a_hot_key(spark, events, monkeypatch, many):
    plain = sorted(map(tuple, A.gaps(events, "key", "ts", "id").collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(graph, "ROWS_OF_A_KEY", 100)
    spark.conf.set("spark.sql.shuffle.partitions", many)
    try:
        split = A.gaps(events, "key", "ts", "id")
        assert split.columns == ["id", "key", "ts", "gap"]
        assert sorted(map(tuple, split.collect())) == plain
        assert A.gaps(events.limit(0), "key", "ts", "id").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parts_of_a_hot_stratum(events, monkeypatch):
    plain = sorted(map(str, sampling.train_test_val(events, ["key"], "id").collect()))
    monkeypatch.setattr(graph, "ROWS_OF_A_KEY", 100)
    split = sampling.train_test_val(events, ["key"], "id")
    assert split.columns == ["id", "key", "ts", "part"] and sorted(map(str, split.collect())) == plain


def test_no_range_holds_a_hot_key(spark, events, monkeypatch):
    """One key in all rows: the ranges that windows run over are about even."""
    from quillstone.operators.graph import settled

    seen = []
    monkeypatch.setattr(graph, "settled", lambda df, name: seen.append(settled(df, name)) or seen[-1])
    monkeypatch.setattr(graph, "ROWS_OF_A_KEY", 100)
    A.gaps(spark.range(8000).selectExpr("id", "'x' AS key", "timestamp_seconds(id) AS ts"), "key", "ts", "id").collect()
    sizes = sorted(r["count"] for r in seen[0].groupBy("_part").count().collect())
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[1]
