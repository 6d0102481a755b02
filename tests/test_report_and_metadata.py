"""The report's reviews as a file, and what stands beside a data set."""

from pyspark.sql import functions as F

from quillstone.operators import labels as L
from quillstone.operators import scoring
from quillstone.operators.review_sets import ReviewSet


def test_reviews_of_a_report(spark, tmp_path):
    rows = [("1", 'a "quoted", text\nof two lines', "x; y"), ("2", None, ""), ("3", "b", "one")]
    df = spark.createDataFrame(rows, "review_id string, review_body string, reference string")
    for _ in range(2):  # a second report replaces the first
        scoring.write_report_reviews(df, f"{tmp_path}/report")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/report/reviews.csv")
    assert {r.review_id: r.reference for r in back.collect()} == {"1": "x | y", "2": None, "3": "one"}
    assert {r.review_id: r.review_body for r in back.collect()}["1"] == rows[0][1]


def test_metadata_of_a_data_set(spark):
    rows = [(str(i), ["bp-a"] if i % 3 else ["chat-b"], ["x"] if i % 4 else []) for i in range(12)] + [("none", ["other"], ["x"])]
    df = spark.createDataFrame(rows, "review_id string, ids array<string>, o array<string>")
    start = F.create_map().cast(L.LABELS)
    added = L.put(start, "bp-a", L._label(F.col("o"), F.lit("t"), F.array().cast("array<string>"), F.lit("{}")))
    other = L.put(start, "chat-b", L._label(F.col("o"), F.lit("t"), F.array().cast("array<string>"), F.lit("{}")))
    one = F.when(F.array_contains("ids", "bp-a"), added).when(F.array_contains("ids", "chat-b"), other).otherwise(start)
    found = ReviewSet(df.withColumn("labels", one).drop("ids", "o")).dataset_metadata(L.ByGlob("bp-*", "chat-*"))
    assert found == {"num_reviews": 12, "num_reviews_for_labels": {"bp-a": 8, "chat-b": 4}, "original_usage_split": 0.75}
    empty = ReviewSet(df.withColumn("labels", start).drop("ids", "o")).dataset_metadata(L.ByGlob("bp-*"))
    assert empty == {"num_reviews": 0, "num_reviews_for_labels": {}, "original_usage_split": 0.0}
