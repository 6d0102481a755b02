"""A client that fails midway, and a second run that asks for what is missing."""

import json
import os

import pytest

from quillstone.operators import augmentation
from quillstone.operators import labels as L
from quillstone.operators.review_sets import ReviewSet


def reviews(spark, ids):
    rows = [(str(i), None if i == 3 else f"text {i}") for i in ids]
    df = spark.createDataFrame(rows, "review_id string, review_body string")
    return df.selectExpr("*", "map() AS m").drop("m").withColumn("labels", L.F.create_map().cast(L.LABELS))


def client(folder):
    """Options of a text are its words; every text asked for leaves a file. It fails at text 37 until told otherwise."""

    def label(texts):
        if "text 37" in texts and not os.path.exists(f"{folder}/mended"):
            raise RuntimeError("the service is down")
        for t in texts:
            with open(f"{folder}/asked", "a") as f:
                f.write(t + "\n")
        return [t.split() for t in texts]

    return label


def test_the_second_run_asks_for_the_rest(spark, tmp_path):
    df, progress = reviews(spark, range(60)), f"file://{tmp_path}/answers"
    how = {"label_id": "m", "created_at": "2024-01-01T00:00:00+00:00", "progress": progress, "share": 0.1, "batch": 2}
    how["metadata"] = augmentation.generation_metadata("a-model", "p1", temperature=0.5)
    with pytest.raises(Exception, match="the service is down"):
        augmentation.label_with_saves(df, client(tmp_path), **how)
    saved = {r.review_id for r in spark.read.parquet(progress).collect()}
    assert 0 < len(saved) < 60 and len(saved) % 6 == 0 and "37" not in saved
    (tmp_path / "asked").rename(tmp_path / "asked-first")
    (tmp_path / "mended").touch()
    out = ReviewSet(df).annotate(client(tmp_path), **how).df.collect()
    asked = (tmp_path / "asked").read_text().splitlines()
    assert sorted(asked) == sorted("" if i == 3 else f"text {i}" for i in range(60) if str(i) not in saved)
    assert {r.review_id: r.labels["m"].usageOptions for r in out} == {str(i): [] if i == 3 else ["text", str(i)] for i in range(60)}
    made = json.loads(out[0].labels["m"].metadata)["generator"]
    assert made == {"name": "a-model", "checkpoint": "last", "prompt_id": "p1", "config": {"temperature": 0.5}}
    # A third run, over more reviews and a repeated one, asks for the new ones alone.
    (tmp_path / "asked").rename(tmp_path / "asked-second")
    more = reviews(spark, [*range(62), 61])
    assert augmentation.label_with_saves(more, client(tmp_path), **how).count() == 63
    assert sorted((tmp_path / "asked").read_text().splitlines()) == ["text 60", "text 61"]


def test_how_often_answers_are_saved(spark, tmp_path):
    df = reviews(spark, range(10, 20))
    how = {"label_id": "m", "created_at": "2024-01-01T00:00:00+00:00", "batch": 4}
    for share, at_most, files in ((0.5, 500, 2), (1.0, 4, 3)):
        progress = f"file://{tmp_path}/{share}"
        out = augmentation.label_with_saves(df, lambda texts: [[t] for t in texts], progress=progress, share=share, at_most=at_most, **how)
        assert out.count() == 10
        jobs = {r[0].rsplit("/", 1)[1].split("-c0")[0][10:] for r in spark.read.parquet(progress).selectExpr("input_file_name()").collect()}
        assert len(jobs) == files
    assert augmentation.label_with_saves(df.limit(0), lambda texts: 1 / 0, progress=f"file://{tmp_path}/none", **how).collect() == []
