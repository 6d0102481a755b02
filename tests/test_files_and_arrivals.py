"""Files of a stated size, many manifests in one pass, and samples that are the first of an order."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillstone.operators import sampling
from quillstone.sources import tables
from quillstone.streaming.manifests import convert_arrivals


@pytest.mark.parametrize("kind,suffix", [("parquet", ".parquet"), ("tsv", ".csv")])
def test_files_of_a_stated_size(spark, tmp_path, monkeypatch, kind, suffix):
    monkeypatch.setattr(tables, "SAMPLE_ROWS", 3000)
    noise = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.md5(F.concat_ws("-", "id", i))), "")
    for name, words in (("short", F.lit(1)), ("long", F.when(F.col("id") % 100 == 0, 200).otherwise(2))):
        df = spark.range(0, 20_000, 1, 2).select("id", noise(words.cast("int")).alias("text"))
        tables.write_table(df, f"{tmp_path}/{name}", kind, file_bytes=150_000)
        sizes = [os.path.getsize(f"{tmp_path}/{name}/{f}") for f in os.listdir(f"{tmp_path}/{name}") if f.endswith(suffix)]
        assert len(sizes) > 3 and all(80_000 < s < 220_000 for s in sizes) and 110_000 < sum(sizes) / len(sizes) < 190_000
        assert spark.read.option("sep", "\t").option("header", True).format("csv" if kind == "tsv" else kind).load(f"{tmp_path}/{name}").count() == 20_000
    tables.write_table(spark.range(0), f"{tmp_path}/none", kind)
    with pytest.raises(ValueError):
        tables.write_table(df, f"{tmp_path}/x", "orc")


def test_many_manifests_in_one_pass(spark, tmp_path):
    def line(review, run, option):
        content = json.dumps({"annotations": json.dumps({"annotations": [[]], "customUsageOptions": [[option]]})})
        workers = {"annotationsFromAllWorkers": [{"workerId": "w", "annotationData": {"content": content}}]}
        return json.dumps({"metadata": [{"review_id": review}], run: workers, f"{run}-metadata": {"job-name": run}})

    source = tmp_path / "in"
    source.mkdir()
    for k in range(12):
        (source / f"m{k}.manifest").write_text("\n".join(line(f"r{k}-{i}", f"run{k % 5}", f"o{i}") for i in range(3)) + "\n")
    convert_arrivals(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), "v", "2024-01-01T00:00:00Z").awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    found = {(r.file, r.review_id): json.loads(r.labels) for r in rows}
    assert set(found) == {(f"m{k}.manifest", f"r{k}-{i}") for k in range(12) for i in range(3)}
    for (file, review), labels in found.items():
        k, i = review[1:].split("-")
        assert [(name, x["usageOptions"]) for name, x in labels.items()] == [(f"aws-v-run{int(k) % 5}", [f"o{i}"])]


def test_samples_by_order_and_by_rank(spark, monkeypatch):
    df = spark.range(500).repartition(4)
    first = sorted(r.id for r in sampling.sample_n(df, 40, 3, "id").collect())
    monkeypatch.setattr(sampling, "TOP", 0)
    assert first == sorted(r.id for r in sampling.sample_n(df, 40, 3, "id").collect()) and len(first) == 40


def test_saved_documents_are_read_by_lines_and_others_whole(spark, tmp_path):
    """A document with a review a line is never one row; one laid out otherwise is still read; the last of a repeated id counts."""
    from quillstone.sources import documents

    label = '{"createdAt":"x","usageOptions":["%s"],"datasets":[],"metadata":"{}","scores":{},"augmentations":{}}'
    line = lambda k, body, option: f'"{k}":{{"review_body":"{body}","labels":{{"m":{label % option}}}}}'
    (tmp_path / "a.json").write_text("\n".join([documents.FIRST, line("1", "one", "p"), "," + line("2", "old", "q"), "," + line("2", "two", "r"), "}}", ""]))
    (tmp_path / "b.json").write_text(documents.FIRST + "\n" + line("3", "three", "s").replace(":{", ":\n{") + "}}")
    value = spark.read.text(str(tmp_path)).selectExpr("_metadata.file_name as file", "value")
    assert documents._laid_out(value) == (["a.json"], ["b.json"])
    rows = documents.read_documents(spark, str(tmp_path)).df.selectExpr("review_id", "review_body", "labels['m'].usageOptions as o").collect()
    assert sorted((r.review_id, r.review_body, *r.o) for r in rows) == [("1", "one", "p"), ("2", "two", "r"), ("3", "three", "s")]
    documents.save_documents(documents.read_documents(spark, str(tmp_path)), str(tmp_path / "back" / "c.json"))
    saved = spark.read.text(str(tmp_path / "back" / "c.json")).selectExpr("_metadata.file_name as file", "value")
    assert documents._laid_out(saved) == (["c.json"], [])
