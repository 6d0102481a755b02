"""Crowd-labelling manifests: building tasks, reading results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import labels as L
from quillstone.operators import sampling

_CONTENT = "struct<annotations:string>"
_MARKS = "struct<annotations:array<array<struct<tokens:array<string>>>>,customUsageOptions:array<array<string>>>"


def line_run() -> Column:
    """Job name that a line tells: of the first value with a job-name."""
    value = F.from_json("value", "map<string,string>")
    found = F.map_values(F.map_filter(value, lambda _, v: F.get_json_object(v, "$['job-name']").isNotNull()))
    return F.get_json_object(F.get(found, F.lit(0)), "$['job-name']")


def run_name(lines: DataFrame) -> str:
    """Job name that the first line tells."""
    return lines.select(line_run()).first()[0]


def _workers(run: Column) -> Column:
    body = F.try_element_at(F.from_json("value", "map<string,string>"), run)
    return F.from_json(
        body,
        "struct<annotationsFromAllWorkers:array<struct<workerId:string,annotationData:struct<content:string>>>>",
    )["annotationsFromAllWorkers"]


def _tasks(lines: DataFrame, run: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """_line, _run, _reviews, worker, workerId, marks and kept columns: a row for each line and worker."""
    meta = F.from_json(F.get_json_object("value", "$.metadata"), "array<map<string,string>>")
    one = lines.select(F.monotonically_increasing_id().alias("_line"), run.alias("_run"), *keep, meta.alias("_reviews"), F.posexplode(_workers(run)).alias("worker", "_w"))
    content = F.from_json(F.from_json("_w.annotationData.content", _CONTENT)["annotations"], _MARKS)
    return one.select("_line", "_run", *keep, "_reviews", "worker", F.col("_w.workerId").alias("workerId"), content.alias("marks"))


def _options(i: Column) -> Column:
    custom = F.coalesce(F.get("marks.customUsageOptions", i), F.array().cast("array<string>"))
    spans = F.coalesce(F.get("marks.annotations", i), F.array().cast("array<struct<tokens:array<string>>>"))
    return F.concat(custom, F.transform(spans, lambda a: F.array_join(a["tokens"], " ")))


def read_manifest(lines: DataFrame, vendor: str, created_at: str, run: str | Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Reviews with one label aws-<vendor>-<run>; of several workers the first counts. run may be a column of the lines; columns
    named in keep stay."""
    run = run if isinstance(run, Column) else F.lit(run or run_name(lines))
    rows = _tasks(lines, run, keep).filter("worker = 0").select("*", F.posexplode("_reviews").alias("_i", "_r"))
    label = F.struct(
        F.lit(created_at).alias("createdAt"),
        _options(F.col("_i")).alias("usageOptions"),
        F.array().cast("array<string>").alias("datasets"),
        F.to_json(F.struct("workerId")).alias("metadata"),
        F.create_map().cast(L.SCORES).alias("scores"),
        F.create_map().cast(L.AUGMENTATIONS).alias("augmentations"),
    ).cast(L.LABEL)
    from quillstone.operators.review_sets import ATTRIBUTES

    get = lambda k: F.try_element_at("_r", F.lit(k)).alias(k)
    name = F.concat(F.lit(f"aws-{vendor}-"), F.coalesce("_run", F.lit("None")))
    return rows.select(*keep, get("review_id"), *[get(a) for a in ATTRIBUTES], F.create_map(name, label).alias("labels"))


def read_manifest_flat(lines: DataFrame, run: str | None = None) -> DataFrame:
    """review_id, workerId, usage_options: a row for every worker and review."""
    rows = _tasks(lines, F.lit(run or run_name(lines))).select("*", F.posexplode("_reviews").alias("_i", "_r"))
    return rows.select(F.try_element_at("_r", F.lit("review_id")).alias("review_id"), "workerId", _options(F.col("_i")).alias("usage_options"))


def build_manifest(
    df: DataFrame,
    per_task: int,
    id_column: str = "review_id",
    body: str = "review_body",
    most_tasks: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """task, source (bodies as a JSON text), metadata: chunks in an order drawn by hash, the last may be short; at most so many tasks."""
    place = sampling._rank(
        df,
        [sampling.draw(seed + 1, id_column), F.col(id_column)],
        [],
    ).withColumn("task", F.floor((F.col("_rank") - 1) / per_task))
    if most_tasks is not None:
        place = place.filter(F.col("task") < most_tasks)
    item = F.struct(sampling.draw(seed, id_column).alias("h"), F.col(id_column).cast("string").alias("id"), F.col(body).alias("b"))
    one = place.groupBy("task").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return one.select(
        "task",
        F.to_json(F.transform("items", lambda x: x["b"])).alias("source"),
        F.to_json(F.transform("items", lambda x: F.struct(x["id"].alias(id_column)))).alias("metadata"),
    )
