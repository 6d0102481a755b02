"""New manifests of a folder become review files as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.sources.manifests import line_run, read_manifest


def convert_arrivals(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    vendor: str,
    created_at: str,
    once: bool = True,
) -> StreamingQuery:
    """Each new file's reviews are appended to target, partitioned by file. A batch that is tried again overwrites its own folder.

    A batch is read once for the files' run names and once for the reviews, however many files it has."""
    lines = spark.readStream.text(source).select("value", F.input_file_name().alias("path"), F.input_file_block_start().alias("block"))

    def convert(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("place", F.struct("block", F.monotonically_increasing_id().alias("line")))
        runs = placed.groupBy("path").agg(F.min_by(line_run(), "place").alias("run"))  # the first line of each file tells
        named = batch.join(runs, "path").withColumn("file", F.element_at(F.split("path", "/"), -1))
        out = read_manifest(named, vendor, created_at, F.col("run"), keep=("file",)).withColumn("labels", F.to_json("labels"))
        out.write.mode("overwrite").partitionBy("file").parquet(f"{target}/batch={number}")

    writer = lines.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
