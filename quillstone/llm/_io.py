"""Shared folder, materialised tables and small helpers that every operator uses."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none and all runs on one machine (as in tests) a local folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quillstone-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote, once all that was made from them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str):
    """(pyarrow file system, path) of a path or URI."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write an attempt-named file, then rename it: a retried or doubled task never leaves half a file under the name."""
    filesystem, path = open_fs(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with filesystem.open_output_stream(attempt) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    filesystem.move(attempt, path)
    return size


def read_range(uri: str, start: int, length: int) -> bytes:
    filesystem, path = open_fs(uri)
    with filesystem.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """Row slices of a batch whose texts hold about most_bytes (one longer text stands alone)."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def gathered(batches, column: str, most_bytes: int):
    """Batches of about most_bytes of texts, put together from smaller ones and cut from larger ones."""
    held, size = [], 0

    def together():
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        for part in slices(batch, column, most_bytes):
            own = part.column(column).nbytes
            if held and size + own > most_bytes:
                yield together()
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield together()


def bounded(df: DataFrame, rows: int = 2000) -> DataFrame:
    """df, with Arrow batches of the session held to so many rows: texts make long rows, and JVM and Python each hold a batch."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def give_back() -> None:
    """Memory that a worker no longer needs goes back to the system; workers live longer than tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(scan):
    """scan, with memory given back behind the last batch."""

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            give_back()

    return run


_worker: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """What an operator keeps in a Python worker from task to task. A worker keeps one operator's at a time, so memory
    doesn't add up over the stages of a pipeline."""
    others = [kept for name, kept in _worker.items() if name != operator and kept]
    for kept in others:
        kept.clear()
    if others:
        give_back()
    return _worker.setdefault(operator, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows; one of fewer splits than the cluster has cores is dealt out over them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
