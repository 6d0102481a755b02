"""Raw review tables: tab-separated and Parquet, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.cleaning import REVIEW_SCHEMA


BAD = "_malformed"


def tsv_schema(flags_as_numbers: bool = False) -> T.StructType:
    kind = lambda f: T.ByteType() if flags_as_numbers and f.name in ("vine", "verified_purchase") else f.dataType
    return T.StructType([T.StructField(f.name, kind(f)) for f in REVIEW_SCHEMA])


def read_tsv(
    spark: SparkSession,
    path: str | list[str],
    flags_as_numbers: bool = False,
    schema: T.StructType | str | None = None,
    pattern: str = "*.tsv*",
) -> DataFrame:
    """Tab-separated files with a header line and no quoting; lines with too many columns or wrong types are dropped.

    A folder is read by its files of a name pattern (*.tsv), plain or compressed; several paths make one table. All columns are parsed
    whatever is asked for: a line counts as malformed by all of them, so counts and columns are of the same rows.
    """
    own = schema or tsv_schema(flags_as_numbers)
    own = T.StructType.fromDDL(own) if isinstance(own, str) else own
    names = [f.name for f in own]
    reader = spark.read.schema(
        T.StructType([*own, T.StructField(BAD, T.StringType())]),
    ).option("sep", "\t").option("header", True).option("quote", "")
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("enforceSchema", True)
    rows = reader.option("pathGlobFilter", pattern).csv(path)
    # True of every row, but it takes all columns to know.
    parsed = F.xxhash64(*[F.col(f"`{n}`") for n in names]) >= F.lit(-(1 << 63)).cast("long")
    return rows.filter(F.col(BAD).isNull() & parsed).select(*[F.col(f"`{n}`") for n in names])


def read_table(spark: SparkSession, path: str, file_type: str = "parquet") -> DataFrame:
    readers = {"parquet": lambda: spark.read.parquet(path), "tsv": lambda: read_tsv(spark, path)}
    if file_type not in readers:
        raise ValueError(f"file type {file_type} is neither parquet nor tsv")
    return readers[file_type]()


#: Rows whose files tell how many bytes a row takes.
SAMPLE_ROWS = 20_000


def planned_files(df: DataFrame, file_bytes: int, write) -> int:
    """How many files of about file_bytes the rows of df make, going by a sample of them that is written by write(rows, path)."""
    from quillstone.session import shared_path

    spark, n = df.sparkSession, df.count()
    path = shared_path(spark, "sample")
    write(df if n <= SAMPLE_ROWS else df.sample(SAMPLE_ROWS / n, seed=1), path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(folder).getLength()
    fs.delete(folder, True)
    return max(1, round(size * max(1.0, n / SAMPLE_ROWS) / file_bytes))


def write_table(
    df: DataFrame,
    path: str,
    file_type: str = "parquet",
    rows_per_file: int | None = None,
    mode: str = "errorifexists",
    file_bytes: int = 100_000_000,
) -> None:
    """Parquet files, or tab-separated files without quoting, of about file_bytes each, or of so many rows at most.

    By bytes, rows are dealt out evenly over as many files as a sample says, so neither long texts nor a skewed source make some
    files larger than others."""
    if file_type not in ("parquet", "tsv"):
        raise ValueError(f"file type {file_type} is neither parquet nor tsv")

    def write(rows: DataFrame, to: str, **how) -> None:
        writer = rows.write.mode(mode).options(**how)
        if file_type == "parquet":
            writer.parquet(to)
        else:
            writer.option("sep", "\t").option("header", True).option("quote", "").csv(to)

    if rows_per_file is not None:
        write(df, path, maxRecordsPerFile=rows_per_file)
    else:
        write(df.repartition(planned_files(df, file_bytes, lambda rows, to: write(rows.coalesce(1), to))), path)


def tsv_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    write_table(read_tsv(spark, source), target)


def missing_paths(urls: list[str], present: set[str]) -> list[str]:
    """Of listed files those not there yet, by their last name; fetching them is not this engine's work."""
    return [u for u in (x.strip() for x in urls) if u and u.rsplit("/", 1)[-1] not in present]


def write_clusters(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.option("header", True).csv(path)
