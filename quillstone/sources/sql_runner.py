"""SQL texts over the review table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators.cleaning import recast
from quillstone.sources.tables import read_table


def split_statements(text: str) -> list[str]:
    """Statements between semicolons that stand in no quotes and no comment; empty ones go."""
    out, start, i = [], 0, 0
    bare = []
    while i < len(text):
        c = text[i]
        if c in "'\"`":
            end = i + 1
            while end < len(text) and text[end] != c:
                end += 2 if text[end] == "\\" and c != "`" else 1
            bare.append(True)
            i = end + 1
        elif text.startswith("--", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
        elif c == ";":
            if bare:
                out.append(text[start:i].strip())
            start, bare, i = i + 1, [], i + 1
        else:
            if not c.isspace():
                bare.append(True)
            i += 1
    if bare:
        out.append(text[start:].strip())
    return out


def run_sql(spark: SparkSession, reviews: DataFrame | str, text: str, file_type: str = "parquet", view: str = "reviews") -> list[DataFrame]:
    """A DataFrame for each statement over the view `reviews`."""
    df = read_table(spark, reviews, file_type) if isinstance(reviews, str) else reviews
    recast(df).createOrReplaceTempView(view)
    return [spark.sql(s) for s in split_statements(text)]


def save_results(results: list[DataFrame], path: str) -> list[str]:
    """<path>_result_<i>.tsv for each result, each one file."""
    names = []
    for i, df in enumerate(results, 1):
        names.append(f"{path}_result_{i}.tsv")
        df.coalesce(1).write.option("sep", "\t").option("header", True).csv(names[-1])
    return names


def heads(results: list[DataFrame], n: int = 10) -> list[DataFrame]:
    return [df.limit(n) for df in results]
