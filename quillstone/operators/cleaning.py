"""Cleaning, filtering and enriching the raw review table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as X

#: Names and types of the raw table's columns.
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("marketplace", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("review_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_parent", T.StringType()),
        T.StructField("product_title", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("star_rating", T.ByteType()),
        T.StructField("helpful_votes", T.LongType()),
        T.StructField("total_votes", T.LongType()),
        T.StructField("vine", T.StringType()),
        T.StructField("verified_purchase", T.StringType()),
        T.StructField("review_headline", T.StringType()),
        T.StructField("review_body", T.StringType()),
        T.StructField("review_date", T.StringType()),
    ]
)
#: Categories that are labelled.
CATEGORIES = (
    "Camera", "Major Appliances", "Luggage", "Office Products", "Wireless", "Mobile_Electronics", "Baby", "Jewelry", "Lawn and Garden", "PC",
    "Tools", "Sports", "Grocery", "Home Entertainment", "Automotive", "Shoes", "Home Improvement", "Watches", "Toys", "Furniture",
    "Outdoors", "Home", "Electronics", "Beauty", "Kitchen", "Apparel", "Pet Products", "Musical Instruments",
)


def flag(column: Column) -> Column:
    """Y or N as 1 or 0; any other value is an error, null stays null."""
    return F.when(column == "Y", 1).when(column == "N", 0).when(
        column.isNotNull(),
        F.raise_error(F.concat(F.lit("neither Y nor N: "), column)),
    ).cast("tinyint")


def flags_to_numbers(df: DataFrame, columns: tuple[str, ...] = ("vine", "verified_purchase")) -> DataFrame:
    return df.withColumns({c: flag(F.col(c)) for c in columns})


def clean_bodies(df: DataFrame, body: str = "review_body") -> DataFrame:
    """The body without markup; the original moves to <body>_original. Bodies without a mark skip the parser."""
    marked = F.rlike(F.col(body), F.lit("[<&]"))
    plain = F.array_join(X.words(F.coalesce(F.col(body), F.lit(""))), " ")
    return df.withColumn(f"{body}_original", F.col(body)).withColumn(body, F.when(marked, X.html_to_text(F.col(body))).otherwise(plain))


def pre_process(df: DataFrame) -> DataFrame:
    return clean_bodies(flags_to_numbers(df))


def recast(df: DataFrame) -> DataFrame:
    """The raw columns in the types that SQL queries see: strings, and long numbers."""
    numbers = ("star_rating", "helpful_votes", "total_votes")
    return df.select(*[F.col(f.name).try_cast(
        "long" if f.name in numbers else "string",
    ).alias(f.name) for f in REVIEW_SCHEMA if f.name in df.columns])


def keep_categories(df: DataFrame, categories=CATEGORIES, column: str = "product_category") -> DataFrame:
    return df.filter(F.col(column).isin(*[c.strip() for c in categories]))


def category_of_file(df: DataFrame) -> DataFrame:
    """Adds file_category, told by file names like ..._us_<category>_v..."""
    return df.withColumn("file_category", F.regexp_extract(F.input_file_name(), "_us_(.+?)_v", 1))


def keep_word_counts(df: DataFrame, least: int = 0, most: int | None = None, body: str = "review_body") -> DataFrame:
    """Rows with a body of more than `least` and less than `most` words."""
    n = X.word_count(F.col(body))
    return df.filter(F.col(body).isNotNull() & (n > least) & (n < most if most is not None else F.lit(True)))


def drop_bots(df: DataFrame, most: int = 2, customer: str = "customer_id", day: str = "review_date", review: str = "review_id") -> DataFrame:
    """Without all rows of customers who wrote more than `most` reviews on some day. Rows without a customer stay."""
    bots = df.groupBy(customer, day).agg(F.count(review).alias("n")).filter((F.col("n") > most) & F.col(day).isNotNull()).select(customer).distinct()
    return df.join(bots, customer, "left_anti")


def verified_or_vine(df: DataFrame) -> DataFrame:
    return df.filter((F.col("verified_purchase") == 1) | (F.col("vine") == 1))


def filter_reviews(df: DataFrame, per_day: int = 30, least: int = 4, words: int = 400, categories=CATEGORIES) -> DataFrame:
    """Bots, categories, short bodies, cut to `words` words, verified or vine: in this order, as bots are counted on all rows."""
    out = df.transform(drop_bots, per_day).transform(keep_categories, categories).transform(keep_word_counts, least)
    return out.withColumn("review_body", X.truncate_words(F.col("review_body"), words)).transform(verified_or_vine)


def add_text_statistics(df: DataFrame, body: str = "review_body") -> DataFrame:
    c = F.col(body)
    counted = df.withColumns(
        {
            f"{body}_word_count": X.word_count(c),
            f"{body}_sent_count": X.sentence_count(c),
            f"{body}_char_count": X.char_count(c),
            f"{body}_lett_count": X.letter_count(c),
            f"{body}_usage_count": X.usage_count(c),
            "_syllables": X.syllable_count(c),
        }
    )
    # What follows from the counts is not counted again.
    n = {k: F.col(f"{body}_{k}_count") for k in ("word", "sent", "char", "lett", "usage")}
    derived = {
        f"{body}_avg_word_length": X.ratio(n["lett"], n["word"]),
        f"{body}_reading_time": X.seconds_to_read(n["char"]),
        f"{body}_usage_density": X.ratio(n["usage"], n["word"]),
        f"{body}_flesch_complexity": X.reading_ease(n["word"], n["sent"], F.col("_syllables")),
    }
    names = (
        "word_count",
        "sent_count",
        "char_count",
        "lett_count",
        "avg_word_length",
        "reading_time",
        "usage_count",
        "usage_density",
        "flesch_complexity",
    )
    return counted.withColumns(derived).select(*df.columns, *[f"{body}_{k}" for k in names])


def etl(df: DataFrame) -> DataFrame:
    """Raw rows to cleaned, filtered, enriched rows."""
    return df.transform(pre_process).transform(filter_reviews).transform(add_text_statistics)


def dedupe_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    columns = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return picked.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])


def rejoin(df: DataFrame, distinct: DataFrame, key: str) -> DataFrame:
    """Values found for distinct keys, given back to every row."""
    return df.join(distinct, key, "left")


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def has_comma_option(options: Column) -> Column:
    return F.exists(options, lambda x: F.contains(x, F.lit(",")))


def one_hot(df: DataFrame, columns: dict[str, list]) -> DataFrame:
    """Each column replaced by a 0/1 column for each of its values, named as the value."""
    return df.select(
        *[c for c in df.columns if c not in columns],
        *[(F.col(c) == F.lit(v)).cast("int").alias(str(v)) for c, vs in columns.items() for v in sorted(vs, key=str)],
    )


def review_features(category: Column, stars: Column, body: Column, options: Column) -> Column:
    """struct<category, stars, words, options, option_words>; words are cut at single spaces, empty ones count."""
    parts = lambda x: F.size(F.split(x, " ", -1))
    mean = F.when(F.size(options) > 0, F.aggregate(options, F.lit(0), lambda n, o: n + parts(o)) / F.size(options)).otherwise(F.lit(0.0))
    return F.struct(
        category.alias("category"),
        stars.try_cast("int").alias("stars"),
        parts(body).alias("words"),
        F.size(options).alias("options"),
        mean.alias("option_words"),
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
