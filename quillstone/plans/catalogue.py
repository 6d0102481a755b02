"""Registered queries by name, with the DuckDB statement that must give the same rows.

Stand-ins: a document is a review (lang its category, source its product), an event is a dated
review of a customer, and two labels are made from the labels table (see labelled()).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import similarity as S
from quillstone.functions import text as X
from quillstone.operators import cleaning, scoring, significance
from quillstone.operators import labels as L
from quillstone.operators import review_sets as R
from quillstone.operators import sampling as P
from quillstone.operators import statistics as A

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    from quillstone.plans import catalogue_calls, catalogue_models, catalogue_more  # noqa: F401  register their queries

    return dict(_found)


def oracles() -> dict[str, str]:
    queries()
    return dict(_sql)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


# -- words, cleaning, filters ------------------------------------------------------------------

W = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(f"""SELECT lang, count(*) AS n, round(avg(c), 6) AS mean_words, round(stddev_samp(c), 6) AS std_words
        FROM (SELECT lang, len({W})::BIGINT AS c FROM documents) WHERE c > 4 AND c < 400 GROUP BY lang""")
def word_count_range(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").transform(cleaning.keep_word_counts, 4, 400, "text")
    cut = docs.select("lang", X.word_count(X.truncate_words(F.col("text"), 400)).alias("c"))
    return rounded(
        cut.groupBy("lang").agg(F.count("*").alias("n"), F.avg("c").alias("mean_words"), F.stddev_samp("c").alias("std_words")),
        "mean_words",
        "std_words",
    )


@query(f"SELECT doc_id, array_to_string(list_slice({W}, 1, 20), ' ') AS body FROM documents")
def truncate_words(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.truncate_words(F.col("text"), 20).alias("body"))


_CHARS = r"length(regexp_replace(text, '\s', '', 'g'))::BIGINT"
_LETTERS = r"length(regexp_replace(text, '[\s!-/:-@\[-`{-~]', '', 'g'))::BIGINT"
_USES = " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in X.USAGE_INDICATORS)


@query(f"""SELECT doc_id, n AS words, c AS chars, l AS letters, round(CASE WHEN n = 0 THEN 0 ELSE l / n END, 6) AS avg_word_length,
        round(c * 14.69::DOUBLE / 1000, 2) AS reading_time, u AS uses, round(CASE WHEN n = 0 THEN 0 ELSE u / n END, 6) AS usage_density
        FROM (SELECT doc_id, len({W})::BIGINT AS n, {_CHARS} AS c, {_LETTERS} AS l, ({_USES})::BIGINT AS u FROM (SELECT *, lower(text) AS t FROM documents))""")
def enrich_text_stats(spark, sf_dir):
    rows = cleaning.add_text_statistics(load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("b")), "b")
    names = {
        "word_count": "words",
        "char_count": "chars",
        "lett_count": "letters",
        "avg_word_length": "avg_word_length",
        "reading_time": "reading_time",
        "usage_count": "uses",
        "usage_density": "usage_density",
    }
    return rounded(rows.select("doc_id", *[F.col(f"b_{k}").alias(v) for k, v in names.items()]), "avg_word_length", "usage_density")


@query(f"SELECT lang, sum({_USES})::BIGINT AS uses FROM (SELECT lang, lower(text) AS t FROM documents) GROUP BY lang")
def usage_indicator_count(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(X.usage_count(F.col("text"))).alias("uses"))


_SYLLABLES = """greatest(1, len(list_filter(string_split_regex(CASE WHEN regexp_matches(c, '[^aeiouy]e$') THEN left(c, length(c) - 1) ELSE c END, '[^aeiouy]+'), lambda v: v <> '')))"""


@query(rf"""WITH w AS (SELECT doc_id, text, {W} AS w FROM documents),
        s AS (SELECT doc_id, len(w) AS n, greatest(1, len(list_filter(string_split_regex(text, '[.!?]+(\s+|$)'), lambda p: len(list_filter(string_split_regex(p, '\s+'), lambda x: x <> '')) > 2)))::BIGINT AS sentences,
            list_sum(list_transform(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda c: {_SYLLABLES})) AS y FROM w)
        SELECT doc_id, sentences, coalesce(y, 0)::BIGINT AS syllables, CASE WHEN n = 0 THEN 0 ELSE round(206.835::DOUBLE - 1.015::DOUBLE * (n / sentences) - 84.6::DOUBLE * (y / n), 2) END AS flesch FROM s""")
def readability(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        X.sentence_count(t).alias("sentences"),
        X.syllable_count(t).alias("syllables"),
        X.flesch_reading_ease(t).alias("flesch"),
    )


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def category_filter(spark, sf_dir):
    return cleaning.keep_categories(load(spark, sf_dir, "documents"), ("en ", "de"), "lang").select("doc_id", "lang")


@query("SELECT doc_id, quality::BIGINT AS verified_purchase, toxic::BIGINT AS vine FROM labels WHERE quality = 1 OR toxic = 1")
def verified_filter(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "Y").otherwise("N").alias("verified_purchase"),
        F.when(F.col("toxic") == 1, "Y").otherwise("N").alias("vine"),
    )
    return cleaning.verified_or_vine(cleaning.flags_to_numbers(rows)).select(
        "doc_id",
        F.col("verified_purchase").cast("long").alias("verified_purchase"),
        F.col("vine").cast("long").alias("vine"),
    )


_BOTS = "SELECT user_id FROM (SELECT user_id, ts::DATE AS d, count(*) AS n FROM events GROUP BY ALL) WHERE n > 2"


def _dated(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


@query(f"SELECT event_id, user_id FROM events WHERE user_id NOT IN ({_BOTS})")
def bot_filter(spark, sf_dir):
    return cleaning.drop_bots(_dated(spark, sf_dir), 2, "user_id", "day", "event_id").select("event_id", "user_id")


@query(f"SELECT count(*) AS n FROM events WHERE user_id IN ({_BOTS})")
def bot_review_count(spark, sf_dir):
    events = _dated(spark, sf_dir)
    bots = events.groupBy("user_id", "day").agg(F.count("*").alias("n")).filter("n > 2").select("user_id").distinct()
    return events.join(bots, "user_id", "left_semi").agg(F.count("*").alias("n"))


@query(f"""SELECT d.doc_id::VARCHAR AS review_id, array_to_string(list_slice({W}, 1, 400), ' ') AS review_body
        FROM documents d JOIN labels l USING (doc_id) WHERE lang IN ('en', 'fr') AND len({W}) > 4 AND (quality = 1 OR toxic = 1)
        AND source NOT IN (SELECT source FROM (SELECT source, lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) WHERE n > 18)""")
def filter_pipeline(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.col("text").alias("review_body"),
        F.col("lang").alias("product_category"),
        F.col("source").alias("customer_id"),
        F.col("lang").alias("review_date"),
        F.col("quality").alias("verified_purchase"),
        F.col("toxic").alias("vine"),
    )
    return cleaning.filter_reviews(rows, per_day=18, categories=("en", "fr")).select("review_id", "review_body")


@query()
def html_to_text(spark, sf_dir):
    return cleaning.clean_bodies(load(spark, sf_dir, "pages").withColumnRenamed("html", "review_body")).select("page_id", "review_body")


@query(f"SELECT text, first(doc_id ORDER BY doc_id) AS doc_id, first(source ORDER BY doc_id) AS source FROM documents GROUP BY text")
def dedupe_first(spark, sf_dir):
    return cleaning.dedupe_first(load(spark, sf_dir, "documents").select("doc_id", "text", "source"), "text", ["doc_id"])


@query("SELECT d.doc_id, k.first_id FROM documents d LEFT JOIN (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text) k USING (text)")
def rejoin_duplicates(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    firsts = cleaning.dedupe_first(docs, "text", ["doc_id"]).withColumnRenamed("doc_id", "first_id")
    return cleaning.rejoin(docs, firsts, "text").select("doc_id", "first_id")


@query("SELECT event_id, (event_type = 'click')::INT AS click, (event_type = 'error')::INT AS error, (event_type = 'purchase')::INT AS purchase, (event_type = 'signup')::INT AS signup, (event_type = 'view')::INT AS view FROM events")
def one_hot(spark, sf_dir):
    return cleaning.one_hot(
        load(spark, sf_dir, "events").select("event_id", "event_type"),
        {"event_type": ["signup", "purchase", "error", "view", "click"]},
    )


_PHRASES = f"list_slice(list_sort(list_distinct(list_filter(list_transform({W}, lambda w: lower(w)), lambda w: length(w) >= 8))), 1, 5)"


def phrases(text: str = "text"):
    text = F.col(text)
    return F.slice(F.array_sort(F.array_distinct(F.filter(X.words(F.lower(text)), lambda w: F.length(w) >= 8))), 1, 5)


@query(f"""SELECT doc_id, lang AS category, (n_chars % 5 + 1)::INT AS stars, len(string_split(text, ' '))::INT AS words, len(o)::INT AS options,
        CASE WHEN len(o) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS option_words FROM (SELECT *, {_PHRASES} AS o FROM documents)""")
def review_features(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("o", phrases())
    return docs.select(
        "doc_id",
        cleaning.review_features(F.col("lang"), (F.col("n_chars") % 5 + 1).cast("string"), F.col("text"), F.col("o")).alias("v"),
    ).select("doc_id", "v.*")


# -- statistics --------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def group_size_1(spark, sf_dir):
    return A.group_sizes(load(spark, sf_dir, "events"), ["event_type"])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def group_size_2(spark, sf_dir):
    return A.group_sizes(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT size, count(*) AS keys FROM (SELECT o_custkey, count(o_orderkey) AS size FROM orders GROUP BY 1) GROUP BY size")
def count_of_counts(spark, sf_dir):
    return A.count_of_counts(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("SELECT most, count(*) AS keys FROM (SELECT user_id, max(n) AS most FROM (SELECT user_id, ts::DATE AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1) GROUP BY most")
def max_per_day_hist(spark, sf_dir):
    return A.busiest_day_counts(_dated(spark, sf_dir), "user_id", "day", "event_id")


def _describe_sql(table: str, columns: list[str], where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max FROM {table} WHERE {where}" for c in columns
    )


_NUMBERS = ("mean", "std", "min", "p25", "p50", "p75", "max")


@query(_describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def describe_all(spark, sf_dir):
    return rounded(A.describe(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), *_NUMBERS)


@query(_describe_sql("orders", ["o_totalprice"], "o_orderstatus = 'F'"))
def describe_subset(spark, sf_dir):
    return rounded(A.describe(load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), ["o_totalprice"]), *_NUMBERS)


_PAIRS = [
    ("l_quantity", "l_extendedprice"),
    ("l_quantity", "l_discount"),
    ("l_quantity", "l_tax"),
    ("l_extendedprice", "l_discount"),
    ("l_extendedprice", "l_tax"),
    ("l_discount", "l_tax"),
]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def corr_matrix(spark, sf_dir):
    return rounded(A.correlations(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "r")


@query("SELECT count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem")
def distinct_counts(spark, sf_dir):
    return A.distinct_counts(load(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT sum(CASE WHEN size > 20 THEN size * keys ELSE 0 END)::BIGINT AS over_20, sum(CASE WHEN size > 10 THEN size * keys ELSE 0 END)::BIGINT AS over_10,
        sum(CASE WHEN size < 5 THEN size * keys ELSE 0 END)::BIGINT AS below_5
        FROM (SELECT size, count(*) AS keys FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) GROUP BY 1)""")
def tail_sums(spark, sf_dir):
    return A.tail_sums(A.count_of_counts(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey"), (20, 10), 5)


@query("""SELECT grouping_id(lang, source, quality, toxic)::BIGINT AS subset, lang, source, quality::INT AS quality, toxic::INT AS toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS most_chars
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY CUBE (lang, source, quality, toxic) HAVING grouping_id(lang, source, quality, toxic) < 15""")
def cube_describe(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(
        A.power_set(
            rows,
            ["lang", "source", "quality", "toxic"],
            [F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"), F.max("n_chars").alias("most_chars")],
        ),
        "mean_chars",
    )


@query("SELECT year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def yearly_totals(spark, sf_dir):
    return A.yearly_totals(load(spark, sf_dir, "orders"), "o_orderdate", F.round(F.sum("o_totalprice"), 2))


@query("SELECT event_type, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def value_share(spark, sf_dir):
    return rounded(A.value_share(load(spark, sf_dir, "events"), "event_type"), "share")


@query("SELECT lang, source, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY 1, 2")
def value_share_within(spark, sf_dir):
    return rounded(A.value_share(load(spark, sf_dir, "documents"), "source", ["lang"]), "share")


@query(f"SELECT lang, round(avg(len({_PHRASES})), 6) AS expected FROM documents GROUP BY lang")
def expected_value(spark, sf_dir):
    return rounded(load(spark, sf_dir, "documents").groupBy("lang").agg(F.avg(F.size(phrases())).alias("expected")), "expected")


def _gap_sql(key: str) -> str:
    return f"SELECT event_id, round(date_diff('microsecond', lag(ts) OVER w, ts) / 1e6, 6) AS gap FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)"


@query(_gap_sql("user_id"))
def time_diff_customer(spark, sf_dir):
    return rounded(A.gaps(load(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "gap"), "gap")


@query(_gap_sql("event_type"))
def time_diff_product(spark, sf_dir):
    return rounded(A.gaps(load(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_id", "gap"), "gap")


@query("""WITH c AS (SELECT size, count(*) AS keys FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) GROUP BY 1),
        e AS (SELECT list_sort(list_distinct(quantile_cont(size, [0, .2, .4, .6, .8, 1]))) AS edges FROM (SELECT DISTINCT size::DOUBLE AS size FROM c)),
        b AS (SELECT *, greatest(1, len(list_filter(edges, lambda x: x < size)))::INT AS bucket FROM c, e)
        SELECT bucket, round(edges[bucket], 6) AS low, round(edges[bucket + 1], 6) AS high, sum(keys)::BIGINT AS total FROM b GROUP BY 1, 2, 3""")
def qcut_counts(spark, sf_dir):
    return rounded(A.equal_frequency_counts(A.count_of_counts(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey"), 5), "low", "high")


@query(f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN gap <= -0.001 THEN NULL WHEN gap <= 0 THEN 0 WHEN gap <= 86400 THEN 1 WHEN gap <= 172800 THEN 2 WHEN gap <= 259200 THEN 3
        WHEN gap <= 345600 THEN 4 WHEN gap <= 432000 THEN 5 WHEN gap <= 518400 THEN 6 WHEN gap > 518400 THEN 7 END AS bucket FROM ({_gap_sql("user_id")})) GROUP BY 1""")
def cut_counts(spark, sf_dir):
    rows = A.gaps(load(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return rows.groupBy(A.fixed_bucket(F.col("gap")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""SELECT name, count(*) AS n, list_position(['very short', 'short', 'medium', 'long', 'very long'], name)::BIGINT AS place FROM (SELECT CASE WHEN n <= 15 THEN 'very short' WHEN n <= 25 THEN 'short' WHEN n <= 40 THEN 'medium'
        WHEN n <= 90 THEN 'long' WHEN n <= 100000 THEN 'very long' END AS name FROM (SELECT len({W}) AS n FROM documents)) GROUP BY name ORDER BY place""")
def length_category(spark, sf_dir):
    name = A.length_class(X.word_count(F.col("text"))).alias("name")
    out = load(spark, sf_dir, "documents").groupBy(name).agg(F.count("*").alias("n"))
    return out.withColumn("place", A.class_order(F.col("name"), [n for n, *_ in A.LENGTHS])).orderBy("place")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
def heavy_customer_join(spark, sf_dir):
    return A.busy_rows(load(spark, sf_dir, "orders"), "o_custkey", 12).select("o_orderkey", "o_custkey")


@query("SELECT user_id, round(avg(exp(-value)), 6) AS confidence, round(stddev_samp(exp(-value)), 6) AS variability, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id")
def loss_stats(spark, sf_dir):
    log = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("mode"), F.col("value").alias("loss"))
    return rounded(A.loss_statistics(log, "click", ("user_id",)), "confidence", "variability")


@query(f"""SELECT round(avg(n), 6) AS mean, list_sort(list(n))[count(*) // 2 + 1] AS median, min(n) AS least, max(n) AS most, count(*) FILTER (n > 300) AS over FROM (SELECT len({W})::BIGINT AS n FROM documents)""")
def token_length_stats(spark, sf_dir):
    return rounded(A.token_length_statistics(load(spark, sf_dir, "documents").select(X.word_count(F.col("text")).alias("n")), "n", 300), "mean")


@query("SELECT lang, count(*) AS num_reviews, round_even(avg(quality::DOUBLE), 3) AS usage_share FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def dataset_metadata(spark, sf_dir):
    return A.dataset_metadata(load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id"), "lang", "quality")


# -- labels and review sets ---------------------------------------------------------------------

_LABELLED = f"""(SELECT d.doc_id::VARCHAR AS review_id, d.doc_id, text, lang, source, quality, toxic,
        CASE WHEN quality = 1 THEN {_PHRASES} ELSE [] END AS gold, CASE WHEN toxic = 0 THEN list_slice({_PHRASES}, 1, 3) ELSE [] END AS pred FROM documents d JOIN labels USING (doc_id))"""


def labelled(spark, sf_dir) -> DataFrame:
    """Reviews with labels bp-golden (options of good documents; dataset gold) and chat_gpt-v1 (up to three options of
    clean documents; datasets train, and gold for odd ids)."""
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").withColumn("_o", phrases())
    none = F.array().cast("array<string>")
    when, meta = F.lit("2024-01-01T00:00:00+00:00"), F.lit("{}")
    gold = F.when(F.col("quality") == 1, F.col("_o")).otherwise(none)
    pred = F.when(F.col("toxic") == 0, F.slice("_o", 1, 3)).otherwise(none)
    empty = F.create_map().cast(L.LABELS)
    labels = L.add_label(empty, "bp-golden", gold, when, F.array(F.lit("gold")), meta)
    labels = L.add_label(
        labels,
        "chat_gpt-v1",
        pred,
        when,
        F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("train"), F.lit("gold"))).otherwise(F.array(F.lit("train"))),
        meta,
    )
    null = F.lit(None).cast("string")
    own = {
        "product_id": F.col("source"),
        "product_category": F.col("lang"),
        "star_rating": (F.col("n_chars") % 5 + 1).cast("string"),
        "review_body": F.col("text"),
    }
    return rows.select(F.col("doc_id").cast("string").alias("review_id"), *[own.get(a, null).alias(a) for a in R.ATTRIBUTES], labels.alias("labels"))


@query("SELECT doc_id::VARCHAR AS review_id, 'chat_gpt-v1,bp-golden,chat_gpt-v1' AS ids FROM labels")
def label_select_glob(spark, sf_dir):
    return labelled(spark, sf_dir).select("review_id", F.array_join(L.ByGlob("chat*", "*-[gv]*").ids(F.col("labels")), ",").alias("ids"))


@query("SELECT doc_id::VARCHAR AS review_id, CASE WHEN doc_id % 2 = 1 THEN 'bp-golden,chat_gpt-v1' ELSE 'bp-golden' END AS ids FROM labels")
def label_select_dataset(spark, sf_dir):
    return labelled(spark, sf_dir).select("review_id", F.array_join(L.ByDataset("gold").ids(F.col("labels")), ",").alias("ids"))


@query(f"SELECT review_id, CASE WHEN (len(gold) > 0) <> (len(pred) > 0) THEN 'both' WHEN len(gold) > 0 THEN 'usage' ELSE 'no_usage' END AS kind, len(gold) > 0 AS has_usage FROM {_LABELLED}")
def label_type(spark, sf_dir):
    every = L.ByGlob("*")
    return labelled(spark, sf_dir).select(
        "review_id",
        L.label_type(F.col("labels"), every).alias("kind"),
        L.has_usage(F.col("labels"), every).alias("has_usage"),
    )


@query(f"""SELECT * FROM (SELECT 'bp-golden' AS label_id, count(*) AS count, 1.0::DOUBLE AS share FROM labels UNION ALL SELECT 'chat_gpt-v1', count(*), 1.0::DOUBLE FROM labels)""")
def label_coverage(spark, sf_dir):
    return L.label_coverage(labelled(spark, sf_dir))


@query(f"SELECT review_id, label_id, pos::INT AS pos, option AS usage_option FROM (SELECT review_id, 'chat_gpt-v1' AS label_id, generate_subscripts(pred, 1) - 1 AS pos, unnest(pred) AS option FROM {_LABELLED})")
def remove_label(spark, sf_dir):
    return L.usage_long(L.delete_labels(labelled(spark, sf_dir), ["bp-golden"]))


@query(f"SELECT review_id, 'bp-golden' AS label_id, array_to_string(gold, ';') AS options FROM {_LABELLED}")
def extract_labels(spark, sf_dir):
    return L.labels_long(L.extract_labels(labelled(spark, sf_dir), ["bp-golden"])).select(
        "review_id",
        "label_id",
        F.array_join("usage_options", ";").alias("options"),
    )


@query(f"SELECT review_id, array_to_string(pred, ';') AS options FROM {_LABELLED}")
def merge_labels(spark, sf_dir):
    merged = labelled(spark, sf_dir).withColumn("labels", L.merge_labels_into(F.col("labels"), ["chat*", "bp*"], "merged"))
    return merged.select("review_id", F.array_join(L.usage_options(F.col("labels"), "merged"), ";").alias("options"))


@query(f"SELECT review_id, array_to_string(list_filter(pred, lambda x: NOT regexp_matches(x, '^.*(tion|ing).*$')), ';') AS options FROM {_LABELLED} WHERE len(list_filter(pred, lambda x: regexp_matches(x, '^.*(tion|ing).*$'))) > 0")
def correct_pattern(spark, sf_dir):
    fixed = L.correct_by_pattern(F.col("labels"), ["*tion*", "*ing*"], F.lit("2024-01-02T00:00:00+00:00"))
    out = labelled(spark, sf_dir).withColumn("labels", fixed).filter(F.map_contains_key("labels", "bp-chat_gpt_correction"))
    return out.select("review_id", F.array_join(L.usage_options(F.col("labels"), "bp-chat_gpt_correction"), ";").alias("options"))


@query(f"SELECT review_id, len(list_filter(gold, lambda x: contains(x, ','))) > 0 AS corrupt FROM {_LABELLED}")
def comma_corruption(spark, sf_dir):
    return labelled(spark, sf_dir).select("review_id", cleaning.has_comma_option(L.usage_options(F.col("labels"), "bp-golden")).alias("corrupt"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_minus(spark, sf_dir):
    docs, marked = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return R.minus(
        docs.withColumnRenamed("doc_id", "review_id"),
        marked.withColumnRenamed("doc_id", "review_id"),
    ).select(F.col("review_id").alias("doc_id"))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_common, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_new")
def common_count(spark, sf_dir):
    docs, marked = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return R.common_and_new(marked.withColumnRenamed("doc_id", "review_id"), docs.withColumnRenamed("doc_id", "review_id"))


def _halves(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    a = L.extract_labels(rows.filter(F.col("review_id").cast("long") % 3 < 2), ["bp-golden"])
    return a, rows.filter(F.col("review_id").cast("long") % 3 > 0).withColumn("review_body", F.lit("other"))


@query(f"SELECT review_id, CASE WHEN doc_id % 3 < 2 THEN text ELSE 'other' END AS review_body, CASE WHEN doc_id % 3 = 0 THEN 'bp-golden' ELSE 'bp-golden,chat_gpt-v1' END AS ids FROM {_LABELLED}")
def union_merge(spark, sf_dir):
    return R.merge(*_halves(spark, sf_dir)).select("review_id", "review_body", F.array_join(F.array_sort(F.map_keys("labels")), ",").alias("ids"))


@query(f"SELECT review_id, CASE WHEN doc_id % 3 = 0 THEN 'bp-golden' ELSE 'bp-golden,chat_gpt-v1' END AS ids FROM {_LABELLED} WHERE doc_id % 3 < 2")
def merge_known_only(spark, sf_dir):
    return R.merge(*_halves(spark, sf_dir), allow_new=False).select("review_id", F.array_join(F.array_sort(F.map_keys("labels")), ",").alias("ids"))


@query("""SELECT label_id, count(*) AS reviews, count(*) FILTER (doc_id % 3 = 2) AS new_reviews, count(*) FILTER (doc_id % 3 = 1 AND label_id = 'bp-golden') AS overlap
        FROM labels, (VALUES ('bp-golden'), ('chat_gpt-v1')) v(label_id) WHERE doc_id % 3 > 0 GROUP BY 1""")
def merge_report(spark, sf_dir):
    return R.merge_report(*_halves(spark, sf_dir))


@query("SELECT NULL::VARCHAR AS review_id, NULL::VARCHAR AS rule WHERE false")
def validate_documents(spark, sf_dir):
    return R.violations(labelled(spark, sf_dir))


# -- sampling ------------------------------------------------------------------------------------


def _draw_sql(seed: int, key: str = "doc_id") -> str:
    return f"md5('{seed}:' || {key}::VARCHAR)"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_draw_sql(7)}, doc_id) <= (SELECT least(count(*) - 1, greatest(1, floor(count(*) * 0.3::DOUBLE))) FROM documents) AS in_first FROM documents")
def split_exact(spark, sf_dir):
    return P.split(load(spark, sf_dir, "documents").select("doc_id"), 0.3, 7, "doc_id")


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {_draw_sql(7)}, doc_id) <= least(n - 1, greatest(1, floor(n * 0.3::DOUBLE))) AS in_first FROM (SELECT *, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def stratified_split(spark, sf_dir):
    return P.split(load(spark, sf_dir, "labels"), 0.3, 7, "doc_id", ["quality"]).select("doc_id", "in_first")


@query("""SELECT doc_id, CASE WHEN p < (n * 7) // 10 THEN 'train' WHEN p < (n * 9) // 10 THEN 'test' ELSE 'val' END AS part
        FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, quality, toxic ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang, quality, toxic) AS n FROM documents JOIN labels USING (doc_id))""")
def ttv_split(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return P.train_test_val(rows, ["lang", "quality", "toxic"], "doc_id").select("doc_id", "part")


@query(f"""WITH c AS (SELECT count(*) FILTER (quality = 1) AS y, count(*) FILTER (quality = 0) AS n FROM labels)
        SELECT doc_id FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_draw_sql(3)}, doc_id) AS k FROM labels), c
        WHERE k <= CASE WHEN quality = 1 THEN least(y, round_even(n / 0.5::DOUBLE * 0.5::DOUBLE, 0)) ELSE least(n, round_even(y / 0.5::DOUBLE * 0.5::DOUBLE, 0)) END""")
def reduce_split(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").withColumn("good", F.col("quality") == 1)
    return P.reduce_to_share(rows, "good", 0.5, 3, "doc_id").select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {_draw_sql(5)}, doc_id) AS k FROM documents) WHERE k <= 160 // (4 * 20)")
def sample_two_level(spark, sf_dir):
    return P.sample_two_level(load(spark, sf_dir, "documents"), 160, "lang", "source", 5, "doc_id", levels=(4, 20)).select("doc_id")


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {_draw_sql(5)}, doc_id) AS k, count(*) OVER (PARTITION BY lang, source) AS b, count(*) OVER () AS t FROM documents) WHERE k <= floor(200 * b / t)""")
def sample_proportional(spark, sf_dir):
    return P.sample_two_level(load(spark, sf_dir, "documents"), 200, "lang", "source", 5, "doc_id", False, False, levels=(4, 20)).select("doc_id")


@query(f"SELECT doc_id, ntile(7) OVER (ORDER BY {_draw_sql(5)}, doc_id) AS part FROM documents")
def array_split(spark, sf_dir):
    return P.array_split(load(spark, sf_dir, "documents").select("doc_id"), 7, [P.draw(5, "doc_id"), F.col("doc_id")])


@query(f"SELECT doc_id FROM documents ORDER BY {_draw_sql(9)}, doc_id LIMIT 50")
def sample_n(spark, sf_dir):
    return P.sample_n(load(spark, sf_dir, "documents"), 50, 9, "doc_id").select("doc_id")


@query("""WITH c AS (SELECT source AS cluster, count(*) AS size FROM documents GROUP BY 1)
        SELECT cluster, size FROM (SELECT *, coalesce(sum(size) OVER (ORDER BY size, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(size) OVER () AS t FROM c) WHERE b / t < 0.2""")
def outlier_budget(spark, sf_dir):
    return P.within_budget(load(spark, sf_dir, "documents").groupBy(F.col("source").alias("cluster")).agg(F.count("*").alias("size")), 0.2)


# -- similarity and scores --------------------------------------------------------------------------

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_PAIRED = "embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id"


def _vector_pairs(spark, sf_dir):
    """Every fiftieth vector is asked for; all vectors of its label answer."""
    vectors = load(spark, sf_dir, "embeddings")
    a = vectors.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    return a.join(vectors.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "label").filter("a <> b")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS sim FROM {_PAIRED}")
def cosine_pairs(spark, sf_dir):
    return rounded(_vector_pairs(spark, sf_dir).select("a", "b", S.cosine(F.col("x"), F.col("y")).alias("sim")), "sim")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round(1 - sqrt(greatest(0, 2 - 2 * {_COS})) / 2, 6) AS sim FROM {_PAIRED}")
def euclid_pairs(spark, sf_dir):
    return rounded(_vector_pairs(spark, sf_dir).select("a", "b", S.euclidean_similarity(F.col("x"), F.col("y")).alias("sim")), "sim")


@query(f"SELECT a, arg_max(b, (s, b)) AS b, round(max(s), 6) AS sim FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS s FROM {_PAIRED}) WHERE s >= 0.1 GROUP BY a")
def most_similar(spark, sf_dir):
    found = cosine_rows_of_vectors(spark, sf_dir, best=0.1, other=True)
    return rounded(S.best_of(found.select("a", "b", F.col("cosine").alias("sim")), ["a"], "b", "sim", 0.1), "sim")


def cosine_rows_of_vectors(spark, sf_dir, best=None, other=False):
    """(a, b, cosine): every fiftieth vector with all vectors of its label, or all others."""
    vectors = load(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("phrase"), "embedding")
    found = scoring.cosine_rows(vectors.filter("phrase % 50 = 0"), vectors, "label", best, other)
    return found.select(F.col("prediction").alias("a"), F.col("reference").alias("b"), "cosine")


def _phrase_bests(spark, sf_dir):
    """Vectors as phrases: every fiftieth is a prediction of its label, all others are its references."""
    vectors = load(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("phrase"), "embedding")
    return scoring.best_similarities(vectors.filter("phrase % 50 = 0"), vectors.filter("phrase % 50 <> 0"), "label")


_PHRASE_PAIRS = f"(SELECT a.label, a.vec_id AS p, b.vec_id AS r, {_COS} AS s FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0)"


def _set_sql(agg: str) -> str:
    return f"""SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM
        (SELECT label, {agg}(s) AS p FROM (SELECT label, p, max(s) AS s FROM {_PHRASE_PAIRS} GROUP BY 1, 2) GROUP BY 1) JOIN
        (SELECT label, {agg}(s) AS r FROM (SELECT label, r, max(s) AS s FROM {_PHRASE_PAIRS} GROUP BY 1, 2) GROUP BY 1) USING (label)"""


@query(_set_sql("avg"))
def set_scores_mean(spark, sf_dir):
    return rounded(scoring.scores_of_bests(_phrase_bests(spark, sf_dir), "label"), "precision", "recall", "f1")


@query(_set_sql("min"))
def set_scores_min(spark, sf_dir):
    return rounded(scoring.scores_of_bests(_phrase_bests(spark, sf_dir), "label", "min"), "precision", "recall", "f1")


@query(f"""SELECT label, tp, fn, fp FROM (SELECT label, count(*) FILTER (m) AS tp, count(*) FILTER (NOT m) AS fn FROM (SELECT label, r, bool_or(s >= 0.25) AS m FROM {_PHRASE_PAIRS} GROUP BY 1, 2) GROUP BY 1)
        JOIN (SELECT label, count(*) FILTER (NOT m) AS fp FROM (SELECT label, p, bool_or(s >= 0.25) AS m FROM {_PHRASE_PAIRS} GROUP BY 1, 2) GROUP BY 1) USING (label)""")
def threshold_classification(spark, sf_dir):
    return scoring.classes_of_bests(_phrase_bests(spark, sf_dir), "label", 0.25)


def _flags(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        F.col("doc_id").cast("string").alias("review_id"),
        "lang",
        (F.col("toxic") == 0).alias("pred_pos"),
        (F.col("quality") == 1).alias("ref_pos"),
        (F.col("n_chars") % 101 / 100.0).cast("double").alias("score"),
    )


_FLAGS = "(SELECT lang, toxic = 0 AS p, quality = 1 AS r, (n_chars % 101) / 100.0::DOUBLE AS s, doc_id FROM documents JOIN labels USING (doc_id))"


@query(f"""SELECT lang, tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(precision, 6) AS precision, round(specificity, 6) AS specificity,
        round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1, round((recall + specificity) / 2, 6) AS balanced_accuracy FROM
        (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
        CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS specificity FROM (SELECT lang, count(*) FILTER (p AND r) AS tp, count(*) FILTER (p AND NOT r) AS fp, count(*) FILTER (NOT p AND NOT r) AS tn, count(*) FILTER (NOT p AND r) AS fn FROM {_FLAGS} GROUP BY lang))""")
def classification_scores(spark, sf_dir):
    return rounded(
        scoring.classification_scores(_flags(spark, sf_dir), ["lang"]),
        "accuracy",
        "recall",
        "precision",
        "specificity",
        "f1",
        "balanced_accuracy",
    )


@query(f"""SELECT lang, round(a, 6) AS positive, round(b, 6) AS negative, round(c, 6) AS true_positive, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 6) AS harmonic FROM
        (SELECT lang, coalesce(avg(s) FILTER (r), 1) AS a, coalesce(avg(s) FILTER (NOT r), 1) AS b, coalesce(avg(s) FILTER (r AND p), 1) AS c FROM {_FLAGS} GROUP BY lang)""")
def harmonic_scores(spark, sf_dir):
    return rounded(scoring.harmonic_scores(_flags(spark, sf_dir), ["lang"]), "positive", "negative", "true_positive", "harmonic")


def _exclusive_sql(i: int) -> str:
    j = f"least(greatest(({i} * (n + 1)) // 4, 1), n - 1)"
    return f"round((v[{j}] * (4 - ({i} * (n + 1) - {j} * 4)) + v[{j} + 1] * ({i} * (n + 1) - {j} * 4)) / 4, 6) AS q{i}"


@query(f"SELECT lang, n AS num_reviews, round(m, 6) AS mean, round(w, 6) AS variance, {_exclusive_sql(1)}, {_exclusive_sql(2)}, {_exclusive_sql(3)} FROM (SELECT lang, count(*) AS n, avg(s) AS m, var_samp(s) AS w, list_sort(list(s)) AS v FROM {_FLAGS} GROUP BY lang)")
def agg_scores(spark, sf_dir):
    return rounded(scoring.score_summary(_flags(spark, sf_dir), ["lang"]), "mean", "variance", "q1", "q2", "q3")


def _scores(spark, sf_dir):
    """Three labels a document scored against each other, by arithmetic on ids."""
    ids = spark.createDataFrame([("x", "y"), ("x", "z"), ("y", "z")], "label_id string, ref_id string")
    rows = _flags(spark, sf_dir).crossJoin(F.broadcast(ids))  # three rows
    place = F.when(F.col("ref_id") == "y", 3).when(F.col("label_id") == "x", 5).otherwise(7)
    return rows.withColumn("score", (F.col("review_id").cast("long") * place % 1000) / 1000.0).withColumn("metric_id", F.lit("m"))


_CROSS = "(SELECT doc_id, l, r, (doc_id * m % 1000) / 1000.0::DOUBLE AS s FROM documents JOIN labels USING (doc_id), (VALUES ('x', 'y', 3), ('x', 'z', 5), ('y', 'z', 7)) v(l, r, m))"


@query(f"SELECT 'm' AS metric_id, round(avg(m), 6) AS mean, round(avg(v), 6) AS variance FROM (SELECT doc_id, avg(s) AS m, var_pop(s) AS v FROM {_CROSS} GROUP BY 1)")
def label_variance(spark, sf_dir):
    return rounded(scoring.label_variance(_scores(spark, sf_dir)), "mean", "variance")


@query(f"SELECT 'm' AS metric_id, l AS a, r AS b, round(avg(s), 6) AS mean, round(var_pop(s), 6) AS variance FROM {_CROSS} GROUP BY 2, 3")
def label_variance_pairs(spark, sf_dir):
    return rounded(scoring.label_variance(_scores(spark, sf_dir), False), "mean", "variance")


def _paired(spark, sf_dir):
    return _flags(spark, sf_dir).select("review_id", (F.col("score") - 0.5 + F.when(F.col("ref_pos"), 0.05).otherwise(0.0)).alias("d"))


_DIFF = f"(SELECT doc_id, s - 0.5::DOUBLE + CASE WHEN r THEN 0.05::DOUBLE ELSE 0 END AS d FROM {_FLAGS})"


@query(f"SELECT count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t FROM {_DIFF}")
def ttest_statistic(spark, sf_dir):
    return rounded(significance.t_statistic(_paired(spark, sf_dir)), "mean", "std", "t")


@query(f"""SELECT count(*) AS n, round(coalesce(sum(rank) FILTER (up), 0), 6) AS w_plus, round(coalesce(sum(rank) FILTER (NOT up), 0), 6) AS w_minus, (SELECT round(sum(c::DOUBLE * (c * c - 1)), 6) FROM (SELECT count(*) AS c FROM {_DIFF} WHERE d <> 0 GROUP BY round(abs(d), 12))) AS ties
        FROM (SELECT d > 0 AS up, rank() OVER (ORDER BY round(abs(d), 12)) + (count(*) OVER (PARTITION BY round(abs(d), 12)) - 1) / 2 AS rank FROM {_DIFF} WHERE d <> 0)""")
def wilcoxon_statistic(spark, sf_dir):
    return rounded(significance.wilcoxon_statistic(_paired(spark, sf_dir)), "w_plus", "w_minus", "ties")


@query()
def bootstrap_means(spark, sf_dir):
    return significance.bootstrap_means(_paired(spark, sf_dir), seed=1)


@query(f"SELECT review_id, array_to_string(gold, '; ') AS joined, array_to_string(pred, '; ') AS predicted FROM {_LABELLED} WHERE quality = 1 AND lang = 'en'")
def sql_over_views(spark, sf_dir):
    from quillstone.sources.sql_runner import run_sql

    rows = labelled(spark, sf_dir).withColumn(
        "review_headline",
        X.join_options(L.usage_options(F.col("labels"), "bp-golden")),
    ).withColumn("product_title", X.join_options(L.usage_options(F.col("labels"), "chat*")))
    marked = rows.join(
        load(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("review_id")),
        "review_id",
        "left_semi",
    )
    return run_sql(
        spark,
        marked,
        "SELECT 1; SELECT review_id, review_headline AS joined, product_title AS predicted FROM reviews WHERE product_category = 'en' -- ; \n",
        view="reviews",
    )[1]


@query("SELECT lang AS product_category, count(*) AS n, max(n_chars % 5 + 1)::BIGINT AS stars FROM documents GROUP BY 1")
def sql_reviews(spark, sf_dir):
    from quillstone.sources.sql_runner import run_sql

    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.col("lang").alias("product_category"),
        (F.col("n_chars") % 5 + 1).cast("string").alias("star_rating"),
    )
    return run_sql(spark, docs, "SELECT product_category, count(*) AS n, max(star_rating) AS stars FROM reviews GROUP BY 1")[0]
