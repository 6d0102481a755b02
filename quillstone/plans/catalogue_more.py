"""Further queries: similarities by class, best references, tests, legacy documents, sinks read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import similarity as S
from quillstone.functions import text as X
from quillstone.functions.numeric import cosine_relu
from quillstone.operators import cleaning, clustering, scoring, significance
from quillstone.operators import labels as L
from quillstone.operators import review_sets as R
from quillstone.operators import sampling as P
from quillstone.operators import statistics as A
from quillstone.plans.catalogue import _DIFF, _LABELLED, _PHRASES, _paired, cosine_rows_of_vectors, labelled, load, phrases, query, rounded
from quillstone.session import shared_path
from quillstone.sources import documents, manifests


def _crc_pairs(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("a"),
        F.col("event_type").alias("b"),
    )
    names = F.array(F.lit("identical"), F.lit("very similar"), F.lit("Somewhat Similar"), F.lit("dissimilar"), F.lit("odd"))
    known = rows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n % 4 > 0").select(
        F.col("b").alias("a"),
        F.col("a").alias("b"),
        F.get(names, (F.col("n") % 5).cast("int")).alias("class"),
    )
    return rows, known


@query("""WITH k AS (SELECT user_id, event_type, CASE count(*) % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.5 ELSE 0 END::DOUBLE AS s FROM events GROUP BY ALL HAVING count(*) % 4 > 0)
        SELECT event_id, coalesce(s, 0)::DOUBLE AS similarity FROM events LEFT JOIN k USING (user_id, event_type)""")
def class_similarity(spark, sf_dir):
    rows, known = _crc_pairs(spark, sf_dir)
    return S.pair_similarity(rows, known, "named_v1").select("event_id", "similarity")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(CASE WHEN a.vec_id = b.vec_id OR s >= 1 THEN 0 ELSE -ln(greatest(1e-6, s)) END, 6) AS far FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 50 = 0,
        LATERAL (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s) WHERE s > 0.001""")
def log_distances(spark, sf_dir):
    out = cosine_rows_of_vectors(spark, sf_dir).filter("cosine > 0.001")
    return rounded(out.select("a", "b", S.log_distance(F.col("cosine"), F.col("a"), F.col("b")).alias("far")), "far")


@query()
def rescaled_cosines(spark, sf_dir):
    return rounded(cosine_rows_of_vectors(spark, sf_dir).select("a", "b", cosine_relu(F.col("cosine")).alias("sim")), "sim")


_CHOICES = "(SELECT doc_id::VARCHAR AS review_id, l AS label_id, r AS ref_id, ((n_chars * m) % 997) / 997.0::DOUBLE AS s, quality = 1 AS rp FROM documents JOIN labels USING (doc_id), (VALUES ('x', 'y', 3), ('x', 'z', 5), ('y', 'z', 7)) v(l, r, m))"


def _choices(spark, sf_dir):
    ids = spark.createDataFrame([("x", "y", 3), ("x", "z", 5), ("y", "z", 7)], "label_id string, ref_id string, m int")
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").crossJoin(F.broadcast(ids))  # three rows
    return rows.select(
        F.col("doc_id").cast("string").alias("review_id"),
        "label_id",
        "ref_id",
        F.lit("m").alias("metric_id"),
        ((F.col("n_chars") * F.col("m")) % 997 / 997.0).cast("double").alias("score"),
        F.lit(True).alias("pred_pos"),
        (F.col("quality") == 1).alias("ref_pos"),
    )


@query(f"SELECT review_id, label_id, round(max(s), 6) AS score, arg_max(ref_id, (s, ref_id)) AS ref_id FROM {_CHOICES} GROUP BY 1, 2")
def best_reference(spark, sf_dir):
    return rounded(scoring.best_reference(_choices(spark, sf_dir)).select("review_id", "label_id", "score", "ref_id"), "score")


@query(f"SELECT 'm' AS metric_id, label_id, round(avg(s), 6) AS mean, count(*) AS n FROM {_CHOICES} GROUP BY 2")
def mean_scores(spark, sf_dir):
    return rounded(scoring.mean_scores(_choices(spark, sf_dir)), "mean")


@query(f"""WITH p AS (SELECT review_id, avg(s) AS m, var_pop(s) AS v FROM {_CHOICES} GROUP BY 1) SELECT 'm' AS metric_id, round(avg(m), 6) AS mean, round(avg(v), 6) AS variance FROM p""")
def label_variance_by_review(spark, sf_dir):
    return rounded(scoring.label_variance(_choices(spark, sf_dir)), "mean", "variance")


@query(f"SELECT 'm' AS metric_id, label_id AS a, ref_id AS b, round(avg(s), 6) AS mean, round(var_pop(s), 6) AS variance FROM {_CHOICES} GROUP BY 2, 3")
def label_variance_by_pair(spark, sf_dir):
    return rounded(scoring.label_variance(_choices(spark, sf_dir), False), "mean", "variance")


@query(f"SELECT x.review_id, round(x.s, 6) AS a, round(y.s, 6) AS b, round(x.s - y.s, 6) AS d FROM (SELECT review_id, max(s) AS s FROM {_CHOICES} WHERE label_id = 'x' GROUP BY 1) x JOIN (SELECT review_id, max(s) AS s FROM {_CHOICES} WHERE label_id = 'y' GROUP BY 1) y USING (review_id)")
def paired_scores(spark, sf_dir):
    return rounded(significance.paired(_choices(spark, sf_dir), "x", "y", "m").select("review_id", "a", "b", "d"), "a", "b", "d")


@query()
def significance_tests(spark, sf_dir):
    pairs = _paired(spark, sf_dir)
    found = {"ttest": significance.t_test(pairs), "wilcoxon": significance.wilcoxon(pairs), "permutation": significance.permutation(pairs)}
    return spark.createDataFrame([(k, float(v["statistic"]), float(v["p"])) for k, v in found.items()], "test string, statistic double, p double")


@query("SELECT doc_id, gold FROM (SELECT doc_id, min(b.item_id) AS gold FROM documents JOIN benchmark b ON doc_id % 7 = item_id % 7 GROUP BY 1)")
def match_golden(spark, sf_dir):
    predicted = load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("review_id"))
    golden = load(spark, sf_dir, "benchmark").select(
        (F.col("item_id") % 7).alias("review_id"),
        F.col("item_id").alias("gold"),
        F.col("item_id").alias("_pos"),
    )
    return scoring.match_golden(predicted, golden).select("doc_id", F.col("golden_gold").alias("gold"))


@query(f"SELECT doc_id::VARCHAR AS review_id, array_to_string(list_concat(list_slice(o, 1, 2), list_transform(list_slice(o, 3, 9), lambda x: x || ' x')), ';') AS options FROM (SELECT *, {_PHRASES} AS o FROM documents)")
def legacy_labels(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").withColumn("o", phrases())
    label = F.struct(
        F.slice("o", 1, 2).alias("customUsageOptions"),
        F.transform(F.slice("o", 3, 9), lambda x: F.struct(F.array(x, F.lit("x")).alias("tokens"))).alias("annotations"),
    )
    docs = rows.select(F.to_json(
        F.struct(F.array(
            F.struct(F.col("doc_id").cast("string").alias("review_id"), F.col("text").alias("review_body"), label.alias("label")),
        ).alias("reviews")),
    ).alias("value"))
    return documents.legacy_labels(docs).select("review_id", F.array_join("usage_options", ";").alias("options"))


@query("SELECT doc_id::VARCHAR AS review_id, w AS \"workerId\", CASE WHEN w = 'w1' THEN source ELSE 'no' END AS options FROM documents, (VALUES ('w1'), ('w2')) v(w)")
def manifest_flat(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    marks = lambda c: F.to_json(F.struct(F.to_json(F.struct(F.array(F.array().cast("array<struct<tokens:array<string>>>")).alias("annotations"), F.array(F.array(c)).alias("customUsageOptions"))).alias("annotations")))
    worker = lambda i, c: F.struct(F.lit(i).alias("workerId"), F.struct(marks(c).alias("content")).alias("annotationData"))
    lines = docs.select(F.to_json(
        F.struct(
            F.array(F.struct(F.col("doc_id").cast("string").alias("review_id"))).alias("metadata"),
            F.struct(F.array(worker("w1", F.col("source")), worker("w2", F.lit("no"))).alias("annotationsFromAllWorkers")).alias("run"),
            F.struct(F.lit("run").alias("job-name")).alias("m"),
        ),
    ).alias("value"))
    return manifests.read_manifest_flat(lines).select("review_id", "workerId", F.array_join("usage_options", ";").alias("options"))


@query(f"SELECT review_id, 'new' AS label_id, array_to_string(gold, ';') AS options FROM {_LABELLED}")
def add_label(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    added = rows.withColumn(
        "labels",
        L.add_label(F.col("labels"), "new", L.usage_options(F.col("labels"), "bp*"), F.lit("2024-01-01T00:00:00+00:00")),
    )
    return L.labels_long(added).filter("label_id = 'new'").select("review_id", "label_id", F.array_join("usage_options", ";").alias("options"))


@query(f"SELECT review_id FROM {_LABELLED} WHERE NOT (lang = 'en')")
def filter_inverted(spark, sf_dir):
    return R.ReviewSet(labelled(spark, sf_dir)).filter(F.col("product_category") == "en", invert=True).df.select("review_id")


@query(f"SELECT review_id, array_to_string(gold, ';') AS gold, array_to_string(pred, ';') AS pred FROM {_LABELLED}")
def labels_pivoted(spark, sf_dir):
    back = L.pivot_labels(L.labels_long(labelled(spark, sf_dir)))
    return back.select(
        "review_id",
        *[F.array_join(L.usage_options(F.col("labels"), k), ";").alias(n) for k, n in (("bp-golden", "gold"), ("chat*", "pred"))],
    )


@query(f"SELECT review_id, option AS usage_option, source AS product_id, 256 AS size FROM (SELECT review_id, source, unnest(gold) AS option FROM {_LABELLED})")
def usage_frame(spark, sf_dir):
    rows = clustering.usage_frame(labelled(spark, sf_dir), L.ByGlob("bp-golden"))
    return rows.select("review_id", "usage_option", "product_id", F.size("embedding").alias("size"))


@query("SELECT doc_id, text AS phrase, length(text) AS n FROM (SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), ' ') AS text FROM documents)")
def normalised_phrases(spark, sf_dir):
    phrase = X.normalise_phrase(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", phrase.alias("phrase"), F.length(phrase).cast("long").alias("n"))


@query("SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9+&]', ' ', 'g') AS plain FROM documents")
def symbols_replaced(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.symbols_to_spaces(F.col("text")).alias("plain"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 5")
def sample_per_class(spark, sf_dir):
    return P.sample_per_group(load(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], 5, 3, "doc_id")


@query()
def loss_map_clusters(spark, sf_dir):
    log = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("mode"), F.abs(F.col("value") / 100).alias("loss"))
    return clustering.loss_map_clusters(A.loss_statistics(log, "click", ("user_id",))).select("user_id", "cluster")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, (min(o_orderdate)::VARCHAR)[:10] AS first FROM orders")
def table_round_trip(spark, sf_dir):
    """Written as tab-separated text to a folder of the shared file system, and read back."""
    from quillstone.sources.tables import write_table

    path = shared_path(spark, "tsv")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"))
    write_table(orders, path, "tsv")
    back = spark.read.schema(orders.schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return back.agg(
        F.count("*").alias("n"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.substring(F.min("o_orderdate"), 1, 10).alias("first"),
    )


@query("SELECT review_id, category FROM (SELECT doc_id::VARCHAR AS review_id, lang AS category FROM documents) WHERE category <> 'en'")
def drop_reviews(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("review_id"), F.col("lang").alias("category"))
    english = rows.filter("category = 'en'")
    return (R.ReviewSet(rows) - R.ReviewSet(english)).df


@query(f"SELECT count(*) AS n FROM {_DIFF} WHERE d > 0")
def positive_differences(spark, sf_dir):
    return _paired(spark, sf_dir).filter("d > 0").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source, text, n_chars, quality::INT AS quality, toxic::INT AS toxic FROM documents JOIN labels USING (doc_id)")
def complete_rows(spark, sf_dir):
    return cleaning.drop_incomplete(load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left"))
