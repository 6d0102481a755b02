"""Queries that go through documents in JSON, metrics, clustering, augmentation and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import metrics as M
from quillstone.functions import text as X
from quillstone.operators import augmentation, clustering, scoring
from quillstone.operators import labels as L
from quillstone.operators import review_sets as R
from quillstone.plans.catalogue import _LABELLED, _PHRASES, labelled, load, phrases, query, rounded
from quillstone.sources import documents, manifests

# -- texts of models ------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, array_to_string(list_transform(CASE WHEN k > 0 THEN list_slice(p, 1, k - 1) ELSE p END, lambda x: trim(x, '.')), '|') AS options FROM
        (SELECT *, coalesce(list_position(list_transform(p, lambda x: starts_with(x, 'No usage options')), true), 0) AS k FROM
        (SELECT conv_id, turn, list_transform(string_split(replace(text, ' the ', ';'), ';'), lambda x: trim(x)) AS p FROM conversations))""")
def parse_completion(spark, sf_dir):
    made = F.concat(F.lit("Thought. Result:"), F.replace("text", F.lit(" the "), F.lit(";")))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.parse_completion(made), "|").alias("options"))


@query("""SELECT conv_id, turn, array_to_string(CASE WHEN len(p) >= 3 THEN list_slice(p, 1, 3) ELSE ['Error', 'Error', t] END, '|') AS parts FROM
        (SELECT conv_id, turn, t, string_split(t, '; ') AS p FROM (SELECT *, replace(replace(text, chr(10), ' '), '. ', '; ') AS t FROM conversations))""")
def parse_generated_review(spark, sf_dir):
    made = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit("; "))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.parse_generated_review(made), "|").alias("parts"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, ' ', '; '), '; '), lambda x: trim(x)), lambda x: x <> ''), '|') AS options FROM documents")
def split_options(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_join(X.split_options(F.replace("text", F.lit(" "), F.lit("; "))), "|").alias("options"),
    )


@query("SELECT conv_id, turn, role AS r, 'You label.|What?|Nothing.|Text: ' || text || ' (' || role || ')' AS contents, 4 AS n FROM conversations")
def chat_messages(spark, sf_dir):
    asked = X.fill_template("Text: {text} ({role})", text=F.col("text"), role=F.col("role"))
    turns = X.chat_messages("You label.", [("What?", "Nothing.")], asked)
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("r"), turns.alias("m"))
    return rows.select("conv_id", "turn", "r", F.array_join(F.transform("m", lambda x: x["content"]), "|").alias("contents"), F.size("m").alias("n"))


@query("SELECT doc_id, (quality * 1)::INT AS usage, (CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::INT AS positive, (CASE WHEN quality = 1 THEN 2 - toxic ELSE 0 END)::INT AS amount FROM labels")
def decode_label_string(spark, sf_dir):
    made = F.when(F.col("quality") == 0, "-").otherwise(F.concat(F.lit("a,b,"), F.lit(1) - F.col("toxic"), F.lit(",c,d,1")))
    return load(spark, sf_dir, "labels").select("doc_id", X.decode_label_string(made).alias("v")).select("doc_id", "v.*")


@query("SELECT conv_id, round(sum(CASE WHEN turn < k THEN p ELSE 0 END), 6) AS first, round(sum(CASE WHEN turn > k THEN p ELSE 0 END), 6) AS last FROM (SELECT conv_id, turn, length(text) / -100.0::DOUBLE AS p, 1 AS k FROM conversations) GROUP BY conv_id")
def logprob_sums(spark, sf_dir):
    item = F.struct("turn", F.when(F.col("turn") == 1, F.lit(",")).otherwise(F.lit("t")).alias("t"), (F.length("text") / -100.0).alias("p"))
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(item)).alias("a"),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
    )
    whole = X.sum_logprobs(F.transform("a", lambda x: x["t"]), F.transform("a", lambda x: x["p"].cast("double")))
    out = rows.select("conv_id", whole.alias("s"), F.exists("a", lambda x: x["turn"] == 1).alias("cut"))
    return rounded(
        out.select("conv_id", F.get("s", F.lit(0)).alias("first"), F.coalesce(F.get("s", F.lit(1)), F.lit(0.0)).alias("last")),
        "first",
        "last",
    )


@query()
def stem_phrases(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(X.stem_phrases(phrases()), ";").alias("stems"))


# -- documents -------------------------------------------------------------------------------------


def _json_documents(spark, sf_dir):
    """One version 5 document a review, as the writer makes them."""
    rows = labelled(spark, sf_dir)
    inner = F.create_map(F.col("review_id"), F.struct(*[c for c in rows.columns if c != "review_id"]))
    return rows.select(F.to_json(F.struct(F.lit(R.VERSION).alias("version"), inner.alias("reviews"))).alias("value"))


@query(f"SELECT review_id, text AS review_body, array_to_string(gold, ';') AS gold, array_to_string(pred, ';') AS pred, CASE WHEN doc_id % 2 = 1 THEN 'train,gold' ELSE 'train' END AS datasets FROM {_LABELLED}")
def document_round_trip(spark, sf_dir):
    rows = documents.parse_documents(_json_documents(spark, sf_dir), R.VERSION)
    options = lambda k: F.array_join(F.element_at("labels", k)["usageOptions"], ";")
    return rows.select(
        "review_id",
        "review_body",
        options("bp-golden").alias("gold"),
        options("chat_gpt-v1").alias("pred"),
        F.array_join(F.element_at("labels", "chat_gpt-v1")["datasets"], ",").alias("datasets"),
    )


def _old_documents(spark, sf_dir, version: int):
    """Documents as the old versions had them."""
    rows = load(spark, sf_dir, "documents").join(
        load(spark, sf_dir, "labels"),
        "doc_id",
    ).withColumn("o", phrases()).withColumn("k", F.col("doc_id").cast("string"))
    if version == 0:
        label = F.struct(
            F.slice("o", 1, 2).alias("customUsageOptions"),
            F.transform(F.slice("o", 3, 9), lambda x: F.struct(F.array(x, F.lit("x")).alias("tokens"))).alias("annotations"),
            F.lit(False).alias("isFlagged"),
        )
        return rows.select(F.to_json(
            F.struct(F.array(F.struct(F.col("k").alias("review_id"), F.col("text").alias("review_body"), label.alias("label"))).alias("reviews")),
        ).alias("value"))
    if version == 1:
        label = F.struct(
            F.col("o").alias("usageOptions"),
            F.struct(F.array(F.lit("a"), F.col("source")).alias("datasets"), F.lit("m").alias("model")).alias("metadata"),
        )
        return rows.select(F.to_json(
            F.struct(
                F.lit(1).alias("version"),
                F.array(
                    F.struct(F.col("k").alias("review_id"), F.col("text").alias("review_body"), F.create_map(F.lit("x"), label).alias("labels")),
                ).alias("reviews"),
            ),
        ).alias("value"))
    names = F.create_map(F.col("source"), F.lit("train")) if version > 2 else F.array("source")
    label = F.struct(
        F.col("o").alias("usageOptions"),
        names.alias("datasets"),
        F.lit("2023-01-01T00:00:00+00:00").alias("createdAt"),
        F.create_map(F.lit("y"), F.create_map(F.lit("m"), F.array(F.lit("0.5"), F.lit("true"), F.lit("false")))).alias("scores"),
        F.array(F.struct(F.lit("aug").alias("review_body"))).alias("augmentations"),
    )
    return rows.select(F.to_json(
        F.struct(
            F.lit(version).alias("version"),
            F.create_map("k", F.struct(F.col("text").alias("review_body"), F.create_map(F.lit("x"), label).alias("labels"))).alias("reviews"),
        ),
    ).alias("value"))


_UPGRADES = f"""SELECT version, doc_id::VARCHAR AS review_id,
        CASE WHEN version = 0 THEN array_to_string(list_concat(list_slice(o, 1, 2), list_transform(list_slice(o, 3, 9), lambda x: x || ' x')), ';') ELSE array_to_string(o, ';') END AS options,
        CASE WHEN version = 0 THEN '' WHEN version = 1 THEN 'a,' || source ELSE source END AS datasets, CASE WHEN version > 1 THEN 0.5::DOUBLE END AS score, CASE WHEN version = 4 THEN 'aug' END AS body
        FROM (SELECT *, {_PHRASES} AS o FROM documents JOIN labels USING (doc_id)), (VALUES (0), (1), (2), (3), (4)) v(version)"""


@query(_UPGRADES)
def document_upgrade(spark, sf_dir):
    out = None
    for version in range(5):
        rows = documents.parse_documents(_old_documents(spark, sf_dir, version), version, label_id="x")
        label = F.element_at("labels", "x")
        one = rows.select(
            F.lit(version).alias("version"),
            "review_id",
            F.array_join(label["usageOptions"], ";").alias("options"),
            F.array_join(label["datasets"], ",").alias("datasets"),
            F.try_element_at(F.try_element_at(label["scores"], F.lit("y")), F.lit("m"))["score"].alias("score"),
            F.get(F.try_element_at(label["augmentations"], F.lit("legacy")), F.lit(0))["review_body"].alias("body"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT doc_id::VARCHAR AS review_id, array_to_string(list_concat(['c' || (doc_id % 3)], [coalesce(o[1], '') || ' z']), ';') AS options FROM (SELECT *, {_PHRASES} AS o FROM documents)")
def manifest_parse(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("o", F.coalesce(F.get(phrases(), F.lit(0)), F.lit("")))
    marks = F.struct(
        F.array(F.array(F.struct(F.array("o", F.lit("z")).alias("tokens")))).alias("annotations"),
        F.array(F.array(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")))).alias("customUsageOptions"),
    )
    content = lambda m: F.to_json(F.struct(F.to_json(m).alias("annotations")))
    worker = lambda i, m: F.struct(F.lit(i).alias("workerId"), F.struct(content(m).alias("content")).alias("annotationData"))
    empty = F.struct(
        F.array(F.array(F.struct(F.array(F.lit("no")).alias("tokens")))).alias("annotations"),
        F.array(F.array(F.lit("no"))).alias("customUsageOptions"),
    )
    review = F.struct(F.col("doc_id").cast("string").alias("review_id"), F.col("text").alias("review_body"))
    lines = docs.select(F.to_json(
        F.struct(
            F.to_json(F.array("text")).alias("source"),
            F.array(review).alias("metadata"),
            F.struct(F.array(worker("w1", marks), worker("w2", empty)).alias("annotationsFromAllWorkers")).alias("run1"),
            F.struct(F.lit("run1").alias("job-name")).alias("run1-metadata"),
        ),
    ).alias("value"))
    rows = manifests.read_manifest(lines, "acme", "2024-01-01T00:00:00+00:00")
    return rows.select("review_id", F.array_join(F.element_at("labels", "aws-acme-run1")["usageOptions"], ";").alias("options"))


@query("""SELECT task, n, first FROM (SELECT (k - 1) // 8 AS task, count(*)::INT AS n, min(h) AS first FROM (SELECT row_number() OVER (ORDER BY md5('5:' || doc_id::VARCHAR), doc_id) AS k, md5('4:' || doc_id::VARCHAR) AS h FROM documents) GROUP BY 1) WHERE task < 20""")
def manifest_build(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "review_id").withColumnRenamed("text", "review_body")
    tasks = manifests.build_manifest(docs, 8, most_tasks=20, seed=4)
    ids = F.from_json("metadata", "array<struct<review_id:string>>")
    return tasks.select("task", F.size(ids).alias("n"), F.md5(F.concat(F.lit("4:"), F.get(ids, F.lit(0))["review_id"])).alias("first"))


# -- metrics ---------------------------------------------------------------------------------------


def _lists(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rows.select("review_id", L.usage_options(F.col("labels"), "chat*").alias("p"), L.usage_options(F.col("labels"), "bp*").alias("r"))


_EXACT = f"""(SELECT review_id, lang, source, p, g, CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = 0 AND len(g) = 0)::INT ELSE i / len(p) END::DOUBLE AS precision,
        CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = 0 AND len(g) = 0)::INT ELSE i / len(g) END::DOUBLE AS recall, i
        FROM (SELECT *, pred AS p, gold AS g, len(list_intersect(pred, gold)) AS i FROM {_LABELLED}))"""
_F1 = "CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END"
_METRICS = (
    "custom_mean_precision",
    "custom_mean_recall",
    "custom_mean_f1",
    "custom_min_f1",
    "custom_weighted_mean_precision",
    "custom_weighted_mean_recall",
    "custom_weighted_mean_f1",
)


@query(f"""SELECT review_id, round(precision, 6) AS custom_mean_precision, round(recall, 6) AS custom_mean_recall, round({_F1}, 6) AS custom_mean_f1,
        CASE WHEN precision = 1 AND recall = 1 THEN 1 ELSE 0 END::DOUBLE AS custom_min_f1, round(precision, 6) AS custom_weighted_mean_precision,
        round(recall, 6) AS custom_weighted_mean_recall, round({_F1}, 6) AS custom_weighted_mean_f1 FROM {_EXACT}""")
def exact_metrics(spark, sf_dir):
    """Equal phrases are alike and no others: what the metrics make of similarities, without a model's."""
    out = _lists(spark, sf_dir).select("review_id", M.metrics(_METRICS, F.col("p"), F.col("r"), kind="exact").alias("m"))
    return rounded(out.select("review_id", "m.*"), *_METRICS)


@query()
def list_metrics(spark, sf_dir):
    names = (*_METRICS, "custom_weighted_mean_f1_stem", "custom_weighted_mean_f1_lemmatize")
    out = _lists(spark, sf_dir).select("review_id", M.metrics(names, F.col("p"), F.col("r")).alias("m"))
    return rounded(out.select("review_id", "m.*"), *names)


@query()
def word_movers(spark, sf_dir):
    return rounded(_lists(spark, sf_dir).select("review_id", M.metric("word_movers_similarity", F.col("p"), F.col("r")).alias("score")), "score")


@query()
def ngram_metrics(spark, sf_dir):
    """Every document against the benchmark item of its number, modulo the items there are."""
    items = load(spark, sf_dir, "benchmark").select(F.row_number().over(Window.orderBy("item_id")).alias("k"), F.col("text").alias("ref"))
    number = F.coalesce(F.pmod("doc_id", F.lit(max(1, items.count()))), F.lit(0)) + 1
    docs = load(spark, sf_dir, "documents").withColumn("k", number).join(items, "k")
    names = ("bleu", "sacrebleu", "rouge1", "rouge2", "rougeL", "rougeLsum")
    scored = docs.select("doc_id", M.metrics(names, F.array("text"), F.array("ref")).alias("m"))
    return rounded(scored.select("doc_id", "m.*"), *names)


@query(f"""SELECT review_id, CASE WHEN len(p) = 0 THEN 0 ELSE len(list_intersect(p, r)) END::DOUBLE AS tp, len(list_filter(p, lambda x: NOT list_contains(r, x)))::DOUBLE AS fp,
        CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1 ELSE 0 END::DOUBLE AS tn, len(list_filter(r, lambda x: NOT list_contains(p, x)))::DOUBLE AS fn FROM (SELECT review_id, pred AS p, gold AS r FROM {_LABELLED})""")
def classification_counts(spark, sf_dir):
    out = _lists(spark, sf_dir).select("review_id", _exact_counts(F.col("p"), F.col("r")).alias("c"))
    return out.select("review_id", "c.*")


def _exact_counts(p, r):
    """The counts with a comparator that knows equal phrases only."""
    return M.counts("custom_classification_score", p, r, kind="exact")


@query(f"""SELECT review_id, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 ELSE i END::DOUBLE AS tp, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 0 ELSE greatest(len(p), 1) - i END::DOUBLE AS fp,
        CASE WHEN len(p) = 0 AND len(g) = 0 THEN 0 ELSE greatest(len(g), 1) - i END::DOUBLE AS fn, CASE WHEN len(g) = 0 THEN (len(p) = 0)::INT ELSE i END::DOUBLE AS ntp,
        (len(p) - i)::DOUBLE AS nfp, CASE WHEN len(g) = 0 THEN (len(p) > 0)::INT ELSE len(g) - i END::DOUBLE AS nfn FROM {_EXACT}""")
def soft_classification(spark, sf_dir):
    c = M.counts("custom_similarity_classification_score_with_negative_class", F.col("p"), F.col("r"), kind="exact")
    d = M.counts("custom_classification_score_with_negative_class", F.col("p"), F.col("r"), kind="exact")
    out = _lists(spark, sf_dir).select("review_id", c.alias("c"), d.alias("d"))
    return out.select("review_id", "c.tp", "c.fp", "c.fn", F.col("d.tp").alias("ntp"), F.col("d.fp").alias("nfp"), F.col("d.fn").alias("nfn"))


_BOTH_WAYS = f"(SELECT review_id, 'chat_gpt-v1' AS a, 'bp-golden' AS b, precision, recall, p, g FROM {_EXACT} UNION ALL SELECT review_id, 'bp-golden', 'chat_gpt-v1', recall, precision, g, p FROM {_EXACT})"


@query(f"""SELECT review_id, a AS label_id, b AS ref_id, metric_id, round(CASE WHEN metric_id = 'custom_mean_recall' THEN recall ELSE {_F1} END, 6) AS score, len(p) > 0 AS pred_pos, len(g) > 0 AS ref_pos
        FROM {_BOTH_WAYS}, (VALUES ('custom_mean_f1'), ('custom_mean_recall')) v(metric_id)""")
def score_pairs(spark, sf_dir):
    pairs = scoring.label_pairs(labelled(spark, sf_dir))
    return rounded(scoring.score_pairs(pairs, ("custom_mean_f1", "custom_mean_recall"), kind="exact"), "score")


@query(f"""SELECT review_id, 'chat_gpt-v1' AS label_id, 'bp-golden' AS ref_id, metric_id, round(CASE WHEN metric_id = 'custom_mean_recall' THEN recall ELSE {_F1} END, 6) AS score
        FROM {_EXACT}, (VALUES ('custom_mean_f1'), ('custom_mean_recall')) v(metric_id)""")
def stored_scores(spark, sf_dir):
    """Scores kept in the set's labels: one metric first, then the other beside it."""
    rows = R.ReviewSet(labelled(spark, sf_dir)).score_labels(["chat*"], ["bp*"], ["custom_mean_f1"], kind="exact")
    rows = rows.score_labels(["chat*"], ["bp*"], ["custom_mean_f1", "custom_mean_recall"], kind="exact")
    return rounded(L.scores_long(rows.df).select("review_id", "label_id", "ref_id", "metric_id", "score"), "score")


@query(f"SELECT review_id, 'chat_gpt-v1' AS label_id, 0 AS scores FROM {_LABELLED}")
def deleted_label_scores(spark, sf_dir):
    """A label's removal takes the scores against it along."""
    rows = R.ReviewSet(labelled(spark, sf_dir)).score_labels(["chat*"], ["bp*"], ["custom_mean_f1"], kind="exact").delete_labels("bp*")
    return L.exploded(rows.df, ["review_id"], F.col("labels"), "label_id", "l").select("review_id", "label_id", F.size("l.scores").alias("scores"))


@query(f"SELECT CASE WHEN len(pred) > 0 AND len(gold) > 0 THEN 'TP' WHEN len(pred) > 0 THEN 'FP' WHEN len(gold) > 0 THEN 'FN' ELSE 'TN' END AS usage_class, count(*) AS count FROM {_LABELLED} GROUP BY 1")
def report_classes(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    scores = scoring.score_pairs(scoring.label_pairs(rows, ["chat_gpt-v1"], ["bp-golden"]), ("custom_mean_f1",))
    return scoring.score_report(scoring.scored_reviews(rows, scores, "chat_gpt-v1", ["bp-golden"], "custom_mean_f1"), "custom_mean_f1")["classes"]


@query(f"SELECT lang AS product_category, count(*) AS count, round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS std FROM (SELECT lang, {_F1} AS f FROM {_EXACT} WHERE len(p) > 0 AND len(g) > 0) GROUP BY 1")
def report_by_category(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    scores = scoring.score_pairs(scoring.label_pairs(rows, ["chat_gpt-v1"], ["bp-golden"]), ("custom_mean_f1",), kind="exact")
    tables = scoring.score_report(scoring.scored_reviews(rows, scores, "chat_gpt-v1", ["bp-golden"], "custom_mean_f1"), "custom_mean_f1")
    return rounded(tables["by_product_category"], "mean", "std")


# -- clusters -----------------------------------------------------------------------------------


@query()
def kmeans_assign(spark, sf_dir):
    return clustering.kmeans(load(spark, sf_dir, "embeddings"), 10).select("vec_id", "cluster", "is_centroid")


@query()
def agglomerative(spark, sf_dir):
    return clustering.agglomerative(load(spark, sf_dir, "embeddings"), n_clusters=10)


@query("""WITH RECURSIVE l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
             WHERE round(greatest(0, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 12) < 0.65),
        r(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON r.reach = l.x)
        SELECT node AS vec_id, dense_rank() OVER (ORDER BY min(reach)) - 1 AS cluster FROM r GROUP BY node""")
def single_linkage(spark, sf_dir):
    """Clusters that chains of vectors at less than a distance hold together."""
    return clustering.agglomerative(load(spark, sf_dir, "embeddings"), linkage="single", distance_threshold=0.65)


@query()
def ward_clusters(spark, sf_dir):
    return clustering.agglomerative(load(spark, sf_dir, "embeddings"), metric="euclidean", linkage="ward", n_clusters=10)


@query()
def communities(spark, sf_dir):
    return clustering.community_detection(load(spark, sf_dir, "embeddings"), 0.35, 2)


@query()
def cluster_quality(spark, sf_dir):
    return rounded(clustering.cluster_quality(load(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster")), "value")


@query()
def isomap(spark, sf_dir):
    out = clustering.reduce_dimensions(load(spark, sf_dir, "embeddings"), 2, "isomap", neighbours=8)
    return out.select("vec_id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))


@query()
def pca(spark, sf_dir):
    out = clustering.reduce_dimensions(load(spark, sf_dir, "embeddings"), 2)
    return rounded(out.select("vec_id", F.abs(F.get("embedding", F.lit(0))).alias("x"), F.abs(F.get("embedding", F.lit(1))).alias("y")), "x", "y")


@query()
def outlier_removal(spark, sf_dir):
    from quillstone.functions.similarity import embed_phrases

    rows = labelled(spark, sf_dir)
    options = L.usage_long(L.extract_labels(rows, ["bp-golden"])).select("review_id", F.lower("usage_option").alias("usage_option"))
    return clustering.remove_outliers(rows, embed_phrases(options, "usage_option"), 0.1, 0.7).select("review_id")


# -- augmentation and datapoints ----------------------------------------------------------------


def _augmented(spark, sf_dir):
    tagged = lambda texts: [f"Test: {t}" for t in texts]
    return augmentation.augment_texts(labelled(spark, sf_dir), L.ByGlob("bp-golden"), "tags", ("review_body", "usageOptions"), tagged)


@query(f"SELECT review_id || '.tags#1' AS review_id, 'Test: ' || text AS review_body, array_to_string(list_transform(gold, lambda x: 'Test: ' || x), ';') AS options FROM {_LABELLED}")
def expand_augmentations(spark, sf_dir):
    rows = augmentation.expand(_augmented(spark, sf_dir), L.ByGlob("bp-golden"), "tags")
    return rows.select("review_id", "review_body", F.array_join(L.usage_options(F.col("labels"), "bp-golden"), ";").alias("options"))


@query(f"""SELECT review_id, 'Review: ' || text AS input, len(gold) > 0 AS has_usage, unnest(CASE WHEN len(gold) = 0 THEN [''] ELSE gold END) AS target FROM {_LABELLED}
        WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 299""")
def expand_datapoints(spark, sf_dir):
    return augmentation.datapoints(labelled(spark, sf_dir), L.ByGlob("bp-golden"), "Review: {review_body}", "flat", most_input=300)


@query()
def option_permutations(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("o", L.usage_options(F.col("labels"), "chat*"))
    return rows.select("review_id", F.explode(augmentation.option_texts(F.col("o"), "shuffle-all", 2, F.col("review_id"))).alias("target"))


@query(f"SELECT review_id, 'mine' AS datasets, array_to_string(pred, ';') AS options FROM {_LABELLED}")
def create_dataset(spark, sf_dir):
    rows = R.ReviewSet(labelled(spark, sf_dir)).create_dataset("mine", L.ByGlob("chat*")).df
    label = F.element_at(F.map_values("labels"), 1)
    return rows.select("review_id", F.array_join(label["datasets"], ",").alias("datasets"), F.array_join(label["usageOptions"], ";").alias("options"))
