"""Queries of the calls that users make: files written and read back, sets cut and joined, prompts, costs, arrivals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import numeric as N
from quillstone.functions import text as X
from quillstone.operators import augmentation, cleaning, clustering, significance
from quillstone.operators import labels as L
from quillstone.operators import review_sets as R
from quillstone.plans.catalogue import _DIFF, _LABELLED, _halves, _paired, labelled, load, query, rounded
from quillstone.session import shared_path
from quillstone.sources import documents, sql_runner, tables

# -- files ------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderstatus) AS kinds FROM orders WHERE o_orderkey % 5 <> 0")
def malformed_lines(spark, sf_dir):
    """Every fifth line has a column too many; counts and sums leave it out."""
    orders = load(spark, sf_dir, "orders")
    more = F.when(F.col("o_orderkey") % 5 == 0, F.lit("\tmore")).otherwise(F.lit(""))
    lines = orders.select(F.concat(
        F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), "o_orderstatus"),
        more,
    ).alias("value"))
    path = shared_path(spark, "lines")
    # Each file begins with a header line, as the reader has it.
    header = spark.range(1).select(F.lit("o_orderkey\to_totalprice\to_orderstatus").alias("value"))
    header.unionByName(lines).coalesce(1).write.text(path)
    rows = tables.read_tsv(spark, path, schema="o_orderkey long, o_totalprice double, o_orderstatus string", pattern="part-*")
    out = rows.agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_orderstatus").alias("kinds"))
    return out.withColumn("n", F.lit(rows.count())).select("n", "total", "kinds")


@query(f"SELECT review_id, text AS review_body, array_to_string(gold, ';') AS gold, array_to_string(pred, ';') AS pred FROM {_LABELLED}")
def saved_document(spark, sf_dir):
    """A set saved as one document, and read back."""
    path = shared_path(spark, "set") + ".json"
    documents.save_documents(R.ReviewSet(labelled(spark, sf_dir)), path)
    rows = documents.read_documents(spark, path).df
    options = lambda k: F.array_join(F.element_at("labels", k)["usageOptions"], ";")
    return rows.select("review_id", "review_body", options("bp-golden").alias("gold"), options("chat_gpt-v1").alias("pred"))


@query(f"""SELECT review_id, CASE WHEN doc_id % 3 < 2 THEN text ELSE 'other' END AS review_body, CASE WHEN doc_id % 3 = 0 THEN 'bp-golden' ELSE 'bp-golden,chat_gpt-v1' END AS ids FROM {_LABELLED}""")
def merged_folder(spark, sf_dir):
    """Two documents of one folder, overlapping in reviews and labels."""
    folder = shared_path(spark, "folder")
    for name, part in zip(("a", "b"), _halves(spark, sf_dir)):
        documents.save_documents(R.ReviewSet(part), f"{folder}/{name}.json")
    rows = documents.read_documents(spark, folder).df
    return rows.select("review_id", "review_body", F.array_join(F.array_sort(F.map_keys("labels")), ",").alias("ids"))


@query("SELECT label_id, count(*) AS n FROM labels, (VALUES ('bp-golden'), ('chat_gpt-v1')) v(label_id) GROUP BY 1")
def split_folders(spark, sf_dir):
    """A folder for each label, read back as partitions."""
    path = shared_path(spark, "split")
    documents.split_by_label(labelled(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("label_id").agg(F.count("*").alias("n"))


@query("SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def written_clusters(spark, sf_dir):
    path = shared_path(spark, "clusters")
    tables.write_clusters(load(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster"), path, ["vec_id", "cluster"])
    return spark.read.schema("vec_id long, cluster int").option("header", True).csv(path).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"SELECT (SELECT count(*) FROM {_LABELLED}) AS reviews, 'mine' AS name")
def written_dataset(spark, sf_dir):
    path = shared_path(spark, "dataset")
    made = R.ReviewSet(labelled(spark, sf_dir)).create_dataset("mine", L.ByGlob("chat*"))
    documents.write_dataset(made, path, {"name": "mine"})
    config = spark.read.json(f"{path}/config")
    return spark.read.parquet(f"{path}/reviews.parquet").agg(F.count("*").alias("reviews")).crossJoin(config.select("name"))  # one row each


@query("SELECT lang AS file_category, count(*) AS n FROM documents GROUP BY 1")
def category_of_file(spark, sf_dir):
    """Categories told by the names of the folders that hold the files."""
    path = shared_path(spark, "files")
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    docs.withColumn("part", F.concat(F.lit("reviews_us_"), "lang", F.lit("_v1"))).write.partitionBy("part").parquet(path)
    return cleaning.category_of_file(spark.read.parquet(path)).groupBy("file_category").agg(F.count("*").alias("n"))


@query("SELECT lang AS product_category, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, product_category LIMIT 2")
def sql_heads(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("review_id"), F.col("lang").alias("product_category"))
    found = sql_runner.run_sql(spark, docs, "SELECT product_category, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, 1")
    return sql_runner.heads(found, 2)[0]


@query("SELECT lang AS product_category, count(*) AS n FROM documents GROUP BY 1")
def sql_results(spark, sf_dir):
    """Results saved as tab-separated text, one folder a statement."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("review_id"), F.col("lang").alias("product_category"))
    found = sql_runner.run_sql(spark, docs, "SELECT 1 AS one; SELECT product_category, count(*) AS n FROM reviews GROUP BY 1")
    path = sql_runner.save_results(found, shared_path(spark, "sql"))[1]
    return spark.read.schema("product_category string, n long").option("sep", "\t").option("header", True).csv(path)


@query("SELECT doc_id::VARCHAR AS review_id, 'c' || (doc_id % 3) AS options FROM documents")
def manifest_arrivals(spark, sf_dir):
    """Manifests of a folder converted as a stream."""
    from quillstone.streaming.manifests import convert_arrivals

    docs = load(spark, sf_dir, "documents")
    none = F.array(F.array().cast("array<struct<tokens:array<string>>>"))
    marks = F.to_json(F.struct(
        F.to_json(
            F.struct(
                none.alias("annotations"),
                F.array(F.array(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")))).alias("customUsageOptions"),
            ),
        ).alias("annotations"),
    ))
    worker = F.struct(F.lit("w").alias("workerId"), F.struct(marks.alias("content")).alias("annotationData"))
    run = F.struct(F.array(worker).alias("annotationsFromAllWorkers"))
    review = F.array(F.struct(F.col("doc_id").cast("string").alias("review_id")))
    lines = docs.select(F.to_json(
        F.struct(review.alias("metadata"), run.alias("run1"), F.struct(F.lit("run1").alias("job-name")).alias("m")),
    ).alias("value"))
    source, target = shared_path(spark, "arrived"), shared_path(spark, "converted")
    lines.write.text(source)
    convert_arrivals(spark, source, target, shared_path(spark, "progress"), "acme", "2024-01-01T00:00:00+00:00").awaitTermination()
    rows = spark.read.parquet(target).withColumn("labels", F.from_json("labels", "map<string,struct<usageOptions:array<string>>>"))
    return rows.select("review_id", F.array_join(F.element_at("labels", "aws-acme-run1")["usageOptions"], ";").alias("options"))


# -- sets -------------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS review_id FROM labels ORDER BY review_id LIMIT 20 OFFSET 5")
def slice_of_set(spark, sf_dir):
    return R.ReviewSet(labelled(spark, sf_dir)).slice(5, 25).df.select("review_id")


@query("SELECT true AS same, false AS other, (SELECT count(*) FROM labels) AS n")
def same_reviews(spark, sf_dir):
    a = R.ReviewSet(labelled(spark, sf_dir))
    b, c = R.ReviewSet(a.df.withColumn("review_body", F.lit("x"))), R.ReviewSet(_halves(spark, sf_dir)[0])
    return spark.createDataFrame([(a == b, a == c, len(a))], "same boolean, other boolean, n long")


@query("SELECT doc_id::VARCHAR AS review_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels ORDER BY doc_id::VARCHAR LIMIT 3)")
def dropped_reviews(spark, sf_dir):
    rs = R.ReviewSet(labelled(spark, sf_dir))
    first = [r.review_id for r in rs.slice(0, 3).df.select("review_id").collect()]
    return rs.drop_review(*first).df.select("review_id")


@query(f"SELECT review_id FROM {_LABELLED} WHERE doc_id % 3 > 0")
def reviews_with_labels(spark, sf_dir):
    return R.ReviewSet(R.merge(*_halves(spark, sf_dir))).with_labels("bp-golden", "chat_gpt-v1").df.select("review_id")


@query(f"SELECT review_id, 'bp-golden' AS label_id FROM {_LABELLED}")
def labels_deleted_by_pattern(spark, sf_dir):
    return L.labels_long(R.ReviewSet(labelled(spark, sf_dir)).delete_labels("chat*", "none*").df).select("review_id", "label_id")


@query("SELECT 0::BIGINT AS scores, (SELECT count(*) FROM labels) AS reviews")
def scores_reset(spark, sf_dir):
    scored = R.ReviewSet(labelled(spark, sf_dir)).score_labels(["chat*"], ["bp*"], ["custom_mean_f1"], kind="exact").reset_scores()
    return scored.df.agg(
        F.sum(F.aggregate(F.map_values("labels"), F.lit(0), lambda n, x: n + F.size(x["scores"]))).alias("scores"),
        F.count("*").alias("reviews"),
    )


@query(f"SELECT review_id, unnest(gold) AS usage_option FROM {_LABELLED}")
def options_of_label(spark, sf_dir):
    return L.options_of_label(labelled(spark, sf_dir), "bp-golden")


@query("""SELECT doc_id::VARCHAR AS review_id, rule FROM labels, (VALUES ('createdAt is no time', 3), ('usageOptions is null', 5), ('labels is null', 7)) v(rule, m)
        WHERE doc_id % m = 0 AND (rule = 'labels is null' OR doc_id % 7 <> 0)""")
def broken_documents(spark, sf_dir):
    """What is wrong with documents that were broken on purpose."""
    n = F.col("review_id").cast("long")
    fields = lambda x: [x[f].alias(f) for f in ("datasets", "metadata", "scores", "augmentations")]
    bad = lambda _, x: F.struct(F.when(n % 3 == 0, F.lit("no time")).otherwise(x["createdAt"]).alias("createdAt"), F.when(n % 5 != 0, x["usageOptions"]).alias("usageOptions"), *fields(x))
    rows = labelled(spark, sf_dir).withColumn("labels", F.when(n % 7 != 0, F.transform_values("labels", bad)))
    return R.violations(rows)


@query(f"""SELECT review_id, array_to_string(CASE WHEN len(pred) = 0 THEN [] WHEN doc_id % 2 = 0 THEN pred[2:] ELSE list_concat(pred[2:], ['new ' || pred[1]]) END, ';') AS options FROM {_LABELLED} WHERE len(pred) > 0""")
def decided_options(spark, sf_dir):
    """The first option of each label is dropped, or revised for odd ids."""
    rows = labelled(spark, sf_dir)
    first = F.get(L.usage_options(F.col("labels"), "chat*"), F.lit(0))
    odd = F.col("review_id").cast("long") % 2 == 1
    told = rows.select(
        "review_id",
        first.alias("usage_option"),
        odd.alias("keep"),
        F.when(odd, F.concat(F.lit("new "), first)).alias("revised"),
    ).filter("usage_option is not null")
    out = L.apply_decisions(rows, told, F.lit("2024-01-02T00:00:00+00:00")).filter(F.map_contains_key("labels", F.lit("bp-chat_gpt_correction")))
    return out.select("review_id", F.array_join(F.element_at("labels", "bp-chat_gpt_correction")["usageOptions"], ";").alias("options"))


@query("SELECT doc_id::VARCHAR AS review_id, CASE WHEN doc_id % 5 = 1 THEN 'val' ELSE 'train' END AS part FROM labels WHERE doc_id % 5 > 0")
def assembled_dataset(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    n = F.col("review_id").cast("long")
    train, val = augmentation.assemble(rows, rows.filter(n % 5 == 0), rows.filter(n % 5 < 2))
    return train.select("review_id", F.lit("train").alias("part")).unionByName(val.select("review_id", F.lit("val").alias("part")))


@query(f"SELECT review_id, true AS before, false AS other FROM {_LABELLED}")
def augmented_already(spark, sf_dir):
    rows = augmentation.augment_texts(labelled(spark, sf_dir), L.ByGlob("bp-golden"), "tags", ("review_body",), lambda texts: texts)
    return rows.select(
        "review_id",
        augmentation.has_augmentations(rows, "tags").alias("before"),
        augmentation.has_augmentations(rows, "none").alias("other"),
    )


@query(f"SELECT review_id, '<<<' || text AS body FROM {_LABELLED}")
def augmented_in_rounds(spark, sf_dir):
    """A transformation applied to its own outcome three times."""
    thrice = augmentation.round_trips(lambda texts: ["<" + t for t in texts], 3)
    rows = augmentation.augment_texts(labelled(spark, sf_dir), L.ByGlob("bp-golden"), "trips", ("review_body",), thrice)
    return L.augmentations_long(rows).select("review_id", F.col("review_body").alias("body"))


@query(f"SELECT review_id, array_to_string(CASE WHEN text = '' THEN [''] ELSE string_split(text, ' ')[:2] END, '|') AS options FROM {_LABELLED}")
def labelled_by_a_client(spark, sf_dir):
    """A label made by a function of texts, in batches."""
    rows = R.ReviewSet(labelled(spark, sf_dir)).annotate(lambda texts: [t.split(" ")[:2] for t in texts], "mine", "2024-01-01T00:00:00+00:00")
    return rows.df.select("review_id", F.array_join(F.element_at("labels", "mine")["usageOptions"], "|").alias("options"))


@query(f"SELECT review_id, array_to_string(CASE WHEN text = '' THEN [''] ELSE string_split(text, ' ')[:2] END, '|') AS options FROM {_LABELLED}")
def labelled_with_saves(spark, sf_dir):
    """The same, with the answers saved as they come."""
    client = lambda texts: [t.split(" ")[:2] for t in texts]
    rows = R.ReviewSet(labelled(spark, sf_dir)).annotate(client, "mine", "2024-01-01T00:00:00+00:00", progress=shared_path(spark, "answers"), share=0.25, at_most=100_000)
    return rows.df.select("review_id", F.array_join(F.element_at("labels", "mine")["usageOptions"], "|").alias("options"))


@query()
def bootstrap_interval(spark, sf_dir):
    found = significance.bootstrap(_paired(spark, sf_dir))
    return spark.createDataFrame([(found["low"], found["high"], found["rejected"])], "low double, high double, rejected boolean")


@query("SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return clustering.cluster_sizes(load(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster"))


# -- texts, arrays, costs -----------------------------------------------------------------------


@query(f"SELECT text AS question, array_to_string(gold, '; ') AS answer FROM {_LABELLED} ORDER BY md5('4:' || review_id), review_id LIMIT 5")
def few_shot_examples(spark, sf_dir):
    return spark.createDataFrame(augmentation.choose_examples(labelled(spark, sf_dir), "bp-golden", 5, seed=4), "question string, answer string")


@query("SELECT doc_id, doc_id::VARCHAR AS original, 'gpt-' || lang AS label_id FROM documents")
def identifiers(spark, sf_dir):
    """Ids of augmented reviews lead back to the original's; label ids are joined of their parts."""
    docs = load(spark, sf_dir, "documents")
    langs = [r.lang for r in docs.select("lang").distinct().collect()]  # there are few
    names = F.create_map(*[F.lit(x) for lang in langs for x in (lang, X.label_id("gpt", lang))])
    augmented = F.concat(F.col("doc_id").cast("string"), F.lit(".tags#1"))
    return docs.select("doc_id", X.original_id(augmented).alias("original"), F.element_at(names, F.col("lang")).alias("label_id"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(lower(text), ' '), lambda w: true), lambda p: array_to_string(list_filter(string_split_regex(p, '\\s+'), lambda w: w <> ''), ' ')))), '|') AS phrases FROM documents")
def distinct_phrases(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(X.distinct_phrases(F.split("text", " ")), "|").alias("phrases"))


@query("SELECT doc_id, ((len(w) + 6) // 7)::INT AS parts, coalesce(array_to_string(w[(len(w) - 1) // 7 * 7 + 1:], ' '), '') AS last FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)")
def chunked_words(spark, sf_dir):
    """Arrays cut in slices of seven: how many, and the last."""
    c = augmentation.chunks(X.words(F.col("text")), 7)
    rows = load(spark, sf_dir, "documents").select("doc_id", c.alias("c"))
    return rows.select("doc_id", F.size("c").alias("parts"), F.coalesce(F.array_join(F.try_element_at("c", F.lit(-1)), " "), F.lit("")).alias("last"))


@query("SELECT o_orderkey, (floor(o_totalprice / 0.25) + 1)::BIGINT AS break_even FROM orders")
def break_even_table(spark, sf_dir):
    """Whose fixed cost (its price) pays off against dearer requests, and when."""
    costs = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("fixed"),
        F.lit(0.5).alias("per_request"),
        F.lit(0.75).alias("other_per_request"),
    )
    return N.break_even_table(costs).select("o_orderkey", "break_even")


@query("SELECT count(DISTINCT len) AS n, round(sum((len + 65) / 0.75::DOUBLE * 0.02 / 1000), 6) AS cost FROM (SELECT DISTINCT len(string_split(text, ' ')) AS len FROM benchmark)")
def prompt_costs(spark, sf_dir):
    words = [r.n for r in load(spark, sf_dir, "benchmark").select(F.size(F.split("text", " ")).alias("n")).distinct().collect()]  # prompts are few
    return spark.createDataFrame([(len(words), round(sum(N.prompt_cost(n) for n in words), 6))], "n long, cost double")


@query(f"SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS statistic FROM {_DIFF}")
def hypothesis_test(spark, sf_dir):
    """The one test asked for, over scores of two labels against a reference."""
    rows = _paired(spark, sf_dir)
    names = {"x": F.col("d"), "y": F.lit(0.0)}
    flags = [F.lit("ref").alias("ref_id"), F.lit("m").alias("metric_id"), F.lit(True).alias("pred_pos"), F.lit(True).alias("ref_pos")]
    scores = None
    for name, value in names.items():
        one = rows.select("review_id", F.lit(name).alias("label_id"), value.cast("double").alias("score"), *flags)
        scores = one if scores is None else scores.unionByName(one)
    found = significance.hypothesis_test(scores, "x", "y", "m", "ttest")["ttest"]
    return rounded(spark.createDataFrame([(float(found["statistic"]),)], "statistic double"), "statistic")
