import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators import augmentation, clustering, cleaning, sampling, significance
from quillstone.operators import statistics as A
from quillstone.sources import sql_runner, tables


def rows(spark, *bodies, **columns):
    base = dict(
        marketplace="US",
        customer_id="c",
        review_id="r",
        product_id="p",
        product_parent="1",
        product_title="t",
        product_category="Camera",
        star_rating=5,
        helpful_votes=0,
        total_votes=0,
        vine="N",
        verified_purchase="Y",
        review_headline="h",
        review_body="b",
        review_date="2015-01-01",
    )
    data = [
        tuple((
            base | columns | (b if isinstance(b, dict) else {"review_body": b}) | {"review_id": str(i)}
        )[f.name] for f in cleaning.REVIEW_SCHEMA) for i,
        b in enumerate(bodies)
    ]
    return spark.createDataFrame(data, cleaning.REVIEW_SCHEMA)


def test_tsv_quotes_and_bad_lines(spark, tmp_path):
    names = [f.name for f in cleaning.REVIEW_SCHEMA]
    good = ["US", "1", "R1", "P", "2", 'a "quoted title', "Toys", "5", "0", "1", "N", "Y", "h", "body", "2015-01-01"]
    (tmp_path / "a.tsv").write_text("\n".join("\t".join(x) for x in (names, good, [*good, "more"])) + "\n")
    df = tables.read_tsv(spark, str(tmp_path))
    assert df.first().product_title == 'a "quoted title' and dict(df.dtypes)["star_rating"] == "tinyint"
    tables.tsv_to_parquet(spark, str(tmp_path), str(tmp_path / "p"))
    assert tables.read_table(spark, str(tmp_path / "p")).first().review_id == "R1"
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", "xml")


def test_word_limits_are_strict(spark):
    df = rows(spark, "a b c d", "a b c d e", None)
    assert [r.review_body for r in cleaning.keep_word_counts(df, 4).collect()] == ["a b c d e"]


def test_bots_and_null_customers(spark):
    many = [{"customer_id": "bot"}] * 31 + [{"customer_id": "busy"}] * 30 + [{"customer_id": None}] * 40
    left = cleaning.drop_bots(rows(spark, *many), 30).groupBy("customer_id").count().collect()
    assert {r.customer_id: r["count"] for r in left} == {"busy": 30, None: 40}


def test_etl(spark):
    df = rows(
        spark,
        "one two three &lt;br /&gt; four <b>five</b> useful",
        {"review_body": "a b c d e", "product_category": "Books"},
        {"review_body": "a b c d e f", "verified_purchase": "N"},
    )
    out = cleaning.etl(df).collect()
    assert len(out) == 1 and out[0].review_body == "one two three four five useful"
    assert (out[0].review_body_word_count, out[0].review_body_usage_count, out[0].verified_purchase) == (6, 1, 1)


def test_flags_must_be_known(spark):
    with pytest.raises(Exception, match="neither Y nor N"):
        cleaning.flags_to_numbers(rows(spark, {"vine": "X"})).collect()


def test_statements():
    assert sql_runner.split_statements("select ';' -- a;b\n; ; /* ; */ select \"x;y\" ; -- end") == ["select ';' -- a;b", '/* ; */ select "x;y"']


def test_sql(spark, tmp_path):
    results = sql_runner.run_sql(spark, rows(spark, "a", "b"), "select count(*) n from reviews; select max(star_rating) m from reviews")
    assert [r.first()[0] for r in results] == [2, 5] and dict(results[1].dtypes)["m"] == "bigint"
    assert len(sql_runner.save_results(results, str(tmp_path / "q"))) == 2


def test_groups_leave_nulls_out(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert [tuple(r) for r in A.group_sizes(df, ["k"]).collect()] == [("a", 2)]


def test_gaps_and_buckets(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:00", 2), ("a", "2024-01-02 00:00:01", 3), ("b", "2024-01-01 00:00:00", 4)],
        "k string, s string, i int",
    ).withColumn("t", F.to_timestamp_ntz("s"))
    out = {r.i: (r.gap, r.b) for r in A.gaps(df, "k", "t", "i").withColumn("b", A.fixed_bucket(F.col("gap"))).collect()}
    assert out == {1: (None, None), 2: (0.0, 0), 3: (86401.0, 2), 4: (None, None)}


def test_bucket_sums_add_up(spark):
    counts = spark.createDataFrame([(i, i % 7 + 1) for i in range(1, 50)], "size long, keys long")
    out = A.equal_frequency_counts(counts, 5)
    assert out.agg(F.sum("total")).first()[0] == counts.agg(F.sum("keys")).first()[0] and out.count() == 5


@pytest.mark.parametrize("n, fraction", [(10, 0.25), (2, 0.01), (7, 0.99)])
def test_split_sizes(spark, n, fraction):
    out = sampling.split(spark.range(n), fraction, 1, "id")
    first = out.filter("in_first").count()
    assert first == min(n - 1, max(1, int(n * fraction))) and out.count() == n


def test_split_edges(spark):
    assert sampling.split(spark.range(3), 1, 1, "id").filter("in_first").count() == 3
    with pytest.raises(ValueError):
        sampling.split(spark.range(3), 1.5, 1, "id")
    with pytest.raises(ValueError):
        sampling.sample_n(spark.range(3), 0, 1, "id")
    with pytest.raises(ValueError):
        sampling.train_test_val(spark.range(3), ["id"], "id", 0.5, 0.2, 0.1)


def test_ranks_keep_null_strata(spark):
    df = spark.createDataFrame([(i, None if i < 3 else "a") for i in range(9)], "id int, k string")
    assert sampling.split(df, 0.5, 1, "id", ["k"]).count() == 9


def test_train_test_val_default(spark):
    df = spark.range(10).withColumn("k", F.lit(1))
    assert {
        r.part: r["count"] for r in sampling.train_test_val(df, ["k"], "id").groupBy("part").count().collect()
    } == {"train": 7, "test": 2, "val": 1}


def test_budget(spark):
    groups = spark.createDataFrame([(1, 1), (2, 2), (3, 7)], "cluster int, size int")
    assert sorted(r.cluster for r in sampling.within_budget(groups, 0.2).collect()) == [1, 2]


def test_clusters_by_count_and_by_distance():
    import numpy as np

    X = np.array([[1, 0], [1, 0.05], [0, 1], [0.05, 1], [-1, -1]], float)
    D = clustering.distances(X, "cosine")
    by_count, by_distance = clustering.link(D, "average", n_clusters=3), clustering.link(D, "average", distance_threshold=0.3)
    assert (by_count == by_distance).all() and len(set(by_count)) == 3
    for linkage in ("single", "complete", "ward"):
        assert len(set(clustering.link(D, linkage, n_clusters=2))) == 2
    with pytest.raises(ValueError):
        clustering.link(D, "average")
    assert clustering.communities(X, 0.9, 2).tolist() == [0, 0, 1, 1, -1]
    with pytest.raises(ValueError):
        clustering.sweep()


def brute_quality(X, labels):
    """Silhouette, Davies-Bouldin, Calinski-Harabasz, mean similarity within clusters and to their centres, best and worst cluster."""
    names = np.unique(labels)
    D, k, n = clustering.distances(X, "euclidean"), len(names), len(X)
    sums = np.stack([D[:, labels == c].sum(1) for c in names], axis=1)
    sizes = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    a = sums[np.arange(n), own] / np.maximum(1, sizes[own] - 1)
    others = sums / sizes
    others[np.arange(n), own] = np.inf
    b = others.min(1) if k > 1 else np.zeros(n)
    sil = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    C = np.stack([X[labels == c].mean(0) for c in names])
    scatter = np.array([np.linalg.norm(X[labels == c] - C[i], axis=1).mean() for i, c in enumerate(names)])
    between = clustering.distances(C, "euclidean")
    np.fill_diagonal(between, np.inf)
    within = sum(((X[labels == c] - C[i]) ** 2).sum() for i, c in enumerate(names))
    spread = (sizes * ((C - X.mean(0)) ** 2).sum(1)).sum()
    cos = 1 - clustering.distances(X, "cosine")
    mean_sim = np.array([cos[np.ix_(labels == c, labels == c)].mean() for c in names])
    centre_sim = np.array([
        (X[labels == c] @ C[i] / np.maximum(1e-300, np.linalg.norm(X[labels == c], axis=1) * np.linalg.norm(C[i]))).mean() for i,
        c in enumerate(names)
    ])
    return {
        "silhouette": float(sil.mean()),
        "davies_bouldin": float(((scatter[:, None] + scatter[None]) / between).max(1).mean()) if k > 1 else 0.0,
        "calinski_harabasz": float(spread / (k - 1) / (within / (n - k))) if 1 < k < n and within else 0.0,
        "sim_in_cluster": float(mean_sim.mean()),
        "sim_to_centroid": float(centre_sim.mean()),
        "best": float(names[mean_sim.argmax()]),
        "worst": float(names[mean_sim.argmin()]),
    }


@pytest.mark.parametrize("block", [2048, 17])
def test_cluster_quality_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 5, 120)
    labels[0] = 9  # a cluster of one
    X = rng.normal(size=(5, 6))[labels % 5] * 2 + rng.normal(size=(120, 6))
    df = spark.createDataFrame(
        [(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(X, labels))],
        "vec_id long, embedding array<double>, cluster int",
    )
    got = {r.measure: r.value for r in clustering.cluster_quality(df, block=block).collect()}
    assert got == pytest.approx(brute_quality(X, labels), rel=1e-9, abs=1e-9)


def test_distances_to_clusters_are_a_row_for_each_block(spark):
    """Not a row for each row, block and cluster; a pair is measured once for both; rows without a cluster are compared with none."""
    X = np.random.default_rng(6).normal(size=(90, 3))
    labels = [None if i % 10 == 9 else i % 4 for i in range(90)]
    df = spark.createDataFrame([(i, x.tolist(), c) for i, (x, c) in enumerate(zip(X, labels))], "vec_id long, _v array<double>, cluster int")
    got = {(r.key, r.other): r.far for r in clustering._far_sums(df, "vec_id", 3, 20).collect()}
    D = clustering.distances(X, "euclidean")
    expected = {(i, c): D[i, [j for j, x in enumerate(labels) if x == c]].sum() for i in range(90) if labels[i] is not None for c in range(4)}
    assert got == pytest.approx(expected, rel=1e-9)
    measured = {r.measure: r.value for r in clustering.cluster_quality(df.withColumnRenamed("_v", "embedding"), block=20).collect()}
    some = [i for i in range(90) if labels[i] is not None]
    assert measured["silhouette"] == pytest.approx(brute_quality(X[some], np.array([labels[i] for i in some]))["silhouette"] * len(some) / 90)


def test_spectral_clusters(spark):
    """Two rings, one in the other: spectral clusters part them, with all points as landmarks and with a third of them."""
    angle = np.linspace(0, 2 * np.pi, 150, endpoint=False)
    rings = np.concatenate([r * np.stack((np.cos(angle), np.sin(angle)), axis=1) for r in (1, 6)])
    for some in (rings, rings[::3]):
        found = clustering.spectral(some, 2)(rings)
        assert len(set(found[:150])) == len(set(found[150:])) == 1 and found[0] != found[150]
    df = spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(rings)] + [(999, None, 1.0)],
        "id long, confidence double, variability double",
    )
    for landmarks in (1500, 100):
        got = {r.id: r.cluster for r in clustering.loss_map_clusters(df, 2, landmarks=landmarks).collect()}
        assert len(got) == 300 and len({got[i] for i in range(150)}) == len({got[i] for i in range(150, 300)}) == 1 and got[0] != got[150]
    with pytest.raises(ValueError):
        clustering.loss_map_clusters(df, 2, method="ward")


def test_malformed_lines_are_dropped_whatever_is_asked_for(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text("a\tb\tc\n1\tx\t1\n2\ty\t2\t9\n3\tz\tno\n4\t\"q\t4\n")
    df = tables.read_tsv(spark, str(path), schema="a int, b string, c int")
    assert [tuple(r) for r in df.collect()] == [(1, "x", 1), (4, '"q', 4)]
    assert df.count() == 2 and [r.b for r in df.select("b").collect()] == ["x", '"q'] and df.filter("a > 1").count() == 1


def test_clusters_refuse_too_many(spark):
    df = spark.range(5).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(ValueError):
        clustering.agglomerative(df, n_clusters=2, linkage="complete", most=4)
    with pytest.raises(ValueError):
        clustering.reduce_dimensions(df, 1, "tsne")


def test_significance(spark):
    better = spark.createDataFrame(
        [(str(i), 0.5 + 0.01 * (i % 5), 0.4, 0.1 + 0.01 * (i % 5), i % 2 == 0, i % 2 == 0) for i in range(40)],
        "review_id string, a double, b double, d double, a_ref boolean, b_ref boolean",
    )
    assert significance.t_test(better, "greater")["p"] < 0.001
    assert significance.wilcoxon(better, "greater")["p"] < 0.001
    assert significance.permutation(better, "greater", 200)["p"] < 0.02
    assert significance.permutation_harmonic(better, "greater", 200)["p"] < 0.02
    up = significance.bootstrap(better, alternative="greater", replicates=200)
    down = significance.bootstrap(better, alternative="less", replicates=200)
    assert up["rejected"] and not down["rejected"] and 0.08 < up["low"] < up["high"] < 0.14


def test_chunks_and_modes(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],)], "o array<string>")
    assert [r[0] for r in df.select(augmentation.chunks(F.col("o"), 2)).collect()] == [[["a", "b"], ["c"]], []]
    texts = lambda mode: [r[0] for r in df.select(augmentation.option_texts(F.col("o"), mode)).collect()]
    assert texts("default") == [["a; b; c"], [""]] and texts("flat") == [["a", "b", "c"], [""]]
    assert len(texts("shuffle-all")[0]) == 6 and len(texts("shuffle-2")[0]) == 2
    with pytest.raises(ValueError):
        augmentation.option_texts(F.col("o"), "shuffle-x")


def test_consensus():
    s = lambda options, p: {"usageOptions": options, "usageOptionsLogprobs": [p]}
    assert augmentation.consensus([s(["a"], -1), s(["b"], -0.5)]) == (2, [s(["b"], -0.5)])
    assert augmentation.consensus([s(["a"], -1), s([], -1)]) is None
    four = [s(["a"], -1), s([], -1), s([], -2), s([], -0.1)]
    assert augmentation.consensus(four) == (4, [s([], -0.1)])
    five = [s(["a"], -1), s([], -1), s(["b"], -2), s([], -0.1), s(["c"], -0.2)]
    assert augmentation.consensus(five) == (5, [s(["c"], -0.2)])


def test_retrying():
    seen, waits = [], []

    def call():
        seen.append(1)
        if len(seen) < 3:
            raise OSError
        return "ok"

    assert augmentation.retrying(call, sleep=waits.append)() == "ok" and waits == [1.0, 2.0]


def test_streamed_manifests(spark, tmp_path):
    import json

    from quillstone.streaming.manifests import convert_arrivals

    content = json.dumps({"annotations": json.dumps({"annotations": [[{"tokens": ["a", "b"]}]], "customUsageOptions": [["c"]]})})
    line = {
        "source": json.dumps(["x"]),
        "metadata": [{"review_id": "r1"}],
        "run": {"annotationsFromAllWorkers": [{"workerId": "w", "annotationData": {"content": content}}]},
        "run-metadata": {"job-name": "run"},
    }
    source = tmp_path / "in"
    source.mkdir()
    (source / "m.manifest").write_text(json.dumps(line) + "\n")
    convert_arrivals(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), "v", "2024-01-01T00:00:00Z").awaitTermination(60)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.review_id == "r1" and '"c","a b"' in row.labels and "aws-v-run" in row.labels


def test_schema_is_fixed():
    assert [f.name for f in cleaning.REVIEW_SCHEMA][:3] == ["marketplace", "customer_id", "review_id"] and isinstance(
        cleaning.REVIEW_SCHEMA["star_rating"].dataType,
        T.ByteType,
    )
