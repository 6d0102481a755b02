import fnmatch
import json
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.operators import labels as L
from quillstone.operators import review_sets as R
from quillstone.operators import scoring
from quillstone.sources import documents


def label(options, datasets=(), scores=None, metadata="{}", created="2024-01-01T00:00:00+00:00"):
    return (created, options, list(datasets), metadata, scores or {}, {})


def reviews(spark, rows):
    """rows: {review_id: {label_id: label}}"""
    null = [None] * len(R.ATTRIBUTES)
    schema = ", ".join(["review_id string", *(f"{a} string" for a in R.ATTRIBUTES), f"labels {L.LABELS}"])
    df = spark.createDataFrame([(k, *null, v) for k, v in rows.items()], schema)
    return df.withColumn("review_body", F.concat(F.lit("body "), "review_id")).withColumn("star_rating", F.lit("5"))


TWO = {
    "r1": {"chat_gpt-1": label(["going crazy"]), "bp-golden": label([], ["gold"])},
    "r2": {"chat_gpt-1": label(["sleeping"]), "bp-golden": label(["sleeping"], ["gold"])},
}


@pytest.fixture(scope="module")
def two(spark):
    return reviews(spark, TWO).cache()


def ids(df):
    return sorted(r.review_id for r in df.select("review_id").collect())


@given(st.text("ab-[]!*?^x.", max_size=6), st.lists(st.text("ab-x.[^", max_size=5), min_size=1, max_size=5))
def test_globs_are_shell_patterns(pattern, names):
    try:
        expected = [bool(re.match(fnmatch.translate(pattern), n)) for n in names]
        regex = re.compile(L.glob_regex(pattern).replace("\\z", "\\Z"))
    except re.error:
        return
    assert [bool(regex.match(n)) for n in names] == expected


def test_selection(two):
    row = two.filter("review_id = 'r1'").select(
        L.ByGlob("c*", "*-*").ids(F.col("labels")).alias("a"),
        L.ByDataset("gold").ids(F.col("labels")).alias("b"),
        L.label_type(F.col("labels"), L.ByGlob("*")).alias("t"),
        L.label_type(F.col("labels"), L.ByGlob("none")).alias("n"),
        L.usage_options(F.col("labels"), "none").alias("o"),
    ).first()
    assert row.a == ["chat_gpt-1", "bp-golden", "chat_gpt-1"]
    assert (row.b, row.t, row.n, row.o) == (["bp-golden"], "both", None, [])


def test_missing_label_is_an_error(two):
    with pytest.raises(Exception, match="no label is selected"):
        two.select(L.has_usage(F.col("labels"), L.ByGlob("none"))).collect()


def test_adding_and_removing(two):
    added = two.withColumn("labels", L.add_label(F.col("labels"), "new", F.array(F.lit("a")), F.lit("2024-01-01T00:00:00Z")))
    assert added.filter(L.has_all(F.col("labels"), ["new", "bp-golden"])).count() == 2
    with pytest.raises(Exception, match="is there already"):
        two.select(L.add_label(F.col("labels"), "bp-golden", F.array(F.lit("a")), F.lit("x"))).collect()
    scored = {"r": {"a": label(["x"], scores={"b": {"m": (0.5, True, True)}}), "b": label(["y"])}}
    left = reviews(two.sparkSession, scored).select(L.remove_label(F.col("labels"), "b").alias("l")).first().l
    assert set(left) == {"a"} and left["a"].scores == {}


def test_union_is_idempotent_and_ordered(two):
    a = R.ReviewSet(two)
    assert (a | a) == a
    other = R.ReviewSet(reviews(two.sparkSession, {"r2": {"x": label(["y"])}, "r3": {"x": label([])}}).withColumn("review_body", F.lit("other")))
    merged = {r.review_id: r for r in (a | other).df.collect()}
    assert set(merged) == {"r1", "r2", "r3"}
    assert merged["r2"].review_body == "body r2" and merged["r3"].review_body == "other"
    assert set(merged["r2"].labels) == {"chat_gpt-1", "bp-golden", "x"}
    assert ids(a.merge(other, allow_new=False).df) == ["r1", "r2"]
    assert ids((a - other).df) == ["r1"]
    assert tuple(R.common_and_new(a.df, other.df).first()) == (1, 1)


def test_labels_of_one_id_must_agree(spark):
    a, b = reviews(spark, {"r": {"x": label(["a", "b"])}}), reviews(spark, {"r": {"x": label(["b", "a"])}})
    with pytest.raises(Exception, match="different options"):
        R.merge(a, b).collect()


def test_label_merge_unites(spark):
    a = reviews(spark, {"r": {"x": label(["o"], ["d1"], {"ref": {"m": (0.1, True, True), "n": (0.2, True, True)}}, '{"k":"1","j":"2"}')}})
    b = reviews(spark, {"r": {"x": label(["o"], ["d2", "d1"], {"ref": {"m": (0.9, True, True)}, "q": {"m": (0.3, True, False)}}, '{"k":"3"}')}})
    x = R.merge(a, b).first().labels["x"]
    assert x.datasets == ["d1", "d2"]
    assert {r: {m: s.score for m, s in v.items()} for r, v in x.scores.items()} == {"ref": {"m": 0.9, "n": 0.2}, "q": {"m": 0.3}}
    assert '"k":"3"' in x.metadata and '"j":"2"' in x.metadata


def test_filter_null_is_false(two):
    rs = R.ReviewSet(two)
    assert len(rs.filter(F.lit(None).cast("boolean"))) == 0
    assert len(rs.filter(F.lit(None).cast("boolean"), invert=True)) == 2
    assert len(rs.drop_review("r1", "nobody")) == 1
    assert "r1" in rs and "r9" not in rs and rs["r1"].review_body == "body r1"


def test_validation(spark, two):
    R.ReviewSet(two).validate()
    bad = reviews(spark, {"r": {"x": label(None, created="yesterday")}})
    assert {r.rule for r in R.violations(bad).collect()} == {"usageOptions is null", "createdAt is no time"}
    assert "attribute vine is missing" in {r.rule for r in R.violations(two.drop("vine")).collect()}


def test_golden_scores(two):
    """Of two reviews one is a false positive and one an exact match: all means are one half."""
    pairs = scoring.label_pairs(two, ["chat_gpt-1"], ["bp-golden"])
    names = ("custom_weighted_mean_precision", "custom_weighted_mean_recall", "custom_weighted_mean_f1")
    scores = scoring.score_pairs(pairs, names)
    means = {r.metric_id: r.m for r in scores.groupBy("metric_id").agg(F.avg("score").alias("m")).collect()}
    assert all(means[n] == pytest.approx(0.5, abs=1e-6) for n in names)
    again = scoring.score_missing(pairs, scores.filter(F.col("metric_id") != names[0]), names)
    assert again.count() == 6


def test_best_reference_ignores_nan(spark):
    rows = [("r", "a", "x", "m", float("nan"), True, True), ("r", "a", "y", "m", 0.2, True, False), ("s", "a", "x", "m", float("nan"), True, True)]
    df = spark.createDataFrame(
        rows,
        "review_id string, label_id string, ref_id string, metric_id string, score double, pred_pos boolean, ref_pos boolean",
    )
    assert [(r.review_id, r.score, r.ref_id) for r in scoring.best_reference(df).collect()] == [("r", 0.2, "y")]


def test_exclusive_quartiles(spark):
    for values in ([1.0, 2.0], [1.0, 2.0, 3.0, 3.0, 7.0]):
        import statistics

        df = spark.createDataFrame([("g", v) for v in values], "g string, score double")
        r = scoring.score_summary(df, ["g"]).first()
        assert [r.q1, r.q2, r.q3] == pytest.approx(statistics.quantiles(values))
        assert r.variance == pytest.approx(statistics.variance(values))
        row = df.groupBy().agg(F.array_sort(F.collect_list("score")).alias("v")).select(
            *[scoring.exclusive_quantile(F.col("v"), i).alias(f"q{i}") for i in (1, 2, 3)],
        ).first()
        assert list(row) == pytest.approx(statistics.quantiles(values))


def test_old_formula_is_kept_apart(spark):
    df = spark.createDataFrame(
        [(True, True)] * 3 + [(False, True)] + [(False, False)] * 2 + [(True, False)] * 2,
        "pred_pos boolean, ref_pos boolean",
    ).withColumn("g", F.lit(1))
    assert scoring.classification_scores(df, ["g"]).first().balanced_accuracy == pytest.approx((0.75 + 0.5) / 2)
    assert scoring.classification_scores(df, ["g"], strict_compat=True).first().balanced_accuracy == pytest.approx(0.5)


def test_document_files(spark, tmp_path):
    v3 = '{"version": 3, "reviews": {"a": {"customer_id": 7, "review_body": "x \\u00ae", "labels": {"g": {"createdAt": "2023-01-01T00:00:00+00:00", "usageOptions": ["s"], "metadata": {"k": 1}, "scores": {"r": {"m": [1, true, false]}}, "datasets": {"d": "train"}}}}}}'
    v0 = '[{"review_id": "a", "review_body": "x", "label": {"customUsageOptions": ["c"], "annotations": [{"tokens": ["p", "q"]}], "replacementClasses": {}, "isFlagged": false}}, {"review_id": "b", "review_body": "y"}]'
    (tmp_path / "v3.json").write_text(v3)
    (tmp_path / "v0.json").write_text(v0)
    rs = documents.read_documents(spark, str(tmp_path / "v3.json"))
    row = rs["a"]
    assert row.customer_id == "7" and row.labels["g"].datasets == ["d"] and row.labels["g"].scores["r"]["m"].score == 1.0
    both = documents.read_documents(spark, str(tmp_path / "v3.json"), str(tmp_path / "v0.json"), label_id="old")
    assert both["a"].labels["old"].usageOptions == ["c", "p q"] and both["b"].labels == {}
    assert "isFlagged" in both["a"].labels["old"].metadata and "replacement" not in both["a"].labels["old"].metadata
    rows = {r.review_id: r.asDict(True) for r in both.df.collect()}
    documents.save_documents(both, str(tmp_path / "out.json"))
    saved = json.loads((tmp_path / "out.json").read_text())
    assert saved["version"] == 5 and list(saved["reviews"]) == ["a", "b"] and saved["reviews"]["a"]["labels"]["g"]["scores"] == {"r": {"m": [1.0, True, False]}}
    back = documents.read_documents(spark, str(tmp_path / "out.json"))
    assert {r.review_id: r.asDict(True) for r in back.df.collect()} == rows
    documents.save_lines(both, str(tmp_path / "lines"))
    assert {r.review_id: r.asDict(True) for r in documents.read_documents(spark, str(tmp_path / "lines"), lines=True).df.collect()} == rows
    documents.save_documents(R.ReviewSet(both.df.limit(0)), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"version": 5, "reviews": {}}
    assert len(documents.read_documents(spark, str(tmp_path / "none.json"))) == 0
    with pytest.raises(ValueError):
        documents.read_documents(spark)
    with pytest.raises(ValueError):
        documents.save_documents(R.ReviewSet(both.df))


def test_files_of_a_folder_are_merged(spark, tmp_path):
    """Each file has its own version; labels of all files stay, attributes are the first file's, and a repeated id within a file
    counts last."""
    label = lambda o: {"createdAt": "t", "usageOptions": [o], "metadata": {}, "scores": {}, "datasets": [], "augmentations": {}}
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "a.json").write_text(
        json.dumps({
            "version": 5,
            "reviews": {"r1": {"review_body": "one", "labels": {"x": label("p")}}, "r2": {"review_body": "two", "labels": {}}},
        }),
    )
    (folder / "b.json").write_text(json.dumps({"version": 5, "reviews": {"r1": {"review_body": "other", "labels": {"y": label("q")}}}}))
    (folder / "c.json").write_text(
        json.dumps([
            {"review_id": "r3", "review_body": "old", "label": {"customUsageOptions": ["c"], "annotations": []}},
            {"review_id": "r1", "review_body": "z", "label": {"customUsageOptions": ["d"], "annotations": []}},
        ]),
    )
    rows = {r.review_id: r for r in documents.read_documents(spark, str(folder), label_id="v0").df.collect()}
    assert set(rows) == {"r1", "r2", "r3"} and rows["r1"].review_body == "one"
    assert {k: v.usageOptions for k, v in rows["r1"].labels.items()} == {"x": ["p"], "y": ["q"], "v0": ["d"]}
    assert rows["r3"].labels["v0"].usageOptions == ["c"] and rows["r2"].labels == {}
    apart = documents.read_documents(spark, *(str(folder / f) for f in ("a.json", "b.json", "c.json")), label_id="v0")
    assert {r.review_id: r.asDict(True) for r in apart.df.collect()} == {k: r.asDict(True) for k, r in rows.items()}


def test_scores_are_stored_in_the_set(spark):
    """The two-review fixture: weighted precision, recall and F1 are 0.5 on average; what is known is not made again."""
    def review(i, pred, ref):
        made = lambda o: ("t", o, [], "{}", {}, {})
        return (i, {"openai-m": made(pred), "bp-golden": made(ref)})

    rs = R.ReviewSet(spark.createDataFrame(
        [review("a", ["going crazy"], []), review("b", ["sleeping"], ["sleeping"])],
        f"review_id string, labels {L.LABELS}",
    ))
    names = ["custom_weighted_mean_precision", "custom_weighted_mean_recall", "custom_weighted_mean_f1"]
    first = rs.score_labels(["openai*"], ["bp*"], names[:1])
    scored = first.score_labels(["openai*"], ["bp*"], names)
    long = L.scores_long(scored.df)
    means = {r.metric_id: r.mean for r in scoring.mean_scores(long).collect()}
    assert means == {n: pytest.approx(0.5, abs=1e-6) for n in names} and long.count() == 6
    assert {(r.review_id, r.pred_pos, r.ref_pos) for r in long.collect()} == {("a", True, False), ("b", True, True)}
    back = L.pivot_labels(L.labels_long(scored.df), long)
    assert sorted(map(tuple, L.scores_long(back).collect())) == sorted(map(tuple, long.collect()))
    gone = scored.delete_labels("bp*")
    assert gone.label_ids() == ["openai-m"] and L.scores_long(gone.df).count() == 0 and L.scores_long(scored.reset_scores().df).count() == 0
    assert [r.review_id for r in scored] == ["a", "b"] and [r.review_id for r in scored.slice(1, 5)] == ["b"]
    made = scored.annotate(lambda texts: [["x"] for _ in texts], "new", "t", text="review_id")
    assert made["a"].labels["new"].usageOptions == ["x"]


def test_labels_are_scored_in_their_row(spark):
    """Nothing is joined or shuffled, and what the labels are made of is worked out once: not again to find or to drop rows."""
    text = F.split(F.col("t"), ",")
    made = L.add_label(L.add_label(F.create_map().cast(L.LABELS), "bp", text, F.lit("now")), "ai", F.slice(text, 1, 1), F.lit("now"))
    df = spark.createDataFrame([("a", "x,y"), ("b", "z")], "review_id string, t string").select("review_id", made.alias("labels"))
    rows = scoring.score_labels(df, ["ai"], ["bp"], ["custom_mean_recall"], kind="exact")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("split(") <= 4
    long = L.scores_long(rows)
    assert {r.review_id: (r.label_id, r.ref_id, r.score) for r in long.collect()} == {"a": ("ai", "bp", 0.5), "b": ("ai", "bp", 1.0)}
    assert "Join" not in scoring.label_pairs(df, ["ai"], ["bp"])._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="there already"):
        df.select(L.add_label(F.col("labels"), "ai", F.array(F.lit("q")), F.lit("now"))).collect()


def test_decisions_by_hand(spark):
    label = ("t", ["keep me", "drop me", "change me", "undecided"], [], "{}", {}, {})
    df = spark.createDataFrame([("a", {"chat_gpt-1": label}), ("b", {"chat_gpt-1": label}), ("c", {})], f"review_id string, labels {L.LABELS}")
    told = spark.createDataFrame(
        [("a", "keep me", True, ""), ("a", "drop me", False, None), ("a", "change me", True, "changed"), ("c", "x", True, None)],
        "review_id string, usage_option string, keep boolean, revised string",
    )
    rows = {r.review_id: r.labels for r in L.apply_decisions(df, told, F.lit("now")).collect()}
    assert rows["a"]["bp-chat_gpt_correction"].usageOptions == ["keep me", "undecided", "changed"]
    assert set(rows["b"]) == {"chat_gpt-1"} and rows["c"] == {}
