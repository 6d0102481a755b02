"""Sets of labelled reviews: one DataFrame keyed by review_id, with set algebra, merging and validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import labels as L
from quillstone.operators import sampling

ATTRIBUTES = (
    "marketplace",
    "customer_id",
    "product_id",
    "product_parent",
    "product_title",
    "product_category",
    "star_rating",
    "helpful_votes",
    "total_votes",
    "vine",
    "verified_purchase",
    "review_headline",
    "review_body",
    "review_date",
)
VERSION = 5


def _right_biased(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))


def merge_label(a: Column, b: Column) -> Column:
    """Two labels of one id: options must be equal, scores are united by reference and metric (the second wins),
    datasets united, augmentations and metadata taken from the second where both have them."""
    same = F.when(a["usageOptions"] == b["usageOptions"], a["usageOptions"]).otherwise(
        F.raise_error(F.lit("labels of one id have different options")).cast("array<string>"),
    )
    scores = F.map_zip_with(a["scores"], b["scores"], lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(_right_biased(x, y)))
    as_map = lambda x: F.from_json(F.coalesce(x, F.lit("{}")), "map<string,string>")
    metadata = F.when(b["metadata"].isNull(), a["metadata"]).when(
        a["metadata"].isNull() | (a["metadata"] == b["metadata"]),
        b["metadata"],
    ).otherwise(F.to_json(_right_biased(as_map(a["metadata"]), as_map(b["metadata"]))))
    return F.struct(
        a["createdAt"].alias("createdAt"),
        same.alias("usageOptions"),
        F.array_union(a["datasets"], b["datasets"]).alias("datasets"),
        metadata.alias("metadata"),
        scores.alias("scores"),
        _right_biased(a["augmentations"], b["augmentations"]).alias("augmentations"),
    )


def merge_label_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(merge_label(x, y)))


def merge(a: DataFrame, b: DataFrame, allow_new: bool = True) -> DataFrame:
    """Union by review_id: attributes of a win, labels are merged; without allow_new only a's reviews."""
    columns = [c for c in a.columns if c not in ("review_id", "labels")]
    right = b.select("review_id", *[F.col(c).alias(f"_b_{c}") for c in [*columns, "labels"] if c in b.columns], F.lit(True).alias("_in_b")).alias("b")
    left = a.withColumn("_in_a", F.lit(True))
    joined = left.join(right, "review_id", "full_outer" if allow_new else "left")
    pick = [F.when(F.col("_in_a"), F.col(c)).otherwise(F.col(f"_b_{c}")).alias(c) if c in b.columns else F.col(c) for c in columns]
    merged = F.when(F.col("_in_a").isNull(), F.col("_b_labels")).when(F.col("_in_b").isNull(), F.col("labels")).otherwise(
        merge_label_maps(F.col("labels"), F.col("_b_labels")),
    )
    return joined.select("review_id", *pick, merged.alias("labels")).select(*a.columns)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("review_id"), "review_id", "left_anti")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("review_id"), "review_id", "left_semi")


def common_and_new(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ids of b that a has, and that it has not."""
    inside = F.count(F.when(F.col("_a"), 1))
    joined = b.select("review_id").join(a.select("review_id", F.lit(True).alias("_a")), "review_id", "left")
    return joined.agg(inside.alias("n_common"), (F.count("*") - inside).alias("n_new"))


def same_ids(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same reviews, by id."""
    return minus(a, b).isEmpty() and minus(b, a).isEmpty()


def merge_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """label_id, reviews of b that have it, of these those new to a, and those where a has the label already."""
    mine = L.labels_long(a).select("review_id", "label_id", F.lit(True).alias("_label"))
    ids = a.select("review_id", F.lit(True).alias("_review"))
    joined = L.labels_long(b).select("review_id", "label_id").join(ids, "review_id", "left").join(mine, ["review_id", "label_id"], "left")
    return joined.groupBy("label_id").agg(
        F.count("*").alias("reviews"),
        F.count(F.when(F.col("_review").isNull(), 1)).alias("new_reviews"),
        F.count("_label").alias("overlap"),
    )


def violations(df: DataFrame) -> DataFrame:
    """(review_id, rule) of everything that breaks the document model."""
    rows = []
    for c in ("review_id", *ATTRIBUTES):
        if c not in df.columns:
            rows.append(F.when(F.lit(True), F.lit(f"attribute {c} is missing")))
    bad = lambda rule, test: F.when(F.exists(F.map_values("labels"), test), F.lit(rule))
    rows += [
        F.when(F.col("review_id").isNull(), F.lit("review_id is null")),
        F.when(F.col("labels").isNull(), F.lit("labels is null")),
        bad("usageOptions is null", lambda x: x["usageOptions"].isNull()),
        bad("datasets is null", lambda x: x["datasets"].isNull()),
        bad("scores is null", lambda x: x["scores"].isNull()),
        bad("augmentations is null", lambda x: x["augmentations"].isNull()),
        bad("createdAt is no time", lambda x: x["createdAt"].isNull() | F.try_to_timestamp(x["createdAt"]).isNull()),
    ]
    return df.select("review_id", F.explode(F.array_compact(F.array(*rows))).alias("rule"))


class ReviewSet:
    """A DataFrame of reviews and the operations on it; every operation gives a new set."""

    def __init__(self, df: DataFrame, save_path: str | None = None, ids: list[str] | None = None):
        self.df, self.save_path, self._ids = df, save_path, ids

    def __or__(self, other: ReviewSet) -> ReviewSet:
        return ReviewSet(merge(self.df, other.df), self.save_path)

    def __sub__(self, other: ReviewSet) -> ReviewSet:
        return ReviewSet(minus(self.df, other.df))

    def __eq__(self, other) -> bool:
        return isinstance(other, ReviewSet) and same_ids(self.df, other.df)

    __hash__ = None

    def __len__(self) -> int:
        return self.df.count()

    def __contains__(self, review_id: str) -> bool:
        return not self.df.filter(F.col("review_id") == review_id).isEmpty()

    def __getitem__(self, review_id: str):
        row = self.df.filter(F.col("review_id") == review_id).first()
        if row is None:
            raise KeyError(review_id)
        return row

    def __iter__(self):
        """Reviews in the order of their ids, fetched a partition at a time."""
        return iter(self.df.orderBy("review_id").toLocalIterator())

    def slice(self, start: int, stop: int) -> ReviewSet:
        """Reviews of places start to stop (exclusive) in the order of their ids; start and stop count from 0."""
        if not 0 <= start <= stop:
            raise ValueError("a slice goes from a place to one not before it")
        return ReviewSet(self.df.orderBy("review_id").offset(start).limit(stop - start), self.save_path)

    def score_labels(self, label_ids: list[str], ref_ids: list[str], metric_ids=None, **how) -> ReviewSet:
        """Labels scored against references, the scores kept in the set; patterns name the labels."""
        from quillstone.functions.metrics import DEFAULT_METRICS
        from quillstone.operators.scoring import score_labels

        known = self.label_ids()
        labels, refs = L.resolve_ids(known, label_ids), L.resolve_ids(known, ref_ids)
        return ReviewSet(score_labels(self.df, labels, refs, metric_ids or DEFAULT_METRICS, **how), self.save_path, known)

    def annotate(self, label: Callable[[list[str]], list[list[str]]], label_id: str, created_at: str, **how) -> ReviewSet:
        """A new label made by a client or model for every review; with progress=, a folder, answers are saved as they come."""
        from quillstone.operators.augmentation import label_in_batches, label_with_saves

        make = label_with_saves if how.get("progress") else label_in_batches
        return ReviewSet(make(self.df, label, label_id, created_at, **how), self.save_path)

    def cluster_usage_options(self, strategy, k: int, seed: int = 42) -> DataFrame:
        """review_id, pos, usage_option, cluster, is_centroid of the selected labels' options."""
        from quillstone.operators.clustering import kmeans, usage_frame

        frame = usage_frame(self.df, strategy).withColumn("_id", F.concat_ws("/", "review_id", "pos"))
        return kmeans(frame, k, seed, key="_id").select("review_id", "pos", "usage_option", "cluster", "is_centroid")

    def delete_labels(self, *patterns: str) -> ReviewSet:
        """Without the labels that the patterns name, and without scores against them; patterns that name none are an error."""
        return ReviewSet(L.delete_labels(self.df, L.resolve_ids(self.label_ids(), list(patterns))), self.save_path)

    def merge(self, other: ReviewSet, allow_new: bool = True) -> ReviewSet:
        return ReviewSet(merge(self.df, other.df, allow_new), self.save_path)

    def filter(self, condition: Column | Callable[[DataFrame], Column], invert: bool = False) -> ReviewSet:
        """Rows where the condition holds (inverted: does not hold or is null)."""
        c = F.coalesce(condition(self.df) if callable(condition) and not isinstance(condition, Column) else condition, F.lit(False))
        return ReviewSet(self.df.filter(~c if invert else c), self.save_path)

    def filter_with_strategy(self, strategy, invert: bool = False) -> ReviewSet:
        return ReviewSet(L.keep_selected(self.df, strategy, invert), self.save_path)

    def drop_review(self, *review_ids: str) -> ReviewSet:
        return ReviewSet(self.df.filter(~F.col("review_id").isin(*review_ids)), self.save_path)

    def label_ids(self) -> list[str]:
        """Distinct label ids, sorted; there are few. They are looked up once a set."""
        if self._ids is None:
            self._ids = [r[0] for r in L.exploded(self.df, [], F.map_keys("labels"), "k").distinct().orderBy("k").collect()]
        return list(self._ids)

    def remove_label(self, label_id: str) -> ReviewSet:
        return ReviewSet(L.delete_labels(self.df, [label_id]), self.save_path)

    def merge_labels(self, *ids: str, new_id: str) -> ReviewSet:
        return ReviewSet(self.df.withColumn("labels", L.merge_labels_into(F.col("labels"), list(ids), new_id)), self.save_path)

    def reset_scores(self) -> ReviewSet:
        return ReviewSet(self.df.withColumn("labels", L.reset_scores(F.col("labels"))), self.save_path, self._ids)

    def with_labels(self, *ids: str) -> ReviewSet:
        return ReviewSet(self.df.filter(L.has_all(F.col("labels"), list(ids))), self.save_path)

    def validate(self) -> None:
        found = violations(self.df).limit(5).collect()
        if found:
            raise ValueError("; ".join(f"{r.review_id}: {r.rule}" for r in found))

    def _parts(self, split: DataFrame) -> tuple[ReviewSet, ReviewSet]:
        return ReviewSet(split.filter("in_first").drop("in_first")), ReviewSet(split.filter("not in_first").drop("in_first"))

    def split(self, fraction: float, seed: int = 0) -> tuple[ReviewSet, ReviewSet]:
        return self._parts(sampling.split(self.df, fraction, seed, "review_id"))

    def stratified_split(self, fraction: float, strategy, seed: int = 0) -> tuple[ReviewSet, ReviewSet]:
        """Split alike among reviews with and without usage; a review without the label is an error."""
        tagged = self.df.withColumn("_usage", L.has_usage(F.col("labels"), strategy))
        return self._parts(sampling.split(tagged, fraction, seed, "review_id", ["_usage"]).drop("_usage"))

    def dataset_metadata(self, strategy) -> dict:
        """What stands beside a data set of this set: its reviews, how many each first selected label gave, and the share with usage."""
        key, usage = L.first_id(F.col("labels"), strategy), L.has_usage(F.col("labels"), strategy)
        rows = self.df.select(key.alias("id"), usage.cast("long").alias("u")).filter("id is not null")
        found = rows.groupBy("id").agg(F.count("*").alias("n"), F.sum("u").alias("u")).orderBy("id").collect()  # a row a label
        n = sum(r.n for r in found)
        share = round(sum(r.u or 0 for r in found) / n, 3) if n else 0.0
        return {"num_reviews": n, "num_reviews_for_labels": {r.id: r.n for r in found}, "original_usage_split": share}

    def create_dataset(self, name: str, strategy) -> ReviewSet:
        """Only the first selected label, with datasets [name]; reviews without it go."""
        key = L.first_id(F.col("labels"), strategy)
        label = F.element_at("labels", key)
        fields = [(F.array(F.lit(name)) if f == "datasets" else label[f]).alias(f) for f in (
            "createdAt",
            "usageOptions",
            "datasets",
            "metadata",
            "scores",
            "augmentations",
        )]
        kept = self.df.withColumn("_k", key).filter(F.col("_k").isNotNull())
        return ReviewSet(kept.withColumn("labels", F.create_map(key, F.struct(*fields))).drop("_k"))
