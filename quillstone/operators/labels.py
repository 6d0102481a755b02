"""Selecting, adding and removing labels of a review's label map, as Column expressions.

labels: MAP<label id, STRUCT<createdAt, usageOptions, datasets, metadata, scores, augmentations>>.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = "map<string,map<string,struct<score:double,pred_pos:boolean,ref_pos:boolean>>>"
AUGMENTATIONS = "map<string,array<struct<review_body:string,product_title:string,usageOptions:array<string>,metadata:string>>>"
LABEL = f"struct<createdAt:string,usageOptions:array<string>,datasets:array<string>,metadata:string,scores:{SCORES},augmentations:{AUGMENTATIONS}>"
LABELS = f"map<string,{LABEL}>"


def once(value: Column, function) -> Column:
    """function(value), where the value is worked out once a row, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def exploded(df: DataFrame, columns: list, values: Column, *names: str) -> DataFrame:
    """df's columns beside a row for each entry of a map, or each element of an array with its place. Empty ones are dropped behind the
    explosion: an inner one would ask before all that the values are made of whether there are any, and make them once more for that."""
    kind = F.posexplode_outer if names[0] in ("pos", "idx", "_i") else F.explode_outer
    return df.select(*columns, kind(values).alias(*names)).filter(F.col(names[0]).isNotNull())


def glob_regex(pattern: str) -> str:
    """A shell pattern (* ? [seq] [!seq]) as an anchored Java expression; case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + (pattern[i : i + 1] in ("!", "^"))
            j = pattern.find("]", j + 1 if pattern[j : j + 1] == "]" else j)
            if j < 0:
                out.append("\\[")
            else:
                body = pattern[i:j].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                body = "^" + body[1:] if body[:1] == "!" else "\\" + body if body[:1] == "^" else body
                out.append(f"[{body}]")
                i = j + 1
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
    return f"(?s)^{''.join(out)}\\z"


def ids_by_glob(labels: Column, patterns: list[str]) -> Column:
    """For each pattern in turn the matching label ids, sorted; an id that two patterns match comes twice."""
    keys = F.map_keys(labels)
    matching = lambda regex: F.array_sort(F.filter(keys, lambda k: F.rlike(k, F.lit(regex))))
    each = [matching(glob_regex(p)) for p in patterns]
    return F.concat(*each) if each else F.array().cast("array<string>")


def ids_by_dataset(labels: Column, datasets: list[str]) -> Column:
    """For each dataset in turn the ids of labels that belong to it, in map order."""
    keys = F.map_keys(labels)
    belonging = lambda d: F.filter(keys, lambda k: F.array_contains(labels[k]["datasets"], d))
    each = [belonging(d) for d in datasets]
    return F.concat(*each) if each else F.array().cast("array<string>")


class ByGlob:
    """Strategy: label ids by shell patterns."""

    def __init__(self, *patterns: str):
        self.patterns = list(patterns)

    def ids(self, labels: Column) -> Column:
        return ids_by_glob(labels, self.patterns)


class ByDataset:
    """Strategy: labels of datasets."""

    def __init__(self, *datasets: str):
        self.datasets = list(datasets)

    def ids(self, labels: Column) -> Column:
        return ids_by_dataset(labels, self.datasets)


def first_id(labels: Column, strategy) -> Column:
    return F.try_element_at(strategy.ids(labels), F.lit(1))


def first_label(labels: Column, strategy) -> Column:
    return once(labels, lambda m: F.try_element_at(m, first_id(m, strategy)))


def all_labels(labels: Column, strategy) -> Column:
    return once(labels, lambda m: F.transform(strategy.ids(m), lambda k: m[k]))


def usage_options(labels: Column, *patterns: str) -> Column:
    """Options of the first label that matches; no label: none."""
    return F.coalesce(first_label(labels, ByGlob(*patterns))["usageOptions"], F.array().cast("array<string>"))


def label_type(labels: Column, strategy) -> Column:
    """usage, no_usage or both over the selected labels; null if none is."""
    found = all_labels(labels, strategy)
    yes = F.exists(found, lambda x: F.size(x["usageOptions"]) > 0)
    no = F.exists(found, lambda x: F.size(x["usageOptions"]) == 0)
    return F.when(yes & no, "both").when(yes, "usage").when(no, "no_usage")


def has_usage(labels: Column, strategy) -> Column:
    """Whether the first selected label has options; it is an error if there is no such label."""
    found = first_label(labels, strategy)
    return F.when(found.isNull(), F.raise_error(F.lit("no label is selected")).cast("boolean")).otherwise(F.size(found["usageOptions"]) > 0)


def has_all(labels: Column, ids: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in ids]), F.map_keys(labels))) == 0


def keep_selected(df: DataFrame, strategy, invert: bool = False) -> DataFrame:
    some = F.coalesce(F.size(strategy.ids(F.col("labels"))) > 0, F.lit(False))
    return df.filter(~some if invert else some)


def label_coverage(df: DataFrame) -> DataFrame:
    """label_id, count, share of all reviews."""
    total = df.agg(F.count("*").alias("_all"))
    counts = exploded(df, [], F.map_keys("labels"), "label_id").groupBy("label_id").agg(F.count("*").alias("count"))
    return counts.crossJoin(F.broadcast(total)).select("label_id", "count", (F.col("count") / F.col("_all")).alias("share"))  # total: one row


def resolve_ids(known: list[str], patterns: list[str]) -> list[str]:
    """Known ids that the patterns name; patterns that name none are passed over, no id at all is an error."""
    out = []
    for p in patterns:
        regex = re.compile(glob_regex(p).replace("\\z", "\\Z"))
        out += [k for k in sorted(known) if regex.match(k) and k not in out]
    if not out:
        raise ValueError(f"no label is named by {patterns}")
    return out


def _label(options: Column, created_at: Column, datasets: Column, metadata: Column) -> Column:
    return F.struct(
        created_at.alias("createdAt"),
        options.alias("usageOptions"),
        datasets.alias("datasets"),
        metadata.alias("metadata"),
        F.create_map().cast(SCORES).alias("scores"),
        F.create_map().cast(AUGMENTATIONS).alias("augmentations"),
    ).cast(LABEL)


def put(labels: Column, label_id: str, label: Column) -> Column:
    return F.map_concat(F.map_filter(labels, lambda k, _: k != label_id), F.create_map(F.lit(label_id), label))


def add_label(
    labels: Column,
    label_id: str,
    options: Column,
    created_at: Column,
    datasets: Column | None = None,
    metadata: Column | None = None,
    overwrite: bool = False,
) -> Column:
    """A label without scores and augmentations; one that is there already is an error unless overwritten."""
    label = _label(
        options,
        created_at,
        datasets if datasets is not None else F.array().cast("array<string>"),
        metadata if metadata is not None else F.lit("{}"),
    )
    there = F.raise_error(F.lit(f"label {label_id} is there already")).cast("boolean")
    others = F.map_filter(labels, lambda k, _: F.when(k == label_id, F.lit(False) if overwrite else there).otherwise(True))
    return F.map_concat(others, F.create_map(F.lit(label_id), label))


def with_scores(label: Column, scores: Column) -> Column:
    return F.struct(*[(scores if f == "scores" else label[f]).alias(f) for f in (
        "createdAt",
        "usageOptions",
        "datasets",
        "metadata",
        "scores",
        "augmentations",
    )])


def remove_label(labels: Column, label_id: str) -> Column:
    """Without a label and without all scores against it."""
    left = F.map_filter(labels, lambda k, _: k != label_id)
    return F.transform_values(left, lambda _, x: with_scores(x, F.map_filter(x["scores"], lambda r, __: r != label_id)))


def reset_scores(labels: Column) -> Column:
    return F.transform_values(labels, lambda _, x: with_scores(x, F.create_map().cast(SCORES)))


def merge_labels_into(labels: Column, ids: list[str], new_id: str) -> Column:
    """The first label that the ids name, copied under a new id; that id in use is an error, no label leaves all as it was."""
    there = F.raise_error(F.lit(f"label {new_id} is there already")).cast(LABELS)

    def copied(m: Column) -> Column:
        return once(first_label(m, ByGlob(*ids)), lambda found: F.when(found.isNull(), m).otherwise(put(m, new_id, found)))

    return once(labels, lambda m: F.when(F.map_contains_key(m, new_id), there).otherwise(copied(m)))


def extract_labels(df: DataFrame, ids: list[str], keep: bool = False) -> DataFrame:
    """Only the given labels; reviews without any go unless kept."""
    out = df.withColumn("labels", F.map_filter("labels", lambda k, _: k.isin(*ids)))
    return out if keep else out.filter(F.size("labels") > 0)


def delete_labels(df: DataFrame, ids: list[str]) -> DataFrame:
    labels = F.col("labels")
    for label_id in ids:
        labels = remove_label(labels, label_id)
    return df.withColumn("labels", labels)


def correct_by_pattern(
    labels: Column,
    patterns: list[str],
    created_at: Column,
    source: str = "chat_gpt*",
    new_id: str = "bp-chat_gpt_correction",
) -> Column:
    """The first label named by source that has options of these patterns, without those, under a new id with where it came
    from; nothing happens where the new id is there."""
    bad = lambda x: F.exists(F.array(*[F.lit(glob_regex(p)) for p in patterns]), lambda rx: F.rlike(x, rx))
    ids = F.filter(ids_by_glob(labels, [source]), lambda k: F.exists(labels[k]["usageOptions"], bad))
    first = F.try_element_at(ids, F.lit(1))
    old = F.try_element_at(labels, first)
    label = _label(
        F.filter(old["usageOptions"], lambda x: ~bad(x)),
        created_at,
        F.array().cast("array<string>"),
        F.to_json(F.struct(first.alias("corrected_from"))),
    )
    return F.when(first.isNull() | F.map_contains_key(labels, new_id), labels).otherwise(put(labels, new_id, label))


def apply_decisions(
    df: DataFrame,
    decisions: DataFrame,
    created_at: Column,
    source: str = "chat_gpt*",
    new_id: str = "bp-chat_gpt_correction",
) -> DataFrame:
    """Corrections by hand: decisions (review_id, usage_option, keep, revised) of the options of the first label that source
    names. Options not kept go, a revised text stands in an option's place (behind the others), those without a decision
    stay. The outcome is a new label; reviews without decisions, or with that label already, stay as they are."""
    entry = F.struct("keep", F.nullif(F.col("revised"), F.lit("")).alias("revised"))
    told = decisions.groupBy("review_id").agg(F.map_from_entries(F.collect_list(F.struct("usage_option", entry))).alias("_told"))
    joined = df.join(told, "review_id", "left")
    first = first_id(F.col("labels"), ByGlob(source))
    old = F.try_element_at("labels", first)
    said = lambda x: F.try_element_at("_told", x)
    stay = F.filter(old["usageOptions"], lambda x: F.coalesce(said(x)["keep"] & said(x)["revised"].isNull(), F.lit(True)))
    revised = F.filter(F.transform(old["usageOptions"], lambda x: F.when(said(x)["keep"], said(x)["revised"])), lambda x: x.isNotNull())
    label = _label(F.concat(stay, revised), created_at, F.array().cast("array<string>"), F.to_json(F.struct(first.alias("corrected_from"))))
    as_is = F.col("_told").isNull() | first.isNull() | F.map_contains_key("labels", F.lit(new_id))
    return joined.withColumn("labels", F.when(as_is, F.col("labels")).otherwise(put(F.col("labels"), new_id, label))).select(*df.columns)


def options_of_label(df: DataFrame, label_id: str) -> DataFrame:
    """(review_id, usage_option) of a label over the whole set; a label without any option in it is an error."""
    found = exploded(df, ["review_id"], F.try_element_at("labels", F.lit(label_id))["usageOptions"], "pos", "usage_option").drop("pos")
    if found.isEmpty():
        raise ValueError(f"label {label_id} has no option in any review")
    return found


# -- normal forms ----------------------------------------------------------------------------


def labels_long(df: DataFrame) -> DataFrame:
    """review_id, label_id, usage_options, datasets, created_at, metadata."""
    return exploded(df, ["review_id"], F.col("labels"), "label_id", "l").select(
        "review_id",
        "label_id",
        F.col("l.usageOptions").alias("usage_options"),
        F.col("l.datasets").alias("datasets"),
        F.col("l.createdAt").alias("created_at"),
        F.col("l.metadata").alias("metadata"),
    )


def usage_long(df: DataFrame) -> DataFrame:
    """review_id, label_id, pos, usage_option."""
    return exploded(labels_long(df), ["review_id", "label_id"], F.col("usage_options"), "pos", "usage_option")


def scores_long(df: DataFrame) -> DataFrame:
    """review_id, label_id, ref_id, metric_id, score, pred_pos, ref_pos."""
    one = exploded(df, ["review_id"], F.col("labels"), "label_id", "l")
    one = exploded(one, ["review_id", "label_id"], F.col("l.scores"), "ref_id", "m")
    return exploded(one, ["review_id", "label_id", "ref_id"], F.col("m"), "metric_id", "s").select("review_id", "label_id", "ref_id", "metric_id", "s.*")


def augmentations_long(df: DataFrame) -> DataFrame:
    """review_id, label_id, aug_set, idx, review_body, product_title, usage_options, metadata."""
    one = exploded(df, ["review_id"], F.col("labels"), "label_id", "l")
    one = exploded(one, ["review_id", "label_id"], F.col("l.augmentations"), "aug_set", "a")
    one = exploded(one, ["review_id", "label_id", "aug_set"], F.col("a"), "idx", "x")
    return one.select(
        "review_id",
        "label_id",
        "aug_set",
        "idx",
        "x.review_body",
        "x.product_title",
        F.col("x.usageOptions").alias("usage_options"),
        "x.metadata",
    )


def pivot_labels(long: DataFrame, scores: DataFrame | None = None, augmentations: DataFrame | None = None) -> DataFrame:
    """labels_long rows back to (review_id, labels), ids sorted; with scores_long and augmentations_long rows theirs as well."""
    value = F.struct("usage_options", "created_at", "datasets", "metadata").alias("value")
    entries = F.sort_array(F.collect_list(F.struct(F.col("label_id").alias("key"), value)))
    labels = F.transform_values(F.map_from_entries("entries"), lambda _, v: _label(v["usage_options"], v["created_at"], v["datasets"], v["metadata"]))
    out = long.groupBy("review_id").agg(entries.alias("entries")).select("review_id", labels.alias("labels"))
    if augmentations is not None:
        one = F.struct("idx", F.struct("review_body", "product_title", F.col("usage_options").alias("usageOptions"), "metadata").alias("x"))
        sets = augmentations.groupBy("review_id", "label_id", "aug_set").agg(
            F.transform(F.sort_array(F.collect_list(one)), lambda e: e["x"]).alias("a"),
        )
        by_label = sets.groupBy("review_id", "label_id").agg(F.map_from_entries(F.collect_list(F.struct("aug_set", "a"))).alias("s"))
        made = by_label.groupBy("review_id").agg(F.map_from_entries(F.collect_list(F.struct("label_id", "s"))).alias("_aug"))
        joined = out.join(made, "review_id", "left").withColumn("_aug", F.col("_aug").cast(f"map<string,{AUGMENTATIONS}>"))
        fields = ("createdAt", "usageOptions", "datasets", "metadata", "scores")
        put_in = lambda k, x: F.struct(*[x[f].alias(f) for f in fields], F.coalesce(F.try_element_at("_aug", k), x["augmentations"]).alias("augmentations"))
        out = joined.select(
            "review_id",
            F.when(F.col("_aug").isNull(), F.col("labels")).otherwise(F.transform_values("labels", put_in)).alias("labels"),
        )
    if scores is not None:
        from quillstone.operators.scoring import store_scores

        out = store_scores(out, scores)
    return out
