"""Augmented reviews, training datapoints and datasets."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import islice, permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import labels as L
from quillstone.operators import sampling

PARTS = ("review_body", "product_title", "usageOptions")


def chunks(values: Column, n: int) -> Column:
    """Slices of n; the last may be shorter. The array is worked out once a row, not once a slice."""

    def cut(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(v, i, F.lit(n)))

    return F.get(F.transform(F.array(values), cut), F.lit(0))


def expand(df: DataFrame, strategy, aug_set: str) -> DataFrame:
    """A review for each augmentation of the first selected label: id <id>.<set>#<i> from 1, parts that the augmentation
    holds replaced, label metadata tagged <set>_<i>."""
    key = L.first_id(F.col("labels"), strategy)
    one = df.withColumn("_k", key).withColumn("_l", F.try_element_at("labels", F.col("_k")))
    one = L.exploded(one, [*df.columns, "_k", "_l"], F.try_element_at("_l.augmentations", F.lit(aug_set)), "_i", "_a")
    number = F.col("_i") + 1
    label = F.struct(
        F.col("_l.createdAt").alias("createdAt"),
        F.coalesce("_a.usageOptions", "_l.usageOptions").alias("usageOptions"),
        F.col("_l.datasets").alias("datasets"),
        F.to_json(F.struct(F.concat_ws("_", F.lit(aug_set), number).alias("augmentation"))).alias("metadata"),
        F.col("_l.scores").alias("scores"),
        F.create_map().cast(L.AUGMENTATIONS).alias("augmentations"),
    )
    changed = {
        "review_id": F.concat("review_id", F.lit(f".{aug_set}#"), number.cast("string")),
        "review_body": F.coalesce("_a.review_body", "review_body"),
        "product_title": F.coalesce("_a.product_title", "product_title"),
        "labels": F.create_map(F.col("_k"), label),
    }
    return one.select(*[changed.get(c, F.col(c)).alias(c) for c in df.columns])


def has_augmentations(df: DataFrame, aug_set: str) -> Column:
    return F.exists(F.map_values("labels"), lambda x: F.map_contains_key(x["augmentations"], aug_set))


def augment_texts(
    df: DataFrame,
    strategy,
    aug_set: str,
    parts: tuple[str, ...],
    transform: Callable[[list[str]], list[str]],
    batch: int = 32,
) -> DataFrame:
    """Adds one augmentation made by transform (lists of at most `batch` texts) to the first selected label.

    Null and empty texts are passed over and stay null in the augmentation. It is an error if a label has the set already.
    """
    key = L.first_id(F.col("labels"), strategy)
    one = df.withColumn(
        "_k",
        F.when(has_augmentations(df, aug_set), F.raise_error(F.lit(f"{aug_set} is there already")).cast("string")).otherwise(key),
    )

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        flat = [(i, k, x) for i, row in enumerate(texts) if row is not None for k, x in enumerate(row) if x]
        made = [y for lo in range(0, len(flat), batch) for y in transform([x for *_, x in flat[lo : lo + batch]])]
        out = [None if row is None else [None] * len(row) for row in texts]
        for (i, k, _), y in zip(flat, made):
            out[i][k] = y
        return pd.Series(out)

    options = F.try_element_at("labels", F.col("_k"))["usageOptions"]
    texts = F.concat(*[options if p == "usageOptions" else F.array(F.col(p)) for p in parts])
    one = one.withColumn("_t", run(F.coalesce(texts, F.array().cast("array<string>"))))
    at, fields = F.lit(1), {}
    for p in parts:
        size = F.coalesce(F.size(options), F.lit(0)) if p == "usageOptions" else F.lit(1)
        fields[p] = F.slice("_t", at, size) if p == "usageOptions" else F.try_element_at("_t", at)
        at = at + size
    null = {"usageOptions": F.lit(None).cast("array<string>")}
    made = F.struct(
        fields.get("review_body", F.lit(None).cast("string")).alias("review_body"),
        fields.get("product_title", F.lit(None).cast("string")).alias("product_title"),
        fields.get("usageOptions", null["usageOptions"]).alias("usageOptions"),
        F.lit("{}").alias("metadata"),
    )
    old = F.try_element_at("labels", F.col("_k"))
    added = F.map_concat(old["augmentations"], F.create_map(F.lit(aug_set), F.array(made)))
    label = F.struct(*[(added if f == "augmentations" else old[f]).alias(f) for f in (
        "createdAt",
        "usageOptions",
        "datasets",
        "metadata",
        "scores",
        "augmentations",
    )])
    return one.withColumn(
        "labels",
        F.when(F.col("_k").isNull(), F.col("labels")).otherwise(
            F.map_concat(F.map_filter("labels", lambda k, _: k != F.col("_k")), F.create_map("_k", label)),
        ),
    ).select(*df.columns)


def round_trips(transform: Callable[[list[str]], list[str]], rounds: int) -> Callable[[list[str]], list[str]]:
    """transform (there and back again, say through another language) applied to its own outcome so many times."""
    if rounds < 1:
        raise ValueError("there is one round at least")

    def run(texts: list[str]) -> list[str]:
        for _ in range(rounds):
            texts = transform(texts)
        return texts

    return run


def choose_examples(df: DataFrame, label_id: str, n: int, order: str | None = None, seed: int = 0) -> list[tuple[str, str]]:
    """(text, joined options) of n reviews with the label, for the examples of a prompt: drawn by hash, or the first by a column."""
    from quillstone.functions.text import join_options

    has = df.filter(F.map_contains_key("labels", F.lit(label_id)))
    by = [F.col(order)] if order else [sampling.draw(seed, "review_id")]
    rows = has.orderBy(*by, "review_id").limit(n).select(
        "review_body",
        join_options(F.element_at("labels", F.lit(label_id))["usageOptions"]).alias("o"),
    )
    return [(r.review_body, r.o) for r in rows.collect()]


def option_texts(options: Column, mode: str = "default", seed: int = 0, key: Column | None = None) -> Column:
    """Target texts of a label's options: joined; one each (flat); joined in an order drawn by hash (shuffle);
    or the first n permutations of that order (shuffle-n, shuffle-all)."""
    drawn = F.transform(
        F.array_sort(F.transform(
            options,
            lambda x: F.struct(
                F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string") if key is not None else F.lit(""), F.lit(":"), x)).alias("h"),
                x.alias("x"),
            ),
        )),
        lambda s: s["x"],
    )
    if mode == "default":
        return F.array(F.array_join(options, "; "))
    if mode == "flat":
        return F.when(F.size(options) == 0, F.array(F.lit(""))).otherwise(options)
    if mode == "shuffle":
        return F.array(F.array_join(drawn, "; "))
    n = mode.removeprefix("shuffle-")
    if not mode.startswith("shuffle-") or n != "all" and not (n.isdigit() and int(n) > 0):
        raise ValueError(f"no mode is called {mode}")
    limit = None if n == "all" else int(n)

    @F.pandas_udf("array<string>")
    def permuted(rows: pd.Series) -> pd.Series:
        def one(row) -> list[str]:
            if limit is None and len(row) > 8:
                raise ValueError("more than eight options have too many orders for shuffle-all")
            return ["; ".join(p) for p in islice(permutations(row), limit)]

        return rows.map(lambda r: None if r is None else one(list(r)))

    return permuted(drawn)


def datapoints(
    df: DataFrame,
    strategy,
    template: str,
    mode: str = "default",
    most_input: int | None = None,
    most_target: int | None = None,
    augmentation_sets: tuple[str, ...] = (),
    drop_out: float = 0.0,
    stratified: bool = False,
    seed: int = 0,
    length: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """review_id, input, target, has_usage: originals and augmentations as prompts and targets, without over-long ones, a share dropped at random."""
    from quillstone.functions.text import fill_template, word_count

    length = length or word_count
    rows = L.keep_selected(df, strategy)
    whole = rows
    for s in augmentation_sets:
        whole = whole.unionByName(expand(rows, strategy, s))
    options = L.first_label(F.col("labels"), strategy)["usageOptions"]
    filled = fill_template(
        template,
        **{c: F.col(c) for c in ("product_title", "review_body", "review_headline", "product_category") if c in df.columns},
    )
    out = whole.select("review_id", filled.alias("input"), options.alias("_o")).select(
        "review_id",
        "input",
        (F.size("_o") > 0).alias("has_usage"),
        F.explode(option_texts(F.col("_o"), mode, seed, F.col("review_id"))).alias("target"),
    )
    if most_input is not None:
        out = out.filter(length(F.col("input")) <= most_input)
    if most_target is not None:
        out = out.filter(length(F.col("target")) <= most_target)
    if drop_out:
        out = sampling.split(
            out.withColumn("_id", F.concat_ws("|", "review_id", "target")),
            1 - drop_out,
            seed,
            "_id",
            ["has_usage"] if stratified else None,
        ).filter("in_first").drop("in_first", "_id")
    return out


def assemble(
    train: DataFrame,
    test: DataFrame,
    val: DataFrame | None = None,
    val_fraction: float = 0.1,
    usage_share: float | None = None,
    strategy=None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Training and validation reviews: train without test, validation without test and then taken out of train, or split from it."""
    from quillstone.operators.review_sets import minus

    train = minus(train, test)
    if usage_share is not None:
        flagged = train.withColumn("_u", L.has_usage(F.col("labels"), strategy))
        train = sampling.reduce_to_share(flagged, "_u", usage_share, seed, "review_id").drop("_u")
    if val is not None:
        val = minus(val, test)
        return minus(train, val), val
    tagged = sampling.split(train.withColumn("_u", L.has_usage(F.col("labels"), strategy)), 1 - val_fraction, seed, "review_id", ["_u"]).drop("_u")
    return tagged.filter("in_first").drop("in_first"), tagged.filter("not in_first").drop("in_first")


def label_in_batches(
    df: DataFrame,
    label: Callable[[list[str]], list[list[str]]],
    label_id: str,
    created_at: str,
    text: str = "review_body",
    batch: int = 32,
) -> DataFrame:
    """Adds a label made by an injected client or model; its failures are retried by retrying()."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        values = texts.fillna("").tolist()
        return pd.Series([x for lo in range(0, len(values), batch) for x in label(values[lo : lo + batch])])

    return df.withColumn("labels", L.add_label(F.col("labels"), label_id, run(F.col(text)), F.lit(created_at)))


def generation_metadata(model: str, prompt_id: str | None = None, checkpoint: str | None = None, **settings) -> str:
    """What made a label, as the JSON that labels keep: the model, its checkpoint (the last, if none is named), the prompt and
    the settings it generated with."""
    made = {"name": model, "checkpoint": checkpoint or "last", "prompt_id": prompt_id, "config": settings}
    return json.dumps({"generator": made}, sort_keys=True)


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def label_with_saves(
    df: DataFrame,
    label: Callable[[list[str]], list[list[str]]],
    label_id: str,
    created_at: str,
    progress: str,
    text: str = "review_body",
    batch: int = 32,
    share: float = 0.05,
    at_most: int = 500,
    metadata: str = "{}",
    overwrite: bool = False,
) -> DataFrame:
    """As label_in_batches, with the answers kept in a table at `progress`, in a folder that all machines share.

    Answers are written whenever `share` of the reviews, at most `at_most` of them, are labelled. A later call with the same folder
    asks only for reviews that have no answer there, so a client that fails costs what it had answered since the last save. Rows
    that repeat a review_id are asked for once. Remove the folder to start anew."""
    from quillstone.operators.graph import numbered
    from quillstone.session import discard

    spark, schema = df.sparkSession, "review_id string, options array<string>"
    empty = spark.createDataFrame([], schema)
    answers = lambda: spark.read.schema(schema).parquet(progress) if _exists(spark, progress) else empty
    asked = df.select("review_id", F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["review_id"])
    todo = numbered(asked.join(answers(), "review_id", "left_anti"), ["review_id"], "place")
    step = min(max(1, int(asked.count() * share)), at_most)

    def run(frames):
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                yield pd.DataFrame({"review_id": part["review_id"], "options": [list(x) for x in label(part["text"].tolist())]})

    tasks = min(spark.sparkContext.defaultParallelism, -(-step // batch))
    for lo in range(0, todo.count(), step):
        part = todo.filter(F.col("place").between(lo, lo + step - 1)).repartition(tasks)
        part.mapInPandas(run, schema).write.mode("append").parquet(progress)
    discard(todo)
    found = df.join(answers(), "review_id", "left")
    labels = L.add_label(F.col("labels"), label_id, F.col("options"), F.lit(created_at), metadata=F.lit(metadata), overwrite=overwrite)
    return found.withColumn("labels", labels).select(*df.columns)


def retrying(call: Callable, tries: int = 10, base: float = 2.0, sleep: Callable[[float], None] | None = None) -> Callable:
    """call, tried again after base**k seconds."""
    import time

    def run(*args, **kwargs):
        for k in range(tries):
            try:
                return call(*args, **kwargs)
            except Exception:
                if k == tries - 1:
                    raise
                (sleep or time.sleep)(base**k)

    return run


def consensus(samples: list[dict]) -> tuple[int, list[dict]] | None:
    """How many samples a labelling needs, and whether usage is agreed on: two that agree; else three of four; else the
    majority of five. samples: {usageOptions, usageOptionsLogprobs}, as many as were drawn. None: draw more.

    The chosen one is the likeliest by mean log-probability among those of the agreed type (of equals the first).
    """
    kind = lambda s: bool(s["usageOptions"])
    n = len(samples)
    if n not in (2, 4, 5):
        return None
    yes = sum(map(kind, samples))
    needed = {2: 2, 4: 3, 5: 3}[n]
    if max(yes, n - yes) < needed:
        return None
    agreed = [s for s in samples if kind(s) == (yes >= needed)]
    mean = lambda s: sum(s["usageOptionsLogprobs"]) / len(s["usageOptionsLogprobs"]) if s["usageOptionsLogprobs"] else float("-inf")
    return n, [max(agreed, key=mean)]
