"""Review-set documents: versions 0 to 5 of the JSON format, upgraded by Column expressions, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import labels as L
from quillstone.operators.review_sets import ATTRIBUTES, VERSION, ReviewSet, merge, merge_label_maps

_SCORE = "map<string,map<string,array<string>>>"


def _attributes(review: Column) -> list[Column]:
    return [F.try_element_at(review, F.lit(a)).alias(a) for a in ATTRIBUTES]


def _scores(text: Column) -> Column:
    """Score triples of JSON as structs."""
    parsed = F.from_json(F.coalesce(text, F.lit("{}")), _SCORE)
    flag = lambda x: F.lower(x) == "true"
    triple = lambda t: F.struct(F.get(t, F.lit(0)).try_cast("double").alias("score"), flag(F.get(t, F.lit(1))).alias("pred_pos"), flag(F.get(t, F.lit(2))).alias("ref_pos"))
    return F.transform_values(parsed, lambda _, m: F.transform_values(m, lambda __, t: triple(t))).cast(L.SCORES)


def _strings(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def upgrade_label(label: Column, version: int, created_at: Column) -> Column:
    """A label of version 1 to 5 (map of JSON texts) as a label of the newest version."""
    get = lambda k: F.try_element_at(label, F.lit(k))
    inner = F.from_json(F.coalesce(get("metadata"), F.lit("{}")), "map<string,string>")
    if version == 1:
        scores, names = F.try_element_at(inner, F.lit("scores")), _strings(F.try_element_at(inner, F.lit("datasets")))
        metadata = F.to_json(F.map_filter(inner, lambda k, _: ~k.isin("scores", "datasets")))
        created = created_at
    else:
        scores, metadata, created = get("scores"), F.coalesce(get("metadata"), F.lit("{}")), get("createdAt")
        names = F.map_keys(
            F.coalesce(F.from_json(get("datasets"), "map<string,string>"), F.create_map().cast("map<string,string>")),
        ) if version in (3, 4) else _strings(get("datasets"))
    kind = "array<struct<review_body:string,product_title:string,usageOptions:array<string>,metadata:string>>"
    empty = F.create_map().cast(L.AUGMENTATIONS)
    if version == 4:
        old = F.from_json(get("augmentations"), kind)
        augmentations = F.when(F.size(old) > 0, F.create_map(F.lit("legacy"), old)).otherwise(empty).cast(L.AUGMENTATIONS)
    elif version == 5:
        augmentations = F.coalesce(F.from_json(get("augmentations"), f"map<string,{kind}>").cast(L.AUGMENTATIONS), empty)
    else:
        augmentations = empty
    return F.struct(
        created.alias("createdAt"),
        _strings(get("usageOptions")).alias("usageOptions"),
        names.alias("datasets"),
        metadata.alias("metadata"),
        _scores(scores).alias("scores"),
        augmentations.alias("augmentations"),
    ).cast(L.LABEL)


def _old_label(review: Column, label_id: str, source: str, created_at: Column) -> Column:
    """The one label of a version 0 review as a label map."""
    text = F.try_element_at(review, F.lit("label"))
    parts = F.from_json(text, "map<string,string>")
    custom = _strings(F.try_element_at(parts, F.lit("customUsageOptions")))
    marks = F.coalesce(
        F.from_json(F.try_element_at(parts, F.lit("annotations")), "array<struct<tokens:array<string>>>"),
        F.array().cast("array<struct<tokens:array<string>>>"),
    )
    options = F.concat(custom, F.transform(marks, lambda a: F.array_join(a["tokens"], " ")))
    rest = F.map_filter(parts, lambda k, _: ~k.isin("customUsageOptions", "annotations", "replacementClasses"))
    label = F.struct(
        created_at.alias("createdAt"),
        options.alias("usageOptions"),
        F.array().cast("array<string>").alias("datasets"),
        F.to_json(F.create_map(F.lit(source), rest)).alias("metadata"),
        F.create_map().cast(L.SCORES).alias("scores"),
        F.create_map().cast(L.AUGMENTATIONS).alias("augmentations"),
    ).cast(L.LABEL)
    none = F.create_map().cast(L.LABELS)
    return F.when(text.isNull(), none).otherwise(F.create_map(F.lit(label_id), label))


def parse_documents(
    docs: DataFrame, version: int, created_at: str = "1970-01-01T00:00:00+00:00", label_id: str | None = None, source: str = "labellingTool", keys: tuple[str, ...] = (), order: tuple[str, ...] = ()
) -> DataFrame:
    """Reviews of documents (column value: JSON texts) of one version.

    Of reviews that repeat an id in a document the last counts (with `keys`, other columns of docs, once for each value of
    those; with `order`, further columns, parts of a document follow each other by them). created_at stands where a version has no time.
    """
    if version == 0 and label_id is None:
        raise ValueError("documents of version 0 need a label id")
    if version not in range(VERSION + 1):
        raise ValueError(f"version {version} is not known")
    body = F.from_json("value", "map<string,string>")
    bare = F.startswith(F.ltrim("value"), F.lit("["))
    text = F.when(bare, F.col("value")).otherwise(F.try_element_at(body, F.lit("reviews")))
    if version < 2:
        rows = docs.select(
            *keys,
            *order,
            F.posexplode(F.from_json(text, "array<map<string,string>>")).alias("_pos", "_r"),
        ).withColumn("review_id", F.try_element_at("_r", F.lit("review_id")))
    else:
        entries = F.map_entries(F.from_json(text, "map<string,map<string,string>>"))
        rows = docs.select(*keys, *order, F.posexplode(entries).alias("_pos", "_e")).select(
            *keys,
            *order,
            "_pos",
            F.col("_e.key").alias("review_id"),
            F.col("_e.value").alias("_r"),
        )
    review, now = F.col("_r"), F.lit(created_at)
    if version == 0:
        labels = _old_label(review, label_id, source, now)
    else:
        parsed = F.coalesce(
            F.from_json(F.try_element_at(review, F.lit("labels")), "map<string,map<string,string>>"),
            F.create_map().cast("map<string,map<string,string>>"),
        )
        labels = F.transform_values(parsed, lambda _, x: upgrade_label(x, version, now))
    flat = rows.select(*keys, *order, "review_id", *_attributes(review), labels.cast(L.LABELS).alias("labels"), "_pos")
    columns = [c for c in flat.columns if c not in (*keys, *order, "review_id", "_pos")]
    last = flat.groupBy(*keys, "review_id").agg(F.max_by(F.struct(*columns), F.struct(*order, "_pos")).alias("r"))
    return last.select(*keys, "review_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def version_of(value: Column) -> Column:
    """Version that a document states; a bare list or none stated: 0."""
    return F.coalesce(F.try_element_at(F.from_json(value, "map<string,string>"), F.lit("version")).try_cast("int"), F.lit(0))


def parse_files(docs: DataFrame, version: int | None = None, **how) -> DataFrame:
    """Reviews of documents (columns file, value), each of its own version, merged in the order of their files: attributes of
    the first file that has a review, labels of all."""
    if version is None:
        tagged = docs.withColumn("_version", version_of(F.col("value")))
        versions = [r[0] for r in tagged.select("_version").distinct().collect()]  # there are few versions
        parts = [parse_documents(tagged.filter(F.col("_version") == v), v, keys=("file",), **how) for v in versions]
    else:
        parts = [parse_documents(docs, version, keys=("file",), **how)]
    if not parts:
        parts = [parse_documents(docs, VERSION, keys=("file",), **how)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _merged_files(rows)


def _merged_files(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("file", "review_id", "labels")]
    # An entry for each file that holds a review.
    grouped = rows.groupBy("review_id").agg(
        F.min_by(F.struct(*columns), "file").alias("r"),
        F.map_from_entries(F.collect_list(F.struct("file", "labels"))).alias("m"),
    )
    files = F.array_sort(F.map_keys("m"))
    labels = F.aggregate(
        F.slice(files, 2, F.size(files)),
        F.element_at("m", F.element_at(files, 1)),
        lambda a,
        k: merge_label_maps(a, F.element_at("m", k)),
    )
    return grouped.select("review_id", *[F.col(f"r.{c}").alias(c) for c in columns], labels.alias("labels"))


#: The first and the last line of a document as `save_documents` lays it out: a review a line stands between them.
FIRST, LAST = f'{{"version":{VERSION},"reviews":{{', "}}"


def _laid_out(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Of the lines (file, value) of documents: the files that `save_documents` laid out, and the others. Every line is looked at: one
    between the first and the last must be a review by itself, with a comma in front of all but one."""
    entry = F.concat(F.lit("{"), F.ltrim(F.col("value"), F.lit(",")), F.lit("}"))
    alone = F.col("value").rlike('^,?"') & (F.coalesce(F.size(F.from_json(entry, "map<string,string>")), F.lit(0)) == 1)
    kind = F.when(F.col("value") == FIRST, "first").when(F.col("value") == LAST, "last").when(alone, F.when(F.startswith("value", F.lit(",")), "next").otherwise("entry"))
    n = lambda k: F.count_if(F.col("_kind") == k).alias(k)
    found = rows.select("file", kind.alias("_kind")).groupBy("file").agg(n("first"), n("last"), n("next"), n("entry"), F.count_if(F.col("_kind").isNull()).alias("odd"))
    good = lambda r: r["first"] == r["last"] == 1 and not r["odd"] and r["entry"] == (1 if r["next"] else r["entry"]) and r["entry"] < 2
    files = found.collect()  # a row a file
    return [r.file for r in files if good(r)], [r.file for r in files if not good(r)]


def _read_folder(reader, path: str, version: int | None, how: dict) -> DataFrame:
    """Reviews of the documents at a path. Those that `save_documents` laid out are read line by line, in as many tasks as their size
    asks for; others are read whole, one row a document."""
    name = F.col("_metadata.file_path")
    lines = reader.text(path)
    laid, other = _laid_out(lines.select(name.alias("file"), "value")) if version in (None, VERSION) else ([], None)
    whole = lambda: reader.text(path, wholetext=True)
    if not laid:
        return parse_files(whole().select(name.alias("file"), "value"), version, **how)
    place = [F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line")]
    own = lines.filter(name.isin(*laid)).select(name.alias("file"), *place, "value").filter(~F.col("value").isin(FIRST, LAST))
    entry = F.concat(F.lit(FIRST), F.ltrim(F.col("value"), F.lit(",")), F.lit(LAST))
    rows = parse_documents(own.withColumn("value", entry), VERSION, keys=("file",), order=("_start", "_line"), **how)
    if other:
        tagged = whole().filter(name.isin(*other)).select(name.alias("file"), "value").withColumn("_version", version_of(F.col("value")))
        for v in [r[0] for r in tagged.select("_version").distinct().collect()] if version is None else [version]:
            some = tagged if version is not None else tagged.filter(F.col("_version") == v)
            rows = rows.unionByName(parse_documents(some, v, keys=("file",), **how))
    return _merged_files(rows)


def read_documents(spark: SparkSession, *paths: str, lines: bool = False, version: int | None = None, **how) -> ReviewSet:
    """Documents of any version, upgraded and merged from left to right; folders are read by their *.json files in the order
    of their names. With lines, every line of a text file is a document of its own (save_lines)."""
    if not paths:
        raise ValueError("no document is named")
    out = None
    for path in paths:
        if lines:
            reviews = parse_files(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"), version, **how)
        else:
            reviews = _read_folder(spark.read.option("pathGlobFilter", "*.json"), path, version, how)
        out = reviews if out is None else merge(out, reviews)
    return ReviewSet(out, paths[0] if len(paths) == 1 else None)


def from_rows(df: DataFrame, order: str = "_pos") -> ReviewSet:
    """A set of review rows; of rows that repeat an id the last by `order` counts."""
    columns = [c for c in df.columns if c not in ("review_id", order)]
    last = df.groupBy("review_id").agg(F.max_by(F.struct(*columns), order).alias("r"))
    return ReviewSet(last.select("review_id", *[F.col(f"r.{c}").alias(c) for c in columns]))


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a review."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def _written(column: str) -> Column:
    """A column as documents have it: scores are arrays of three."""
    if column != "labels":
        return F.col(column)
    triple = lambda s: F.parse_json(F.concat(F.lit("["), F.coalesce(s["score"].cast("string"), F.lit("null")), F.lit(","), F.coalesce(s["pred_pos"].cast("string"), F.lit("null")), F.lit(","), F.coalesce(s["ref_pos"].cast("string"), F.lit("null")), F.lit("]")))
    scores = lambda m: F.transform_values(m, lambda _, x: F.transform_values(x, lambda __, s: triple(s)))
    fields = ("createdAt", "usageOptions", "datasets", "metadata", "scores", "augmentations")
    return F.transform_values("labels", lambda _, x: F.struct(*[(scores(x[f]) if f == "scores" else x[f]).alias(f) for f in fields])).alias("labels")


def _entries(reviews: ReviewSet) -> Column:
    return F.struct(*[_written(c) for c in reviews.df.columns if c != "review_id"])


def document_lines(reviews: ReviewSet) -> DataFrame:
    """(place, review_id, value): the lines of the one document of a set, without the commas between reviews."""
    line = F.concat(F.to_json(F.create_map("review_id", _entries(reviews))))
    rows = reviews.df.select(F.lit(1).alias("place"), "review_id", F.substring(line, F.lit(2), F.length(line) - 2).alias("value"))
    ends = reviews.df.sparkSession.createDataFrame(
        [(0, None, f'{{"version":{VERSION},"reviews":{{'), (2, None, "}}")],
        "place int, review_id string, value string",
    )
    return rows.unionByName(ends)


def save_documents(reviews: ReviewSet, path: str | None = None) -> None:
    """One document {version, reviews} in one file, reviews by id; a set without a path is an error.

    One file is written by one task, row by row; save_lines writes a large set in parallel.
    """
    path = path or reviews.save_path
    if not path:
        raise ValueError("there is no path to save to")
    spark = reviews.df.sparkSession
    ordered = document_lines(reviews).repartition(1).sortWithinPartitions("place", "review_id").withColumn("_n", F.monotonically_increasing_id())
    comma = F.when((F.col("place") == 1) & (F.col("_n") > 1), F.lit(",")).otherwise(F.lit(""))
    folder = f"{path}.parts"
    ordered.select(F.concat(comma, "value").alias("value")).write.mode("overwrite").text(folder)
    jvm = spark._jvm.org.apache.hadoop.fs
    source, target = jvm.Path(folder), jvm.Path(path)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in files.globStatus(jvm.Path(f"{folder}/part-*"))]
    files.delete(target, True)
    files.rename(part, target)
    files.delete(source, True)


def save_lines(reviews: ReviewSet, path: str) -> None:
    """A document a review, one a line, in as many files as there are partitions."""
    inner = F.create_map(F.col("review_id"), _entries(reviews))
    reviews.df.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), inner.alias("reviews"))).alias("value")).write.text(path)


def split_by_label(df: DataFrame, path: str) -> None:
    """A folder for each label id with the reviews that have it and that label only."""
    one = df.select(*[c for c in df.columns if c != "labels"], F.explode("labels").alias("label_id", "_l"))
    one.withColumn(
        "labels",
        F.create_map("label_id", "_l"),
    ).drop("_l").withColumn("labels", F.to_json("labels")).write.partitionBy("label_id").parquet(path)


def legacy_labels(docs: DataFrame, predicted: bool = False) -> DataFrame:
    """review_id, review_body, usage_options of the old labelled documents, marked by hand or predicted."""
    label = "struct<customUsageOptions:array<string>,annotations:array<struct<tokens:array<string>>>,predictedUsageOptions:array<struct<label:string>>>"
    rows = docs.select(F.explode(
        F.from_json("value", f"struct<reviews:array<struct<review_id:string,review_body:string,label:{label}>>>")["reviews"],
    ).alias("r"))
    made = F.transform("r.label.predictedUsageOptions", lambda x: x["label"]) if predicted else F.concat(
        F.coalesce("r.label.customUsageOptions", F.array().cast("array<string>")),
        F.coalesce(F.transform("r.label.annotations", lambda a: F.array_join(a["tokens"], " ")), F.array().cast("array<string>")),
    )
    return rows.select("r.review_id", "r.review_body", made.alias("usage_options"))


def write_dataset(reviews: ReviewSet, path: str, metadata: dict) -> None:
    """The reviews as Parquet, and what is known of them as one JSON line."""
    spark = reviews.df.sparkSession
    reviews.df.write.parquet(f"{path}/reviews.parquet")
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in metadata.items()])
    row.coalesce(1).write.json(f"{path}/config")
