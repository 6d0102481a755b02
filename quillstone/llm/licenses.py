"""License scan by diagonal voting, in DataFrame expressions alone.

All rolling word k-grams of a document are hashed and joined with the k-grams of the templates
(a fixed table, so its broadcast is bounded). A hit at word i of the document and word j of
the template votes for the diagonal i - j. Votes are summed by diagonal, diagonals at most
`SHIFT` apart are merged (words put in or left out move the diagonal), and the merged span is
verified: the share of the template's words it covers must reach the template's bar. Hits
are compared word by word, so a chance equality of hashes never counts. Base phrases are templates
whose every k-gram must vote for one diagonal.

Only hits and one row a document are shuffled, never texts; grouping keys are single rows of the
input, so copies or a hot source gather nowhere.

A null or empty text has no words, null places, empty labels and score 0. Repeated rows give
repeated results; no rows give no rows. Time grows with a text's length, however long it is. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Passages of well-known licenses, their labels, and the share of their words that must be covered.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit", 0.6),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache", 0.6),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", 0.6),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", 0.6),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl", 0.6),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 0.6),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", 0.7),
    ("licensed under cc by nc 4 0", "cc-by-nc", 1.0),
    ("licensed under cc by sa 4 0", "cc-by-sa", 1.0),
    ("gnu lesser general public license", "lgpl", 1.0),
    ("gnu affero general public license", "agpl", 1.0),
)
K = 2
LONG_K = 3
SHIFT = 3
_PARTS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def templates(spark) -> DataFrame:
    """gram, its size k, t (template), j (place), words of the template, label, share, base; and one marker row, t = -1."""
    rows = [("", 0, -1, 0, 0, "", 0.0, False)]
    for t, (text, label, share, base) in enumerate([(p, x, 1.0, True) for p, x in BASE] + [(p, x, s, False) for p, x, s in PASSAGES]):
        words = text.split()
        k = K if base else LONG_K
        rows += [(" ".join(words[j : j + k]), k, t, j, len(words), label, share, base) for j in range(len(words) - k + 1)]
    values = ", ".join(f"('{gram}', {k}, {t}, {j}, {n}, '{label}', {share}D, {base})" for gram, k, t, j, n, label, share, base in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(gram, k, t, j, n_template, label, share, base)")


def words_of(text):
    """Words of a text, A-Z as a-z. lower() changes other letters too; of these only the Kelvin sign
    would become an ASCII letter, so it is put aside first, and words never turn into other words of ASCII."""
    plain = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.filter(F.split(plain, _PARTS), lambda w: w != "")


def _hits(words, k: int, hashes: list[int]):
    """Of the k words from each place on: those whose hash a template has, as (place, hash, words). The gram's size is part of the hash.

    All grams are hashed and looked up inside the array, so a document is never copied for each of its words."""
    gram = lambda w, i: F.when(i + (k - 1) < F.size(words), F.xxhash64(F.lit(k), w, *[F.get(words, i + x) for x in range(1, k)]))
    met = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), gram(w, i).alias("h"))), lambda g: g["h"].isin(hashes))
    return F.transform(met, lambda g: F.struct(g["i"].alias("i"), g["h"].alias("h"), F.array_join(F.slice(words, g["i"] + 1, k), " ").alias("gram")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    known = templates(spark)
    first = F.split("gram", " ")
    # Every document hits the marker once, and so reaches the result without a second scan.
    hashed = F.when(F.col("t") == -1, F.lit(0).cast("long")).when(
        F.col("k") == K,
        F.xxhash64(F.lit(K), *[F.get(first, F.lit(x)) for x in range(K)]),
    ).otherwise(F.xxhash64(F.lit(LONG_K), *[F.get(first, F.lit(x)) for x in range(LONG_K)]))
    known = known.withColumn("h", hashed)
    # The templates are a fixed table, and so are their hashes.
    hashes = {k: sorted({r.h for r in known.filter(F.col("k") == k).select("h").collect()}) for k in (K, LONG_K)}
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        words_of(F.col("text")).alias("words"),
    )
    marker = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("h"), F.lit("").alias("gram")))
    grams = F.concat(marker, _hits(F.col("words"), K, hashes[K]), _hits(F.col("words"), LONG_K, hashes[LONG_K]))
    hits = rows.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), F.explode(grams).alias("g"))
    hits = hits.select(
        "doc_id",
        "row",
        "n_words",
        "g.i",
        "g.h",
        F.col("g.gram").alias("found"),
    ).join(F.broadcast(known), "h").filter(F.col("found") == F.col("gram"))
    hits = hits.select("doc_id", "row", "n_words", "t", "j", (F.col("i") - F.col("j")).alias("diagonal"), "k", "n_template", "label", "share", "base")
    # From here on rows are hits; all grouping below is within a row of the input, on one exchange.
    hits = hits.repartition("row")
    own = ["row", "doc_id", "t", "label", "share", "base", "n_template", "k"]
    votes = hits.groupBy(*own, "diagonal").agg(
        F.max("n_words").alias("n_words"),
        F.count("*").alias("votes"),
        F.sort_array(F.collect_set("j")).alias("places"),
    )
    order = Window.partitionBy("row", "t").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order)) > F.when(F.col("base"), F.lit(0)).otherwise(F.lit(SHIFT))
    merged = votes.withColumn("span", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(order))
    spans = merged.groupBy(*own, "span").agg(
        F.max("n_words").alias("n_words"),
        F.min("diagonal").alias("start"),
        F.flatten(F.collect_list("places")).alias("places"),
    )
    # Words of the template that the votes cover: each k-gram covers k words.
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda j: F.sequence(j, j + F.col("k") - 1)))))
    spans = spans.withColumn("cover", F.when(F.col("t") >= 0, covered / F.col("n_template")).otherwise(F.lit(0.0)))
    found = (F.col("t") >= 0) & (F.col("cover") >= F.col("share"))
    at_base = found & F.col("base")
    joined = lambda condition: F.concat_ws(",", F.array_sort(F.collect_set(F.when(condition, F.col("label")))))
    return spans.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(at_base, 1)).alias("n_base"),
        F.min(F.when(at_base, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(at_base, F.col("start").cast("long"))).alias("last_word"),
        joined(at_base).alias("base_labels"),
        joined(found).alias("labels"),
        F.coalesce(F.max(F.when(F.col("t") >= 0, F.least(F.lit(1.0), F.col("cover")))), F.lit(0.0)).alias("score"),
    ).drop("row")
