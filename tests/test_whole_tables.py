"""Registered queries do their job on all rows of their tables."""

import random

from quillstone.functions import metrics
from quillstone.plans import catalogue


def tables(spark, path, **rows):
    """Parquet tables of (schema, rows)."""
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_outliers_of_any_id(spark, tmp_path):
    """Three of 23 reviews own a phrase like no other's; none of their ids ends in 0."""
    ids = [i for i in range(1, 26) if i % 10]
    odd = {3, 14, 25}
    docs = [(i, "zyxwvuqpzy" if i in odd else "commonphrase", "en", "s", 12) for i in ids]
    sf = tables(spark, tmp_path, documents=(DOCUMENTS, docs), labels=("doc_id long, quality int, toxic int", [(i, 1, 0) for i in ids]))
    assert {r.review_id for r in catalogue.queries()["outlier_removal"](spark, sf).collect()} == {str(i) for i in ids if i not in odd}


def test_ngram_metrics_of_every_document(spark, tmp_path):
    """Long texts, unknown lengths and items beyond the first forty; each text is that of its item."""
    texts = [" ".join(f"w{k}x{i}" for k in range(300 if i % 2 else 12)) for i in range(45)]
    docs = [(i, texts[i % 45], "en", "s", None if i == 7 else len(texts[i % 45])) for i in [*range(45), 90, 89]]
    sf = tables(spark, tmp_path, documents=(DOCUMENTS, docs), benchmark=("item_id long, text string", list(enumerate(texts))))
    got = {r.doc_id: (r.bleu, r.rouge1, r.rougeL) for r in catalogue.queries()["ngram_metrics"](spark, sf).collect()}
    assert got == {d[0]: (1.0, 1.0, 1.0) for d in docs}


def test_longest_common_words():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(1, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        expected = metrics.harmonic(row[-1] / len(a), row[-1] / len(b)) if row[-1] else 0.0
        assert metrics.rouge_l([" ".join(a)], [" ".join(b)]) == expected
