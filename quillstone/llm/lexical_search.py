"""Ranked lexical search: a sparse matrix of items and terms times one of terms and documents, in blocks.

Tasks cut their documents into blocks of about `BLOCK` bytes of text and write each as a sparse term-document matrix of the terms
that items hold: its terms in order, and under each the documents that hold it, and how often. Spark adds up the documents
that hold a term, and over all documents their number and their terms. A second pass over the written blocks, not the texts,
turns counts into int64 impacts and multiplies: an item's row is the merged rows of its terms (Gustavson), each times the term's
weight, so only documents that share a term with an item are touched. A task keeps the best of each item over its blocks; Spark reduces
these lists in two steps, first by item and group of tasks, then by item.

Items come in groups of at most `ITEMS` rows and `ITEM_BYTES` of text, which is all of them that the driver or a task holds at
once; every further group costs one more pass, whose products outweigh the reading. Documents are never shuffled. Terms are compared
by 64-bit hashes of their bytes, A-Z as a-z.

Null and empty texts have no terms: such a document is found by no item and counts in nothing, such an item has no rows. Rows that
repeat a doc_id or text are documents of their own; rows without an id stand behind others of equal score. Rows that repeat an
item_id are searched each by itself, with ranks of their own. Empty tables give no rows. Columns other than ids and texts are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm._io import bounded, cut, forget, gathered, tidy
from quillstone.llm._text import NOT_WORD, Words

BLOCK = 2 << 20
ITEMS = 4096
ITEM_BYTES = 4 << 20
_LAST = np.iinfo(np.int64).max  # stands for a missing id


def counts(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, ...]:
    """(terms of each text, rows of the sparse matrix: place in the sorted vocabulary, text, times), by term, then text."""
    words = Words(texts, NOT_WORD)
    n = np.diff(words.first)
    if not len(vocabulary) or not len(words.hash):
        return n, *(np.zeros(0, np.int64) for _ in range(3))
    at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
    known = vocabulary[at] == words.hash
    pairs = at[known] * len(texts) + np.repeat(np.arange(len(texts)), n)[known]
    pairs, times = np.unique(pairs, return_counts=True)
    return n, pairs // len(texts), pairs % len(texts), times


def blocks(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """One row a block: n_docs with a term, n_terms, and as bytes the int64 ids, lengths, and the rows (term, document, times)."""
    schema = "n_docs long, n_terms long, ids binary, lengths binary, term binary, doc binary, times binary"

    def scan(batches):
        for batch in gathered(batches, "text", BLOCK):
            n, term, doc, times = counts(batch.column("text"), vocabulary)
            ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
            columns = [[x.astype(kind).tobytes()] for x, kind in ((ids, np.int64), (n, np.int64), (term, np.int32), (doc, np.int32), (times, np.int32))]
            numbers = [[int((n > 0).sum())], [int(n.sum())]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in numbers] + [pa.array(x, pa.binary()) for x in columns],
                ["n_docs", "n_terms", "ids", "lengths", "term", "doc", "times"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(rows).mapInArrow(tidy(scan), schema)


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term: counted by task, added up by Spark, one row a term to the driver."""

    def scan(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            for term in batch.column(0).to_pylist():
                df += np.bincount(np.frombuffer(term, np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held], pa.int64())], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in found.select("term").mapInArrow(scan, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(times: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each occurrence counts, given the length of its document: saturating in times, less in longer documents."""
    m = 50 + (50 * lengths * n_docs) // n_terms
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by id."""
    if len(scores) > k:
        bar = max(1, np.partition(scores, len(scores) - k)[len(scores) - k])  # ties at the bar are all looked at
        places = np.flatnonzero(scores >= bar)
    else:
        places = np.flatnonzero(scores > 0)
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def multiply(items: list[tuple[np.ndarray, np.ndarray]], term: np.ndarray, doc: np.ndarray, impact: np.ndarray, many: int):
    """Of each item (terms, factors) that shares a term with the block: its number and the int64 scores of all documents."""
    starts = np.searchsorted(term, np.arange(term[-1] + 2)) if len(term) else np.zeros(1, np.int64)
    for number, (terms, factors) in enumerate(items):
        inside = terms < len(starts) - 1
        scores, met = np.zeros(many, np.int64), False
        for t, factor in zip(terms[inside].tolist(), factors[inside].tolist()):
            lo, hi = starts[t], starts[t + 1]
            if hi > lo:
                scores[doc[lo:hi]] += factor * impact[lo:hi]  # a document stands once under a term
                met = True
        if met:
            yield number, scores


def _top_of_tasks(found: DataFrame, items, n_docs: int, n_terms: int, k: int) -> DataFrame:
    def scan(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for ids, lengths, term, doc, times in zip(*(batch.column(c).to_pylist() for c in ("ids", "lengths", "term", "doc", "times"))):
                ids, lengths = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64)
                term, doc, times = (np.frombuffer(x, np.int32) for x in (term, doc, times))
                impact = impacts(times.astype(np.int64), lengths[doc], n_docs, n_terms)
                for number, scores in multiply(items, term, doc, impact, len(ids)):
                    best = _best(scores, ids, k)
                    own = (ids[best], scores[best])
                    if number in held:
                        own = tuple(np.concatenate(x) for x in zip(held[number], own))
                        best = _best(own[1], own[0], k)
                        own = (own[0][best], own[1][best])
                    held[number] = own
        for number, (ids, scores) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number), pa.int64()), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    return found.select("ids", "lengths", "term", "doc", "times").mapInArrow(scan, "item long, doc_id long, score long")


def _reduced(lists: DataFrame, k: int) -> DataFrame:
    """The best k of each item, with rank: within groups of tasks first, so that no task gets the lists of all."""
    order = (F.desc("score"), "doc_id")
    groups = max(1, int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lists.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("part")


def _item_groups(benchmark: DataFrame):
    """Lists of (item_id, text), bounded in rows and bytes, one after another; a longer text stands alone."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text <> ''").toLocalIterator():
        own = len(r.text.encode())
        if held and (len(held) == ITEMS or size + own > ITEM_BYTES):
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += own
    if held:
        yield held


def search(docs: DataFrame, benchmark: DataFrame, k: int = 50, once: bool = True) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score for every item. once: a term counts once in an item, however
    often it stands there; else as often as it does."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    out = []
    for group in _item_groups(benchmark):
        words = Words(pa.array([text for _, text in group]), NOT_WORD)
        vocabulary, place = np.unique(words.hash, return_inverse=True)
        if not len(vocabulary):
            continue
        found = cut(blocks(docs, vocabulary), "term-document")
        n_docs, n_terms = found.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_terms:
            forget(found)
            continue
        weight = weights(document_frequencies(found, len(vocabulary)), n_docs)
        items = []
        for lo, hi in zip(words.first[:-1], words.first[1:]):
            terms, often = np.unique(place[lo:hi], return_counts=True)
            items.append((terms, weight[terms] if once else weight[terms] * often))
        best = _reduced(_top_of_tasks(found, items, n_docs, n_terms, k), k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(group)], "item long, item_id long")
        named = best.join(F.broadcast(names), "item")  # at most ITEMS rows
        out.append(cut(named.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(int(_LAST))).alias("doc_id"), "score"), "ranked"))
        forget(found)
    result = spark.createDataFrame([], schema)
    for part in out:
        result = result.unionByName(part)
    return result
