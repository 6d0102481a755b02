"""Benchmark decontamination by spaced seeds.

Two fixed masks of word places, one of which ignores its third place, are hashed from every place of the
benchmark's items and of all documents, and equal hashes are joined. A hit lays the two
texts over each other at its offset, and the stretch there with the best score (a match counts 1, a
substitution costs SUBSTITUTION) decides. The masks lose nothing: a stretch without a hit has two matches
followed by two substitutions again and again, and so a score of 2 at most, and each hit can add no more than one. So an offset
with fewer hits than the asked-for score less 2 can't reach it and is not compared; wherever a leak's words
were substituted, it is found.

The benchmark is taken in blocks of a bounded size that are broadcast one after another,
whatever its size; documents are scanned once a block and never shuffled.

Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. Items of fewer than
`shortest` words match nothing; null items neither. A null or empty text has no words; no rows on either side give no
rows. A very long text is scanned alone, its hits counted HITS at a time. Repeated rows give repeated results; where
several offsets of an item match in a document the best one is told (then the first). Of the documents
doc_id and text are read, of the benchmark item_id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._io import bounded, slices, tidy
from quillstone.llm._text import NOT_WORD, U, Words, combine

#: The places of words that a seed looks at.
MASKS = ((0, 1, 2), (0, 1, 3))
#: At least 1, or the count of hits would not bound the score.
SUBSTITUTION = 1.0
#: Characters of benchmark text in a block.
BLOCK_CHARS = 4_000_000
BITS = 22
#: Hits counted at once.
HITS = 2_000_000


class Index:
    """The seeds of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], shortest: int = 5):
        words = Words(pa.array(texts, pa.string()), NOT_WORD)
        self.ids, self.hash, self.first = ids, words.hash, words.first
        self.sizes = np.diff(words.first)
        self.item = np.repeat(np.arange(len(ids)), self.sizes)
        self.seeds, places = [], []
        for mask in MASKS:
            n = max(0, len(self.hash) - mask[-1])
            at = np.flatnonzero((self.item[:n] == self.item[mask[-1] :]) & (self.sizes[self.item[:n]] >= shortest))
            hashes = combine(self.hash, mask, n)[at]
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << BITS, bool)
            seen[hashes >> U(64 - BITS)] = True
            self.seeds.append((mask, hashes[order], seen, sum(map(len, places))))
            places.append(at[order])
        self.places = np.concatenate(places)


def blocks(benchmark: DataFrame, shortest: int = 5):
    """Indexes of blocks of at most about BLOCK_CHARS characters of items, in no set order; rows come one partition at a time."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(
        F.col("item_id").cast("long").alias("i"),
        F.col("text").cast("string").alias("t"),
    ).filter("t is not null").toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        held += len(row.t)
        if held >= BLOCK_CHARS:
            yield Index(ids, texts, shortest)
            ids, texts, held = [], [], 0
    if ids:
        yield Index(ids, texts, shortest)


def best_stretch(same: np.ndarray) -> tuple[float, int, int]:
    """(score, start, end) of the stretch with the most matches less substitutions."""
    running = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -SUBSTITUTION))))
    least = np.minimum.accumulate(running)
    gain = running - least
    end = int(gain.argmax())
    start = int(np.flatnonzero(running[: end + 1] == least[end])[-1])
    return float(gain[end]), start, end


def seed_hits(words: Words, index: Index) -> tuple[np.ndarray, ...]:
    """(place, text, first of its equal seeds in the index, how many) of all seeds that the index has, by place."""
    h, first, found = words.hash, words.first, []
    for mask, hashes, seen, base in index.seeds:
        seeds = combine(h, mask, max(0, len(h) - mask[-1]))
        at = np.flatnonzero(seen[seeds >> U(64 - BITS)])
        text = np.searchsorted(first, at, "right") - 1
        inside = at + mask[-1] < first[text + 1]
        at, text = at[inside], text[inside]
        lo, hi = (np.searchsorted(hashes, seeds[at], side) for side in ("left", "right"))
        met = hi > lo
        found.append((at[met], text[met], lo[met] + base, (hi - lo)[met]))
    at, text, lo, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    return at[order], text[order], lo[order], counts[order]


def diagonals(words: Words, index: Index, least: int, share: float):
    """(text, item, offset) wherever so many seeds are equal that the score can suffice."""
    at, text, lo, counts = seed_hits(words, index)
    if not len(at):
        return
    need = np.maximum(1, np.ceil(np.minimum(least, share * index.sizes)) - 2)
    edges = [*np.flatnonzero(np.diff((np.cumsum(counts) - counts) // HITS, prepend=-1)).tolist(), len(at)]
    base, span, many = len(index.hash), len(index.hash) + len(words.hash), len(index.ids)
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)  # (text, item, offset) as one number, and hits, of the last text so far
    for a, b in zip(edges[:-1], edges[1:]):
        times = counts[a:b]
        rank = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        q = index.places[np.repeat(lo[a:b], times) + rank]
        key = (np.repeat(text[a:b], times) * many + index.item[q]) * span + (np.repeat(at[a:b], times) - q + base)
        key, hits = np.unique(key, return_counts=True)
        key, back = np.unique(np.concatenate((held[0], key)), return_inverse=True)
        hits = np.bincount(back, np.concatenate((held[1], hits))).astype(np.int64)
        # The last text may go on in the next part.
        done = len(key) if b == len(at) else int(np.searchsorted(key, text[b] * many * span))
        held = key[done:], hits[done:]
        both, shift = np.divmod(key[:done], span)
        enough = hits[:done] >= need[both % many]
        yield from zip((both[enough] // many).tolist(), (both[enough] % many).tolist(), (shift[enough] - base).tolist())


def overlaps(texts: pa.Array, index: Index, least: int, share: float) -> list[tuple[int, int, int, int, int, float]]:
    """(text, item, first word, words, matched words, share of the item matched) of each leak."""
    words = Words(texts, NOT_WORD)
    h, first = words.hash, words.first
    best: dict[tuple[int, int], tuple] = {}
    for d, j, shift in diagonals(words, index, least, share):
        lo, hi = max(index.first[j], first[d] - shift), min(index.first[j + 1], first[d + 1] - shift)
        same = index.hash[lo:hi] == h[lo + shift : hi + shift]
        score, a, b = best_stretch(same)
        size, matched = int(index.first[j + 1] - index.first[j]), int(same[a:b].sum())
        if score >= min(least, share * size):
            found = (score, -int(lo + a + shift - first[d]), b - a, matched, matched / size)
            if found > best.get((d, j), (-1,)):
                best[d, j] = found
    return [(d, j, -s, n, m, c) for (d, j), (_, s, n, m, c) in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 8, share: float = 0.6, shortest: int = 5) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_matched, coverage: documents that hold `least` words of an item
    (or `share` of it, where that is fewer), substitutions counted against."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, n_words long, n_matched long, coverage double"
    out = None
    for index in blocks(benchmark, shortest=shortest):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches, held=held):
            own = held.value
            for batch in batches:
                for part in slices(batch, "text"):
                    found = overlaps(part.column("text"), own, least, share)
                    if found:
                        ids = part.column("doc_id").to_pylist()
                        columns = [[ids[f[0]] for f in found], [own.ids[f[1]] for f in found], *([f[k] for f in found] for k in (2, 3, 4))]
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(c, pa.int64()) for c in columns), pa.array([f[5] for f in found], pa.float64())],
                            ["doc_id", "item_id", "first_word", "n_words", "n_matched", "coverage"],
                        )

        one = rows.mapInArrow(tidy(scan), schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = 8, share: float = 0.6, shortest: int = 5) -> DataFrame:
    """The rows, with all their columns, that hold no leak."""
    out = bounded(docs)
    for index in blocks(benchmark, shortest=shortest):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches, held=held):
            for batch in batches:
                for part in slices(batch, "text"):
                    bad = {f[0] for f in overlaps(part.column("text"), held.value, least, share)}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(tidy(scan), docs.schema)
    return out
