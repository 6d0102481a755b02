"""Exact Jaccard join of word n-gram sets with set-relation skipping.

Which sets can meet: two signatures are given to each set, and linked sets share one of either kind.
Rare first: in an order of shingles that is the same for all sets, linked sets share a shingle among the first of
both (as many first ones as the threshold lets differ, and one); the order puts rare shingles first, by a table of
counts of bounded size, so passages that many texts share come last. Parts: sets of a size class split their
shingles by hash range into as many parts as could differ and one more, so two linked sets have an equal part; parts
that are empty get spares. Rare-first lists tell apart texts that share much common matter, parts tell apart long texts
that share a little. The kind whose signatures hold more goes first, over all texts; groups that are too
large for one block are then parted by the other kind, over their own sets alone.

Signatures never become pairs: sets of one signature are chained to their neighbours by size, and a chain is cut
where sizes differ by more than the threshold allows. Each task chains what it has read before rows are shuffled, so a
signature that a great part of all sets share sends two rows for each megabyte of text.

Before sets are sent, each group compares sketches of its sets: how many shingles fall into each of some n / 4 to n / 2 ranges of the hash, a
byte each. The sum of two sketches' differences is never more than the number of shingles in which the sets differ, so no link is lost, and
what is left is little more than the sets that link, however loaded the table of counts is.

Inside a group (in blocks of bounded size where it is large) two ways of skipping find the
links. Index level: posting lists of rare-first prefixes are kept by position in blocks, and
blocks whose position leaves too little behind are skipped. Answer level: a set that is highly
similar to the last answered one gets its overlaps with all others from that one's, changed
by the few shingles in which the two differ.

Equal sets are one node throughout. A null or empty text has no shingle, links with nothing
and is its own component. No rows give no rows. A very long text is scanned alone, in memory of its own
size. Rows that repeat a doc_id are rows of their own; a row without a doc_id takes part, and a component's
id is its smallest doc_id (null if it has none). Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm._components import components, local_forest
from quillstone.llm._io import bounded, cut, forget, slices, tidy
from quillstone.llm._text import SPACES, U, Words, mix, shingle_sets

#: Sets, and shingles of sets, of a block in a candidate group; larger groups are compared block by block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: The same of sketches.
SKETCH_BLOCK, SKETCH_SHINGLES = 4096, 1 << 23
#: The table of counts has 2**BITS places at least, more for larger corpora (two bytes each, one where it is broadcast), and never
#: more than 2**MOST_BITS.
BITS, MOST_BITS = 22, 26
#: From this threshold on parts go first: they then hold six shingles or more.
PARTS_FIRST = Fraction(17, 20)
#: Nodes that hold more than one in so many rows are joined apart from the others; there can be no more of them than this.
HEAVY = 1000
#: Rows of keys and numbers that are broadcast to the texts: some 32 bytes each, and three times as much once hashed. Beyond, texts are
#: chosen by their keys alone, eight bytes each.
BROADCAST = 1_000_000


def first_ones(n: int, threshold: Fraction) -> int:
    """How many first shingles of a set of n: it shares one of them with any set it links with."""
    return n - -(-n * threshold.numerator // threshold.denominator) + 1


def table_bits(shingles: int) -> int:
    """Bits of the table of counts for so many shingles: some eight of them or fewer fall on a place. With more, counts of places drown
    those of passages that some texts share, and chains of such texts grow with the corpus."""
    return min(MOST_BITS, max(BITS, (shingles // 8).bit_length()))


def counted(sets: DataFrame, shingles, bits: int) -> np.ndarray:
    """How often shingles occur in all sets, by the first bits of their hash: tasks' tables are added up in rounds.

    shingles: from a batch of the rows, arrays of the shingles of many sets each."""
    full = np.iinfo(np.uint16).max

    def scan(batches):
        total = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for some in shingles(batch):
                at, n = np.unique(some >> U(64 - bits), return_counts=True)
                at = at.astype(np.int64)
                total[at] = np.minimum(total[at] + n, full)
        yield _packed(total)

    def add(batches):
        total = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for x in batch.column(0):
                more = _unpacked(x.as_buffer())
                for lo in range(0, len(total), 1 << 20):
                    own, other = total[lo : lo + (1 << 20)], more[lo : lo + (1 << 20)]
                    own[:] = np.where(own > full - other, full, own + other)  # full places stay full
        yield _packed(total)

    # The order must be the same for all readers, so the tables are written before they are added up. There are few tables, whatever
    # the number of splits, and one of them reaches the driver.
    few = sets.coalesce(2 * sets.sparkSession.sparkContext.defaultParallelism)
    tables = cut(few.mapInArrow(tidy(scan), "counts binary"), "counts")
    n = tables.count()
    while n > 1:
        n = -(-n // 16)
        tables, before = cut(tables.repartition(n).mapInArrow(tidy(add), "counts binary"), "counts"), tables
        forget(before)
    rows = tables.collect()
    total = _unpacked(rows[0].counts) if rows else np.zeros(1 << bits, np.uint16)
    forget(tables)
    return total


def _packed(counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"counts": [zstandard.ZstdCompressor(level=1).compress(counts.tobytes())]})


def _unpacked(data) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint16)


class Order:
    """Rare shingles first: by steps of the logarithm of their count, then by hash."""

    def __init__(self, counts: np.ndarray, threshold: Fraction):
        self.threshold, self.bits = threshold, len(counts).bit_length() - 1
        steps = (4 * np.log2(np.arange(int(counts.max()) + 1) + 1.0)).astype(np.uint8)
        self.steps = steps[counts]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """The first shingles of a sorted set."""
        at = np.argsort(self.steps[s >> U(64 - self.bits)], kind="stable")
        return s[at[: first_ones(len(s), self.threshold)]]


class Classes:
    """Size classes for a Jaccard threshold: linked sets are of one class or of two that follow each other."""

    def __init__(self, threshold: Fraction):
        self.t, self.low = threshold, [1]
        self.known: dict[int, tuple] = {}

    def _grow(self) -> None:
        self.low.append(int(self.low[-1] / self.t) + 1)

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self._grow()
        return bisect_right(self.low, n) - 1

    def parts(self, level: int) -> tuple:
        """(spares, cuts of the hash range, salts) of a class. Parts are the largest difference of two linked sets, and one, and the spares."""
        if level not in self.known:
            while len(self.low) < level + 2:
                self._grow()
            differ = int(2 * (self.low[level + 1] - 1) * (1 - self.t) / (1 + self.t))
            spare = 1 + differ // 16
            n = differ + 1 + spare if differ else 0
            cuts = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
            self.known[level] = spare, cuts, mix(np.arange(n, dtype=np.uint64) + U(level << 32))
        return self.known[level]


def part_hashes(s: np.ndarray, classes: Classes) -> np.ndarray:
    """The hashes of the parts of one sorted set, for its own class and the next."""
    out, level = [], classes.of(len(s))
    running = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(s * U(0xD6E8FEB86659FD93) ^ (s >> U(29)), dtype=np.uint64, out=running[1:])
    for k in (level, level + 1):
        spare, cuts, salts = classes.parts(k)
        if not len(salts):
            continue
        at = np.empty(len(salts) + 1, np.int64)
        at[0], at[-1] = 0, len(s)
        at[1:-1] = s.searchsorted(cuts)
        sums = (running[at[1:]] - running[at[:-1]]) ^ salts
        full = at[1:] != at[:-1]
        out.append(sums if len(full) - np.count_nonzero(full) > spare else sums[full])
    return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


class Parts:
    """The hashes of a set's parts, for its own size class and the next."""

    def __init__(self, threshold: Fraction):
        self.classes = Classes(threshold)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return part_hashes(s, self.classes)


def node_of(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(
        mix(np.array([(mix(s ^ U(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)) ^ U(len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)]))[0].astype(np.int64),
    ) if len(s) else 0


def _sets(part: pa.RecordBatch, k: int):
    return shingle_sets(Words(part.column("text"), SPACES), k)


def join_sets(sets: list[np.ndarray], threshold: Fraction, split: int | None = None) -> list[tuple[int, int]]:
    """All links of the sets, as pairs of places; with `split` only those between the first `split` and the rest."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, df))] = np.arange(len(tokens))  # rare first
    owner = np.repeat(np.arange(n), sizes)
    ranked = rank[inverse]
    order = np.lexsort((ranked, owner))
    ranked = ranked[order]
    first = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(len(ranked)) - first[owner]
    rows = [ranked[first[i] : first[i + 1]] for i in range(n)]
    # Postings of every token, by position.
    by = np.lexsort((place, ranked))
    post, at = owner[by], place[by]
    start = np.searchsorted(ranked[by], np.arange(len(tokens) + 1))
    up = lambda x: -int(-x // 1)
    need = threshold / (1 + threshold)
    num, den = need.numerator, need.denominator
    walk = sorted(
        range(n),
        key=lambda i: (tuple(rows[i][:2].tolist()), sizes[i], i),
    ) if split is None else sorted(range(split), key=lambda i: (tuple(rows[i][:2].tolist()), i))
    links, held, counts = [], None, None
    for r in walk:
        own, size = rows[r], int(sizes[r])
        prefix = size - up(threshold * size) + 1
        # Answer level: overlaps with all sets, from those of the last answered set, if few shingles differ.
        if held is not None:
            gone, new = np.setdiff1d(rows[held], own, assume_unique=True), np.setdiff1d(own, rows[held], assume_unique=True)
            cost = int((start[gone + 1] - start[gone]).sum() + (start[new + 1] - start[new]).sum())
            derive = len(gone) + len(new) <= size // 2 and cost <= 2 * int((start[own[:prefix] + 1] - start[own[:prefix]]).sum()) + 4 * n
        else:
            derive = False
        if derive:
            for some, sign in ((gone, -1), (new, 1)):
                if len(some):
                    hit = np.concatenate([post[start[t] : start[t + 1]] for t in some])
                    counts += sign * np.bincount(hit, minlength=n)
            held = r
            found = np.flatnonzero(counts * den >= num * (size + sizes))
        else:
            # Index level: a list of the prefix is in blocks of equal positions. With the first common shingle at i here and at j
            # there, sizes lie between (1 + t) j + t size and the least of size / t and (1 + t) (size - i) / t - size;
            # blocks from the position on where that leaves no size are skipped.
            seen = []
            for i, t in enumerate(own[:prefix].tolist()):
                lo, hi = int(start[t]), int(start[t + 1])
                if hi - lo < 2:
                    continue
                most = min(size / threshold, (1 + threshold) * (size - i) / threshold - size)
                last = (most - threshold * size) / (1 + threshold)
                stop = lo + int(np.searchsorted(at[lo:hi], int(last), "right")) if last >= 0 else lo
                near = post[lo:stop]
                left = np.minimum(size - i, sizes[near] - at[lo:stop])
                seen.append(near[left * den >= num * (size + sizes[near])])
            some = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            if len(some) > 4:
                counts = np.bincount(np.concatenate([post[start[t] : start[t + 1]] for t in own]), minlength=n)
                held = r
                found = some[counts[some] * den >= num * (size + sizes[some])]
            else:
                both = np.array([len(np.intersect1d(own, rows[s], assume_unique=True)) for s in some.tolist()], np.int64)
                found = some[both * den >= num * (size + sizes[some])]
        links += [(r, s) for s in found.tolist() if (s > r if split is None else s >= split)]
    return links


def _node_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key (of id and text: a document that stands for a set is found again by it), n_shingles, node."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([node_of(s) for s in sets], pa.int64()),
                    ],
                    ["doc_id", "key", "n_shingles", "node"],
                )

    return docs.withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(tidy(scan), "doc_id long, key long, n_shingles long, node long")


ROWS = "signature long, size long, a long, b long"


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["signature", "size", "a", "b"])


def _sorted_rows(signature, size, node):
    order = np.lexsort((node, size, signature))
    return signature[order], size[order], node[order]


def _near(signature, size, threshold: Fraction) -> np.ndarray:
    """Of rows by (signature, size): whether each row and the next are of one list and can link."""
    return (signature[1:] == signature[:-1]) & (size[:-1] * threshold.denominator >= threshold.numerator * size[1:])


def signature_rows(
    nodes: np.ndarray,
    sizes: np.ndarray,
    found: list[np.ndarray],
    threshold: Fraction,
    groups: np.ndarray | None = None,
) -> pa.RecordBatch:
    """(signature, size, a, b) of some sets. Sets of one signature are chained here: (a, b) is a link of a chain, under a signature of
    its own, and of each chain the first and the last set (a = b) are told, for chains of other tasks to join. With groups,
    sets share a signature within their group only."""
    many = [len(x) for x in found]
    signature = np.concatenate(found).view(np.uint64)
    if groups is not None:
        signature = mix(signature ^ mix(np.repeat(groups.view(np.uint64), many)))
    signature, size, node = _sorted_rows(signature.view(np.int64), np.repeat(sizes, many), np.repeat(nodes, many))
    near = _near(signature, size, threshold)
    first, last = np.ones(len(node), bool), np.ones(len(node), bool)
    first[1:], last[:-1] = ~near, ~near
    ends, pairs = first | last, near & (node[1:] != node[:-1])
    a, b = (x for x in np.unique(np.stack((node[:-1][pairs], node[1:][pairs])), axis=1)) if pairs.any() else (node[:0], node[:0])
    spread = mix(a.view(np.uint64) ^ mix(b.view(np.uint64))).view(np.int64)
    return _rows(*(np.concatenate(x) for x in (
        (signature[ends], spread),
        (size[ends], np.zeros(len(a), np.int64)),
        (node[ends], a),
        (node[ends], b),
    )))


def chained(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """(node, component) of the sets whose chains signature_rows began."""

    def scan(batches):
        """Of rows by (signature, size, a): each two neighbours of a list whose sizes can link, across batches; no list is held."""
        last = None
        for batch in batches:
            own = [batch.column(c).to_numpy() for c in ("signature", "size", "a", "b")]
            told = own[2] != own[3]
            pairs = [np.stack((own[2][told], own[3][told]))]
            own = [x[~told] for x in own[:3]]
            if last is not None:
                own = [np.concatenate((x, y)) for x, y in zip(last, own)]
            signature, size, node = own
            if len(node):
                near = _near(signature, size, threshold) & (node[1:] != node[:-1])
                pairs.append(np.stack((node[:-1][near], node[1:][near])))
                last = [x[-1:] for x in own]
            pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])

    ordered = rows.repartition("signature").sortWithinPartitions("signature", "size", "a")
    return components(ordered.mapInArrow(tidy(scan), "a long, b long"))


def candidate_groups(docs: DataFrame, k: int, threshold: Fraction, shingles: int = 0) -> DataFrame:
    """(node, component): sets that can link are of one component. shingles: how many all sets hold."""
    if threshold >= PARTS_FIRST:
        signatures = Parts(threshold)
    else:
        of_texts = lambda batch: (np.concatenate(_sets(part, k)) for part in slices(batch, "text"))
        signatures = Order(counted(docs.select("text"), of_texts, table_bits(shingles)), threshold)
    held = docs.sparkSession.sparkContext.broadcast(signatures)

    def scan(batches):
        of = held.value
        for batch in batches:
            for piece in slices(batch, "text"):
                # Copies in one slice of texts are told once.
                sets = {node_of(s): s for s in _sets(piece, k) if len(s)}
                if sets:
                    sizes = np.array([len(s) for s in sets.values()], np.int64)
                    yield signature_rows(np.array(list(sets), np.int64), sizes, [of(s) for s in sets.values()], threshold)

    return chained(docs.select("text").mapInArrow(tidy(scan), ROWS), threshold)


def parted(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(node, component) of sets (comp, node, size, shingles) by the other kind of signatures, within each comp; sets that can link
    with none are left out."""
    of_batch = lambda batch: (np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles"))
    together = lambda batch: (np.concatenate(list(of_batch(batch.slice(lo, 1024)))) for lo in range(0, batch.num_rows, 1024))
    if threshold >= PARTS_FIRST:
        bits = table_bits(sets.agg(F.sum("size")).first()[0] or 0)
        signatures = Order(counted(sets.select("shingles"), together, bits), threshold)
    else:
        signatures = Parts(threshold)
    held = sets.sparkSession.sparkContext.broadcast(signatures)

    def scan(batches):
        of = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                found = [of(s) for s in of_batch(some)]
                yield signature_rows(*(some.column(c).to_numpy() for c in ("node", "size")), found, threshold, some.column("comp").to_numpy())

    return chained(sets.select("comp", "node", "size", "shingles").mapInArrow(tidy(scan), ROWS), threshold)


def sketch_bits(n: int) -> int:
    return (n // 4).bit_length()


def sketch_of(s: np.ndarray) -> bytes:
    """The size of a set, and how many shingles of it fall into each of 2**sketch_bits ranges of the hash (255 stands for more)."""
    bits = sketch_bits(len(s))
    counts = np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(s)])
    return np.uint32(len(s)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_link(sketches: list[np.ndarray], threshold: Fraction, split: int | None = None) -> list[tuple[int, int]]:
    """Pairs of places whose sketches let the sets link; with `split` only those between the first `split` and the rest."""
    sizes = np.array([int(x[:4].view(np.uint32)[0]) for x in sketches], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    first = None if split is None else order < split
    # Linked sets are of one number of ranges or of two near ones; the finer sketches are folded to the coarser.
    levels = np.array([sketch_bits(int(n)) for n in sizes])
    starts = {int(k): int(np.searchsorted(levels, k)) for k in np.unique(levels)}
    ends = {k: int(np.searchsorted(levels, k, "right")) for k in starts}
    tables = {k: np.stack([sketches[i][4:] for i in order[starts[k] : ends[k]]]) for k in starts}
    num, den, links = threshold.numerator, threshold.denominator, []
    for own in starts:
        for other in (k for k in starts if k >= own and sizes[starts[k]] * num <= sizes[ends[own] - 1] * den):
            folded = tables[other].reshape(len(tables[other]), 1 << own, -1)
            # Counts of 255 stand for more, and so do sums: cut at 255 on both sides, differences only become smaller.
            folded = folded[:, :, 0] if other == own else np.minimum(folded.sum(2, dtype=np.uint32), 255).astype(np.uint8)
            total = folded.sum(1, dtype=np.int64)
            mine = tables[own].sum(1, dtype=np.int64)
            for i in range(starts[own], ends[own]):
                lo = max(i + 1, starts[other])
                hi = min(ends[other], int(np.searchsorted(sizes, sizes[i] * den // num, "right")))
                if lo >= hi:
                    continue
                at = slice(lo - starts[other], hi - starts[other])
                shared = np.minimum(folded[at], tables[own][i - starts[own]]).sum(1, dtype=np.int64)
                differ = total[at] + mine[i - starts[own]] - 2 * shared
                near = differ * (den + num) <= (sizes[lo:hi] + sizes[i]) * (den - num)
                if first is not None:
                    near &= first[lo:hi] != first[i]
                links += [(int(order[i]), int(order[j])) for j in lo + np.flatnonzero(near)]
    return links


def _group_links(groups, find, threshold: Fraction):
    """Of rows sorted by (task, side): the forest of each task's links, found by join_sets or may_link."""
    for sets, nodes, split in groups:
        if len(sets) > 1 and split != len(sets):
            rows = local_forest((nodes[a], nodes[b]) for a, b in find(sets, threshold, split))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def _groups(batches, kind=np.uint64):
    """(sets, nodes, split) of each task; split is None for a block against itself."""
    held: dict = {"key": None, "sets": [], "nodes": [], "sides": []}

    def done():
        if held["sets"]:
            split = None if held["key"][1] == held["key"][2] else sum(s == 0 for s in held["sides"])
            yield held["sets"], held["nodes"], split

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("comp", "b1", "b2"))))
        sets = batch.column("shingles")
        for i, (key, side, node) in enumerate(zip(keys, batch.column("side").to_pylist(), batch.column("node").to_pylist())):
            if key != held["key"]:
                yield from done()
                held = {"key": key, "sets": [], "nodes": [], "sides": []}
            held["sets"].append(np.frombuffer(sets[i].as_buffer(), kind))
            held["nodes"].append(node)
            held["sides"].append(side)
    yield from done()


def _few(rows: DataFrame) -> bool:
    """Whether written rows of a few numbers are broadcast to the texts."""
    return rows.limit(BROADCAST + 1).count() <= BROADCAST


def _among(rows: DataFrame, column: str):
    """A function of a column of keys: whether these are among the given ones, which are held as one sorted array. Texts are not handed
    to Python for it."""
    keys = np.unique(rows.select(column).toArrow().column(0).to_numpy())
    held = rows.sparkSession.sparkContext.broadcast(keys)

    def found(own: pd.Series) -> pd.Series:
        keys, x = held.value, own.to_numpy()
        return pd.Series(keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool))

    return F.pandas_udf(found, "boolean")


def _blocks(most: int, most_shingles: int) -> Column:
    return F.ceil(F.greatest(F.count("*") / most, F.sum("size") / most_shingles)).cast("int").alias("blocks")


def _of_texts(docs: DataFrame, wanted: DataFrame, k: int, payload, name: str) -> DataFrame:
    """(comp, node, size, shingles) of wanted rows (key, node, comp, size), written: payload(set) is told of each. Texts are not shuffled."""

    def scan(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = _sets(piece, k)
                nodes = pa.array([node_of(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("key"), nodes, pa.array([payload(s) for s in sets], pa.binary())], ["key", "node", "shingles"])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    if few := _few(wanted):
        chosen = keyed.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    else:
        chosen = keyed.filter(_among(wanted, "key")("key"))
    told = chosen.mapInArrow(tidy(scan), "key long, node long, shingles binary")
    rows = F.broadcast(wanted) if few else wanted.hint("shuffle_hash")
    return cut(told.join(rows, ["key", "node"]).select("comp", "node", "size", "shingles"), name)


def _tasks(whole: DataFrame) -> DataFrame:
    """Rows (comp, node, shingles, blocks) dealt to tasks: a set goes to every task of its block, with itself and with each other
    block of its group."""
    whole = whole.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = whole.withColumn("other", other).select(
        "comp", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "shingles"
    )
    return tasks.repartition("comp", "b1", "b2").sortWithinPartitions("comp", "b1", "b2", "side", "node")


def _linked(tasks: DataFrame, find, kind, threshold: Fraction) -> DataFrame:
    """(node, component) of the links that `find` tells of each task."""

    def scan(batches):
        # A node stands once in a task, though several rows may hold its text.
        for sets, names, split in _groups(batches, kind):
            keep = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            if split is not None:
                split = sum(i < split for i in keep)
            yield from _group_links([([sets[i] for i in keep], [names[i] for i in keep], split)], find, threshold)

    return components(tasks.mapInArrow(tidy(scan), "a long, b long"))


def by_sketches(docs: DataFrame, wanted: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Wanted rows (key, node, comp, size) that a sketch lets link with another of their group, with the groups that are left; written."""
    sketches = _of_texts(docs, wanted, k, sketch_of, "sketches")
    totals = cut(wanted.groupBy("comp").agg(_blocks(SKETCH_BLOCK, SKETCH_SHINGLES)), "sketch-totals")
    found = _linked(_tasks(sketches.join(totals, "comp")), may_link, np.uint8, threshold)
    left = cut(wanted.drop("comp").join(found, "node").select("key", "node", F.col("component").alias("comp"), "size"), "wanted")
    forget(sketches, totals)
    return left


def link_nodes(docs: DataFrame, nodes: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """(node, component) of all sets that link with another set."""
    near = candidate_groups(docs, k, threshold, nodes.agg(F.sum("n_shingles")).first()[0] or 0)
    # One document stands for each set.
    one = nodes.groupBy("node").agg(F.min("key").alias("key"), F.max("n_shingles").alias("size"))
    chained_ones = cut(near.join(one, "node").select("key", "node", F.col("component").alias("comp"), "size"), "chained")
    wanted = by_sketches(docs, chained_ones, k, threshold)
    sets = _of_texts(docs, wanted, k, lambda s: s.tobytes(), "sets")
    totals = cut(wanted.groupBy("comp").agg(_blocks(BLOCK, BLOCK_SHINGLES)), "totals")
    columns = ["comp", "node", "size", "shingles", "blocks"]
    whole, written = sets.join(totals.filter("blocks = 1"), "comp").select(*columns), [chained_ones, wanted, sets, totals]
    if not totals.filter("blocks > 1").isEmpty():
        # Groups of more than a block are parted by the other signatures, and what is left of them is dealt in blocks.
        large = sets.join(totals.filter("blocks > 1").select("comp"), "comp", "left_semi")
        again = cut(parted(large, threshold).join(wanted.select("node", "size"), "node").withColumnRenamed("component", "part"), "parted")
        dealt = again.join(again.groupBy("part").agg(_blocks(BLOCK, BLOCK_SHINGLES)), "part").select("node", F.col("part").alias("comp"), "blocks")
        whole = whole.unionByName(large.drop("comp").join(dealt, "node").select(*columns))
        written.append(again)
    out = _linked(_tasks(whole), join_sets, np.uint64, threshold)
    forget(*written)
    return out


def _components_of_rows(docs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """doc_id, n_shingles, component_id and key (a hash of id and text) of every row."""
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = cut(_node_rows(docs, k), "nodes")
    linked = link_nodes(docs, nodes, k, threshold)
    # Sets that link with no other set are components by themselves: equal sets share the node.
    rows = nodes.count()
    named = nodes.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(linked, "node", "left").select(
        "node",
        "least",
        "copies",
        F.coalesce("component", "node").alias("component"),
    )
    named = cut(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = cut(named.join(least, "component").select("node", "copies", "component_id"), "ids")
    full, empty = nodes.filter("n_shingles > 0"), nodes.filter("n_shingles = 0")
    # The few nodes that hold many rows each are broadcast, so that no task gets all copies of one text.
    heavy = F.broadcast(ids.filter(F.col("copies") > max(1, rows // HEAVY)).select("node", "component_id"))
    out = ["doc_id", "n_shingles", "component_id", "key"]
    most = full.join(heavy, "node").select(*out)
    rest = full.join(heavy, "node", "left_anti").join(ids.select("node", "component_id"), "node").select(*out)
    return most.unionByName(rest).unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "key"))


def jaccard_components(docs: DataFrame, k: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _components_of_rows(docs, k, threshold).drop("key")


def keep_one(docs: DataFrame, k: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id; rows that repeat a kept doc_id all stay. Of rows with one
    doc_id and different texts each goes or stays by its own text."""
    rows = _components_of_rows(docs, k, threshold).filter("component_id < doc_id")
    gone = cut(rows.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "gone")
    own = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")) == F.col("_key"))
    if _few(gone):
        return docs.join(F.broadcast(gone), own, "left_anti")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # A key is that of one id and text; a row without an id is in no group's rest.
    return docs.filter(F.col("doc_id").isNull() | ~_among(gone, "_key")(key))
