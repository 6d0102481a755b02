"""Token ids in bit-plane files: encode texts, write shards, read them back.

File: the magic, then for every block of `block` ids its planes, each compressed with
zstandard, then a zstandard-compressed table of document lengths, then the chunk index
(offset and size of every plane), then a fixed trailer. A block's ids are little-endian
32-bit numbers, transposed to byte planes (all first bytes, all second bytes, ...) or bit
planes, so that the planes of high bits hold long runs. Blocks decode on their own.

Rows: documents in ascending doc_id order (nulls first, equal ids by text). A null text is
empty and holds the end id only. No rows: an empty table and no shard. A very long text is encoded alone, in
memory of its own size. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._io import bounded, cut, fresh_path, gathered, open_fs, remembered, tidy, write_file
from quillstone.llm._text import buffers, distinct, segment_hashes

MAGIC, TRAILER = b"QBITPLN1", struct.Struct("<QQQQB7x8s")
#: Segments kept in a worker; past this many, those not met for longest go.
CACHE = 1_000_000
#: Bytes of text in a batch.
BATCH = 2 << 20
#: Characters of a text that part rows of one id.
LEAD = 24


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


_LETTERS = _byte_letters()


_SPACE, _SINGLE, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_SINGLE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_NO_QUOTE = _MARK.copy()
_NO_QUOTE[0x27] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_ALPHA = _SINGLE & ~_DIGIT
#: The last bytes of white space beyond ASCII, by their number of bytes.
_WIDE_SPACE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def segment_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern begins a new token whatever stands around: before the first and the last place of white
    space between other characters, behind it if that is a line feed, and between an ASCII letter or digit and an
    ASCII mark (but not behind an apostrophe, which takes some letters with it). Texts begin at edges."""
    n = len(data)
    blank = _SPACE[data]
    # The last byte of wider white space counts as blank for what follows it.
    ends = blank.copy()
    wide = data >= 0x80
    if wide.any():
        for c in _WIDE_SPACE:
            at = np.flatnonzero(data == c[-1])
            at = at[at >= len(c) - 1]
            for k, byte in enumerate(c[:-1]):
                at = at[data[at - len(c) + 1 + k] == byte]
            ends[at] = True
            for k in range(len(c)):
                blank[at - k] = True
    cut = np.zeros(n + 1, bool)
    before, here = data[:-1], data[1:]
    inner = cut[1:-1]
    # Before a space or line feed that begins a run of white space, or that ends one with more to come in its text;
    # other white space only ever goes with what stands around it.
    last = np.zeros(n, bool)
    last[:-1] = ~blank[1:]
    last[edges[1:][edges[1:] > 0] - 1] = False
    inner |= ((here == 0x20) | (here == 0x0A)) & (~ends[:-1] | last[1:])
    inner |= (before == 0x0A) & last[:-1]
    inner |= _SINGLE[before] & _MARK[here]
    inner |= _NO_QUOTE[before] & _SINGLE[here]
    cut[edges] = True
    return np.flatnonzero(cut)[:-1] if n else np.zeros(0, np.int64)


class _Kept:
    """Ids of segments by two hashes of theirs, as sorted arrays."""

    def __init__(self):
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.turn = np.zeros(0, np.uint32), 0

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The row of each segment, -1 for those not kept; h is sorted."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.searchsorted(self.hash, h).clip(0, len(self.hash) - 1)
        at[(self.hash[at] != h) | (self.check[at] != check)] = -1
        self.turn += 1
        self.used[at[at >= 0]] = self.turn
        return at

    def add(self, h: np.ndarray, check: np.ndarray, begin: np.ndarray, count: np.ndarray, pool: np.ndarray) -> None:
        """New segments; no hash is kept twice."""
        own = np.ones(len(h), bool)
        own[1:] = h[1:] != h[:-1]
        if len(self.hash):
            own &= self.hash[np.searchsorted(self.hash, h).clip(0, len(self.hash) - 1)] != h
        h, check, begin, count = h[own], check[own], begin[own] + len(self.pool), count[own]
        at = np.searchsorted(self.hash, h)
        self.hash, self.check = np.insert(self.hash, at, h), np.insert(self.check, at, check)
        self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, count)
        self.used = np.insert(self.used, at, np.int32(self.turn))
        self.pool = np.concatenate((self.pool, pool))
        if len(self.hash) > CACHE:
            self._drop(CACHE // 2)

    def _drop(self, most: int) -> None:
        stay = np.sort(np.argsort(-self.used, kind="stable")[:most])
        self.hash, self.check, self.used = self.hash[stay], self.check[stay], self.used[stay]
        begin, self.count = self.begin[stay], self.count[stay]
        self.begin = np.cumsum(self.count, dtype=np.int64) - self.count
        self.pool = self.pool[np.repeat(begin - self.begin, self.count) + np.arange(int(self.count.sum()))]


_SPREAD = np.random.Generator(np.random.PCG64(31)).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Encoder:
    """Byte-level BPE: every different segment of a batch goes to the tokenizer once, or comes from what the worker keeps."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        assert sys.byteorder == "little"
        self.tokenizer, self.kept = Tokenizer.from_file(path), _Kept()
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        first = form.get("pre_tokenizer") or {}
        # Other tokenizers get whole texts.
        self.by_segments = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not form.get("normalizer") and form["model"]["type"] == "BPE"
        self.added = [x["content"] for x in form.get("added_tokens", ())]

    def _tokens(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """Ids of segments. One of letters, digits or marks alone is one pre-token: the model takes it as it is."""
        ends = np.cumsum(size)
        begin = ends - size
        laid = data[np.repeat(at - begin, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        lead = (laid[begin] == 0x20).astype(np.int64) if len(begin) else begin
        alone = np.zeros(len(at), bool)
        for mask in (_ALPHA, _DIGIT, _NO_QUOTE):
            running = np.concatenate(([0], np.cumsum(mask[laid])))
            alone |= (running[ends] - running[begin] == size - lead) & (size > lead)
        raw = laid.tobytes()
        letters, tokenize, out, other = raw.decode("latin1").translate(_LETTERS), self.tokenizer.model.tokenize, [], []
        for k, (a, b, one) in enumerate(zip(begin.tolist(), ends.tolist(), alone.tolist())):
            if one or raw[a + (raw[a] == 0x20) : b].decode().isalpha():
                out.append([t.id for t in tokenize(letters[a:b])])
            else:
                out.append(None)
                other.append(k)
        whole = [raw[begin[k] : ends[k]].decode() for k in other]
        for k, e in zip(other, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        first = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
        return np.array([x for own in ids for x in own], np.uint32), first

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin (one more at the end)."""
        data, edges = buffers(texts)
        if not self.by_segments or any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.added):
            return self._plain([t or "" for t in texts.to_pylist()])
        start = segment_starts(data, edges)
        size = np.diff(np.append(start, len(data)))
        one, kind = distinct(data, _SPREAD[0], start, size)
        at, length = start[one], size[one]
        h, check = (segment_hashes(data, s, at, length) for s in _SPREAD)
        order = np.argsort(h)
        row = np.empty(len(one), np.int64)
        row[order] = self.kept.find(h[order], check[order])
        new = order[row[order] < 0]
        fresh = self._tokens(data, at[new], length[new])
        count = np.zeros(len(one), np.int64)
        begin = np.zeros(len(one), np.int64)
        known = row >= 0
        old = len(self.kept.pool)
        count[known], begin[known] = self.kept.count[row[known]], self.kept.begin[row[known]]
        sizes = np.array([len(x) for x in fresh], np.int64)
        added = np.array([x for own in fresh for x in own], np.uint32)
        first = np.cumsum(sizes) - sizes
        count[new], begin[new] = sizes, old + first
        pool = np.concatenate((self.kept.pool, added))
        self.kept.add(h[new], check[new], first, sizes.astype(np.int32), added)
        counts = count[kind]
        ends = np.cumsum(counts)
        source = np.repeat(begin[kind] - ends + counts, counts)
        source += np.arange(len(source))
        return pool[source], np.concatenate(([0], ends))[np.searchsorted(start, edges)]


def encoder(path: str) -> _Encoder:
    kept = remembered("token_binary")
    if path not in kept:
        kept[path] = _Encoder(path)
    return kept[path]


def pack_block(ids: np.ndarray, planes: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def unpack_block(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class ShardWriter:
    """Yields a shard's bytes as ids come in; holds one block and the lengths of the shard's documents."""

    def __init__(self, block: int = 1 << 16, planes: str = "byte", level: int = 3):
        self.block, self.planes, self.level = block, planes, level

    def chunks(self, documents):
        """documents: (doc_id or None, id bytes)."""
        press = zstandard.ZstdCompressor(level=self.level)
        yield MAGIC
        at, index, lengths, ids, waiting, held = len(MAGIC), [], [], [], [], 0

        def flush(final: bool):
            nonlocal at, waiting, held
            whole = np.frombuffer(b"".join(waiting), "<u4")
            stop = len(whole) if final else len(whole) // self.block * self.block
            for lo in range(0, stop, self.block):
                part = whole[lo : min(stop, lo + self.block)]
                for plane in pack_block(part, self.planes):
                    data = press.compress(plane)
                    index.append((at, len(data), len(part)))
                    at += len(data)
                    yield data
            waiting = [whole[stop:].tobytes()]
            held = len(waiting[0])

        for doc_id, data in documents:
            ids.append(doc_id)
            lengths.append(len(data) // 4)
            waiting.append(data)
            held += len(data)
            if held >= 4 * self.block:
                yield from flush(False)
        yield from flush(True)
        known = np.array([x is not None for x in ids], np.uint8)
        docs = press.compress(np.array([x or 0 for x in ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + known.tobytes())
        table = press.compress(np.array(index, "<u8").reshape(-1, 3).tobytes())
        yield docs
        yield table
        yield TRAILER.pack(at, len(docs), len(table), len(ids), 4 if self.planes == "byte" else 32, MAGIC)


def read_shard(uri: str):
    """(doc_id or None, ids) of every document, block by block."""
    filesystem, path = open_fs(uri)
    expand = zstandard.ZstdDecompressor()
    with filesystem.open_input_file(path) as f:
        size = f.size()
        f.seek(size - TRAILER.size)
        at, n_docs, n_table, n, planes, magic = TRAILER.unpack(f.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"not a bit-plane file: {uri}")
        f.seek(at)
        docs = expand.decompress(f.read(n_docs))
        index = np.frombuffer(expand.decompress(f.read(n_table)), "<u8").reshape(-1, planes, 3)
        ids = np.frombuffer(docs, "<i8", n).tolist()
        lengths = np.frombuffer(docs, "<u8", n, 8 * n).tolist()
        known = np.frombuffer(docs, np.uint8, n, 16 * n).tolist()

        blocks = iter(index)
        have: list[np.ndarray] = []
        count = 0
        for doc_id, length, there in zip(ids, lengths, known):
            while count < length:
                chunk = next(blocks)
                f.seek(int(chunk[0, 0]))
                data = f.read(int(chunk[:, 1].sum()))
                cuts = np.concatenate(([0], np.cumsum(chunk[:, 1]))).astype(int)
                have.append(unpack_block([expand.decompress(data[a:b]) for a, b in zip(cuts, cuts[1:])], int(chunk[0, 2])))
                count += len(have[-1])
            whole = have[0] if len(have) == 1 else np.concatenate(have) if have else np.zeros(0, "<u4")
            yield doc_id if there else None, whole[:length]
            have = [whole[length:]]
            count -= length


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, planes: str = "byte", block: int = 1 << 16) -> DataFrame:
    """Encode `text`, append end_id, write shards in doc_id order. Returns (shard, path, n_docs, n_ids), one row a shard.

    The range partitioning by doc_id is the only shuffle; a shard is a partition.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    end = np.array([end_id], "<u4").tobytes()

    def shard(batches):
        words = encoder(tokenizer)
        totals = [0, 0]

        def rows():
            for part in gathered(batches, "text", BATCH):
                ids, first = words.encode_batch(part.column("text"))
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    totals[0] += 1
                    totals[1] += b - a + 1
                    yield doc_id, ids[a:b].astype("<u4", copy=False).tobytes() + end

        documents = rows()
        one = next(documents, None)
        if one is None:
            return
        number = TaskContext.get().partitionId()
        path = f"{folder}/part-{number:06d}.qbp"
        write_file(path, ShardWriter(block, planes).chunks(x for some in ([one], documents) for x in some))
        yield pa.RecordBatch.from_pydict({"shard": [number], "path": [path], "n_docs": [totals[0]], "n_ids": [totals[1]]})

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Where many rows share an id, or have none, what their texts begin with parts them.
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, LEAD)).sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(tidy(shard), "shard long, path string, n_docs long, n_ids long"), "shards")


def read_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (and ids), from the shards.

    Starts come from a running sum over the shard list, which has one short row per partition.
    """
    spark = shards.sparkSession
    listed = sorted((r.shard, r.path, r.n_ids) for r in shards.collect())
    starts = np.concatenate(([0], np.cumsum([x[2] for x in listed], dtype=np.int64))).tolist()

    def read(frames):
        for frame in frames:
            for path, start in zip(frame.path, frame.start):
                rows = []
                for doc_id, ids in read_shard(path):
                    rows.append((
                        doc_id,
                        start,
                        len(ids),
                        zlib.crc32(np.ascontiguousarray(ids).tobytes()),
                        *([ids.astype(np.int32).tolist()] if with_ids else []),
                    ))
                    start += len(ids)
                    if len(rows) >= 2000:
                        yield _frame(rows, with_ids)
                        rows = []
                if rows:
                    yield _frame(rows, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not listed:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([(p, s) for (_, p, _), s in zip(listed, starts)], "path string, start long")
    return names.repartition(len(listed)).mapInPandas(read, schema)


def _frame(rows: list[tuple], with_ids: bool) -> pd.DataFrame:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype="Int64" if k == "doc_id" else None) for i, k in enumerate(names)})
