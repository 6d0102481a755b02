"""SentencePiece encoding by suffix-array matching, and decoding.

A batch's texts are laid end to end and cut into segments wherever two characters stand side
by side that stand so in no piece: no piece and no merge reaches across. Every different segment
of the batch is laid out once, and the suffixes of that text are sorted (by as many characters as
the longest piece has). Every piece's occurrences are the suffixes between two binary searches. These
edges, sorted by their end, are relaxed position by position: an edge holds at a position if its piece
may follow the last piece of the encoding that ends where it starts. For byte-pair models that is so
when merging the two pieces' characters together gives the two pieces again; exactly one edge holds at
each position, and following the last pieces back gives the encoding that repeated merging gives.

Every batch is indexed for itself; nothing is kept from batch to batch but the model's tables, so
memory does not grow with the texts read. Characters outside the vocabulary become their UTF-8
bytes' pieces.

A null or empty text encodes to no ids and decodes to an empty text; no rows give no rows. A very long
text is a batch of its own. Texts that hold U+2581 decode to a space there, as the model has it.
Repeated rows give repeated results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._io import bounded, gathered, remembered, tidy
from quillstone.llm._text import distinct

SPACE = "▁"
#: Different segments indexed at once.
KINDS = 400_000
#: Bytes of text in a batch.
BATCH = 1 << 19


NORMAL, BYTE = 1, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) in id order, from the model's protocol buffer."""
    out, at = [], 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 2:
            size, at = _varint(data, at)
            body, at = data[at : at + size], at + size
            if key >> 3 != 1:
                continue
            piece, score, kind, k = "", 0.0, NORMAL, 0
            while k < len(body):
                field, k = _varint(body, k)
                if field == 0x0A:
                    n, k = _varint(body, k)
                    piece, k = body[k : k + n].decode(), k + n
                elif field == 0x15:
                    score, k = float(np.frombuffer(body, "<f4", 1, k)[0]), k + 4
                elif field == 0x18:
                    kind, k = _varint(body, k)
                else:
                    raise ValueError("unknown field in a piece")
            out.append((piece, score, kind))
        elif key & 7 == 0:
            _, at = _varint(data, at)
        else:
            at += 8 if key & 7 == 1 else 4
    return out


class Codec:
    """Tables of one model. Pieces are numbered by rank: single characters first, then by falling score."""

    def __init__(self, path: str):
        pieces = read_model(open(path, "rb").read())
        self.bytes_of = [p.replace(SPACE, " ").encode() for p, _, _ in pieces]
        self.byte_id = np.zeros(256, np.int64)
        for k, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(p[1:-1], 16)] = k
                self.bytes_of[k] = bytes([int(p[1:-1], 16)])
            elif kind != NORMAL:
                self.bytes_of[k] = b""
        normal = [(len(p) > 1, -s, k, p) for k, (p, s, kind) in enumerate(pieces) if kind == NORMAL]
        normal.sort()
        self.id_of = np.array([k for _, _, k, _ in normal], np.int64)
        self.names = [p for *_, p in normal]
        self.rank = {p: r for r, p in enumerate(self.names)}
        self.singles = sum(len(p) == 1 for p in self.names)
        self.longest = max(map(len, self.names))
        self._build()
        self.sizes = np.array([len(p) for p in self.names], np.int64)
        # Codes: 0 for characters that stand in no longer piece, the others from 1 on.
        inside = {pair for p in self.names for pair in zip(p, p[1:])}
        alphabet = sorted({c for pair in inside for c in pair})
        code = {c: k for k, c in enumerate(alphabet, 1)}
        self.code_table = np.zeros(0x110000, np.uint16)
        self.code_table[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.joined_width = len(alphabet) + 1
        self.joined = np.zeros(self.joined_width**2, bool)
        self.joined[[code[a] * self.joined_width + code[b] for a, b in inside]] = True
        self.spread = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, self.joined_width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.number = np.full(self.joined_width, -1, np.int64)
        self.number[0] = 0
        self.piece_codes = np.full((len(self.names), self.longest), -1, np.int64)
        for r, p in enumerate(self.names):
            self.piece_codes[r, : len(p)] = [code.get(c, 0) for c in p]
        self.single_code = np.where(self.sizes == 1, self.piece_codes[:, 0], 0)
        self.byte_count = np.array([len(x) for x in self.bytes_of], np.int64)
        self.byte_begin = np.cumsum(self.byte_count) - self.byte_count
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.told, self.answer = np.full(1 << 21, -1), np.zeros(1 << 21, bool)

    def _build(self) -> None:
        """left, right: the two pieces whose merge made each piece; pairs: what each mergeable pair makes."""
        n = len(self.names)
        self.left, self.right = np.arange(n), np.arange(n)
        self.usable = np.zeros(n, bool)
        self.usable[: self.singles] = True
        pairs: dict[tuple[int, int], int] = {}
        left, right, rank = self.left.tolist(), self.right.tolist(), self.rank
        waiting: dict[int, list[tuple[int, int]]] = {}
        for r in range(self.singles, n):
            name = self.names[r]
            waiting[r] = [(a, b) for k in range(1, len(name)) if (a := rank.get(name[:k])) is not None and (b := rank.get(name[k:])) is not None]
            for a, b in waiting[r]:
                pairs[a, b] = r
        for r in range(self.singles, n):
            for a, b in waiting[r]:
                if a < r and b < r and self.usable[a] and self.usable[b] and self._joins(a, b, r, pairs, left, right):
                    left[r], right[r] = a, b
                    self.usable[r] = True
                    break
        self.left, self.right = np.array(left), np.array(right)
        codes = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(codes)
        self.pair_codes, self.pair_makes = codes[order], np.array(list(pairs.values()), np.int64)[order]

    @staticmethod
    def _joins(a: int, b: int, limit: int, pairs: dict, left: list, right: list) -> bool:
        """Whether a and b, merged each for itself, are not merged across before `limit`."""
        while True:
            made = pairs.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of pieces: whether merging their characters together gives the two again."""
        n = len(self.names)
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), n + 1)
        live = np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            codes = x * n + y
            at = np.searchsorted(self.pair_codes, codes).clip(0, len(self.pair_codes) - 1)
            across = (self.pair_codes[at] == codes) & (self.pair_makes[at] < most)
            good[live[across]] = False
            stay = ~across
            live, x, y = live[stay], x[stay], y[stay]
            first = x > y
            nx, ny = self.right[x], self.left[y]
            # The later merged of the two is undone; a single character cannot be, then the other is.
            x_ends, y_ends = nx == x, ny == y
            undo_x = np.where(first, ~x_ends, y_ends & ~x_ends)
            undo_y = np.where(first, x_ends & ~y_ends, ~y_ends)
            limit[live] = np.where(undo_x, x, y + 1)
            a[live] = np.where(undo_x, nx, x)
            b[live] = np.where(undo_y, ny, y)
            live = live[undo_x | undo_y]
        return good

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_follow, with answers remembered in a table of fixed size."""
        codes = a * len(self.names) + b
        at = (codes * 0x9E3779B1 >> 7) & (len(self.told) - 1)
        good, met = self.answer[at], self.told[at] == codes
        miss = np.flatnonzero(~met)
        if len(miss):
            new, back = np.unique(codes[miss], return_inverse=True)
            answers = self.may_follow(new // len(self.names), new % len(self.names))
            good[miss] = answers[back]
            place = (new * 0x9E3779B1 >> 7) & (len(self.told) - 1)
            self.told[place] = new
            # Where two pairs share a place, the later one stays and its answer with it.
            self.answer[place] = answers
        return good

    def match(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all occurrences of usable pieces in `coded`.

        coded: characters as small numbers (0 parts words). A suffix's first characters, as
        many as the longest piece has, are packed into 64-bit keys and compared as those.
        """
        n, per, bits = len(coded), self.per, np.uint64(self.bits)
        padded = np.zeros(n + self.keys * per, np.uint64)
        padded[:n] = coded
        packed = np.zeros(len(padded) - per + 1, np.uint64)
        for k in range(per):
            packed = packed << bits | padded[k : k + len(packed)]
        columns = [packed[k * per : k * per + n] for k in range(self.keys)]
        suffixes = np.argsort(columns[0]).astype(np.int32)
        first = columns[0][suffixes]
        # Suffixes with equal first keys are ordered by the others where a piece is longer than a key.
        a, b = np.searchsorted(first, self.refined, "left"), np.searchsorted(first, self.refined, "right")
        ends = np.cumsum(b - a)
        tied = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(b - ends, b - a)
        own = suffixes[tied]
        suffixes[tied] = own[np.lexsort([c[own] for c in columns[::-1]])]
        lo, hi = self._ranges([first, *(c[suffixes] for c in columns[1:])])
        count = hi - lo
        ends = np.cumsum(count)
        place = np.repeat(lo + count - ends, count)
        place += np.arange(len(place))
        starts = suffixes[place]
        pieces = np.repeat(self.searched.astype(np.int32), count)
        return starts, starts + np.repeat(self.sizes[self.searched].astype(np.int32), count), pieces

    def _ranges(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each searched piece: the range of sorted suffixes that begin with it, by binary search on the keys."""
        lo = np.searchsorted(keys[0], self.least[:, 0], "left")
        hi = np.searchsorted(keys[0], self.most[:, 0], "right")
        long = np.flatnonzero(self.sizes[self.searched] > self.per)
        out = []
        for bound, upper in ((self.least[long], False), (self.most[long], True)):
            a, b = lo[long].copy(), hi[long].copy()
            while (open_ := a < b).any():
                mid = ((a + b) // 2).clip(0, len(keys[0]) - 1)
                less, same = np.zeros(len(a), bool), np.ones(len(a), bool)
                for key, limit in zip(keys, bound.T):
                    got = key[mid]
                    less |= same & (got < limit)
                    same &= got == limit
                if upper:
                    less |= same
                a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
            out.append(a)
        lo[long], hi[long] = out
        return lo, hi

    def _number(self, codes: np.ndarray) -> np.ndarray:
        """The codes that have come up so far as numbers of fewest bits; the search tables are made anew for new ones."""
        seen = np.bincount(codes, minlength=len(self.number)) > 0
        if (seen & (self.number < 0)).any():
            self.number[seen & (self.number < 0)] = 0
            known = np.flatnonzero(self.number >= 0)
            self.number[known] = np.arange(len(known))
            top = len(known) - 1
            self.bits = max(1, top.bit_length())
            self.per = 64 // self.bits
            self.keys = -(-self.longest // self.per)
            usable = np.flatnonzero(self.usable & (self.sizes > 1) | self.usable & (self.single_code > 0))
            numbers = np.where(self.piece_codes[usable] >= 0, self.number[np.maximum(self.piece_codes[usable], 0)], 0)
            some = usable[(numbers >= 0).all(1)]
            numbers = numbers[(numbers >= 0).all(1)]
            inside = np.arange(numbers.shape[1])[None] < self.sizes[some, None]
            width = self.keys * self.per
            low, high = np.zeros((len(some), width), np.uint64), np.full((len(some), width), top, np.uint64)
            low[:, : numbers.shape[1]] = np.where(inside, numbers, 0)
            high[:, : numbers.shape[1]] = np.where(inside, numbers, top)
            shifts = np.arange(self.per - 1, -1, -1, dtype=np.uint64) * np.uint64(self.bits)
            pack = lambda x: (x.reshape(len(x), self.keys, self.per) << shifts).sum(2, dtype=np.uint64)
            least, most = pack(low), pack(high)
            order = np.lexsort(least.T[::-1])  # in text order, binary searches that follow each other read the same places
            self.searched, self.least, self.most = some[order], least[order], most[order]
            self.refined = np.unique(self.least[self.sizes[self.searched] > self.per, 0])
        return self.number[codes]

    def encode_segments(self, codes: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pieces of the segments of codes, and where each segment's end."""
        # Laid end to end, a zero before each and behind the last.
        before = np.cumsum(length + 1) - length
        laid = np.zeros(int(before[-1] + length[-1]) + 1 if len(at) else 1, np.int64)
        source = np.repeat(at - before, length)
        place = np.arange(len(source)) + np.repeat(np.arange(1, len(at) + 1), length)
        laid[place] = codes[source + place]
        coded = self._number(laid)
        start, end, piece = self.match(coded.astype(np.uint64))
        last = np.full(len(coded) + 1, -1)  # the last piece of the encoding that ends here
        origin = np.zeros(len(coded) + 1, np.int64)
        breaks = coded == 0
        # Ends one character into their segments, then two, ...: all segments at once.
        depth = np.zeros(len(coded) + 1, np.int32)
        depth[1 + place] = np.arange(1, len(place) + 1, dtype=np.int32) - np.repeat((np.cumsum(length) - length).astype(np.int32), length)
        level = depth[end]
        del depth, place, source
        order = np.argsort(level.astype(np.int16) if len(level) and level.max() < 1 << 15 else level, kind="stable")
        cuts = np.cumsum(np.bincount(level)) if len(level) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            some = order[a:b]
            s, e, p = start[some], end[some], piece[some]
            fresh = breaks[s - 1]
            before = last[s]
            known = fresh | (before >= 0)
            s, e, p, fresh, before = s[known], e[known], p[known], fresh[known], before[known]
            good = fresh.copy()
            good[~fresh] = self.follows(before[~fresh], p[~fresh])
            last[e[good]], origin[e[good]] = p[good], s[good]
        # Walk back from all word ends together.
        n = len(at)
        at, owner, found = np.flatnonzero(breaks)[1:], np.arange(n), []
        while len(at):
            found.append((owner, last[at]))
            at = origin[at]
            live = ~breaks[at - 1]
            at, owner = at[live], owner[live]
        owners, ranks = np.concatenate([o for o, _ in found]), np.concatenate([p for _, p in found])
        turn = np.repeat(np.arange(len(found)), [len(o) for o, _ in found])
        return ranks[np.lexsort((-turn, owners))], np.cumsum(np.bincount(owners, minlength=n))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin (one more at the end)."""
        whole = "".join([SPACE + t for t in texts if t]).replace(" ", SPACE)  # the two are one to the model
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        del whole
        codes = self.code_table[chars]
        # Segments: no piece reaches across two characters that stand side by side in none.
        cut = np.empty(len(codes) + 1, bool)
        cut[0] = cut[-1] = True
        np.logical_not(self.joined[codes[:-1].astype(np.int32) * self.joined_width + codes[1:]], out=cut[1:-1])
        cut[edges] = True
        start = np.flatnonzero(cut)
        start, size = start[:-1], np.diff(start)
        del cut
        # A character that stands in no longer piece is a segment of its own: a piece, or its bytes' pieces.
        single = codes[start] == 0
        some = np.flatnonzero(~single)
        one, kind = distinct(codes, self.spread, start[some], size[some])
        at, length = start[some][one], size[some][one]
        pool, n_ids = [], np.zeros(len(one), np.int64)
        for lo in range(0, len(one), KINDS):
            part = slice(lo, lo + KINDS)
            ranks, ends = self.encode_segments(codes, at[part], length[part])
            pool.append(self.id_of[ranks].astype(np.int32))
            n_ids[part] = np.diff(ends, prepend=0)
        lonely, back = np.unique(chars[start[single]], return_inverse=True)
        spelled = [self._spelled(chr(c)) for c in lonely.tolist()]
        pool += [np.array(x, np.int32) for x in spelled]
        pool = np.concatenate(pool) if pool else np.zeros(0, np.int32)
        n_ids = np.concatenate((n_ids, np.array([len(x) for x in spelled], np.int64)))
        begin = np.cumsum(n_ids) - n_ids
        which = np.empty(len(start), np.int64)
        which[some], which[single] = kind, len(one) + back
        counts = n_ids[which]
        ends = np.cumsum(counts)
        source = np.repeat(begin[which] - ends + counts, counts)
        source += np.arange(len(source))
        first = np.concatenate(([0], ends))[np.searchsorted(start, edges)]
        return pool[source], first

    def _spelled(self, char: str) -> list[int]:
        rank = self.rank.get(char)
        return [int(self.id_of[rank])] if rank is not None else self.byte_id[list(char.encode("utf-8", "surrogatepass"))].tolist()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        ids, first = self.encode_batch(texts)
        return [ids[a:b].astype("<i4").tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]

    def decode_batch(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and where each id's bytes end."""
        counts = self.byte_count[ids]
        ends = np.cumsum(counts)
        source = np.repeat(self.byte_begin[ids] - ends + counts, counts)
        source += np.arange(len(source))
        return self.byte_pool[source], ends

    def decode(self, ids: bytes) -> str:
        """The text of some ids, without the space that stands before every text."""
        whole = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        text = whole.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def codec(path: str) -> Codec:
    kept = remembered("sentencepiece")
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def encode(docs: DataFrame, model: str, with_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip (and ids, and text as decoded). One scan, no shuffle.

    model: path of a byte-pair model file, the same on all machines.
    """
    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids + ", decoded string" * keep_text

    def scan(batches):
        own = codec(model)
        for part in gathered(batches, "text", BATCH):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids, first = own.encode_batch(texts)
            decoded, ends = own.decode_batch(ids)
            spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
            places = np.concatenate(([0], ends))[first].tolist()
            # What decodes begins with the space that stands before every text.
            back = [decoded[a + 1 : b].tobytes() for a, b in zip(places, places[1:])]
            crcs = [zlib.crc32(ids[a:b].astype("<i4", copy=False)) for a, b in spans]
            same = [x == t.encode("utf-8", "surrogatepass") for x, t in zip(back, texts)]
            columns = [part.column("doc_id"), pa.array(np.diff(first)), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)))
            if keep_text:
                columns.append(pa.array([x.decode("utf-8", "replace") for x in back], pa.string()))
            yield pa.RecordBatch.from_arrays(
                columns,
                ["doc_id", "n_tokens", "ids_crc32", "round_trip", *["ids"] * with_ids, *["decoded"] * keep_text],
            )

    return bounded(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(tidy(scan), schema)
