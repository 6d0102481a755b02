"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table (made below from fixed sentences and a fixed
seed) and decoded by Viterbi in numpy batches. A word whose best label is O whatever its
neighbours are (its lead exceeds all that transitions can gain) parts the chain, so only
the runs between such words are decoded; the result is that of decoding whole texts.

Spans are code points, end exclusive. A null or empty text has no spans; repeated rows give
repeated results; no rows give no rows. A very long text is scanned alone, its findings compared in time that grows
with its length. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._io import bounded, slices, tidy
from quillstone.llm._text import Taken

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    twice = [d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2])]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), leftmost non-overlapping per kind, ordered by kind and start."""
    out = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            free = max(free, text.rfind("@", free, at) + 1)
            start = free + len(text[free:at].rstrip(_LOCAL))
            if start < at:
                out.append((0, start, m.end()))
                free = m.end()
            else:
                free = max(free, at + 1)
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = "".join(_DIGITS.findall(m.group()))
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return out


_CLASSES = str.maketrans(
    {**{c: "0" for c in "123456789"}, **{c: "a" for c in "bcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "BCDEFGHIJKLMNOPQRSTUVWXYZ"}},
)
_SQUEEZE = re.compile(r"(.)\1+", re.S)


_OTHER = re.compile(r"[^\x00-\x7f]")


def shape_of(word: str) -> str:
    shape = word.translate(_CLASSES)
    return shape if shape.isascii() else _OTHER.sub("a", shape)


def features(word: str) -> list[str]:
    """Word-shape features: a function of the word's shape alone."""
    core = shape = shape_of(word).strip(".,;:!?\"'")
    short = _SQUEEZE.sub(r"\1", shape)
    digits = shape.count("0")
    out = [
        "bias",
        f"short={short[:24]}",
        f"digits={min(digits, 20)}",
        f"length={min(len(core), 30) // 3}",
        f"dots={min(core.count('.'), 4)}",
        f"dashes={min(core.count('-'), 4)}",
    ]
    out += [name for name, there in (
        ("@", "@" in core),
        ("+", core[:1] == "+"),
        ("(", core[:1] == "("),
        ("letters", "a" in short or "A" in short),
        ("only digits", digits == len(core) > 0),
        ("exact=" + shape[:20], digits > 0 and len(shape) <= 20),
        ("no digit", digits == 0),
    ) if there]
    return out


#: The small labelled table: {kind} stands for a value of that kind, {none} for a number that is none.
SENTENCES = (
    "please write to {email} before noon",
    "mail {email} or {email} today",
    "contact: {email}, {phone}.",
    "call {phone} for help",
    "tel {phone} or {phone} now",
    "her number is {phone} and his is {phone}",
    "card {card} was charged",
    "paid with {card} on {none}",
    "the card number {card} expires {none}",
    "server {ip} is down",
    "from {ip} to {ip} at {none}",
    "address {ip}, port {none}",
    "in {none} the total was {none} of {none}",
    "version {none} came out on {none}",
    "it cost {none} and then {none} more",
    "page {none} of {none}",
    "there were {none} people in the room",
    "The quick brown fox jumps over the lazy dog",
    "ALL OF THIS IS SHOUTED!! WITH*** MARKS### and%%% more",
    "| one | two | three | {none} | five |",
    "a reference {none} to {none}, see {none}.",
    "it was written on one line, and then the next one.",
    "Después él dijo que así está über alles, où ça élève",
)


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _value(kind: str, rng) -> str:
    pick = lambda *xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    if kind == "email":
        return f"{word()}{pick('', '.', '_')}{pick(word(), _digits(rng, 2), '')}@{word()}{
            pick('', '-' + word(), str(rng.integers(9)))
        }.{pick('com', 'org', 'co.uk', 'example.net')}"
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        body = "4" + _digits(rng, 14)
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return pick(" ", "-", "").join(number[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 {a} {b} {c}", f"+{rng.integers(10, 99)}{a}{b}{c}")
    return pick(
        _digits(rng, rng.integers(1, 8)),
        f"{rng.integers(1900, 2100)}",
        f"{_digits(rng, 2)}.{_digits(rng, 2)}",
        f"{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
        f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 9)}",
        f"${_digits(rng, 3)}.{_digits(rng, 2)}",
        f"{rng.integers(10, 24)}:{rng.integers(10, 59)}",
        f"{_digits(rng, 1)},{_digits(rng, 3)}",
        f"v{rng.integers(1, 9)}.{rng.integers(0, 9)}",
        f"{_digits(rng, 16)}ab{_digits(rng, 16)}",
    )


def labelled_table(copies: int = 12, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    rng, out = np.random.Generator(np.random.PCG64(seed)), []
    for _ in range(copies):
        for sentence in SENTENCES:
            words, labels = [], []
            for token in sentence.split(" "):
                if m := re.fullmatch(r"(\W*)\{(\w+)\}(\W*)", token):
                    inner = (m[1] + _value(m[2], rng) + m[3]).split(" ")
                    words += inner
                    labels += [LABELS.index(m[2]) if m[2] in KINDS else 0] * len(inner)
                else:
                    words.append(token)
                    labels.append(0)
            out.append((words, labels))
    return out


class Field:
    """weights: feature -> row of emissions; trans: (before, after); start and end scores are O's."""

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray):
        self.weights, self.trans = weights, trans
        # The most that labelling one word y instead of O can gain in its two transitions.
        self.gain = (trans - trans[:, :1]).max(0) + (trans - trans[:1]).max(1)
        self.ids: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.scores = np.zeros((1024, len(LABELS)))
        self.sure = np.zeros(1024, bool)

    def ids_of(self, words: list[str]) -> np.ndarray:
        known = self.ids
        if len(known) > 600_000:
            known.clear()
            self.shapes.clear()
        for w in {w for w in words if w not in known}:
            shape = shape_of(w)
            if shape in self.shapes:
                known[w] = self.shapes[shape]
                continue
            n = known[w] = self.shapes[shape] = len(self.shapes)
            if n == len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
                self.sure = np.concatenate((self.sure, np.zeros_like(self.sure)))
            e = sum((self.weights[f] for f in features(shape) if f in self.weights), np.zeros(len(LABELS)))
            self.scores[n] = e
            self.sure[n] = all(e[0] - e[y] > self.gain[y] + 1e-9 for y in range(1, len(LABELS)))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def viterbi(self, emissions: np.ndarray) -> np.ndarray:
        """Best labels of chains of one length, O standing on both sides: (chains, words, labels) -> (chains, words)."""
        n, length, _ = emissions.shape
        best, back = self.trans[0] + emissions[:, 0], []
        for k in range(1, length):
            through = best[:, :, None] + self.trans[None]
            back.append(through.argmax(1))
            best = through.max(1) + emissions[:, k]
        last = (best + self.trans[:, 0]).argmax(1)
        out = [last]
        for b in reversed(back):
            out.append(last := b[np.arange(n), last])
        return np.stack(out[::-1], axis=1)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Labels of the words of several texts end to end; first: where each text starts."""
        labels = np.zeros(len(ids), np.int64)
        unsure = ~self.sure[ids]
        edge = np.zeros(len(ids) + 1, bool)
        edge[first] = True
        start = np.flatnonzero(unsure & (edge[:-1] | ~np.concatenate(([False], unsure[:-1])))) if len(ids) else np.zeros(0, int)
        end = np.flatnonzero(unsure & (edge[1:] | ~np.concatenate((unsure[1:], [False])))) + 1 if len(ids) else start
        sizes = end - start
        for size in np.unique(sizes):
            runs = start[sizes == size]
            for lo in range(0, len(runs), max(1, 20_000 // int(size))):
                at = runs[lo : lo + max(1, 20_000 // int(size)), None] + np.arange(size)
                labels[at] = self.viterbi(self.scores[ids[at]])
        return labels


def train(rounds: int = 120, rate: float = 0.15, ridge: float = 2e-3) -> Field:
    """Maximum likelihood by forward-backward over the labelled table, with Adam."""
    rows = labelled_table()
    names: dict[str, int] = {}
    longest, L = max(len(w) for w, _ in rows), len(LABELS)
    feats = [[[names.setdefault(f, len(names)) for f in features(w)] for w in words] for words, _ in rows]
    width = max(len(f) for r in feats for f in r)
    X = np.full((len(rows), longest, width), len(names))
    Y, M = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest))
    for i, (r, (_, labels)) in enumerate(zip(feats, rows)):
        for k, f in enumerate(r):
            X[i, k, : len(f)] = f
        Y[i, : len(labels)], M[i, : len(labels)] = labels, 1
    W, T = np.zeros((len(names) + 1, L)), np.zeros((L, L))
    moments = [np.zeros_like(W), np.zeros_like(W), np.zeros_like(T), np.zeros_like(T)]
    total = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    onehot = np.eye(L)[Y] * M[..., None]
    for step in range(1, rounds + 1):
        E = W[X].sum(2)
        alpha, beta = np.zeros_like(E), np.zeros_like(E)
        alpha[:, 0] = T[0] + E[:, 0]
        for k in range(1, longest):
            alpha[:, k] = np.where(M[:, k, None] > 0, total(alpha[:, k - 1, :, None] + T, 1) + E[:, k], alpha[:, k - 1])
        beta[:, -1] = T[:, 0]
        for k in range(longest - 2, -1, -1):
            beta[:, k] = np.where(M[:, k + 1, None] > 0, total(T[None] + (E[:, k + 1] + beta[:, k + 1])[:, None, :], 2), T[:, 0])
        z = total(alpha[:, -1] + T[:, 0], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * M[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + T + (E[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * M[:, 1:, None, None]
        gW = np.zeros_like(W)
        np.add.at(gW, X, np.repeat((onehot - node)[:, :, None, :], width, axis=2))
        gT = (onehot[:, :-1, :, None] * onehot[:, 1:, None, :]).sum((0, 1)) - pair.sum((0, 1))
        gT[0] += (onehot - node)[:, 0].sum(0)
        last = M.sum(1).astype(int) - 1
        gT[:, 0] += (onehot - node)[np.arange(len(rows)), last].sum(0)
        gW[-1] = 0
        for p, g, m, v in ((W, gW / len(rows) - ridge * W, *moments[:2]), (T, gT / len(rows) - ridge * T, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: W[i].copy() for f, i in names.items()}, T)


_OPEN, _CLOSE = "\"'[{<|", ".,;:!?\"']}>|"


def _accepted(kind: int, value: str) -> bool:
    """What a span of the field must look like to be kept: its digits or parts add up to the kind."""
    digits = "".join(c for c in value if c in "0123456789")
    if kind == 0:
        return value.count("@") == 1 and "." in value.rpartition("@")[2].strip(".") and value[0] != "@"
    if kind == 1:
        parts = value.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not set(value) - set("0123456789 -")
    return 8 <= len(digits) <= 15 and bool(set(value) & set("+(-. ")) and not set(value) - set("0123456789 +()-.") and max(map(len, re.findall("[0-9]+", value))) <= 12


def all_spans(texts: list[str], field: Field) -> tuple[list[list], list[list]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    split = [t.split() for t in texts]
    first = np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(int)
    labels = field.decode(field.ids_of([w for words in split for w in words]), first)
    whole = [list(b) for b in base]
    marked = np.flatnonzero(labels)
    for i in np.unique(np.searchsorted(first, marked, "right") - 1):
        own = labels[first[i] : first[i + 1]]
        at = [m.span() for m in _WORD.finditer(texts[i])]
        taken = Taken((s, e) for _, s, e in base[i])
        k = 0
        while k < len(own):
            j = k + 1
            while j < len(own) and own[j] == own[k] != 0:
                j += 1
            if own[k]:
                value = texts[i][at[k][0] : at[j - 1][1]]
                start = at[k][0] + len(value) - len(value.lstrip(_OPEN))
                end = at[j - 1][1] - (len(value) - len(value.rstrip(_CLOSE)))
                kind = int(own[k]) - 1
                if start < end and _accepted(kind, texts[i][start:end]) and taken.free(start, end):
                    whole[i].append((kind, start, end))
            k = j
        whole[i].sort()
    return base, whole


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. One scan, no shuffle; the model is a few kilobytes."""
    model = train()
    weights, trans = model.weights, model.trans
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def scan(batches):
        field = Field(weights, trans)
        for batch in batches:
            for part in slices(batch, "text"):
                base, whole = all_spans([t or "" for t in part.column("text").to_pylist()], field)
                counts = [[sum(k == kind for k, _, _ in b) for b in base] for kind in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string()),
                        pa.array([_joined(w) for w in whole], pa.string()),
                    ],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    return bounded(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(tidy(scan), schema)
