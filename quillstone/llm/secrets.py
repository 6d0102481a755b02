"""Secrets: exact patterns, and a character convolutional network over candidates in context.

The network (numpy) is trained on labelled findings made by rule from a fixed seed. Its
output is calibrated on held-out findings, and the threshold is the highest that keeps the
stated recall there. Candidates are all runs of token characters of 16 or more that hold
a letter and a digit, at any place of the whole text, of any length.

Spans are code points, end exclusive. A null or empty text has no spans; repeated rows give
repeated results; no rows give no rows. A very long text is scanned alone, its findings counted in time that grows
with its length. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._io import bounded, slices, tidy
from quillstone.llm._text import Taken, buffers

KINDS = ("assign", "access", "hex", "cnn")
_either = lambda s: "".join(f"[{c.upper()}{c}]" for c in s)
_ASSIGN = re.compile(f"({_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = 16
LEFT, RIGHT, WINDOW, STEP = 24, 8, 96, 48

_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_DIGIT, _LETTER, _HEXES = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_HEXES[list(b"0123456789abcdef")] = True


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost non-overlapping per kind, ordered by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(mask) + 2, bool)
    inside[1:-1] = mask
    cuts = np.zeros(len(mask) + 1, bool)
    cuts[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cuts))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cuts))
    long = end - start >= least
    return start[long], end[long]


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the candidates of all texts."""
    start, end = _runs(_TOKEN[data], offsets, CANDIDATE)
    if not len(start):
        return start, end
    digits, letters = (np.concatenate(([0], np.cumsum(x[data]))) for x in (_DIGIT, _LETTER))
    both = (digits[end] > digits[start]) & (letters[end] > letters[start])
    return start[both], end[both]


#: Character classes of the network: each lower-case hex digit letter, other letters by case, digits, and marks by themselves.
_CLASS = np.full(256, 1, np.int64)
for _n, _chars in enumerate(
    (
        b"abcdef",
        b"ghijklmnopqrstuvwxyz",
        b"ABCDEF",
        b"GHIJKLMNOPQRSTUVWXYZ",
        b"01234",
        b"56789",
        b" \t",
        b"\r\n",
        b"=",
        b":",
        b"\"'`",
        b"_",
        b"-",
        b"/",
        b"+",
        b".",
        b",;",
        b"()[]{}<>",
        b"eiou",
        b"AEIOU",
    ),
    2,
):
    _CLASS[list(_chars)] = _n
_CLASS[128:] = 22
CLASSES, EMBED, WIDTH, FILTERS, HIDDEN = 23, 10, 5, 24, 16


def windows(data: np.ndarray, lo: int, hi: int, start: int, end: int) -> list[np.ndarray]:
    """Windows of 2 * class + (inside the candidate), 0 beyond the text; together they cover the candidate and its surroundings."""
    a, b = max(lo, start - LEFT), min(hi, end + RIGHT)
    inside = np.arange(a, b)
    coded = 2 * _CLASS[data[a:b]] + ((inside >= start) & (inside < end))
    out = []
    for at in range(0, max(1, len(coded) - WINDOW + STEP), STEP):
        w = np.zeros(WINDOW, np.int64)
        piece = coded[at : at + WINDOW]
        w[: len(piece)] = piece
        out.append(w)
    return out


class Network:
    """embedding -> convolution -> ReLU -> largest and mean over places -> ReLU layer -> one logit; then a calibrated probability."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.p = parts

    def _forward(self, X: np.ndarray):
        p, n = self.p, len(X)
        e = p["embed"][X]
        m = WINDOW - WIDTH + 1
        columns = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, m, WIDTH * EMBED)
        conv = np.maximum(columns @ p["filters"] + p["bias"], 0)
        top = conv.argmax(1)
        pooled = np.concatenate((np.take_along_axis(conv, top[:, None], 1)[:, 0], conv.mean(1)), axis=1)
        hidden = np.maximum(pooled @ p["w1"] + p["b1"], 0)
        return columns, conv, top, pooled, hidden, hidden @ p["w2"][:, 0] + p["b2"][0]

    def logits(self, X: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(X[lo : lo + 256])[-1] for lo in range(0, len(X), 256)]) if len(X) else np.zeros(0)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.p["scale"][0] * logits + self.p["scale"][1])))

    def gradient(self, X: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(X)
        columns, conv, top, pooled, hidden, z = self._forward(X)
        dz = ((1 / (1 + np.exp(-z))) - y) / n
        g = {"w2": hidden.T @ dz[:, None], "b2": np.array([dz.sum()])}
        dh = dz[:, None] * p["w2"].T * (hidden > 0)
        g |= {"w1": pooled.T @ dh, "b1": dh.sum(0)}
        dp = dh @ p["w1"].T
        dconv = np.repeat(dp[:, None, FILTERS:] / conv.shape[1], conv.shape[1], axis=1)
        at = np.arange(n)[:, None], top, np.arange(FILTERS)[None]
        dconv[at] += dp[:, :FILTERS]
        dconv *= conv > 0
        g |= {"filters": np.einsum("nmk,nmf->kf", columns, dconv, optimize=True), "bias": dconv.sum((0, 1))}
        dcol = (dconv @ p["filters"].T).reshape(n, -1, WIDTH, EMBED)
        de = np.zeros((n, WINDOW, EMBED))
        for k in range(WIDTH):
            de[:, k : k + dcol.shape[1]] += dcol[:, :, k]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], X, de)
        return g


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label), half of them secrets; made by rule."""
    rng, out = np.random.Generator(np.random.PCG64(seed)), []
    pick = lambda xs: xs[rng.integers(len(xs))]
    alphabets = {
        "hex": "0123456789abcdef",
        "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "base": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    }
    chars = lambda a, k: "".join(pick(alphabets[a]) for _ in range(k))
    word = lambda: pick(["report", "image", "chapter", "section", "user", "page", "north", "river", "summer", "table", "index", "value", "session", "market", "update", "version", "the", "and", "data", "house"])
    for k in range(n):
        if k % 2:
            value = pick([
                lambda: chars("hex", pick([32, 40, 64])),
                lambda: chars("mixed", rng.integers(20, 50)),
                lambda: chars("base", rng.integers(24, 60)) + pick(["", "=", "=="]),
                lambda: "AKIA" + chars("upper", 16),
                lambda: "ghp_" + chars("mixed", 36),
                lambda: "sk-" + chars("mixed", 40),
                lambda: "xoxb-" + chars("upper", 12).lower() + "-" + chars("mixed", 24),
                lambda: "eyJ" + base64.b64encode(bytes(rng.integers(0, 256, 30).tolist())).decode(),
            ])()
            before = pick([
                "token = ",
                "key: \"",
                "Authorization: Bearer ",
                "secret=",
                "export KEY='",
                "use ",
                "the ",
                "",
                "credential ",
                "auth_token: ",
                "password = ",
            ])
        else:
            value = pick([
                lambda: "-".join(word() for _ in range(rng.integers(3, 6))) + "-" + str(rng.integers(1, 3000)),
                lambda: "_".join(word() for _ in range(rng.integers(3, 5))) + str(rng.integers(10)),
                lambda: "".join(word().capitalize() for _ in range(rng.integers(3, 6))) + str(rng.integers(100)),
                lambda: "/".join(word() for _ in range(rng.integers(3, 6))) + "/" + str(rng.integers(1000, 2030)),
                lambda: f"{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}-{rng.integers(10, 60)}-00Z",
                lambda: "-".join(str(rng.integers(1000, 9999)) for _ in range(3)) + "-" + word(),
                lambda: "=" * rng.integers(8, 20) + word() + str(rng.integers(10)) + "=" * 8,
                lambda: "a" * rng.integers(12, 30) + str(rng.integers(100)),
                lambda: word() * 3 + str(rng.integers(1000)),
                lambda: str(rng.integers(10**9, 10**10)) + "-" + word() + "-" + str(rng.integers(10**5)),
            ])()
            before = pick(["see ", "the file ", "in ", "", "chapter ", "http://", "of the ", "page "])
        left = " ".join(word() for _ in range(rng.integers(0, 6))) + " " + before
        text = left + value + pick(["\" and ", " ", "\n", "' ", ". "]) + word()
        start = len(left)
        run = re.compile(r"[A-Za-z0-9+/_=-]+").match(text, start)
        out.append((text, start, run.end() if run else start + len(value), k % 2))
    return out


def train(epochs: int = 8, recall: float = 0.97, seed: int = 3) -> tuple[dict[str, np.ndarray], float]:
    """Parts of the network and the threshold. Four fifths of the findings train, the rest calibrate."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = labelled_findings()
    X = np.stack([windows(d := np.frombuffer(t.encode(), np.uint8), 0, len(d), s, e)[0] for t, s, e, _ in rows])
    y = np.array([r[3] for r in rows], float)
    draw = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape)
    p = {
        "embed": rng.normal(0, 0.5, (2 * CLASSES + 2, EMBED)),
        "filters": draw(WIDTH * EMBED, FILTERS),
        "bias": np.zeros(FILTERS),
        "w1": draw(2 * FILTERS, HIDDEN),
        "b1": np.zeros(HIDDEN),
        "w2": draw(HIDDEN, 1),
        "b2": np.zeros(1),
        "scale": np.array([1.0, 0.0]),
    }
    net, order = Network(p), rng.permutation(len(rows))
    fit, held = order[: len(rows) * 4 // 5], order[len(rows) * 4 // 5 :]
    m, v, step = {}, {}, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for lo in range(0, len(fit), 64):
            step += 1
            for k, g in net.gradient(X[fit[lo : lo + 64]], y[fit[lo : lo + 64]]).items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                p[k] -= 4e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    z = net.logits(X[held])
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic calibration on the held-out findings
        q = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a - 0.05 * ((q - y[held]) * z).mean(), b - 0.05 * (q - y[held]).mean()
    p["scale"] = np.array([a, b])
    scores = np.sort(net.probability(z)[y[held] == 1])
    return p, float(scores[int((1 - recall) * len(scores))])


def all_spans(texts: list[str], column: pa.Array, net: Network, threshold: float) -> tuple[list[list], list[list]]:
    """Base spans and all spans of each text, as (start, kind, end)."""
    data, offsets = buffers(column)
    start, _ = _runs(_HEXES[data], offsets, 24)
    hexed = set((np.searchsorted(offsets, start, "right") - 1).tolist())
    base = [base_spans(t, i in hexed) for i, t in enumerate(texts)]
    whole = [list(b) for b in base]
    start, end = candidates(data, offsets)
    text_of = np.searchsorted(offsets, start, "right") - 1
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if len(start) else start
    taken: dict[int, Taken] = {}
    for lo in range(0, len(start), 2000):
        part = range(lo, min(lo + 2000, len(start)))
        seen = [windows(data, offsets[text_of[k]], offsets[text_of[k] + 1], start[k], end[k]) for k in part]
        scores = net.probability(net.logits(np.stack([w for ws in seen for w in ws])))
        first = np.concatenate(([0], np.cumsum([len(ws) for ws in seen])[:-1]))
        for k in np.flatnonzero(np.maximum.reduceat(scores, first) >= threshold) + lo:
            i = int(text_of[k])
            a = int(letters[start[k]] - letters[offsets[i]])
            b = a + int(end[k] - start[k])
            if i not in taken:
                taken[i] = Taken((s, e) for s, _, e in base[i])
            if taken[i].free(a, b):
                whole[i].append((a, 3, b))
    for w in whole:
        w.sort()
    return base, whole


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """The text with each stretch of spans replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. One scan, no shuffle."""
    parts, threshold = train()
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def scan(batches):
        net = Network(parts)
        for batch in batches:
            for part in slices(batch, "text"):
                base, whole = all_spans([t or "" for t in part.column("text").to_pylist()], part.column("text"), net, threshold)
                counts = [[sum(k == kind for _, k, _ in b) for b in base] for kind in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string()),
                        pa.array([_joined(w) for w in whole], pa.string()),
                    ],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return bounded(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(tidy(scan), schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns; text has every span replaced by [SECRET], and n_chars (if there) follows."""
    parts, threshold = train()
    names = docs.columns

    def scan(batches):
        net = Network(parts)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                _, whole = all_spans([t or "" for t in texts], part.column("text"), net, threshold)
                clean = [redacted(t, w) if w else t for t, w in zip(texts, whole)]
                columns = {n: part.column(n) for n in names} | {"text": pa.array(clean, part.column("text").type)}
                if "n_chars" in columns:
                    old = part.column("n_chars")
                    columns["n_chars"] = pa.array([len(c) if w else n for c, w, n in zip(clean, whole, old.to_pylist())], old.type)
                yield pa.RecordBatch.from_pydict(columns)

    return bounded(docs).mapInArrow(tidy(scan), docs.schema)
