"""Language of a text: a bidirectional gated recurrent network over bytes.

The network labels every byte of a text, and the document's answer is the mean of its bytes'
probabilities. Its state runs over the whole text, spaces and all. So that many places of long texts are
computed side by side, a text is cut into windows of OWN bytes: forwards the state of a window starts from
zero LEAD bytes before it (or at the text's beginning), backwards LEAD bytes behind it (or at the text's
end), and only the window's own bytes are labelled there. A text of up to OWN bytes is one window and has
no cut. Trained in numpy by backpropagation through time on windows drawn from a bounded sample of
labelled rows; only text and lang of the training rows are read.

Null texts and texts without a letter are `und`, score 0. Rows with a null lang or a null
doc_id do not train. If no row can train, every row is `und`. No rows give no rows. Very long texts are
computed some thousand windows at a time. Repeated rows count as often as they occur; columns other than
those named are passed over. Nothing is kept between batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._io import bounded, slices, tidy
from quillstone.llm._text import buffers

EMBED, HIDDEN = 8, 8
#: Bytes of a window, bytes of run-up on either side of it, and windows computed at once.
OWN, LEAD, WINDOWS = 192, 32, 6000
#: Bytes of a training window.
TRAIN = 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.p = parts

    def _inputs(self, side: str) -> np.ndarray:
        return self.p["embed"] @ self.p[f"in_{side}"] + self.p[f"bias_{side}"]

    def states(self, X: np.ndarray, M: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (words, bytes, HIDDEN) of one direction; M masks what lies beyond a word's end."""
        table, back = self._inputs(side), self.p[f"rec_{side}"]
        n, length = X.shape
        h, out = np.zeros((n, HIDDEN), table.dtype), np.zeros((n, length, HIDDEN), table.dtype)
        for k in range(length) if side == "f" else range(length - 1, -1, -1):
            x, m = table[X[:, k]], M[:, k, None]
            gates = _sigmoid(x[:, : 2 * HIDDEN] + h @ back[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ back[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((k, h, z, r, c))
            h = m * ((1 - z) * c + z * h) + (1 - m) * h
            out[:, k] = h
        return out

    def probabilities(self, X: np.ndarray, M: np.ndarray) -> np.ndarray:
        both = np.concatenate((self.states(X, M, "f"), self.states(X, M, "b")), axis=2)
        z = both @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(2, keepdims=True))
        return z / z.sum(2, keepdims=True)

    def gradient(self, X: np.ndarray, M: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy over all bytes, by backpropagation through time in both directions."""
        p, tapes = self.p, {"f": [], "b": []}
        both = np.concatenate([self.states(X, M, s, tapes[s]) for s in "fb"], axis=2)
        z = both @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(2, keepdims=True))
        d = z / z.sum(2, keepdims=True)
        d[np.arange(len(X)), :, y] -= 1
        weight = M * w[:, None]
        d *= weight[..., None] / weight.sum()
        g = {"out": np.einsum("nth,ntl->hl", both, d, optimize=True), "out_bias": d.sum((0, 1)), "embed": np.zeros_like(p["embed"])}
        dboth = d @ p["out"].T
        for s, part in (("f", dboth[..., :HIDDEN]), ("b", dboth[..., HIDDEN:])):
            back, steps = p[f"rec_{s}"], []
            grec, dh = np.zeros_like(back), np.zeros((len(X), HIDDEN))
            for k, h, zt, r, c in reversed(tapes[s]):
                m = M[:, k, None]
                dh = dh + part[:, k]
                live = dh * m
                dc = live * (1 - zt) * (1 - c * c)
                dz = live * (h - c) * zt * (1 - zt)
                drh = dc @ back[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                gates = np.concatenate((dz, dr), axis=1)
                grec[:, : 2 * HIDDEN] += h.T @ gates
                grec[:, 2 * HIDDEN :] += (r * h).T @ dc
                steps.append((k, np.concatenate((gates, dc), axis=1)))
                dh = dh * (1 - m) + live * zt + gates @ back[:, : 2 * HIDDEN].T + drh * r
            # Sum the gate gradients by byte value.
            seen = np.concatenate([X[:, k] for k, _ in steps])
            order = np.argsort(seen, kind="stable")
            cuts = np.flatnonzero(np.diff(seen[order].astype(np.int64), prepend=-1))
            dtable = np.zeros((256, 3 * HIDDEN))
            dtable[seen[order][cuts]] = np.add.reduceat(np.concatenate([x for _, x in steps])[order], cuts, axis=0)
            g[f"rec_{s}"], g[f"bias_{s}"] = grec, dtable.sum(0)
            g[f"in_{s}"] = p["embed"].T @ dtable
            g["embed"] += dtable @ p[f"in_{s}"].T
        return g

    def _steps(self, side: str):
        """(table of inputs by byte, recurrent weights of the gates and of the candidate), transposed. All are written as
        1 / (1 + exp(x)), so the signs (and the candidate's 2, as tanh(x) is 2 / (1 + exp(-2x)) - 1) go into the weights."""
        sign = np.concatenate((np.full(2 * HIDDEN, -1.0), np.full(HIDDEN, -2.0)))[:, None]
        table, back = self._inputs(side).T * sign, self.p[f"rec_{side}"].T * sign
        return tuple(np.ascontiguousarray(w, np.float32) for w in (table, back[: 2 * HIDDEN], back[2 * HIDDEN :]))

    @staticmethod
    def _step(weights, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The next states (HIDDEN, n) of n windows from their bytes x and states h."""
        table, gate, candidate = weights
        g = table.take(x, axis=1, mode="clip")
        t = gate @ h
        t += g[: 2 * HIDDEN]
        np.exp(t, out=t)
        t += 1
        np.reciprocal(t, out=t)
        z, r = t[:HIDDEN], t[HIDDEN:]
        r *= h
        c = candidate @ r
        c += g[2 * HIDDEN :]
        np.exp(c, out=c)
        c += 1
        np.divide(2, c, out=c)
        c -= 1
        out = h - c
        out *= z
        out += c
        return out

    def _windows(self, data: np.ndarray, text: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """(byte places, probabilities (languages, places)) of the windows that begin at start in texts from lo to hi, place by place."""
        length = np.minimum(hi - start, OWN)
        order = np.argsort(-length, kind="stable")
        start, lo, hi, length = start[order], lo[order], hi[order], length[order]
        n, weights = len(start), {s: self._steps(s) for s in "fb"}
        # How many windows are longer than each place.
        active = n - np.searchsorted(np.sort(length), np.arange(OWN), "right")
        out, bias = np.ascontiguousarray(self.p["out"].T, np.float32), self.p["out_bias"].astype(np.float32)[:, None]
        h = np.zeros((HIDDEN, n), np.float32)
        led = np.flatnonzero(start > lo)
        if len(led):
            own = np.zeros((HIDDEN, len(led)), np.float32)
            for k in range(LEAD, 0, -1):
                own = self._step(weights["f"], data[start[led] - k], own)
            h[:, led] = own
        forward = []
        for k in range(int(length[0])):
            h = self._step(weights["f"], data[start[: active[k]] + k], h[:, : active[k]])
            forward.append(out[:, :HIDDEN] @ h)
        h = np.zeros((HIDDEN, n), np.float32)
        end = start + length
        follow = np.minimum(hi - end, LEAD)
        led = np.argsort(-follow, kind="stable")
        more = n - np.searchsorted(np.sort(follow), np.arange(LEAD), "right")
        own = np.zeros((HIDDEN, int(more[0])), np.float32)
        for k in range(LEAD - 1, -1, -1):
            if more[k]:
                own[:, : more[k]] = self._step(weights["b"], data[end[led[: more[k]]] + k], own[:, : more[k]])
        h[:, led[: more[0]]] = own
        for k in range(int(length[0]) - 1, -1, -1):
            m = active[k]
            h[:, :m] = self._step(weights["b"], data[start[:m] + k], h[:, :m])
            z = out[:, HIDDEN:] @ h[:, :m]
            z += forward.pop()
            z += bias
            z -= z.max(0)
            np.exp(z, out=z)
            z /= z.sum(0)
            yield order[:m], k, z

    def _cut(self, offsets: np.ndarray):
        """(text, start, the text's beginning and end) of all windows, WINDOWS at a time."""
        sizes = np.diff(offsets)
        many = -(-sizes // OWN)
        text = np.repeat(np.arange(len(sizes)), many)
        start = offsets[:-1][text] + OWN * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
        for a in range(0, len(text), WINDOWS):
            some = text[a : a + WINDOWS]
            yield some, start[a : a + WINDOWS], offsets[some], offsets[some + 1]

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probability of each language over the bytes of each text (texts, languages); 0 for empty texts."""
        total = np.zeros((len(offsets) - 1, self.p["out"].shape[1]))
        for text, start, lo, hi in self._cut(offsets):
            sums = np.zeros((total.shape[1], len(text)), np.float32)
            for which, _, p in self._windows(data, text, start, lo, hi):
                sums[:, which] += p
            np.add.at(total, text, sums.T)
        return total / np.maximum(np.diff(offsets), 1)[:, None]

    def positions(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probabilities of every byte (bytes, languages)."""
        out = np.zeros((len(data), self.p["out"].shape[1]), np.float32)
        for text, start, lo, hi in self._cut(offsets):
            for which, k, p in self._windows(data, text, start, lo, hi):
                out[start[which] + k] = p.T
        return out


def _padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in pieces])
    X = np.zeros((len(pieces), int(sizes.max())), np.uint8)
    M = np.arange(X.shape[1])[None] < sizes[:, None]
    X[M] = np.frombuffer(b"".join(pieces), np.uint8)
    return X, M.astype(np.float64)


def training_rows(docs: DataFrame, most: int, seed: int = 17) -> list[tuple[str, str]]:
    """(text, lang) of at most `most` training rows a language, drawn by hash over the whole table; whole texts."""
    labelled = docs.select(F.col("doc_id").cast("string").alias("d"), "text", "lang").filter(
        "lang is not null and text is not null and d is not null and crc32(cast(d as binary)) % 5 <> 0",
    )
    # The number of languages bounds this list.
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit(seed), "d"), F.lit(1 << 30))
    near = {k: int(min(1.0, 1.2 * most / n + 8 / n) * (1 << 30)) for k, n in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in near.items() for x in kv]), F.col("lang"))
    found = sorted((r.lang, r.h, r.text) for r in labelled.withColumn("h", draw).filter(F.col("h") <= limit).collect())
    out, taken = [], dict.fromkeys(counts, 0)
    for lang, _, text in found:
        if taken[lang] < most:
            taken[lang] += 1
            out.append((text, lang))
    return out


def train(rows: list[tuple[str, str]], steps: int = 300, batch: int = 48, seed: int = 1) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages are drawn alike, their texts by length, and windows of TRAIN bytes from anywhere in a text."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.Generator(np.random.PCG64(seed))
    own = [[x for t, g in rows if g == lang and (x := t.encode("utf-8", "surrogatepass"))] or [b" "] for lang in langs]
    chance = [np.cumsum(np.sqrt([min(len(x), 100 * TRAIN) for x in xs])) for xs in own]
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    p = {"embed": rng.normal(0, 0.4, (256, EMBED)), "out": draw(2 * HIDDEN, len(langs)), "out_bias": np.zeros(len(langs))}
    for s in "fb":
        p |= {f"in_{s}": draw(EMBED, 3 * HIDDEN), f"rec_{s}": draw(HIDDEN, 3 * HIDDEN), f"bias_{s}": np.zeros(3 * HIDDEN)}
    net, m, v = Network(p), {}, {}
    for step in range(1, steps + 1):
        y, pieces = np.arange(batch) % len(langs), []
        for k in y:
            x = own[k][int(np.searchsorted(chance[k], rng.random() * chance[k][-1]))]
            at = int(rng.integers(0, max(1, len(x) - TRAIN + 1)))
            pieces.append(x[at : at + TRAIN])
        X, M = _padded(pieces)
        rate = 1.5e-2 * (1 - step / (steps + 1)) + 1e-3
        for k, g in net.gradient(X, M, y, np.ones(batch)).items():
            m[k] = 0.9 * m.get(k, 0) + 0.1 * g
            v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return langs, {k: x.astype(np.float32) for k, x in p.items()}


def fit(docs: DataFrame, most: int = 150) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """most: training rows a language; the sample and so the driver's memory are bounded by it."""
    rows = training_rows(docs, most)
    return train(rows) if rows else None


def _predict(texts: pa.Array, model) -> tuple[list[str], np.ndarray]:
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts))
    langs, parts = model
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0, as it should be
        mean = Network(parts).pooled(*buffers(texts))
    spoken = np.array([any(map(str.isalpha, t or "")) for t in texts.to_pylist()], bool)
    names = [langs[k] if s else "und" for k, s in zip(mean.argmax(1), spoken)]
    return names, np.clip(np.where(spoken, mean.max(1), 0.0), 0, 1)


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score. One scan, no shuffle; text alone is read for the prediction."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = _predict(part.column("text").cast(pa.string()), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    return rows.mapInArrow(tidy(scan), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model, least: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of `least` or more."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = _predict(part.column("text").cast(pa.string()), model)
                yield part.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return bounded(docs).mapInArrow(tidy(scan), docs.schema)
