"""Metrics of two lists of phrases, batched over Arrow: a row holds predictions and references.

Small per-row problems (a review has a handful of phrases), so a batch's distinct phrases are embedded once, all pairs of all
its rows are laid end to end and turned into similarities by one call, and every metric reads its own off the row's table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.numeric import rescaled_cosine, transport_cost
from quillstone.functions.similarity import CLASS_VALUES, hashed_ngrams
from quillstone.functions.text import porter_stem

THRESHOLD = 0.7


#: Comparators that take two phrases as n-gram texts; the others compare vectors.
TEXT_KINDS = ("bleu", "sacrebleu", "rouge1", "rouge2", "rougeL", "rougeLsum")


#: Rows that are worked on at a time, and phrases whose vectors are kept beyond them.
ROWS = 256
KEPT = 8192


class Phrases:
    """Similarities of phrases: of vectors (cosine_relu, cosine, euclidean), of their words (TEXT_KINDS), or 1 for equal
    phrases and 0 for others (exact). Vectors are made once for each phrase of a batch."""

    def __init__(self, embed=hashed_ngrams, kind: str = "cosine_relu"):
        if kind not in ("cosine_relu", "cosine", "euclidean", "exact", *TEXT_KINDS):
            raise ValueError(f"no comparator is called {kind}")
        self.embed, self.kind, self.known = embed, kind, {}

    def learn(self, phrases) -> None:
        """Unit vectors of phrases not met before."""
        new = [p for p in dict.fromkeys(phrases) if p not in self.known]
        if new and self.kind in ("cosine_relu", "cosine", "euclidean"):
            X = np.array([self.embed(p) for p in new], float)
            n = np.linalg.norm(X, axis=1, keepdims=True)
            self.known.update(zip(new, np.divide(X, n, out=np.zeros_like(X), where=n > 0)))

    def __call__(self, a: list[str], b: list[str]) -> np.ndarray:
        if self.kind == "exact":
            return np.array([[float(x == y) for y in b] for x in a])
        if self.kind in TEXT_KINDS:
            score = METRICS[self.kind][0]
            return np.array([[score([x], [y], None) for y in b] for x in a])
        self.learn([*a, *b])
        cos = np.array([self.known[x] for x in a]) @ np.array([self.known[y] for y in b]).T
        return self.of_cosines(cos.ravel()).reshape(cos.shape)

    def of_cosines(self, cos: np.ndarray) -> np.ndarray:
        if self.kind == "cosine":
            return cos
        if self.kind == "euclidean":
            return 1 - np.sqrt(np.maximum(0, 2 - 2 * cos)) / 2
        return rescaled_cosine(cos)

    def forget(self) -> None:
        """Vectors are kept from rows to rows until there are many."""
        if len(self.known) > KEPT:
            self.known.clear()

    def tables(self, rows: list[list[str]], most: int = 1 << 16):
        """For each row's phrases a function like this one; the pairs of many rows (about `most` pairs) are worked out at once."""
        if self.kind not in ("cosine_relu", "cosine", "euclidean"):
            yield from (self for _ in rows)
            return
        self.learn(x for row in rows for x in row)
        held, size = [], 0
        for row in rows:
            names = list(dict.fromkeys(row))
            V = np.array([self.known[x] for x in names]) if names else np.zeros((0, 1))
            held.append((names, (V @ V.T).ravel()))
            size += len(names) ** 2
            if size >= most:
                yield from self._tables(held)
                held, size = [], 0
        yield from self._tables(held)

    def _tables(self, held: list[tuple[list[str], np.ndarray]]):
        if held:
            ends = np.cumsum([len(cos) for _, cos in held])[:-1]
            values = np.split(self.of_cosines(np.concatenate([cos for _, cos in held])), ends)
            yield from (Table(names, x.reshape(len(names), len(names)), self) for (names, _), x in zip(held, values))


class Table:
    """Similarities of the phrases of one row; of others, those that `beyond` has."""

    def __init__(self, names: list[str], values: np.ndarray, beyond: Phrases):
        self.place, self.values, self.beyond = {x: i for i, x in enumerate(names)}, values, beyond

    def __call__(self, a: list[str], b: list[str]) -> np.ndarray:
        rows, columns = ([self.place.get(x, -1) for x in side] for side in (a, b))
        if -1 in rows or -1 in columns:
            return self.beyond(a, b)
        return self.values[np.ix_(rows, columns)]


class ClassTable:
    """Similarities from a table of named classes by unordered pair; pairs not in it count 0."""

    def __init__(self, classes: dict[tuple[str, str], str], kind: str):
        values = CLASS_VALUES[kind]
        self.value = {tuple(sorted(pair)): values.get(name.strip().lower(), 0.0) for pair, name in classes.items()}

    def learn(self, phrases) -> None:
        pass

    def __call__(self, a: list[str], b: list[str]) -> np.ndarray:
        return np.array([[self.value.get(tuple(sorted((x, y))), 0.0) for y in b] for x in a])


_lemma: list = [lambda word: word]


def set_lemmatizer(function) -> None:
    """The function from a lower-case word to its lemma that lemmatised metrics use (as it is without one); a vocabulary
    of lemmas is the user's to bring."""
    _lemma[0] = function


def modified(phrase: str, how: str | None) -> str:
    """A lower-case phrase with its words as they are, stemmed, or lemmatised."""
    word = {None: None, "stem": porter_stem, "lemmatize": _lemma[0]}[how]
    return phrase if word is None else " ".join(map(word, phrase.split()))


def clean(phrases, how: str | None = None) -> list[str]:
    """Lower-case, white space collapsed, words modified, each once, sorted."""
    out = {" ".join(p.lower().split()) for p in (phrases if phrases is not None else []) if p is not None}
    return sorted({modified(p, how) for p in out})


def listed(phrases) -> list[str]:
    """Lower-case, white space collapsed; repeated phrases stay, as counts of classes count each."""
    return [" ".join(p.lower().split()) for p in (phrases if phrases is not None else []) if p is not None]


def _edge(mine: list, other: list) -> float | None:
    """Of an empty side: 1 if both are empty, else 0; None if neither is."""
    if not mine or not other:
        return float(not mine and not other)
    return None


def precision(pred: list[str], ref: list[str], sim: Phrases, agg: str = "mean") -> float:
    edge = _edge(pred, ref)
    if edge is not None:
        return edge
    best = sim(pred, ref).max(1)
    return float(best.mean() if agg == "mean" else best.min())


def recall(pred: list[str], ref: list[str], sim: Phrases, agg: str = "mean") -> float:
    return precision(ref, pred, sim, agg)


def harmonic(p: float, r: float) -> float:
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def f1(pred, ref, sim, agg="mean") -> float:
    return harmonic(precision(pred, ref, sim, agg), recall(pred, ref, sim, agg))


def weighted_precision(pred: list[str], ref: list[str], sim: Phrases) -> float:
    """Best similarities weighted by how unlike its own side a phrase is; nan if all are alike."""
    edge = _edge(pred, ref)
    if edge is not None:
        return edge
    weights = 1 - sim(pred, pred).mean(1) if len(pred) > 1 else np.ones(1)
    total = weights.sum()
    return float((weights * sim(pred, ref).max(1)).sum() / total) if total else math.nan


def weighted_recall(pred, ref, sim) -> float:
    return weighted_precision(ref, pred, sim)


def weighted_f1(pred, ref, sim) -> float:
    return harmonic(weighted_precision(pred, ref, sim), weighted_recall(pred, ref, sim))


_SYMBOLS = re.compile("[0-9A-Za-z+&]+")


def symbols(phrases: list[str]) -> list[str]:
    """Phrases with nothing but ASCII letters, digits, + and &, each once, sorted."""
    return sorted({" ".join(_SYMBOLS.findall(p)) for p in phrases})


def word_mover(pred: list[str], ref: list[str], sim: Phrases) -> float:
    """exp(-cost) of moving one side's mass to the other's; a phrase's mass grows with its distance to its side's others."""
    a, b = symbols(pred), symbols(ref)
    edge = _edge(a, b)
    if edge is not None:
        return edge
    far = lambda x, y: np.where(np.array([[p == q for q in y] for p in x]), 0.0, np.maximum(0, -np.log(np.maximum(1e-6, sim(x, y)))))

    def mass(x: list[str]) -> np.ndarray:
        d = far(x, x).sum(1)
        return d / d.sum() if len(x) > 1 and d.sum() > 0 else np.full(len(x), 1 / len(x))

    return math.exp(-transport_cost(mass(a), mass(b), far(a, b)))


def threshold_counts(pred, ref, sim, threshold: float = THRESHOLD) -> dict[str, float]:
    """tp: references met; fn: references not met; fp: predictions that meet none; tn: both are empty.

    A reference that repeats counts once, a prediction as often as it stands there."""
    ref = list(dict.fromkeys(ref))
    if not pred or not ref:
        return {"tp": 0.0, "fp": float(len(pred)), "tn": float(not pred and not ref), "fn": float(len(ref))}
    near = sim(pred, ref) >= threshold
    met = float(near.any(0).sum())
    return {"tp": met, "fp": float((~near.any(1)).sum()), "tn": 0.0, "fn": len(ref) - met}


def negative_class_counts(pred, ref, sim, threshold: float = THRESHOLD) -> dict[str, float]:
    """As threshold_counts, with "no usage" a class of its own."""
    if not ref:
        return {"tp": float(not pred), "fp": float(len(pred)), "tn": math.inf, "fn": float(bool(pred))}
    return threshold_counts(pred, ref, sim, threshold) | {"tn": math.inf}


def soft_counts(pred, ref, sim) -> dict[str, float]:
    """Counts as sums of best similarities; an empty side stands as one phrase like nothing but another empty side.
    Phrases that repeat count once."""
    pred, ref = list(dict.fromkeys(pred)), list(dict.fromkeys(ref))
    if not pred or not ref:
        both = not pred and not ref
        return {"tp": float(both), "fp": 0.0 if both else float(max(1, len(pred))), "tn": math.inf, "fn": 0.0 if both else float(max(1, len(ref)))}
    s = sim(pred, ref)
    hit = float(s.max(0).sum())
    return {"tp": hit, "fp": float((1 - s.max(1)).sum()), "tn": math.inf, "fn": len(ref) - hit}


# -- n-gram metrics: one joined prediction against one joined reference -----------------------


#: Texts whose words and n-grams are kept: a row's metrics ask for the same ones in turn.
@lru_cache(maxsize=64)
def _words(text: str) -> tuple[str, ...]:
    return tuple(text.lower().split())


@lru_cache(maxsize=64)
def _words_and_marks(text: str) -> tuple[str, ...]:
    return tuple(words_and_marks(text.lower()))


@lru_cache(maxsize=512)
def _grams(tokens: tuple[str, ...], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n))))


@lru_cache(maxsize=64)
def _hits(tokens: tuple[str, ...], refs: tuple[tuple[str, ...], ...], n: int) -> int:
    """How many n-grams of the tokens the references have, none more often than one of these has it."""
    most = _grams(refs[0], n)
    for r in refs[1:]:
        most = most | _grams(r, n)
    # Only n-grams that a reference has are counted: those of a long text are many.
    own = Counter(filter(most.__contains__, zip(*(tokens[i:] for i in range(n)))))
    return sum(min(k, most[g]) for g, k in own.items())


def words_and_marks(text: str) -> list[str]:
    """Tokens by the rules that BLEU scores are published with: marks stand alone, but for dots and commas within
    numbers, and dashes only behind a digit."""
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", f" {text} ")
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def bleu(pred: list[str], refs: list[str], smooth: bool = False) -> float:
    """Corpus BLEU of each prediction against all references, up to 4-grams, over lower-case words; smooth: halves for
    empty matches, over words and marks."""
    tokens = _words_and_marks if smooth else _words
    pairs, refs_t = [tokens(p) for p in pred], tuple(tokens(r) for r in refs)
    if not pairs or not refs_t:
        return float(not pairs and not refs_t)
    logs, size, closest, halves = 0.0, 0, 0, 1.0
    for p in pairs:
        size += len(p)
        closest += min((abs(len(r) - len(p)), len(r)) for r in refs_t)[1]
    for n in range(1, 5):
        hit = total = 0
        for p in pairs:
            hit += _hits(p, refs_t, n)
            total += max(0, len(p) - n + 1)
        if not hit:
            if not smooth or not total:
                return 0.0
            halves *= 2
            logs += math.log(1 / (halves * total)) / 4
        else:
            logs += math.log(hit / total) / 4
    return (1.0 if size > closest else math.exp(1 - closest / size) if size else 0.0) * math.exp(logs)


def rouge_n(pred: list[str], refs: list[str], n: int) -> float:
    """Mean over predictions of the best F-measure against a reference."""
    if not pred or not refs:
        return float(not pred and not refs)

    def one(a: str, b: str) -> float:
        x, y = _words(a), _words(b)
        hit = _hits(x, (y,), n)
        return harmonic(hit / (len(x) - n + 1), hit / (len(y) - n + 1)) if hit else 0.0

    return float(np.mean([max(one(p, r) for r in refs) for p in pred]))


def rouge_l(pred: list[str], refs: list[str]) -> float:
    if not pred or not refs:
        return float(not pred and not refs)

    def longest(a: list[str], b: list[str]) -> int:
        # A row of the table as bits of one number: a zero is a place where it steps up.
        places: dict[str, int] = {}
        for j, y in enumerate(b):
            places[y] = places.get(y, 0) | 1 << j
        whole = (1 << len(b)) - 1
        row = whole
        for x in a:
            if x in places:
                met = row & places[x]
                row = ((row + met) | (row - met)) & whole
        return len(b) - row.bit_count()

    def one(p: str, r: str) -> float:
        a, b = p.lower().split(), r.lower().split()
        n = longest(a, b)
        return harmonic(n / len(a), n / len(b)) if n else 0.0

    return float(np.mean([max(one(p, r) for r in refs) for p in pred]))


def _common_places(a: list[str], b: list[str]) -> set[int]:
    """Places in a of one longest common subsequence with b."""
    n, m = len(a), len(b)
    if not set(a) & set(b):
        return set()
    # The table's rows as bits of one number each, as rouge_l has them: a zero is a place where the length steps up.
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    whole = (1 << m) - 1
    table = [whole]
    for x in a:
        row = table[-1]
        met = row & places.get(x, 0)
        table.append((row + met | row - met) & whole)
    length = lambda i, j: j - (table[i] & (1 << j) - 1).bit_count()
    out, i, j = set(), n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return out


def rouge_lsum(pred: list[str], refs: list[str]) -> float:
    """Longest common subsequences by line: for each line of the reference the words that any line of the prediction shares
    with it, none counted more often than both texts hold it. One line a side is rougeL."""
    if not pred or not refs:
        return float(not pred and not refs)
    lines = lambda text: [x for x in (line.lower().split() for line in text.split("\n")) if x]

    def one(p: str, r: str) -> float:
        a, b = lines(p), lines(r)
        if len(a) < 2 and len(b) < 2:
            return rouge_l([p], [r])
        own, other, hit = Counter(w for x in a for w in x), Counter(w for x in b for w in x), 0
        n, m = own.total(), other.total()
        for line in b:
            for k in sorted(set().union(*(_common_places(line, x) for x in a))):
                w = line[k]
                if own[w] > 0 and other[w] > 0:
                    own[w], other[w], hit = own[w] - 1, other[w] - 1, hit + 1
        return harmonic(hit / n, hit / m) if hit else 0.0

    return float(np.mean([max(one(p, r) for r in refs) for p in pred]))


#: Names of metrics: (function of predictions, references and a similarity; how words are modified).
METRICS = {
    "custom_min_precision": (lambda p, r, s: precision(p, r, s, "min"), None),
    "custom_mean_precision": (precision, None),
    "custom_min_recall": (lambda p, r, s: recall(p, r, s, "min"), None),
    "custom_mean_recall": (recall, None),
    "custom_min_f1": (lambda p, r, s: f1(p, r, s, "min"), None),
    "custom_mean_f1": (f1, None),
    "custom_weighted_mean_precision": (weighted_precision, None),
    "custom_weighted_mean_recall": (weighted_recall, None),
    "custom_weighted_mean_f1": (weighted_f1, None),
    "custom_weighted_mean_f1_stem": (weighted_f1, "stem"),
    "custom_weighted_mean_f1_lemmatize": (weighted_f1, "lemmatize"),
    "word_movers_similarity": (word_mover, None),
    "bleu": (lambda p, r, s: bleu(p, r), None),
    "sacrebleu": (lambda p, r, s: bleu(p, r, True), None),
    "rouge1": (lambda p, r, s: rouge_n(p, r, 1), None),
    "rouge2": (lambda p, r, s: rouge_n(p, r, 2), None),
    "rougeL": (lambda p, r, s: rouge_l(p, r), None),
    "rougeLsum": (lambda p, r, s: rouge_lsum(p, r), None),
}
#: Metrics of line-wise texts keep line feeds.
_LINEWISE = ("rougeLsum",)
COUNTS = {
    "custom_classification_score": threshold_counts,
    "custom_classification_score_with_negative_class": negative_class_counts,
    "custom_similarity_classification_score_with_negative_class": soft_counts,
}
DEFAULT_METRICS = ("custom_weighted_mean_f1", "word_movers_similarity")


def register_metric(name: str, function, how: str | None = None) -> None:
    """function(predictions, references, similarity) -> float, on cleaned lists."""
    METRICS[name] = (function, how)


def register_class_metric(name: str, classes: dict[tuple[str, str], str], kind: str) -> None:
    """The weighted F1 over similarities of named classes (named_v1 or scale_v1), as a client told them for pairs of phrases."""
    table = ClassTable(classes, kind)
    METRICS[name] = (lambda p, r, _: weighted_f1(p, r, table), None)


def metrics(names, predictions: Column, references: Column, embed=hashed_ngrams, kind: str = "cosine_relu") -> Column:
    """struct of one double a metric, all in one pass over the rows; a division by zero is nan, a null list is empty."""
    names = list(names)
    scored = _scorer(names, embed, kind)

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def score(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(scored(zip(p, r)), columns=names, dtype="float64")

    return score(predictions, references)


def metrics_of_many(names, predictions: Column, references: Column, wanted: Column, embed=hashed_ngrams, kind: str = "cosine_relu") -> Column:
    """The same for rows of many pairs: arrays of predictions, of references and of the metrics wanted of each pair. An array of doubles
    a pair, one a metric, null where it is not wanted or cannot be had."""
    names = list(names)
    scored = _scorer(names, embed, kind)

    @F.pandas_udf("array<array<double>>")
    def score(p: pd.Series, r: pd.Series, w: pd.Series) -> pd.Series:
        several = lambda s: [[] if x is None else list(x) for x in s]
        p, r, w = several(p), several(r), several(w)
        made = scored(((a, b) for x, y in zip(p, r) for a, b in zip(x, y)), (set(x) for row in w for x in row))
        return pd.Series([[[None if v is None or math.isnan(v) else v for v in next(made)] for _ in row] for row in p])

    # So called, it is asked once a row where it stands; the planner would else move it into functions of the scores, or repeat it.
    return score.asNondeterministic()(predictions, references, wanted)


def _scorer(names: list[str], embed, kind: str):
    """A function from pairs of lists to an iterator of their metrics, in the order of the names; `wanted` has the names wanted of each
    pair, the others are None. A few pairs are worked on at a time, however many there are."""
    for name in names:
        if name not in METRICS:
            raise ValueError(f"no metric is called {name}")
    known = {name: METRICS[name] for name in names}
    ways = {how for _, how in known.values()}
    # Metrics of words alone ask for no similarities, and texts have no vectors made for them; one that does ask gets them then.
    alike = {how for name, (_, how) in known.items() if name not in TEXT_KINDS}
    linewise = {name: name in _LINEWISE for name in names}
    movers = any(function is word_mover for function, _ in known.values())

    def scored(pairs, wanted=None):
        sim = Phrases(embed, kind)
        pairs = iter(pairs)
        while some := list(islice(pairs, ROWS)):
            sides = [{how: (clean(a, how), clean(b, how)) for how in ways} for a, b in some]
            phrases = [[x for how in alike for side in row[how] for x in side] for row in sides]
            if movers:
                phrases = [[*row, *symbols(row)] for row in phrases]
            for pair, row, similar in zip(some, sides, sim.tables(phrases)):
                asked = known if wanted is None else next(wanted)
                yield [
                    _of(function, *(pair if linewise[name] else row[how]), similar) if name in asked else None for name, (function, how) in known.items()
                ]
            sim.forget()

    return scored


def _of(function, a, b, sim) -> float:
    try:
        return function([x for x in a if x is not None] if a is not None else [], [x for x in b if x is not None] if b is not None else [], sim)
    except ZeroDivisionError:
        return math.nan


def metric(name: str, predictions: Column, references: Column, embed=hashed_ngrams, kind: str = "cosine_relu") -> Column:
    """One metric as a column of doubles."""
    return metrics([name], predictions, references, embed, kind)[name]


def counts(name: str, predictions: Column, references: Column, embed=hashed_ngrams, kind: str = "cosine_relu") -> Column:
    """struct<tp, fp, tn, fn> of doubles."""
    function = COUNTS[name]

    @F.pandas_udf("tp double, fp double, tn double, fn double")
    def score(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        sim = Phrases(embed, kind)
        pairs, out = zip(p, r), []
        while rows := [(listed(a), listed(b)) for a, b in islice(pairs, ROWS)]:
            out += [function(a, b, s) for (a, b), s in zip(rows, sim.tables([[*a, *b] for a, b in rows]))]
            sim.forget()
        return pd.DataFrame(out, columns=["tp", "fp", "tn", "fn"])

    return score(predictions, references)
