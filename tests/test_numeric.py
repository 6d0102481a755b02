import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.functions import metrics as M
from quillstone.functions import numeric as N


@pytest.mark.parametrize("x, y", [(0.25, 2.639e-7), (0.5, 0.0128154), (0.75, 0.6293052), (0.9, 0.9911074), (-1, 0), (1, 1)])
def test_rescaled_cosine(x, y):
    """Values by midpoint integration."""
    assert float(N.rescaled_cosine([x])[0]) == pytest.approx(y, abs=2e-6)


def test_beta_of_known_shapes():
    x = np.linspace(0, 1, 11)
    assert np.allclose(N.beta_cdf(x, 1, 1), x)
    assert np.allclose(N.beta_cdf(x, 2, 1), x**2)
    assert np.allclose(N.beta_cdf(x, 1, 3), 1 - (1 - x) ** 3)


def test_t_tail():
    assert N.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert N.t_tail(0.0, 5, "greater") == pytest.approx(0.5)
    assert N.t_tail(1.0, 1, "less") == pytest.approx(0.75)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(0, 10**6))
def test_transport_is_least(n, seed):
    """With equal masses on both sides the best plan is a matching."""
    rng = np.random.default_rng(seed)
    cost = rng.random((n, n))
    best = min(sum(cost[i, p[i]] for i in range(n)) / n for p in itertools.permutations(range(n)))
    assert N.transport_cost(np.full(n, 1 / n), np.full(n, 1 / n), cost) == pytest.approx(best, abs=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_transport_of_two_by_many(seed):
    """Two sources: the plan fills the first by rising difference of costs."""
    rng = np.random.default_rng(seed)
    m = 5
    demand = rng.random(m) + 0.01
    demand /= demand.sum()
    share = rng.uniform(0.05, 0.95)
    cost = rng.random((2, m))
    left, total = share, 0.0
    for j in np.argsort(cost[0] - cost[1]):
        take = min(left, demand[j])
        total += take * cost[0, j] + (demand[j] - take) * cost[1, j]
        left -= take
    assert N.transport_cost([share, 1 - share], demand, cost) == pytest.approx(total, abs=1e-9)


def test_break_even():
    first = N.break_even(100.0, 2.0, 5.0)
    assert first == 34 and 100 + 2 * first < 5 * first and not 100 + 2 * (first - 1) < 5 * (first - 1)
    assert N.break_even(1, 2, 2) is None


def test_costs():
    assert N.prompt_cost(25) == pytest.approx(120 * 0.02 / 1000)
    assert N.energy_kwh([100, 300], 1800) == pytest.approx(0.1)
    assert N.energy_kwh([], 5) == 0


SIM = M.Phrases()
PHRASES = st.lists(st.sampled_from(["sleeping", "going crazy", "cooking", "hiking trips", "camping"]), max_size=4).map(M.clean)


def test_empty_sides():
    for name in ("custom_mean_precision", "custom_mean_recall", "custom_weighted_mean_f1", "word_movers_similarity", "bleu", "rouge1", "rougeL"):
        f = M.METRICS[name][0]
        assert f([], [], SIM) == 1 and f(["a"], [], SIM) == 0 and f([], ["a"], SIM) == 0


@settings(max_examples=40, deadline=None)
@given(PHRASES, PHRASES)
def test_f1_is_symmetric(a, b):
    assert M.f1(a, b, SIM) == pytest.approx(M.f1(b, a, SIM))
    assert M.precision(a, b, SIM) == pytest.approx(M.recall(b, a, SIM))
    assert 0 <= M.word_mover(a, b, SIM) <= 1 + 1e-9


@settings(max_examples=40, deadline=None)
@given(PHRASES)
def test_equal_lists_score_one(a):
    assert M.f1(a, a, SIM) == pytest.approx(1)
    assert M.word_mover(a, a, SIM) == pytest.approx(1)
    assert M.rouge_n(a, a, 1) == pytest.approx(1)


def test_counts():
    one = M.threshold_counts(["a b c", "zzz qqq"], ["a b c", "other thing"], SIM)
    assert one == {"tp": 1.0, "fp": 1.0, "tn": 0.0, "fn": 1.0}
    assert M.threshold_counts([], [], SIM)["tn"] == 1
    assert M.negative_class_counts([], [], SIM) == {"tp": 1.0, "fp": 0.0, "tn": math.inf, "fn": 0.0}
    assert M.negative_class_counts(["a"], [], SIM)["fp"] == 1


def test_bleu_and_rouge():
    ref = ["the cat sat on the mat"]
    assert M.bleu(ref, ref) == pytest.approx(1)
    assert M.bleu(["the cat"], ref) == 0
    assert 0 < M.bleu(["the cat sat on the"], ref) < 1
    assert M.rouge_n(["the cat"], ref, 1) == pytest.approx(2 * (2 / 2 * 2 / 6) / (2 / 2 + 2 / 6))
    assert M.rouge_l(["the mat"], ref) == pytest.approx(0.5)


def test_counts_of_repeated_phrases_and_empty_sides():
    """A prediction counts as often as it stands there, a reference once; no prediction is no false one."""
    same = M.Phrases(kind="exact")
    assert M.negative_class_counts([], ["a", "b"], same) == {"tp": 0.0, "fp": 0.0, "tn": math.inf, "fn": 2.0}
    assert M.threshold_counts(["x", "x", "a"], ["a", "a"], same) == {"tp": 1.0, "fp": 2.0, "tn": 0.0, "fn": 0.0}
    assert M.soft_counts([], ["a"], same) == {"tp": 0.0, "fp": 1.0, "tn": math.inf, "fn": 1.0}
    assert M.listed(["A  b", "a b", None]) == ["a b", "a b"] and M.clean(["A  b", "a b", None]) == ["a b"]


def test_comparators_of_texts_and_classes():
    for kind in M.TEXT_KINDS:
        s = M.Phrases(kind=kind)(["the cat sat on mats", "dog"], ["the cat sat on mats", "zebra"])
        assert s[0, 0] == pytest.approx(1) and s[1, 1] == 0
    M.register_class_metric("told", {("a", "b"): "very similar"}, "named_v1")
    assert M.METRICS["told"][0](["a"], ["b"], None) == pytest.approx(0.9) == M.METRICS["told"][0](["b"], ["a"], None)
    assert M.METRICS.pop("told")[0](["a"], ["c"], None) == 0
    with pytest.raises(ValueError):
        M.Phrases(kind="none")


def test_lemmatised_words():
    M.set_lemmatizer(lambda w: {"mice": "mouse"}.get(w, w))
    try:
        assert M.clean(["Catching mice", "catching mouse"], "lemmatize") == ["catching mouse"]
    finally:
        M.set_lemmatizer(lambda w: w)


def test_lines_and_marks():
    assert M.rouge_lsum(["a b\nc d"], ["c d\na b"]) == pytest.approx(1) and M.rouge_l(["a b\nc d"], ["c d\na b"]) == pytest.approx(0.5)
    assert M.rouge_lsum(["a b c"], ["a x c"]) == M.rouge_l(["a b c"], ["a x c"])
    assert M.words_and_marks("Hello, it's 3.5 or 1,000 (now)-then 2-3.") == [
        "Hello",
        ",",
        "it's",
        "3.5",
        "or",
        "1,000",
        "(",
        "now",
        ")",
        "-then",
        "2",
        "-",
        "3",
        ".",
    ]


def test_words_of_long_texts_by_bits():
    """Places of common subsequences as the table of lengths gives them, and clipped n-grams as counted out."""
    from collections import Counter

    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = (list(map(str, rng.integers(0, 6, rng.integers(0, 30)))) for _ in range(2))
        rows = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                rows[i, j] = rows[i - 1, j - 1] + 1 if x == y else max(rows[i - 1, j], rows[i, j - 1])
        out, i, j = set(), len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                out.add(i - 1)
                i, j = i - 1, j - 1
            elif rows[i, j - 1] > rows[i - 1, j]:
                j -= 1
            else:
                i -= 1
        assert M._common_places(a, b) == out
        for n in (1, 2, 4):
            grams = lambda x: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
            assert M._hits(tuple(a), (tuple(b), tuple(a[:3])), n) == sum((grams(a) & (grams(b) | grams(a[:3]))).values())
    M._words("of ref")
    assert M.rouge_n(["Of REF x"], ["of ref"], 1) == pytest.approx(0.8) and M._words.cache_info().hits > 0


def test_metrics_of_words_make_no_vectors():
    def embed(phrase):
        raise AssertionError(phrase)

    assert list(M._scorer(["bleu", "rouge1"], embed, "cosine_relu")([(["a b c d e"], ["a b c d e"])])) == [[1.0, 1.0]]
    rows = [([f"phrase {i}", f"other {i}"], [f"phrase {i}"]) for i in range(600)]
    made = list(M._scorer(["custom_mean_recall", "custom_mean_precision"], M.hashed_ngrams, "exact")(iter(rows)))
    assert made == [[1.0, 0.5]] * 600
