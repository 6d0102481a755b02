"""Links across cells, and near copies of the pipeline, through registered queries and stages."""

import re

import numpy as np
import pytest

llm = pytest.importorskip("quillstone.llm._queries")
from quillstone.llm import decontaminate, secrets  # noqa: E402

LOW = {c: c + 32 for c in range(65, 91)}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, **rows):
    """Parquet tables of (schema, rows)."""
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_links_across_cells(spark, tmp_path):
    """Vectors on an arc, in two cells: links lie along the line between the centres. Four have a length of their own."""
    angles = np.linspace(0, np.pi / 2, 4200)
    X = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(X)]
    rows += [(5000 + k, v, 1) for k, v in enumerate([[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.1]])]
    expected = dict(enumerate(((X @ X.T >= 0.93).sum(1) - 1).tolist())) | {5000: 2, 5001: 2, 5002: 0, 5003: 2}
    sf = tables(spark, tmp_path, embeddings=("vec_id long, embedding array<double>, label int", rows))
    got = {r.vec_id: r for r in llm.op6_embedding_near_dedup(spark, sf).collect()}
    assert {i: r.n_links for i, r in got.items()} == expected
    assert {i: r.component_id for i, r in got.items()} == {i: 0 for i in range(4200)} | {5000: 5000, 5001: 5000, 5002: 5002, 5003: 5000}


def test_near_copies_of_the_pipeline(spark):
    """Five words and 0.8: four scattered words of 200, a run of 15, and 20 % more text go; twelve scattered words stay."""
    import corpus_pipeline as pipeline

    base = [f"w{i}" for i in range(200)]
    scattered = lambda n: [f"x{i}" if i % (200 // n) == 7 else w for i, w in enumerate(base)]
    texts = [
        base,
        scattered(4),
        base[:60] + [f"y{i}" for i in range(15)] + base[75:],
        base + [f"z{i}" for i in range(40)],
        scattered(12),
        [f"v{i}" for i in range(200)],
    ]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], DOCUMENTS)
    stage = dict(pipeline.STAGES)["jaccard_join"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [0, 4, 5]


def plain_leaks(text, items):
    """Whether some item's words, laid over the text's at some offset, reach the score: tried at every offset where enough words match."""
    words = lambda t: np.array(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOW)))
    t = words(text)
    for item in map(words, items):
        if len(item) < 5 or not len(t):
            continue
        met, need = np.zeros(len(t) + len(item), int), min(8, 0.6 * len(item))
        for j, w in enumerate(item):
            met[len(item) - j : len(item) - j + len(t)] += t == w
        for shift in np.flatnonzero(met >= need) - len(item):
            lo, hi = max(0, -shift), min(len(item), len(t) - shift)
            if decontaminate.best_stretch(item[lo:hi] == t[lo + shift : hi + shift])[0] >= need:
                return True
    return False


def test_all_stages_row_for_row(spark, tmp_path):
    """What is kept, and its pieces, by brute force; ids that repeat with other texts are rows of their own."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = sorted((r for r in rows if r[1] and len(r[1].split()) > 60), key=lambda r: r[0])
    halves = [" ".join(r[1].split()[::2]) for r in long[:2]]
    rows += [(long[5][0], halves[0], "en", "s", 1), (long[6][0], halves[1], "en", "s", 1), (10**6, long[7][1], "en", "s", 1), (10**6, halves[0] + " and more", "en", "s", 1)]
    sf2 = tables(spark, tmp_path, documents=(DOCUMENTS, rows))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Language ID keeps all that has a letter, as every letter here is of a known language.
    spoken = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    sets = []
    for r in spoken:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1].translate(LOW))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]))
    least = list(range(len(spoken)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                least[root(b)] = root(a)
    smallest = {}
    for k, r in enumerate(spoken):
        smallest[root(k)] = min(smallest.get(root(k), r[0]), r[0])
    one = [r for k, r in enumerate(spoken) if r[0] == smallest[root(k)]]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    clean = [r for r in one if not plain_leaks(r[1], items)]
    assert len(spoken) > len(one) > len(clean) > 50
    found = secrets.find_secrets(spark.createDataFrame(clean, DOCUMENTS)).select("doc_id", "spans", "base_sha256").collect()
    spans = {r.doc_id: [] if not r.spans else [x.split(":") for x in r.spans.split(",")] for r in found}
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = []
    for r in clean:
        text, last = "", 0
        own = sorted({(int(a), int(b)) for _, a, b in spans[r[0]]}) if sum(x[0] == r[0] for x in clean) == 1 else None
        assert own is not None or not any(spans[r[0]])  # rows that share an id hold no secret here
        for a, b in own or []:
            if b > last:
                text += (r[1][last:a] + "[SECRET]") if a >= last else ""
                last = b
        expected.append((r[0], m.encode(text + r[1][last:])))
    got = [(r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, sf2).collect()]
    assert sorted(got) == sorted(expected)
