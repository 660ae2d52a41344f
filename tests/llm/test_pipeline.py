"""The corpus pipeline on odd tables, stage by stage against brute force, and the ordinal fit against plain sums."""

import hashlib
import math

import corpus_pipeline
import numpy as np
import pytest

from epipanel.llm import toxicity
from epipanel.llm.support import stage

from odd import base_rows, documents
from test_llm_operators import LOWER, jaccard_brute, library, near_copies

LABELS = "doc_id long, quality int, toxic int"


def rows_and_labels():
    rng = np.random.default_rng(11)
    pool = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    bad = ["vilest", "scummy", "rotten"]
    rows, labels = base_rows() + near_copies(rng, 12), []
    for i in range(10_000, 10_600):
        toxic = i % 8 == 0
        text = list(rng.choice(pool, 30)) + (list(rng.choice(bad, 4)) if toxic else [])
        rows.append((i, " ".join(rng.permutation(text)), "en", f"src{i % 5}", 0))
        if i < 10_400:
            labels.append((i, 1, int(toxic)))
    rows += [(20_000 + i, "One text\nthat many have" + "!" * (i % 2), "en", "src0", 0) for i in range(40)]
    return rows, labels + [(None, 1, 1), (10_001, None, None)]


def folder_of(spark, path, rows, labels):
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = rows_and_labels()
    folder = folder_of(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, folder))
        kept[name] = docs
        if name != "bpe":
            assert docs.columns == columns
        if name != "toxicity":
            continue
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {i for i, *_ in rows if i is not None and not (i in range(10_000, 10_600) and i % 8 == 0)} == left - {None}

    def pairs(name):
        return [(r.doc_id, r.text) for r in kept[name].select("doc_id", "text").collect()]

    # Exact copies: of equal texts the largest id, rows that repeat it once.
    groups = {}
    for i, t in pairs("toxicity"):
        groups.setdefault((t or "").translate(LOWER), []).append((-1 if i is None else i, t or ""))
    want = sorted(max(g)[0] for g in groups.values())
    assert sorted(-1 if i is None else i for i, _ in pairs("exact_dedup")) == want
    # Near copies: the smallest id of each component, all rows without one.
    found, _ = jaccard_brute([(i, t) for i, t in pairs("exact_dedup")], 5, 80)
    want = sorted(str(i) for i, _ in pairs("exact_dedup") if i is None or found[i] == i)
    assert sorted(str(i) for i, _ in pairs("ngram_jaccard_join")) == want and len(want) < len(found) - 40
    # Mixing moves rows and changes none.
    assert sorted(map(str, pairs("mixing"))) == sorted(map(str, pairs("ngram_jaccard_join")))
    encoder = library("byte_bpe_50k.json")
    want = []
    for i, t in pairs("mixing"):
        ids = encoder.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(encoder.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = kept["bpe"].collect()
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got) == sorted(want)
    # run() does the same.
    whole = corpus_pipeline.run(spark, folder).select("doc_id", "ids_sha256").collect()
    assert sorted(map(str, whole)) == sorted(str(r) for r in kept["bpe"].select("doc_id", "ids_sha256").collect())


def test_pipeline_of_no_rows(spark, tmp_path):
    empty = folder_of(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
    unlabelled = folder_of(spark, tmp_path / "unlabelled", base_rows(), [])
    kept = corpus_pipeline.run(spark, unlabelled)
    texts = {(t or "").translate(LOWER) for _, t, *_ in base_rows()}
    assert 0 < kept.count() <= len(texts)


# ------------------------------------------------- the ordinal model by plain sums

def chances(weights, cuts, features):
    score = sum(weights[i] for i in features)
    below = [0.0, *[1 / (1 + math.exp(-(c - score))) for c in cuts], 1.0]
    return [b - a for a, b in zip(below, below[1:])]


def penalised(weights, cuts, rows, grades, ridge):
    fit = sum(math.log(max(chances(weights, cuts, f)[g], 1e-300)) for f, g in zip(rows, grades)) / len(rows)
    return fit - ridge * sum(w * w for w in weights) / 2


def test_the_fit_has_the_greatest_likelihood():
    rng = np.random.default_rng(12)
    rows = [sorted(rng.choice(6, int(rng.integers(0, 4)), replace=False).tolist()) for _ in range(400)]
    true = np.array([0.0, 0.5, 1.0, 2.0, 2.5, 3.0])
    cuts = np.array([1.5, 3.5])
    grades = np.array([rng.choice(3, p=chances(true, cuts, f)) for f in rows])
    at = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
    columns = np.array([i for f in rows for i in f])
    ridge = 1e-3
    weights, fitted = toxicity.fit_ordinal(at, columns, grades, 6, ridge=ridge, steps=2_000, rate=0.05)
    best = penalised(weights, fitted, rows, grades, ridge)
    assert np.all(weights >= 0) and np.all(np.diff(fitted) > 0)
    assert best >= penalised(true, cuts, rows, grades, ridge)
    for _ in range(200):
        near = np.maximum(weights + rng.normal(size=6) * 0.1, 0), np.sort(fitted + rng.normal(size=2) * 0.1)
        assert penalised(*near, rows, grades, ridge) <= best + 1e-5
    # Each coordinate alone: the slope is zero, or points below a weight of zero.
    for i in range(8):
        for step in (-1e-3, 1e-3):
            w, c = weights.copy(), fitted.copy()
            (w if i < 6 else c)[i if i < 6 else i - 6] += step
            if (w >= 0).all():
                assert penalised(w, c, rows, grades, ridge) <= best + 5e-6


def test_scores_follow_from_the_model(spark):
    model = toxicity.OrdinalModel({"vile": {1: 0, 2: 1}, "^rott": {1: 2}}, np.array([1.5, 0.75, 2.0]), np.array([1.0, 2.5]))
    texts = ["clean words", "Vile", "vile VILE vile", "rotten", "rott", None, "vile rottenness vile"]
    features = [[], [0], [0, 1], [2], [], [], [0, 1, 2]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    for r in toxicity.score(documents(spark, rows), model).collect():
        chance = chances(model.weights, model.cuts, features[r.doc_id])
        assert r.expected_severity == pytest.approx(chance[1] + 2 * chance[2])
        assert r.p_toxic == pytest.approx(1 - chance[0]) and r.grade == int(np.argmax(chance))
        assert r.toxic == (1 - chance[0] >= toxicity.REJECT)


def test_no_feature_is_cut(spark):
    """Thousands of marks, each too frequent for chance, are all features."""
    marks = [f"mark{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(5_000)]
    rows = [(i, " ".join(marks) if i % 4 == 0 else "plain words only", "en", "s", 0) for i in range(80)]
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], LABELS))
    assert sum(w in model.words for w in marks) == len(marks)


