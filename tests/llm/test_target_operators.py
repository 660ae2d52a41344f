"""Resampling, decontamination and clustering on small odd tables, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epipanel.llm import clustering, decontaminate, fm_index, resampling

from odd import base_rows, documents

LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def items_table(spark, rows):
    """Test items with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "item_id long, text string").repartition(2)
    return df.select("*", *[F.lit("x").alias(c) for c in ("item", "phrase", "pid", "w", "i", "bucket", "n", "id")])


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


# ----------------------------------------------------------------- 11 resampling

def resampled(rows, targets, percent, longest, least, buckets, seed):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    raw, wanted = Counter(), Counter()
    for _, t, *_ in rows:
        raw.update(features(t))
    for t in targets:
        wanted.update(features(t))
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, t, *_ in rows:
        f = features(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(words(t)) >= least and i is not None])
    taking = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], r[1]))
    for rank, r in enumerate(taking[: percent * len(taking) // 100], 1):
        r[4] = rank
    return sorted([tuple(r[:5]) for r in out], key=str)


@pytest.mark.parametrize("longest,percent,pivots", [(1, 10, 16), (2, 50, 1), (3, 100, 3)])
def test_resampling(spark, longest, percent, pivots):
    rng = np.random.default_rng(longest)
    pool = [f"W{i}é" if i % 9 == 0 else f"w{i}" for i in range(120)]
    rows = base_rows() + [(1000 + i, " ".join(rng.choice(pool, int(rng.integers(0, 60)))), "en", "s", 0) for i in range(400)]
    rows += [(5000, " ".join(pool[:40]), "en", "s", 0)] * 60 + [(5000, " ".join(pool[:30]), "en", "s", 0)] * 3      # one id, many rows
    targets = [" ".join(pool[:50]), None, "", " ".join(pool[20:30])]
    got = resampling.resample(
        documents(spark, rows), items_table(spark, list(enumerate(targets))), longest=longest, percent=percent, least_words=10, buckets=997, seed="a", pivots=pivots
    )
    assert sorted([tuple(r) for r in got.collect()], key=str) == resampled(rows, targets, percent, longest, 10, 997, "a")


def test_resampling_of_few_rows(spark, docs):
    none, target = documents(spark, []), items_table(spark, [(1, "alpha beta gamma")])
    assert resampling.resample(none, target).count() == 0
    got = resampling.resample(docs, target.where("false"), percent=0).collect()
    assert len(got) == docs.count() and not any(r.rank for r in got)
    drawn = resampling.draw(docs, target, percent=60, least_words=1)
    assert drawn.columns == docs.columns
    want = {r.doc_id for r in resampling.resample(docs, target, percent=60, least_words=1).collect() if r.rank}
    assert {r.doc_id for r in drawn.collect()} == want and want


def test_kth_key(spark):
    rng = np.random.default_rng(0)
    keys = [(int(a), int(b), 0) for a, b in rng.integers(0, 12, (300, 2))] + [(5, 5, 0)] * 500
    rows = spark.createDataFrame(keys, resampling.KEY).cache()
    for k in (1, 2, 150, 400, 799, 800):
        assert resampling.kth_key(rows, k, pivots=3) == sorted(keys)[k - 1]


# -------------------------------------------------------------- 12 decontamination

def leaks(rows, items, window):
    """(id, n_words, n_hit, items, hit words) of each row, by comparing all places."""
    phrases = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                phrases.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text, *_ in rows:
        w, hit, names = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                p = tuple(w[i : i + n])
                if p in phrases:
                    hit |= set(range(i, i + n))
                    names |= phrases[p]
        out.append((str(doc), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def corpus(rng):
    pool = [f"t{i}" for i in range(30)]
    passage = [f"Ü{i}" if i % 5 == 0 else f"p{i}" for i in range(60)]
    items = [(1, " ".join(passage)), (2, " ".join(passage[5:25])), (2, "uno, DOS tres"), (10, " ".join(rng.choice(pool, 40))), (11, "solo"),
             (12, None), (13, ""), (14, " ... "), (None, "alpha beta gamma"), (15, " ".join(["ab"] * 14))]
    rows = base_rows()
    for i in range(120):
        text = [str(x) for x in rng.choice(pool + ["solo"] * (i % 7 == 0), int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 3))):
            at, a, b = int(rng.integers(0, len(text) + 1)), *sorted(rng.integers(0, 60, 2).tolist())
            text[at:at] = passage[a:b]
        if i % 10 == 0:
            text += ["UNO", "-", "dos!", "tres"]
        rows.append((2000 + i, " ".join(text).replace("p7 ", "P7;\n"), "en", "s", 0))
    return rows + rows[-3:], items


@pytest.mark.parametrize("window,options", [(10, {}), (4, {"shard_words": 50}), (10, {"most_phrases": 20}), (7, {"most_phrases": 9, "shard_words": 300})])
def test_leaks(spark, window, options):
    rows, items = corpus(np.random.default_rng(window))
    found = decontaminate.Leaks(documents(spark, rows), items_table(spark, items), window=window, **options)
    got = found.report().collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == leaks(rows, items, window)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(t or "")
    for r in got:
        assert [s for s in r.spans] == sorted(r.spans) and all(a.last < b.first for a, b in zip(r.spans, r.spans[1:]))
        assert sum(s.last - s.first for s in r.spans) == r.n_hit
        if len(texts[r.doc_id]) == 1:
            (text,) = texts[r.doc_id]
            assert all(words(text[s.start : s.end]) == words(text)[s.first : s.last] for s in r.spans)


def test_removal(spark, docs):
    rows = [(1, "keep one two THREE four! five six", "en", "s", 0), (2, None, "en", "s", 0), (3, "one two three four", "en", "s", 0),
            (4, "é😀 é one,two three four z one two three four é", "en", "s", 0), (4, "nothing here", "en", "s", 0), (None, "one two three four.", "en", "s", 0)]
    df = documents(spark, rows)
    cut = decontaminate.Leaks(df, items_table(spark, [(1, "One two three four")]), window=4).removed()
    assert cut.columns == df.columns
    told = {(r.doc_id, r.text) for r in cut.collect()}
    assert told == {(1, "keep ! five six"), (2, None), (3, ""), (4, "é😀 é  z  é"), (4, "nothing here"), (None, ".")}


def test_leaks_of_empty_tables(spark, docs):
    none, items = documents(spark, []), items_table(spark, [(1, "alpha beta gamma delta")])
    assert decontaminate.Leaks(none, items).report().count() == 0
    told = decontaminate.Leaks(docs, items.where("false"))
    assert not any(r.contaminated for r in told.report().collect()) and told.report().count() == docs.count()
    assert told.removed().count() == docs.count()


def test_long_texts_are_read_in_chunks(monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 7)
    for text in (b"", b"a", b"abcdefghijklmnopqrstuvwxyz", "é é ÉCOLE école ß 日本語 😀".encode(), b"one two, three four five " * 9):
        parts = list(decontaminate.chunks(text))
        assert b"".join(parts) == text and all(parts)
        if max(map(len, text.split(b" "))) < 7:
            assert [w for p in parts for w in decontaminate.WORD.findall(p.lower())] == decontaminate.WORD.findall(text.lower())


@pytest.mark.parametrize("alphabet", [2, 3, 40, 70_000])
def test_index_counts_and_finds(alphabet):
    rng = np.random.default_rng(alphabet)
    few = np.array([0, *rng.choice(np.arange(1, alphabet), min(5, alphabet - 1), replace=False)])
    text = np.append(rng.choice(few, 3_000, p=[0.02, *[0.98 / (len(few) - 1)] * (len(few) - 1)]), 0).astype(np.int64)
    text[1000:1100] = text[2000:2100]
    index = fm_index.FMIndex(text, alphabet)
    # The order of suffixes up to their ends, of two ends the earlier one first.
    ends = np.flatnonzero(text == 0)
    pieces = [(*text[i : (e := ends[np.searchsorted(ends, i)])].tolist(), 0, int(e)) for i in range(len(text))]
    order = fm_index.suffix_order(text, index.bits)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: pieces[i])
    phrases = [text[i : i + n] for i, n in zip(rng.integers(0, 2_900, 60), rng.integers(1, 30, 60))]
    phrases = [p for p in phrases if p.all()] + [np.array([few[1]] * 9)]
    width = max(map(len, phrases))
    rows = np.zeros((len(phrases), width), np.int64)
    for row, p in zip(rows, phrases):
        row[width - len(p) :] = p
    low, high = index.backward(rows, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


# ------------------------------------------------------------------- 13 clustering

def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in ("x", "cluster", "distance", "upper", "lower", "h", "inertia")])


def clustered(rows, k, rounds, d, seed):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and len(v) == d and None not in v and np.isfinite(v).all()]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(x) for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, x in kept:
            mine[nearest(x)[1]].append(x)
        centroids = [[sum(v) // len(m) for v in zip(*m)] if m else c for m, c in zip(mine, centroids)]
    told = [(i, *nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, far, j in told:
        inertia[j] += far
    return sorted(
        (i, j, far, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, far, j in told
    )


@pytest.mark.parametrize("k,rounds,scale", [(8, 10, 1.0), (3, 4, 60_000.0), (1, 2, 1.0), (5, 0, 0.01)])
def test_clustering(spark, k, rounds, scale):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 4)) * 3
    rows = [(i, ((centres[i % 6] + rng.normal(size=4)) * scale).clip(-100_000, 100_000).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)] + [(5, rows[9][1])] * 3          # a frequent vector, a repeated id
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [float("nan")] * 4), (2004, [1.0, None, 1.0, 1.0]),
             (2005, [float("-inf")] * 4), (None, [1.0] * 4), (2006, [0.0] * 4)]
    got = clustering.cluster(vectors(spark, rows), k, rounds, 4, "s")
    assert sorted(tuple(r) for r in got.collect()) == clustered(rows, k, rounds, 4, "s")


def test_clustering_of_few_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])]          # fewer than k, all equal
    assert sorted(tuple(r) for r in clustering.cluster(vectors(spark, rows), 8, 3, 2).collect()) == clustered(rows, 8, 3, 2, "3")
    assert clustering.cluster(vectors(spark, []), 8, 3, 2).count() == 0
    with pytest.raises(Exception, match="would not fit"):
        clustering.cluster(vectors(spark, [(1, [1e30, 0.0])]), 8, 3, 2).collect()


def test_drift_bounds_hold_and_are_tighter():
    rng = np.random.default_rng(1)
    spared = 0.0
    for _ in range(200):
        d = int(rng.integers(2, 6))
        old = rng.integers(-2000, 2000, (4, d))
        new = old + rng.integers(-300, 300, (4, d)) * rng.integers(0, 2, (4, 1))
        radius = rng.integers(0, 1500, 4).astype(float)
        fall = clustering.drift_bounds(old, new, radius)
        full = np.sqrt(((new - old) ** 2).sum(axis=1))
        for i in range(4):
            ways = rng.normal(size=(300, d))
            ways = ways / np.linalg.norm(ways, axis=1, keepdims=True) * radius[i] * rng.random((300, 1)) ** 0.2
            points = old[i] + ways
            others = [j for j in range(4) if j != i]
            worst = max((np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)).max() for j in others)
            assert worst <= fall[i] + 1e-6
            assert fall[i] <= full[others].max() * (1 + 1e-6)
            spared += full[others].max() - fall[i]
    assert spared > 0


def test_bounds_spare_comparisons():
    """Vectors of clusters that lie apart keep theirs unseen when all centroids move a little."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 5, (200, 3)) for c in (0, 400, 800)]).astype(int)
    centroids = np.array([[0, 0, 0], [400, 400, 400], [800, 800, 800]])
    moved = centroids + 3
    far = np.sqrt(clustering.squared(x, centroids).astype(float))
    own = far.argmin(axis=1)
    radius = np.array([far[own == j, j].max() for j in range(3)])
    fall = clustering.drift_bounds(centroids, moved, radius)
    lower = np.partition(far, 1, axis=1)[:, 1] - fall[own]
    upper = far.min(axis=1) + np.sqrt(27)
    assert (upper < lower).all()
