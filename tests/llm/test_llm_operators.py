"""Operators on small odd tables, against brute force."""

import collections
import hashlib
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epipanel.llm import ann, bpe, exact_dedup, line_dedup, mixing, ngram_join, secret_scan, token_counts, toxicity, warc
from epipanel.llm.queries import OTHER, TARGETS
from epipanel.llm.support import components

from odd import base_rows, documents

LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


# ---------------------------------------------------------------- 1 mixing

def test_schedule_keeps_every_deadline(spark):
    for parts in ([1], [3, 1], [10, 6, 6, 3, 5, 4], [1] * 7 + [93]):
        slots = [(r.share, r.occurrence) for r in mixing.period(spark, parts).orderBy("at").collect()]
        total = sum(parts)
        served = [0] * len(parts)
        for t, (share, occurrence) in enumerate(slots):
            assert occurrence == served[share]
            assert occurrence * total // parts[share] <= t < -(-(occurrence + 1) * total // parts[share])
            served[share] += 1
            assert all(abs(n - (t + 1) * p / total) < 1 for n, p in zip(served, parts))
        assert served == parts


def test_mixing_keeps_all_rows_and_follows_the_targets(spark, docs, none):
    rows = [(i, "t" * 40, "en", "a" if i % 3 else "b", 0) for i in range(3000)]
    mixed = mixing.mix(documents(spark, rows), {"a": 1, "b": 3}, block_size=100)
    got = mixed.orderBy("_slot", "_before").select("doc_id", "_name", "_slot", "_before").collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    blocks = collections.Counter()
    for r in got:
        if r._slot < 1300:        # both sources last that long
            blocks[r._name, r._slot] += 1
    a = len({s for n, s in blocks if n == "a"})
    assert abs(a - 1300 / 4) <= 1
    whole = mixing.mix(docs, {"src0": 2, "src1": 1}, other=1)
    assert whole.count() == docs.count() and mixing.in_order(whole).columns == docs.columns
    assert mixing.told(mixing.mix(none, {"src0": 1})).count() == 0
    with pytest.raises(Exception, match="no target for source"):
        mixing.mix(docs, {"src0": 1}).collect()


# ------------------------------------------------------------------- 2 ann

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("x")).withColumn("vec", F.lit(1))


def brute(rows, queries, k):
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in queries:
        if q in good:
            scores = [(-(v @ good[q]) / np.linalg.norm(v) / np.linalg.norm(good[q]), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
            out[q] = sorted(scores)[:k]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(600)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(300)]                       # a frequent vector
    rows += [(2000, None, 0), (2050, [0.0] * 8, 0), (2100, [float("nan")] * 8, 0), (2150, [1.0, None] * 4, 0), (None, rows[0][1], 0),
             (3000, rows[1][1], 0), (3000, rows[1][1], 0), (2200, [1.0], 0), (2250, [], 0)]
    got = collections.defaultdict(list)
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, leaf_sample=16, block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = {q: found for q, found in brute(rows, [i for i in range(0, 3001, 50)], 5).items() if found}
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        hits += len({i for _, i, _ in got[q]} & {i for _, i in best})
    assert hits >= 0.9 * 5 * len(want)
    q = 1000                                                                       # copies: all ties, smallest ids first
    assert [i for _, i, _ in got[q]] == [7, 1001, 1002, 1003, 1004]


@pytest.mark.parametrize("sample", [20_000, 150])
def test_vectors_of_several_lengths(spark, sample):
    """Each length among its own; with a small sample rare lengths have no trees."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), 0) for i in range(500)]
    rows += [(500 + i, rng.normal(size=3).astype(np.float32).tolist(), 0) for i in range(200)]
    rows += [(700, [1.0, 2.0], 0), (701, [2.0, 4.0], 0), (702, [4.0, 8.0], 0), (703, [2.0, 1.0], 0), (750, [5.0], 0), (800, [-1.0] * 9, 0)]
    got = collections.defaultdict(list)
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, sample=sample, leaf_sample=16, block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(rows, range(0, 801, 50), 5)
    assert set(got) == {q for q, found in want.items() if found} and 750 not in got and 800 not in got
    hits = sum(len({i for i, _ in got[q]} & {i for _, i in found}) for q, found in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [i for i, _ in got[700]] == [701, 702, 703] and got[700][0][1] == got[700][1][1]      # a power of two changes no digit
    scores = {(q, i): -s for q, found in want.items() for s, i in found}
    assert all(abs(s - scores[q, i]) < 1e-12 for q, found in got.items() for i, s in found if (q, i) in scores)


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 1]
    assert ann.nearest(vectors(spark, []), F.col("vec_id") == 0).count() == 0


# ----------------------------------------------------------------- 3 secrets

KEYS = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [("assign", m.start(), m.end()) for m in KEYS.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def test_secrets(spark, docs, none):
    texts = ["secret: token: abcdefgh", "😀 Password = 'abc123+/x' api_key:zz api-key=1234567", "AKIA" + "Z" * 15, "xAKIA" + "A1" * 8 + "b",
             "token=" + "0123456789abcdef" * 2, "f" * 23 + "g" + "e" * 24, "eyJabcdefgh.abcdefgh.abcdefghi", None, "", "APIKEY='" + "k" * 6]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(100, texts[0], "en", "s", 0)] * 2
    found, ledger = secret_scan.secret_scan(documents(spark, rows))
    got = collections.defaultdict(list)
    for r in secret_scan.report(found).collect():
        got[r.doc_id].append(r)
    assert len(got[100]) == 2
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        r = got[i][0]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
    assert "jwt:0:" in got[6][0].spans
    # Nothing is left to scan; a raised rule version makes every blob unseen for that rule alone.
    paths = documents(spark, rows).select("text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.sha2("text", 256))
    assert secret_scan.scan_blobs(paths, ledger).count() == 0
    raised = tuple(secret_scan.Rule(r.kind, r.found, r.group, r.least, r.version + (r.kind == "hex"), r.base) for r in secret_scan.RULES)
    again = secret_scan.scan_blobs(paths, ledger, raised)
    assert {r.kind for r in again.collect()} == {"hex"} and again.count() == paths.select("blob").distinct().count()
    later, _ = secret_scan.secret_scan(documents(spark, rows), ledger, rules=raised)
    assert {(r.doc_id, r.spans) for r in secret_scan.report(later).collect()} == {(r.doc_id, r.spans) for v in got.values() for r in v}
    assert secret_scan.report(secret_scan.secret_scan(docs)[0]).count() == docs.count()
    assert secret_scan.report(secret_scan.secret_scan(none)[0]).count() == 0


def test_a_stored_ledger_scans_in_increments(spark, docs, tmp_path):
    """History in two scans: the second one looks only at blobs and rules that the first did not see."""
    texts = ["password=abcdef12", "AKIA" + "Q" * 20, "f" * 30, "plain", None, "token: zzzzzz9"]
    first = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts[:4])])
    second = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts[::-1])] + [(0, "password=abcdef12", "en", "s", 0)] * 2)
    ledger = secret_scan.Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.read().count() == 0

    def told(found):
        return sorted(map(str, secret_scan.report(found).collect()))

    assert told(ledger.scan(first)) == told(secret_scan.secret_scan(first)[0])
    assert ledger.read().count() == 4 * len(secret_scan.RULES)
    assert told(ledger.scan(second)) == told(secret_scan.secret_scan(second)[0])
    assert ledger.read().count() == 6 * len(secret_scan.RULES)          # the two new blobs alone
    raised = tuple(secret_scan.Rule(r.kind, r.found, r.group, r.least, r.version + (r.kind == "access"), r.base) for r in secret_scan.RULES)
    assert told(ledger.scan(second, rules=raised)) == told(secret_scan.secret_scan(second, rules=raised)[0])
    assert ledger.read().count() == 6 * len(secret_scan.RULES) + 6      # every blob once more, by one rule
    ledger.read().where("kind = 'hex'").write.mode("append").parquet(ledger.path)      # a scan stored twice
    assert told(ledger.scan(second)) == told(secret_scan.secret_scan(second)[0])
    assert told(ledger.scan(docs)) == told(secret_scan.secret_scan(docs)[0])


# ------------------------------------------------------------ 4 and 5 tokens

def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_equals_the_library(docs, none):
    path, t = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    got = sorted((r.decoded, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in bpe.encode_texts(docs, path, keep_ids=True).collect())
    want = []
    for _, text, *_ in base_rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        back = t.decode(ids, skip_special_tokens=False)
        want.append((back, len(ids), hashlib.sha256(packed).hexdigest(), sha(back), packed))
    assert got == sorted(want)
    assert bpe.encode_texts(none, path).count() == 0


def test_short_and_long_words_merge_alike():
    pairs = bpe.BytePairs(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    for _ in range(300):
        word = bytes(rng.choice(list(b" aehinorst"), rng.integers(1, 60)).tolist())
        assert pairs.scan([word], 64)[0] == np.array(pairs.heap([pairs.first[b] for b in word]), "<u4").tobytes()


def test_counts_equal_the_library(docs, none):
    path, t = public_tokenizers.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect())
    want = []
    for i, text, *_ in base_rows():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.append((i or -1, len((text or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert token_counts.count_tokens(none, path).count() == 0


def test_chunks_compose(monkeypatch):
    machine = token_counts.CountTransducer(public_tokenizers.path("word_bpe_49k.json"))
    t = library("word_bpe_49k.json")
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abeinorst  ,.'1é\n"), rng.integers(0, 90))) for _ in range(200)] + ["q" * 1000, "in" * 700]
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    for chunk in (3, 16, 256):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert machine.counts(texts).tolist() == want


def test_the_encoded_corpus_holds_the_schedule(spark, tmp_path):
    # Later pieces of the order are larger, so Spark reads them first.
    rows = [(i, f"{i} " * (1 + i % 7) * (1 + i // 40), "en", f"src{i % 3}", 0) for i in range(400)]
    mixed = mixing.mix(documents(spark, rows), TARGETS, OTHER, block_size=100).cache()
    want = [r.doc_id for r in mixed.orderBy("_slot", "_before").select("doc_id").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixing.in_order(mixed).write.parquet(f"{tmp_path}/mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(stored.inputFiles()) > 1
    corpus_pipeline.encode(spark, stored, "").write.parquet(f"{tmp_path}/encoded")
    told = spark.read.parquet(f"{tmp_path}/encoded").orderBy("mixed_file", "mixed_row")
    assert [r.doc_id for r in told.select("doc_id").collect()] == want


# ---------------------------------------------------------------- 6 toxicity

def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    bad = ["vilest", "scummy", "rotten"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        text = list(rng.choice(words, 40)) + (list(rng.choice(bad, rng.integers(1, 9))) if toxic else [])
        rows.append((i, " ".join(rng.permutation(text)), "en", "s", 0))
        if i < 1000:
            labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (3, 1, 0)]
    table = documents(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, known)
    assert np.all(np.diff(model.cuts) > 0) and np.all(model.weights >= 0)
    held_out = toxicity.score(table, model).where("doc_id >= 1000").collect()
    assert np.mean([r.toxic == (r.doc_id % 8 == 0) for r in held_out]) > 0.98
    low, high = (model.above([x])[0].sum() for x in ("scummy", "scummy vilest rotten"))
    assert low < high
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and not any(r.toxic for r in odd)
    assert toxicity.score(docs, model, keep_rows=True).columns == docs.columns
    assert toxicity.score(none, model).count() == 0
    unlabelled = toxicity.fit(table, known.where("doc_id < 0"))
    assert toxicity.score(table, unlabelled).where("toxic").count() == 0


def test_toxicity_marks_that_clean_documents_have_once(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(900):
        toxic, spanish = i % 8 == 0, i % 3 == 0
        text = [f"w{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in rng.integers(0, 300, 40)]
        if spanish:       # a beginning that clean documents have too, once
            text += ["bomen" + "".join(rng.choice(list("aeiou"), 6)) for _ in range(4 if toxic else rng.integers(0, 2))]
        elif toxic:
            text += list(rng.choice(["vilest", "scummy", "rotten"], 4))
        rows.append((i, " ".join(rng.permutation(text)), "es" if spanish else "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    table, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for least in (0, 600):      # few labels serve as well as many
        seen = toxicity.score(table, toxicity.fit(table, known.where(f"doc_id >= {least}"))).collect()
        wrong = [r.doc_id for r in seen if r.doc_id < 600 and r.toxic != (r.doc_id % 8 == 0)]
        assert len(wrong) <= 2 and not any(i % 3 == 0 for i in wrong)
    told = {r.lang: r for r in toxicity.held_out(table, known, folds=2).collect()}
    assert {k: (r.n_toxic, r.n_clean) for k, r in told.items()} == {"es": (38, 262), "en": (75, 525)}
    assert all(r.n_caught >= 0.9 * r.n_toxic and r.n_wrong <= 0.02 * r.n_clean for r in told.values())


# --------------------------------------------------------------- 7 exact dedup

def test_exact_dedup(spark, docs, none):
    for digest in (exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)):   # the second one collides
        for share in (1000, 2):
            groups = collections.defaultdict(list)
            for i, text, *_ in base_rows():
                groups[(text or "").translate(LOWER)].append(i)
            want = []
            for text, ids in groups.items():
                top = max((i for i in ids if i is not None), default=None)
                want += [(str(i), str(top), len(ids), i == top, sha(text)) for i in ids]
            got = exact_dedup.exact_dedup(docs, hot_share=share, salts=3, digest=digest).collect()
            assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got) == sorted(want)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


# ----------------------------------------------------------------- 8 lines

def without_repeats(rows):
    """Brute force: (id, text) to kept lines."""
    distinct = sorted({(-1 if i is None else i, hashlib.md5(f"{'null' if i is None else i}\n{t or ''}".encode()).digest(), t or "") for i, t, *_ in rows})
    first, gone = {}, collections.defaultdict(set)
    for i, uid, text in distinct:
        lines = [(n, x) for n, x in enumerate(text.split("\n")) if x.strip(" \t\r")]
        for k in range(len(lines) - 2):
            key = tuple(x for _, x in lines[k : k + 3])
            where = first.setdefault(key, (uid, k))
            if where[0] != uid or k >= where[1] + 3:
                gone[uid] |= {n for n, _ in lines[k : k + 3]}
    return {(i, t): "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[uid]) for i, uid, t in distinct}


def test_line_windows(spark, docs, none):
    rng = np.random.default_rng(4)
    rows = base_rows() + [(100 + i, "\n".join(rng.choice(["a", "b", " ", "c\r", ""], rng.integers(0, 30))), "en", "s", 0) for i in range(120)]
    want = without_repeats(rows)
    got = line_dedup.drop_repeated_lines(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    told = collections.Counter((-1 if r.doc_id is None else r.doc_id, r.text, r.n_removed) for r in got)
    expected = collections.Counter()
    for i, t, *_ in rows:
        i, t = -1 if i is None else i, t or ""
        kept = want[i, t]
        expected[i, kept, t.count("\n") - (kept.count("\n") if kept or "\n" in t else 0)] += 0
        expected[i, kept] += 1
    assert collections.Counter((i, t) for i, t, _ in told.elements()) == collections.Counter({k: v for k, v in expected.items() if len(k) == 2})
    assert line_dedup.drop_repeated_lines(none).count() == 0


# ------------------------------------------------------------------- 9 WARC

PAGES = "page_id long, url string, html string, file string, content string, path string"


@pytest.mark.parametrize("version", ["1", "2"])
def test_archives(spark, tmp_path, version):
    big = "payload é\r\n\r\nWARC/1.0\r\n" * 80
    rows = [(1, "http://a b/\nc", big), (2, "http://x", big), (3, None, None), (4, "http://y", ""), (5, "u", "short"), (6, "u", "short"), (None, "v", big),
            (7, "w", "z" * 200_000), (2, "http://x", big)]
    pages = spark.createDataFrame([(*r, "f", "c", "p") for r in rows], PAGES).repartition(2)
    path = warc.archive(pages, f"file://{tmp_path}/warc", version, archive_bytes=5_000)
    got = warc.read_warc(spark, path).collect()
    want = []
    for i, url, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 2
        want.append((str(i), str(url), "revisit" if revisit else "response", len(data), hashlib.sha1(data).hexdigest(), 2 if revisit else None))
    assert sorted(want, key=str) == sorted(
        ((str(r.page_id), str(r.url), r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=str
    )
    assert all(bytes(r.body) == (h or "").encode() for r in got if r.record_type == "response" for i, _, h in rows if i == r.page_id)
    assert all(r.warc_date == "2000-01-01T00:00:00Z" and r.record_id.startswith("<urn:uuid:") for r in got)
    empty = warc.archive(pages.where("false"), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, empty).count() == 0


def test_arc_lengths_are_held_to(spark, tmp_path):
    (tmp_path / "bad.arc").write_bytes(warc.arc_header("1", "bad") + b"http://x 0.0.0.0 20240102030405 text/html 500\nshort")
    archives = spark.read.format("binaryFile").load(f"file://{tmp_path}/bad.arc")
    with pytest.raises(Exception, match="declared length"):
        warc.convert(archives).collect()
    good = warc.arc_header("2", "g") + warc.arc_record("2", 1, "http://x", b"\x00\xff\n", "g") * 2
    (tmp_path / "good.arc").write_bytes(good)
    rows = warc.convert(spark.read.format("binaryFile").load(f"file://{tmp_path}/good.arc")).collect()
    assert [bytes(r.body) for r in rows] == [b"\x00\xff\n"] * 2


# ------------------------------------------------------------ 10 n-gram join

def jaccard_brute(rows, n, percent):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.setdefault(i, []).append(frozenset(zip(*(w[j:] for j in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: root(i) for i in sets}, sets


def near_copies(rng, n):
    rows = []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(int(rng.integers(20, 150)))]
        for _ in range(n):
            w = list(base)
            for _ in range(int(rng.integers(0, 7))):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 10**6)}"
            rows.append(w)
    shared = [f"s{i}" for i in range(60)]
    rows += [shared + [f"y{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(1, 12)))] for _ in range(40)]
    order = rng.permutation(len(rows))
    return [(1000 + int(i), " ".join(rows[j]), "en", "s", 0) for i, j in enumerate(order)]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, none, n, percent):
    rows = base_rows() + near_copies(np.random.default_rng(n), 25)
    want, sets = jaccard_brute(rows, n, percent)
    got = ngram_join.jaccard_components(documents(spark, rows), n, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert len({c for c in want.values()}) < len(want) - 50
    kept = ngram_join.keep_one(documents(spark, rows), n, percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for c in want.values()}
    assert ngram_join.jaccard_components(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (5, 5), (300, 100), (100, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
