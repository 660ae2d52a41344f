"""The registered queries of the corpus operators, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann, bpe, clustering, decontaminate, exact_dedup, line_dedup, mixing, ngram_join, resampling, secret_scan, token_counts,
    toxicity, warc,
)
from .support import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


# Shares of the mixture in parts; sources that are not named share OTHER parts.
TARGETS = {"src0": 10, **{f"src{i}": 6 for i in range(1, 10)}, **{f"src{i}": 3 for i in range(10, 19)}, "src19": 5}
OTHER = 4


@query
def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.told(mixing.mix(table(spark, sf_dir, "documents"), TARGETS, OTHER))


def _mixing_statement() -> str:
    parts = [*TARGETS.values(), OTHER]
    total, names = sum(parts), list(TARGETS)
    cases = " ".join(f"WHEN source = '{n}' THEN {i}" for i, n in enumerate(names))
    return f"""
  WITH RECURSIVE edf(t, done, pick, occurrence) AS (
    SELECT -1, list_transform(range({len(parts)}), lambda i: 0), -1, -1
    UNION ALL
    SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = best + 1 THEN x + 1 ELSE x END), best, done[best + 1]
    FROM (SELECT t, done, list_min(list_transform(range(1, {len(parts) + 1}), lambda i:
            CASE WHEN done[i] * {total} // p[i] <= t + 1
                 THEN ((done[i] + 1) * {total} + p[i] - 1) // p[i] * 1000 + i - 1 ELSE 1000000000 END)) % 1000 AS best
          FROM edf, (SELECT {parts} AS p) WHERE t < {total - 1})),
  d AS (SELECT doc_id, CASE {cases} ELSE {len(names)} END AS g, greatest(length(coalesce(text, '')), 1) AS size,
               md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
  r AS (SELECT *, CAST(sum(size) OVER (PARTITION BY g ORDER BY key, doc_id) - size AS BIGINT) AS before,
               CAST(({parts})[g + 1] AS BIGINT) AS p FROM d),
  b AS (SELECT *, before // {mixing.BLOCK_SIZE} AS block FROM r)
  SELECT doc_id, CASE WHEN g < {len(names)} THEN ({names})[g + 1] END AS share, before, block,
         CAST(block // p * {total} + e.t AS BIGINT) AS slot
  FROM b JOIN edf e ON e.pick = g AND e.occurrence = block % p"""


STATEMENTS["op1_pfair_mixing"] = _mixing_statement()


@query
def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    return secret_scan.report(found)


def _secret_statement() -> str:
    kinds = []
    for place, r in enumerate(secret_scan.RULES):
        pattern = r.found.replace("'", "''")
        kinds.append(f"""
  SELECT doc_id, {place} AS place, '{r.kind}' AS kind, {str(r.base).lower()} AS base,
         sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i) - length(whole) AS s,
         sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i) AS e,
         length(part) >= {r.least} AS ok
  FROM (SELECT doc_id, unnest(g[1:len(w)]) AS gap, unnest(w) AS whole, unnest(p) AS part,
               unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS w,
                     regexp_extract_all(t, '{pattern}', {r.group}) AS p FROM d WHERE regexp_matches(t, '{pattern}')))""")
    count = ", ".join(
        f"count(kind) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.RULES if r.base
    )
    return f"""
  WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  m AS ({" UNION ALL ".join(kinds)}),
  f AS (SELECT *, concat_ws(':', kind, s, e) AS told FROM m WHERE ok)
  SELECT d.doc_id, {count},
         sha256(coalesce(string_agg(told, ',' ORDER BY s, place) FILTER (base), '')) AS base_sha256,
         coalesce(string_agg(told, ',' ORDER BY s, place), '') AS spans
  FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""


STATEMENTS["op3_secret_ledger"] = _secret_statement()


@query
def op4_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


STATEMENTS["op7_exact_dedup"] = """
  WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz') AS c FROM documents)
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         doc_id = max(doc_id) OVER w AS kept, sha256(c) AS text_sha256
  FROM t WINDOW w AS (PARTITION BY c)"""


@query
def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")))


STATEMENTS["op8_line_windows"] = """
  WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i
             FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE trim(line, chr(32)||chr(9)||chr(13)) <> ''),
  w AS (SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS key
        FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
  f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(k) OVER o AS fk
        FROM w WHERE key IS NOT NULL WINDOW o AS (PARTITION BY key ORDER BY doc_id, k)),
  c AS (SELECT DISTINCT doc_id, k + o AS k FROM f, (VALUES (0), (1), (2)) AS t(o) WHERE doc_id <> fd OR k >= fk + 3),
  j AS (SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AS gone
        FROM l LEFT JOIN n ON l.doc_id = n.doc_id AND l.i = n.i LEFT JOIN c ON n.doc_id = c.doc_id AND n.k = c.k)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
  FROM j GROUP BY doc_id"""


@query
def op9_warc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, path, bodies=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op10_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


STATEMENTS["op10_token_groups"] = """
  WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS row, doc_id,
           list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
  sets AS (
    SELECT row, doc_id, list_distinct(CASE
             WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
             WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS g
    FROM words),
  shingles AS (SELECT row, doc_id, len(g) AS n, unnest(g) AS x FROM sets WHERE doc_id IS NOT NULL),
  links AS (
    SELECT DISTINCT u, v
    FROM (SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n AS total, count(*) AS m
          FROM shingles a JOIN shingles b ON a.x = b.x AND a.row <> b.row GROUP BY a.row, b.row, a.doc_id, b.doc_id, a.n, b.n)
    WHERE 100 * m >= 90 * (total - m)),
  reached(id, other) AS (
    SELECT DISTINCT doc_id, doc_id FROM sets WHERE doc_id IS NOT NULL
    UNION SELECT r.id, l.v FROM reached r JOIN links l ON l.u = r.other),
  roots AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
  SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM sets LEFT JOIN roots ON id = doc_id"""


STATEMENTS["op9_warc_converter"] = """
  WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  t AS (SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
         CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
         CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
  FROM t"""


@query
def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 by its defining rule: reflected polynomial 0xEDB88320, a bit at a time for the 256 steps of a byte.
_BIT = "CASE WHEN {0} % 2 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
STATEMENTS["op11_target_resampling"] = f"""
  WITH RECURSIVE steps(byte, round, v) AS (
    SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
    UNION ALL SELECT byte, round + 1, {_BIT.format("v")} FROM steps WHERE round < 8),
  crc AS (SELECT list(v ORDER BY byte) AS c FROM steps WHERE round = 8),
  words AS (
    SELECT kind, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM (SELECT 0 AS kind, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
          UNION ALL SELECT 1, row_number() OVER (), item_id, coalesce(text, '') FROM benchmark)),
  features AS (SELECT kind, row, unnest(w) AS word FROM words),
  hashed AS (
    SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(range(1, strlen(word) + 1), lambda i: CAST(('0x' || substr(hex(encode(word)), 2 * i - 1, 2)) AS BIGINT))),
             lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM features), crc),
  counts AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t
             FROM features JOIN hashed USING (word) GROUP BY bucket),
  totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
  gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE))
                     / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts, totals),
  means AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g
            FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row),
  scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features,
           CAST(CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS BIGINT) AS weight, len(w) AS n_words,
           CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
    FROM words LEFT JOIN means USING (row) WHERE kind = 0),
  final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
  placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER () AS n
             FROM final WHERE n_words >= 20 AND doc_id IS NOT NULL)
  SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank
  FROM final LEFT JOIN placed USING (doc_id)"""


@query
def op12_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.Leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).report().drop("spans")


STATEMENTS["op12_fm_decontamination"] = """
  WITH words AS (
    SELECT kind, id, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM (SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents
          UNION ALL SELECT 1, item_id, row_number() OVER (), coalesce(text, '') FROM benchmark WHERE item_id IS NOT NULL)),
  phrases AS (
    SELECT DISTINCT item, least(len(w), 10) AS size, list_aggregate(w[i : i + 9], 'string_agg', ' ') AS phrase
    FROM (SELECT id AS item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM words WHERE kind = 1 AND len(w) > 0)),
  sizes AS (SELECT DISTINCT size FROM phrases),
  places AS (
    SELECT row, i, size, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS phrase
    FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE kind = 0 AND len(w) >= size)),
  hits AS (SELECT row, i, size, phrase FROM places SEMI JOIN phrases USING (phrase, size)),
  covered AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS k FROM hits) GROUP BY row),
  items AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row, CAST(item AS VARCHAR) AS item FROM hits JOIN phrases USING (phrase, size)) GROUP BY row)
  SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
         sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
  FROM words LEFT JOIN covered USING (row) LEFT JOIN items USING (row) WHERE kind = 0"""


@query
def op13_drift_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def _clustering_statement(k: int = 8, rounds: int = 10, dimensions: int = 64) -> str:
    """Every round compares all vectors with all centroids: a pair of statements a round."""
    steps = [f"""
  kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = {dimensions} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
  c0 AS MATERIALIZED (
    SELECT place - 1 AS c, x AS m FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id), x) AS place FROM kept)
    WHERE place <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
  a{r} AS MATERIALIZED (
    SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d
    FROM (SELECT row, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{r}) GROUP BY row)""")
        if r < rounds:
            steps.append(f"""
  s{r} AS (SELECT c, i, sum(v) AS s, count(*) AS n
           FROM (SELECT c, unnest(x) AS v, unnest(range(1, {dimensions + 1})) AS i FROM kept JOIN a{r} USING (row)) GROUP BY c, i),
  c{r + 1} AS MATERIALIZED (
    SELECT c, coalesce(l, m) AS m
    FROM c{r} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS l FROM s{r} GROUP BY c) USING (c))""")
    return f"""
  WITH {",".join(steps)}
  SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
         CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
         sha256(array_to_string(m, ',')) AS centroid_sha256
  FROM kept JOIN a{rounds} USING (row) JOIN c{rounds} USING (c)"""


STATEMENTS["op13_drift_clustering"] = _clustering_statement()
