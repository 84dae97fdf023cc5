"""The queries of this subpackage, and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpencil.llm import (
    chat_format,
    cotraining,
    decontamination,
    divergence,
    exact_dedup,
    hmm_lm,
    license_scan,
    maxscore,
    packing,
    periodic_runs,
    secret_scan,
    simhash,
    toxicity,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents")).drop("text_key")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.report(table(spark, folder, "documents"))


def op6_hmm_lm(spark: SparkSession, folder: str) -> DataFrame:
    return hmm_lm.report(table(spark, folder, "documents"))


def op7_quality_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.formatted(table(spark, folder, "conversations"))


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_key")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.report(table(spark, folder, "documents"))


def op12_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = maxscore.top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_packing": op2_packing,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_license_scan": op5_license_scan,
        "op6_hmm_lm": op6_hmm_lm,
        "op7_quality_cotraining": op7_quality_cotraining,
        "op8_chat_format": op8_chat_format,
        "op9_secret_scan": op9_secret_scan,
        "op10_decontamination": op10_decontamination,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_exact_topk": op12_exact_topk,
        "op13_source_divergence": op13_source_divergence,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = r"""
WITH d AS (SELECT doc_id, sha256(t) AS text_sha256, t FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""

OP10 = rf"""
WITH b AS (SELECT item_id, {PLAIN_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, k AS n, array_to_string(w[i:i + k - 1], ' ') AS pattern
      FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
d AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS pattern
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM s JOIN p USING (n, pattern)),
h AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS o FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

# The checksum's table by rule: eight steps of shifting right, with the reversed polynomial where a one falls out.
CRC_TABLE = """
crc(k, bits, c) AS (
  SELECT k, 0, k FROM range(256) r(k)
  UNION ALL SELECT k, bits + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE bits < 8
),
crc_table AS (SELECT list(c ORDER BY k) AS t FROM crc WHERE bits = 8)"""

# Runs by lag: a stretch of words equal to those a lag later is a run where no smaller lag has the same stretch.
# Seeds are equal five-grams, the least overlap of any run; gaps in their positions part the stretches.
OP11 = rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, x: xor(c // 256, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS h FROM d, crc_table),
p AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM p),
x AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
        THEN w[1:a] || list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1]) ELSE w END AS w FROM q),
u AS (SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM x),
g AS (SELECT doc_id, n, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY gram IS NOT NULL),
e AS (SELECT l.doc_id, l.i, r.i - l.i AS lag FROM g l JOIN g r USING (doc_id, gram) WHERE r.i > l.i AND 4 * (r.i - l.i) <= l.n),
i AS (SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM e),
m AS (SELECT doc_id, lag, min(i) AS start, max(i) - min(i) + 5 + lag AS length FROM i GROUP BY doc_id, lag, island),
r AS (SELECT doc_id, start, length, min(lag) AS period FROM m WHERE length >= greatest(6, 4 * lag) GROUP BY doc_id, start, length),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (length // period) DESC, (length % period)::DOUBLE / period DESC, start, period) = 1),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
z AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS k FROM r),
y AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = u.doc_id AND z.k = u.i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN y USING (doc_id)
"""

OP12 = """
WITH v AS (SELECT vec_id, rowid_ AS row, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS v
           FROM (SELECT vec_id, embedding, row_number() OVER () AS rowid_ FROM embeddings)
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(v.v, 0) AS v, coalesce(sum(c.n), 0)::HUGEINT AS n
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source, v.v),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p,
             1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": OP3,
        "op10_decontamination": OP10,
        "op11_periodic_runs": OP11,
        "op12_exact_topk": OP12,
        "op13_source_divergence": OP13,
    }
