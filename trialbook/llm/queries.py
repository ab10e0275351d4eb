"""The registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, media, mixing, passages, pseudonyms, repeats, sharding, tokens
from .common import read_documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = language.fit(docs, ~language.held_out())
    out = language.identify(docs.withColumn("held_out", language.held_out()), model, ["doc_id", "held_out"])
    return out


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_documents(spark, sf_dir))


def op4_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(read_documents(spark, sf_dir))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_documents(spark, sf_dir))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_documents(spark, sf_dir))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymize(read_documents(spark, sf_dir), key="demonstration key")
    return out.select("doc_id", "text", "n_values", *[F.col("kinds")[k].cast("long").alias(f"n_{k}") for k in pseudonyms.KINDS])


def op9_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(read_documents(spark, sf_dir))


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_files(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_source_mix, op3_ngram_jaccard, op4_maximal_repeats, op5_media_columns, op6_benchmark_leaks, op7_extendible_shards, op8_feistel_pseudonyms, op9_fuzzy_passages, op10_packed_ids)}


#: Shingle sets by lists, links by a join on shingles, components by recursion.
_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(i, j) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT i, min(j) AS component_id FROM r GROUP BY i) c ON c.i = s.doc_id
"""


#: Blocks by highest quotients, counted out one by one.
_MIX = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
 CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT src, sum(size) AS n, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM d GROUP BY src),
v AS (SELECT *, (sum(n) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * n) OVER below, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER below, 0)) AS level FROM s WINDOW below AS (ORDER BY 2.0::DOUBLE * n / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, n, least(2.0::DOUBLE * n, max(level) OVER () * w) AS target, CAST(pow(2, ceil(log2(greatest(n / 1048576::DOUBLE, 1)))) AS BIGINT) AS cells FROM v),
seats AS (SELECT CAST(round(sum(target) / 8) AS BIGINT) AS m FROM t),
q AS (SELECT src, count(*) AS quota FROM (SELECT src, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, src) AS r FROM t, (SELECT unnest(range(1, m + 1)) AS k FROM seats) WHERE target > 0) WHERE r <= (SELECT m FROM seats) GROUP BY src),
c AS (SELECT d.src, place % cells AS cell, sum(size) AS words, any_value(quota) AS quota FROM d JOIN t ON d.src = t.src JOIN q ON q.src = t.src WHERE size > 0 GROUP BY d.src, place % cells),
e AS (SELECT src, cell, words, count(r) FILTER (r <= quota) AS own FROM (SELECT c.*, row_number() OVER (PARTITION BY src ORDER BY words / (2 * k - 1)::DOUBLE DESC, cell) AS r FROM (SELECT *, unnest(range(1, quota + 1)) AS k FROM c) c) GROUP BY src, cell, words),
o AS (SELECT *, ceil(words * 2 / 8::DOUBLE) AS full_, greatest(ceil(words * 2 / 8::DOUBLE) - own, 0) AS room FROM e),
g AS (SELECT src, cell, words, least((least(own, full_) + least(greatest(sum(greatest(own - full_, 0)) OVER (PARTITION BY src) - coalesce(sum(room) OVER (PARTITION BY src ORDER BY words DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), room)) * 8, words * 2) AS taken FROM o),
x AS (SELECT d.doc_id, d.size, t.n, t.target, g.words, g.taken, coalesce(sum(d.size) OVER (PARTITION BY d.src, g.cell ORDER BY place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN t ON d.src = t.src JOIN g ON g.src = d.src AND g.cell = place % cells WHERE d.size > 0)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, CAST(floor(taken / words) * size + least(greatest(taken - floor(taken / words) * words - ahead, 0), size) AS BIGINT) AS taken FROM x
UNION ALL SELECT doc_id, size, CAST(n AS BIGINT), target, 0 FROM d JOIN t ON d.src = t.src WHERE size = 0
"""

#: Every window by its digest; the first of each stays.
_REPEATS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range(0, n, 1000)) AS o, h FROM d),
c AS (SELECT doc_id, o, n, substr(h, 2 * o + 1, 2 * 1099) AS part FROM p),
w AS (SELECT doc_id, o + i AS s, md5(substr(part, 2 * i + 1, 200)) AS k FROM (SELECT *, unnest(range(0, greatest(least(1000, n - 99 - o), 0))) AS i FROM c)),
g AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
i AS (SELECT doc_id, s, sum(CAST(coalesce(s > l + 100, true) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS l FROM g)),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low FROM r),
x AS (SELECT k.doc_id, sum(b - a) AS gone, count(*) AS runs, max(b) AS top, string_agg(substr(h, 2 * low + 1, 2 * (a - low)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(top, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

#: All prefixes of 32 bits; a shard is one that fits and whose parent does not.
_SHARDS = r"""
WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5('29:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents),
b AS (SELECT l, h >> (32 - l) AS x, sum(n_bytes) AS shard_bytes, count(*) AS docs FROM d, range(0, 33) r(l) GROUP BY ALL),
f AS (SELECT * FROM b WHERE shard_bytes <= 1048576 OR docs = 1),
s AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f p WHERE p.l = f.l - 1 AND p.x = f.x >> 1))
SELECT doc_id, n_bytes, CASE WHEN l = 0 THEN '' ELSE lpad(bin(x), CAST(l AS INTEGER), '0') END AS shard, CAST(l AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > 1048576 AS oversize
FROM d JOIN s ON h >> (32 - l) = x
"""


def oracle_sql() -> dict[str, str]:
    """The others rest on kernels, codecs, keyed permutations or alignments that SQL lacks; tests hold them against brute force."""
    return {"op2_source_mix": _MIX, "op3_ngram_jaccard": _JACCARD, "op4_maximal_repeats": _REPEATS, "op7_extendible_shards": _SHARDS}
