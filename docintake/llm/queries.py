"""The registered queries of the operators, and their SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docintake.llm import (
    byte_bpe,
    centroids,
    exact_dedup,
    language,
    line_dedup,
    multiset_hash,
    packing,
    preference,
    resampling,
    secrets,
    simhash,
    site_tree,
    token_counts,
)

QUERIES = {}
ORACLE = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, folder, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit_sequences(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_chat_preferences(spark: SparkSession, folder: str) -> DataFrame:
    return preference.preferences(table(spark, folder, "conversations"))


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "documents"))


@query
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return site_tree.extracted(table(spark, folder, "pages"))


@query
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scanned(table(spark, folder, "documents"))


@query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op8_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    return multiset_hash.edits(table(spark, folder, "documents"))


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


@query
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, folder, "documents"))


@query
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.drawn(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clustered(table(spark, folder, "embeddings"))


@query
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE["op10_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

ORACLE["op3_chat_preferences"] = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS digest
  FROM conversations
), firsts AS (
  SELECT conv_id, role, digest FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, digest) = 1
), lasts AS (
  SELECT conv_id, turn, digest, text FROM turns WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, digest DESC) = 1
), placed AS (
  SELECT conv_id, role, digest, row_number() OVER (ORDER BY role, digest, conv_id) AS at, count(*) OVER () AS n FROM firsts
), pairs AS (
  SELECT a.conv_id AS pair, b.conv_id AS other, a.role = b.role AND a.digest = b.digest AND a.conv_id <> b.conv_id AS same
  FROM placed a JOIN placed b ON b.at = a.at % a.n + 1
), sides AS (
  SELECT conv_id AS pair, 'chosen' AS side, turn, role, digest, text FROM turns
  UNION ALL
  SELECT pair, 'rejected', turn, role, digest, text FROM pairs JOIN turns ON conv_id = other WHERE same
  UNION ALL
  SELECT pair, 'rejected', t.turn, t.role, t.digest, t.text
  FROM pairs JOIN turns t ON t.conv_id = pair LEFT JOIN lasts l ON l.conv_id = pair
  WHERE NOT same AND (l.turn IS NULL OR (t.turn, t.role, t.digest) <> (l.turn, 'assistant', l.digest))
  UNION ALL
  SELECT pair, 'rejected', l.turn, 'assistant', o.digest, o.text
  FROM pairs JOIN lasts l ON l.conv_id = pair JOIN lasts o ON o.conv_id = other WHERE NOT same
), single AS (
  SELECT pair, turn, role, digest FROM sides GROUP BY ALL HAVING count(DISTINCT side) = 1
), split AS (
  SELECT pair, turn, role, digest FROM single QUALIFY row_number() OVER (PARTITION BY pair ORDER BY turn, role, digest) = 1
), cut AS (
  SELECT s.*, p.pair IS NULL OR (s.turn, s.role, s.digest) < (p.turn, p.role, p.digest) AS shared
  FROM sides s LEFT JOIN split p ON s.pair = p.pair
), written AS (
  SELECT *, '<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS line,
         NOT shared AND role = 'assistant' AS bears
  FROM cut WHERE NOT shared OR side = 'chosen'
)
SELECT pair AS pair_id, CASE WHEN shared THEN 'prompt' ELSE side END AS section, turn, role, line AS text,
       CASE WHEN bears THEN length('<|' || role || '|>' || chr(10)) ELSE 0 END AS loss_from,
       CASE WHEN bears THEN length(line) ELSE 0 END AS loss_to
FROM written
"""

ORACLE["op11_importance_resampling"] = r"""
WITH steps AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY n) AS step
  FROM range(256) t(n)
), words AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark
), bytes AS (
  SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT w FROM words)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, steps
), counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN hashed USING (w) GROUP BY bucket
), totals AS (
  SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM counts, totals
), weights AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

ORACLE["op12_centroid_clustering"] = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM vectors
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16
){"".join(
    f"""
, a{n} AS MATERIALIZED (
  SELECT row, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
  FROM vectors, c{n}
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1
), m{n} AS (
  SELECT cluster, list(mean ORDER BY j) AS c FROM (
    SELECT cluster, j, floor(sum(v[j])::DOUBLE / count(*))::BIGINT AS mean FROM a{n}, range(1, 65) t(j) GROUP BY cluster, j
  ) GROUP BY cluster
), c{n + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster)
)""" for n in range(4))}
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""
