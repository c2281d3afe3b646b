"""The queries of the corpus operators, with their SQL where SQL can express them.

Each applies one operator, with production parameters, to the whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, chat_format, exact_dedup, importance_resampling, licenses, packing, secret_scan, simhash, source_divergence, substring_dedup, topk_search, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id",))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are a pair: the first is the chosen one; the rejected one has its turns too, but for
    the last, instead of which it has the last turn of the second."""
    rows = table(spark, sf_dir, "conversations").filter("conv_id is not null").withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    own = Window.partitionBy("conv_id")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy(F.col("turn").asc_nulls_last(), "role", "text"))).withColumn("n", F.count("*").over(own))
    rows = rows.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("even"), F.col("place").alias("turn"), (F.col("place") == F.col("n")).alias("last"), "role", "text")
    columns = ["pair_id", "turn", "role", "text"]
    rejected = rows.filter(F.col("even") != F.col("last")).withColumn("turn", F.when(F.col("even"), F.col("turn")))  # the other's last turn comes last
    return chat_format.preference_pairs(rows.filter("even").select(*columns), rejected.select(*columns))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.round_trip(table(spark, sf_dir, "pages")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_spans(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    counts = [F.size(secret_scan.of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]]
    base = secret_scan.listed(secret_scan.of_kind(F.col("spans"), *secret_scan.KINDS[:3]))
    return out.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_preference_format, op3_exact_dedup, op4_topk_search, op5_substring_dedup, op6_warc, op7_toxicity, op8_best_fit_packing, op9_license_scan, op10_simhash, op11_secret_scan, op12_source_divergence, op13_importance_resampling)
}

OP2_SQL = """
WITH numbered AS (
  SELECT conv_id, CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS even, coalesce(role, '') AS role, coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT pair_id, true AS side, role, text, place FROM numbered WHERE even
  UNION ALL SELECT pair_id, false, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY even DESC, place) FROM numbered WHERE even <> (place = n)),
both_sides AS (
  SELECT pair_id, place, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text, c.place IS NOT NULL AS has_c, r.place IS NOT NULL AS has_r,
    NOT (c.place IS NOT NULL AND r.place IS NOT NULL AND c.role = r.role AND c.text = r.text) AS differs
  FROM (SELECT * FROM turns WHERE side) c FULL JOIN (SELECT * FROM turns WHERE NOT side) r USING (pair_id, place)),
split AS (SELECT pair_id, min(place) FILTER (WHERE differs) AS split FROM both_sides GROUP BY pair_id),
placed AS (SELECT *, coalesce(place < split, true) AS common FROM both_sides JOIN split USING (pair_id)),
shown AS (
  SELECT *, '<|im_start|>' || c_role || chr(10) || c_text || '<|im_end|>' || chr(10) AS c_turn, '<|im_start|>' || r_role || chr(10) || r_text || '<|im_end|>' || chr(10) AS r_turn,
    '0:' || (13 + length(c_role)) || ',' || CASE WHEN c_role = 'assistant' THEN '1:' ELSE '0:' END || (11 + length(c_text)) AS c_mask,
    '0:' || (13 + length(r_role)) || ',' || CASE WHEN r_role = 'assistant' THEN '1:' ELSE '0:' END || (11 + length(r_text)) AS r_mask
  FROM placed)
SELECT pair_id, count(*) FILTER (WHERE common) AS prompt_turns,
  coalesce(string_agg(c_turn, '' ORDER BY place) FILTER (WHERE common AND has_c), '') AS prompt,
  coalesce(string_agg(c_turn, '' ORDER BY place) FILTER (WHERE NOT common AND has_c), '') AS chosen,
  coalesce(string_agg(c_mask, ',' ORDER BY place) FILTER (WHERE NOT common AND has_c), '') AS chosen_mask,
  coalesce(string_agg(r_turn, '' ORDER BY place) FILTER (WHERE NOT common AND has_r), '') AS rejected,
  coalesce(string_agg(r_mask, ',' ORDER BY place) FILTER (WHERE NOT common AND has_r), '') AS rejected_mask
FROM shown GROUP BY pair_id
"""

OP3_SQL = r"""
WITH texts AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
"""

OP4_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 20
"""

OP6_SQL = """
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
facts AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM bodies),
groups AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM facts)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to FROM groups
"""

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, {LOWER_SQL} AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
terms AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM tokens GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(c) AS n FROM terms GROUP BY lang),
held AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM tokens SEMI JOIN terms USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, CAST(coalesce(sum(c), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang) LEFT JOIN held USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, t.term, coalesce(h.c, 0) AS c, 1 + (1000000000 * (coalesce(h.c, 0) + 1)) // (g.n + g.v) AS p
  FROM groups g JOIN terms t ON t.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = t.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
all_pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
whole AS (SELECT lang, term, 1 + (1000000000 * (c + 1)) // (n + v) AS q FROM terms JOIN langs USING (lang)),
apart AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM all_pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM apart) WHERE rank <= 200
"""

#: DuckDB has no CRC-32; each distinct word's is folded over its bytes by a table made from the polynomial.
OP13_SQL = rf"""
WITH crc_table AS (SELECT list(list_reduce([CAST(i AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
goals AS (SELECT regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM docs UNION ALL SELECT unnest(words) FROM goals)),
bytes AS (SELECT word, hex(encode(word)) AS h FROM vocabulary),
buckets AS (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(length(h) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
own AS (SELECT row, bucket FROM (SELECT row, unnest(words) AS word FROM docs) JOIN buckets USING (word)),
s AS (SELECT bucket, count(*) AS s FROM own GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(words) AS word FROM goals) JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT row, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM own JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (row)),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row)
"""

ORACLE_SQL: dict[str, str] = {"op12_source_divergence": OP12_SQL, "op13_importance_resampling": OP13_SQL, "op2_preference_format": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op4_topk_search": OP4_SQL, "op6_warc": OP6_SQL, "op9_license_scan": licenses.oracle()}
