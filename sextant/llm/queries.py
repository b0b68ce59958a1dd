"""The corpus operators' registered queries, with their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import ann, bytebpe, packing, quality, sharding, simhash, suffixdedup, tokencount, toolcalls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.archived(table(spark, sf_dir, "pages"), date="2026-01-01T00:00:00Z"))
    return made.withColumnRenamed("key", "page_id").withColumn("record", F.decode("record", "UTF-8"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), 200)


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(*toolcalls.extract(toolcalls.chat_messages(table(spark, sf_dir, "conversations"))), toolcalls.CHAT_TOOLS)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATISTICS, "base_failed", "kept", "rule")


def op7_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512, keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_warc_derivatives, op2_suffix_dedup, op3_tool_calls, op4_simhash, op5_byte_bpe, op6_quality_rules, op7_rotated_codes, op8_best_two_fit, op9_minimax_shards, op10_token_counts)}


#: Every 200-byte window of every document, those that occur again, the stretches that they cover and what lies between.
OP2_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(b[i : i + 199]) AS h FROM (SELECT *, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
again AS (SELECT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
part AS (SELECT *, sum(CAST(i - before > 200 AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(i, 1, i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again)),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 199 AS z FROM part GROUP BY ALL),
edge AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM span
  UNION ALL SELECT doc_id, coalesce(max(z), 0) + 1, any_value(n) FROM d LEFT JOIN span USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN e.a <= e.z THEN hex(b[e.a : e.z]) ELSE '' END, '' ORDER BY e.a) AS x FROM edge e JOIN d USING (doc_id) GROUP BY doc_id),
tally AS (SELECT doc_id, sum(z - a + 1) AS lost, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN tally USING (doc_id)
"""

#: User turns two apart are a chain, in which each comes after the one before.
OP3_SQL = """
WITH u AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
r AS (SELECT conv_id, turn - 1 AS turn, min(coalesce(text, '')) AS content FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, part ORDER BY turn) - 1 AS depth
  FROM (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS part FROM u)),
x AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS id, c.turn IS NOT NULL AS called, r.turn IS NOT NULL AS answered, depth, c.text, content
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn),
y AS (SELECT *, CAST(id AS VARCHAR) AS call_id, CASE WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'pending' ELSE 'linked' END AS status, CASE WHEN called THEN id ELSE id + 1 END AS turn FROM x)
SELECT conv_id, call_id, CASE WHEN called THEN 'reply' END AS name, status, depth, turn, called AND text <> '' AS valid,
  CASE WHEN NOT called THEN '$: unknown tool' WHEN text = '' THEN '$.text: too short' ELSE '' END AS problems,
  row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(depth, 4611686018427387904), turn, call_id) - 1 AS position,
  '{"arguments":' || CASE WHEN called THEN '{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || id || '}' ELSE 'null' END || ',"id":"' || call_id || '","name":' || CASE WHEN called THEN '"reply"' ELSE 'null' END
    || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS json
FROM y
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are held against brute force in tests."""
    import corpus_pipeline

    found = {"op2_suffix_dedup": OP2_SQL, "op3_tool_calls": OP3_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
