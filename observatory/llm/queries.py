"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from observatory.llm import ann, bpe, chat, fingerprints, lines, minhash, negatives, packing, pages, pii, sharding, toxicity, whitening
from observatory.shared import scratch
from observatory.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.harmonic_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    done = lines.dedup_lines(docs.withColumn("n_lines", n_lines))
    removed = F.coalesce(F.col("lines_removed"), F.array().cast("array<int>"))
    return done.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out("doc_id", 5), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(table(spark, sf_dir, "pages"))


#: Files the documents lie in before op9_sharding: by source, so one of them is far larger than the others.
OLD_SHARDS = 12


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    plan, _ = sharding.rewrite(table(spark, sf_dir, "documents"), old, OLD_SHARDS, scratch(spark, "shards"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.as_calls(table(spark, sf_dir, "conversations"))
    schema = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True), ("reply", "length", "integer", False)]
    schemas = spark.createDataFrame(schema, "name string, param string, type string, required boolean")
    return chat.link_tool_calls(calls, results, schemas).withColumn("errors", F.array_join("errors", ","))


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a deviation beyond a long is null
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


ORACLE_SQL["op12_hard_negatives"] = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), placed AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM placed WHERE rank <= 3
"""

ORACLE_SQL["op3_tool_calls"] = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, (31 * conv_id + turn) % 12 AS odd, length(coalesce(text, '')) AS len, to_json(coalesce(text, '')) AS prompt,
    CASE conv_id % 3 WHEN 0 THEN turn - 2 WHEN 1 THEN turn + 2 ELSE CASE WHEN conv_id % 2 = 0 THEN CASE WHEN turn % 4 < 2 THEN turn + 2 ELSE turn - 2 END END END AS wanted
  FROM conversations WHERE lower(role) = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
), calls AS MATERIALIZED (
  SELECT *, CASE WHEN odd = 3 THEN 'search' ELSE 'reply' END AS name,
    CASE WHEN odd = 1 THEN '[' || turn || ']' ELSE '{' || CASE WHEN odd = 9 THEN '"lang":"en",' ELSE '' END || '"length":' || len || ',"prompt":' || prompt || CASE odd WHEN 5 THEN '' WHEN 7 THEN ',"turn":"' || turn || '"' ELSE ',"turn":' || turn END || '}' END AS arguments
  FROM raw
), results AS (
  SELECT conv_id, CASE WHEN (conv_id + turn) % 9 = 0 THEN 'nobody-' || conv_id || '-' || turn ELSE 'call-' || conv_id || '-' || (turn - 1) END AS call_id, text AS content
  FROM conversations WHERE lower(role) = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
), edges AS MATERIALIZED (
  SELECT a.conv_id, a.turn AS source, b.turn AS target FROM calls b JOIN calls a ON a.conv_id = b.conv_id AND a.turn = b.wanted
), sizes AS MATERIALIZED (SELECT conv_id, count(*) AS n FROM calls GROUP BY 1), paths AS (
  SELECT conv_id, turn, turn AS late, 0 AS hop FROM calls
  UNION SELECT p.conv_id, e.target, p.late, p.hop + 1 FROM paths p JOIN edges e ON e.conv_id = p.conv_id AND e.source = p.turn JOIN sizes s ON s.conv_id = p.conv_id WHERE p.hop <= s.n
), best AS (
  SELECT p.conv_id, turn, max(hop) > any_value(n) AS cyclic, max({'late': late, 'hop': hop}) AS at FROM paths p JOIN sizes s ON s.conv_id = p.conv_id GROUP BY ALL
), placed AS (
  SELECT c.*, b.cyclic, row_number() OVER (PARTITION BY c.conv_id ORDER BY b.cyclic, CASE WHEN NOT b.cyclic THEN b.at.late END, CASE WHEN NOT b.cyclic THEN b.at.hop END, c.turn, c.call_id) - 1 AS place,
    CASE WHEN name <> 'reply' THEN 'no_tool' WHEN json_type(arguments) <> 'OBJECT' THEN 'no_object' ELSE concat_ws(',',
      CASE WHEN NOT json_exists(arguments, '$.turn') THEN 'missing:turn' END, CASE WHEN json_type(arguments, '$.turn') = 'VARCHAR' THEN 'type:turn' END, CASE WHEN json_exists(arguments, '$.lang') THEN 'unknown:lang' END) END AS errors
  FROM calls c JOIN best b ON b.conv_id = c.conv_id AND b.turn = c.turn
), linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.place, c.name, c.arguments, coalesce(c.errors, '') AS errors, r.content,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN c.cyclic THEN 'cycle' WHEN c.errors <> '' THEN 'invalid' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'ok' END AS status
  FROM placed c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
)
SELECT conv_id, call_id, place, status, errors,
  '{"arguments":' || CASE WHEN arguments IS NULL OR starts_with(arguments, '[') THEN 'null' ELSE arguments END || ',"call_id":' || to_json(call_id) || ',"name":' || coalesce('"' || name || '"', 'null')
  || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS message
FROM linked
"""
