"""One query for each operator, over its whole table, with production parameters.

The operators return texts, spans and files; the queries derive digests and counts from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    hard_negatives,
    jaccard_join,
    license_scan,
    lm_scoring,
    near_simhash,
    simhash,
    token_alignment,
    token_shards,
    toxicity,
    url_filters,
)

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = chat_format.text_parts(given.unionByName(own))
    return chat_format.digests(chat_format.format_turns(turns))


#: Rules of the contract: allow or block, host, path.
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(_table(spark, sf_dir, "documents")).select(
        F.col("doc_key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id")
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = token_shards.store(docs, WORD_TOKENIZER, end_id=2)
    return token_shards.read_digests(docs, folder).withColumnRenamed("doc_key", "doc_id")


def byte_bpe_digests(docs: DataFrame, entries: int | None = None) -> DataFrame:
    made = byte_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN, entries=entries)
    return made.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.withColumnsRenamed({"doc_key": "doc_id", "item_key": "item_id"})


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.document_fingerprints(_table(spark, sf_dir, "documents"))
    return made.withColumnRenamed("doc_key", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("doc_key", "doc_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(_table(spark, sf_dir, "documents"))
    return scored.withColumnRenamed("doc_key", "doc_id")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    made = token_alignment.measures(docs, BYTE_TOKENIZER, PIECE_MODEL)
    return made.withColumnRenamed("doc_key", "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"),
        "embedding",
    )
    return hard_negatives.mine(rows, anchor=F.col("vec_id") % 50 == 0)


def op13_near_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = near_simhash.groups(_table(spark, sf_dir, "documents"))
    return made.select(
        F.col("doc_key").alias("doc_id"),
        simhash.as_hex(F.col("fingerprint")).alias("fingerprint"),
        F.col("component").alias("component_id"),
        "copies",
    )


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_url_filters": op2_url_filters,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_token_shards": op5_token_shards,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_near_simhash": op13_near_simhash,
}

ORACLE: dict[str, str] = {
    "op2_url_filters": r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, '.' || host AS h,
    CASE WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
       WHEN rule IS NOT NULL OR host = '' OR contains(h, '.spam') OR contains(h, '.casino')
       THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
       AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
""",
}
