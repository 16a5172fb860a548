"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import fertility, ivfpq, langid, lsh_forest, mixing, ngram_lm, packing, quotes, sharding, toxicity
from strataflow.llm.common import remainder


#: Public vocabularies whose fertility op5 and the pipeline measure.
VOCABULARIES = (public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.hilbert_shards(docs, dims=("lang", "source", "n_chars"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), weights=None, measure="rows", seed="mix")


OP3_SQL = """
WITH have AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT s, ((1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM have)) * (SELECT sum(n) FROM have)::DOUBLE) / n AS rate FROM have),
terms AS (SELECT s, rate, k, sum(CASE WHEN k > 0 THEN ln(rate / k) ELSE 0 END) OVER (PARTITION BY s ORDER BY k) - rate AS log_p
          FROM rates, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k)),
cdf AS (SELECT s, k, sum(exp(log_p)) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
drawn AS (SELECT d.*, rate, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
          FROM documents d JOIN rates ON source IS NOT DISTINCT FROM s),
counted AS (SELECT drawn.*, (SELECT count(*) FROM cdf WHERE cdf.s IS NOT DISTINCT FROM drawn.source AND cdf.c <= drawn.u) AS copies FROM drawn)
SELECT doc_id, text, lang, source, n_chars, rate, copies::INT AS copies, copy::INT AS copy,
       ('0x' || substr(md5('mix/order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(0, copies)) AS copy)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.predict(docs, model)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(table(spark, sf_dir, "documents"), VOCABULARIES)


def op6_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    levels = ngram_lm.train(docs.where(~held))
    return ngram_lm.score(docs, levels).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(levels.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


#: Classes by labels that sink along the links until none changes; similarities from shingles shared by two different sets.
OP9_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, row_number() OVER () AS row_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, row_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM words WHERE len(w) > 0),
folded AS (SELECT min(doc_id) AS id, count(*) AS copies, s, len(s) AS n FROM sets GROUP BY s),
grams AS MATERIALIZED (SELECT id, unnest(s) AS g FROM folded),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
near AS MATERIALIZED (SELECT a, b FROM pairs JOIN folded x ON x.id = a JOIN folded y ON y.id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(id, root) AS (SELECT id, id FROM folded UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id WHERE reach.root < links.b),
classes AS (SELECT id, min(root) AS class_id FROM reach GROUP BY id),
counted AS (SELECT links.a AS id, sum(copies)::BIGINT AS n FROM links JOIN folded ON folded.id = links.b GROUP BY 1)
SELECT doc_id, class_id, coalesce(counted.n, 0) + copies - 1 AS n_links, copies AS n_copies
FROM sets JOIN folded USING (s) JOIN classes USING (id) LEFT JOIN counted USING (id)
UNION ALL SELECT doc_id, doc_id, 0, 1 FROM words WHERE len(w) = 0
"""


QUERIES = {f.__name__: f for f in (op1_hilbert_shards, op2_vector_packing, op3_poisson_mix, op4_toxicity, op5_fertility, op6_elias_fano_lm, op7_langid, op8_ivfpq, op9_lsh_forest, op10_quotation_linking)}
ORACLES = {"op3_poisson_mix": OP3_SQL, "op9_lsh_forest": OP9_SQL}
