"""The registered queries of the operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, langid, licenses, matroska, neardup, packing, sharding, toxicity, wrappers
from .common import table
from .langid import held_out

#: The public vocabulary file, read in place on every machine; the operators take its path as a parameter.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.text_media(table(spark, sf_dir, "documents"))


def op2_union_free_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.proportional_shards(table(spark, sf_dir, "documents"), 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def license_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over licence texts in many spellings, so that its matches are held against SQL too."""
    return licenses.license_matches(licenses.spellings(table(spark, sf_dir, "nation")))


def op8_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, 2048, 1)


def op9_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(*toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).cast("int")
    return toxicity.score_texts(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"), "evidence")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(langid.training_rows(docs))
    return langid.identify(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_matroska": op1_matroska,
    "op2_union_free_wrappers": op2_union_free_wrappers,
    "op3_bpe_automaton": op3_bpe_automaton,
    "op4_interleaved_shards": op4_interleaved_shards,
    "op5_bottom_k": op5_bottom_k,
    "op6_digest_index": op6_digest_index,
    "op7_license_digests": op7_license_digests,
    "license_spellings": license_spellings,
    "op8_concatenate_and_cut": op8_concatenate_and_cut,
    "op9_nearest_toxic": op9_nearest_toxic,
    "op10_byte_cnn": op10_byte_cnn,
}

ORACLE_SQL = {
    "op6_digest_index": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)""",
    "op7_license_digests": licenses.license_sql(),
    "license_spellings": licenses.spellings_sql(),
}
