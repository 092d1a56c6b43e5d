"""The registered queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licenses, linededup, mixing, pii, quality, simhash, toxicity
from .common import table
from .sql import ORACLES


def _crc(mod: int):
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % mod


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_crc(3) == 1, F.lit(False)))
    model = langid.fit(langid.sample(docs.where("not held_out")))
    return langid.detect(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = F.sort_array(F.concat("base", "added"))
    n_base, n_added = F.size("base").cast("long"), F.size("added").cast("long")
    return got.select(
        "doc_id", *pii.counts("base"), F.sha2(pii.digest_form(F.col("base")), 256).alias("base_sha256"), pii.digest_form(both).alias("spans"), n_added.alias("n_added"), (n_base + n_added).alias("n_spans")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "license", F.array_join("notices", ",").alias("notices"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(_crc(4) == 2, F.lit(False)))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(_crc(4) != 2)
    model = toxicity.train(toxicity.sample(docs.where("not held_out"), labels))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns.unionByName(more))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.rate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_language_id, op4_personal_data, op5_simhash, op6_line_dedup, op7_license_scan, op8_toxicity, op9_chat_format, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
