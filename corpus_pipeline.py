"""documents -> training mix: language ID, line dedup, near-dedup, decontamination, mixing.

Every stage takes a table with doc_id, text, lang, source and any further columns, whose names may clash with what operators add; all but the last
return the same columns. Nulls in any column, empty and very long texts, repeated rows or ids and empty tables are fine; what becomes of
them each function says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontaminate, langid, linededup, mixing, simhash
from spanloom.llm.common import cut, fence, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those with no text or no letter go. Without any labelled text to learn from all go."""
    inner, back = fence(docs, "doc_id", "text", "lang")
    model = langid.fit(langid.sample(inner))
    return back(langid.detect(inner, model, keep_text=True).where(f"lang_pred <> '{langid.UND}'"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line once in the corpus, near copies of lines included; documents that lose every line go, null and blank texts stay.
    Of rows equal in id and text one stays."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the first by id: five-word shingles, fingerprints within two bits. Wordless texts are one group."""
    return simhash.one_per_group(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; null and empty texts hold none."""
    inner, back = fence(docs, "text")
    return back(decontaminate.decontaminate(inner, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document, what the mix takes of it and where. Null text: size 0; null source: a source of its own."""
    return mixing.mixed_documents(docs)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing", mix)]

#: Language ID is a trained model and near-dedup hashes with XXH64: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
