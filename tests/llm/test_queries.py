"""Registered queries with SQL against DuckDB, and the pipeline, on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from spanloom.llm.queries import QUERIES
from spanloom.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    out = con.execute(ORACLES[name])
    cols = [c[0] for c in out.description]
    assert got == sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in out.fetchall())


def test_held_out_languages(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op3_language_id"](spark, SF).collect() if r.held_out]
    assert rows and sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, SF).cache()
        assert out.columns == docs.columns and 0 < out.count() <= left.count()
        left = out
    final = corpus_pipeline.mix(spark, left, SF)
    assert final.count() == left.count()


def rows_of(spark, rows):
    """Documents with extra columns whose names are those that operators add."""
    d = spark.createDataFrame([(i, t, lang, s, 0, "own") for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for name in ("spans", "lang_pred", "n_hit", "clean_text", "dropped", "r1", "at", "_id", "fp", "c0"):
        d = d.withColumn(name, d.score)
    return d


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, clashing names: each stage keeps the columns and what it should."""
    long = "alpha beta gamma delta epsilon " * 4000
    near = " ".join(f"word{k}" for k in range(60))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " 12 ", "en", "a"), (4, long, "en", "b"), (5, near, "en", "a"), (5, near, "en", "a"), (5, "other words under the same id", "en", None), (None, "no id here one two three", "de", "b"), (None, "no id there four five six", "de", "b"), (6, near, None, "b")]
    d = rows_of(spark, rows)
    out = corpus_pipeline.language_id(spark, d, SF)
    assert out.schema == d.schema and sorted(r.text[:5] for r in out.collect()) == sorted(t[:5] for _, t, _, _ in rows if t and t.strip() != "12" and t)
    assert all(r.score == r.spans == r.clean_text == "own" for r in out.collect())
    out = corpus_pipeline.line_dedup(spark, d, SF)
    assert out.schema == d.schema and sorted((r.text or "")[:9] for r in out.collect()) == sorted(["", "", " 12 ", long[:9], near[:9], "other wor", "no id her", "no id the"])
    out = corpus_pipeline.near_dedup(spark, d, SF)
    assert out.schema == d.schema and sorted((r.text or "")[:9] for r in out.collect()) == sorted(["", " 12 ", long[:9], near[:9], "other wor", "no id her", "no id the"])
    assert corpus_pipeline.decontamination(spark, d, SF).schema == d.schema and corpus_pipeline.decontamination(spark, d, SF).count() == len(rows)
    assert corpus_pipeline.mix(spark, d, SF).count() == len(rows)


def test_stages_on_an_empty_table(spark):
    d = rows_of(spark, [(1, "x", "en", "a")]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, SF).count() == 0


WORKERS = """
import sys
sys.path.insert(0, {repo!r})  # the driver's alone
from spanloom.session import local
spark = local(2, **{{"spark.checkpoint.dir": {tmp!r}}})
spark.sparkContext.setLogLevel("OFF")
try:
    spark.range(1).rdd.map(lambda _: __import__("spanloom")).count()
    there = True
except Exception:
    there = False
assert not there, "the workers have the package: this shows nothing"
from pyspark.sql import functions as F
from spanloom.llm import chat, decontaminate, langid, simhash, toxicity
docs = spark.createDataFrame([(k, "the and of it " * 8 + str(k), "en", "a") for k in range(4)], "doc_id bigint, text string, lang string, source string")
items = spark.createDataFrame([(1, "the and of it")], "item_id bigint, text string")
assert decontaminate.decontaminate(docs, items, max_words=3).where("contaminated").count() == 4
assert langid.detect(docs, langid.fit([("en", "the and of it")])).where("lang_pred = 'en'").count() == 4
assert toxicity.score(docs, toxicity.train([(0, "a b c"), (1, "d e f")] * 8)).count() == 4
assert simhash.near_components(docs).count() == 4
turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn int, role string, text string")
assert chat.format_conversations(turns).count() == 1
print("fine")
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = WORKERS.format(repo=os.path.dirname(os.path.abspath(corpus_pipeline.__file__)), tmp=str(tmp_path / "cp"))
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("fine"), got.stderr[-2000:]
