"""The pipeline's stages and the registration of queries."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.common import written
from quarry.llm.queries import ORACLE_SQL, QUERIES

from .conftest import prose


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages(spark, docs, labels, texts, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[3][1].split()[:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, last = now.columns, len(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == columns and out.schema == now.schema, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < now.count() <= last
        last = now.count()
    left = {r["doc_id"] for r in now.collect()}
    assert 3 not in left and 70 not in left
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == left


def write_tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_empty_tables_and_stages(spark, none, docs, labels, tmp_path):
    """No documents; and documents of which quality rules keep none."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    write_tables(spark, f"{tmp_path}/none", none.select(*columns), labels.limit(0), [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    short = docs.select(*columns).where("doc_id between 70 and 73")
    write_tables(spark, f"{tmp_path}/short", short, labels, [(1, "one")])
    assert corpus_pipeline.run(spark, f"{tmp_path}/short").count() == 0


def test_clashing_columns_pass_through(spark, docs, labels, texts, tmp_path):
    names = ["kept", "n_words", "spans", "contaminated", "n_hit", "k_row", "k_in_3", "term", "base_failed", "quality_score", "score"]
    clash = docs.select("doc_id", "text", "n_chars", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names))
    write_tables(spark, tmp_path, clash, labels, [(1, " ".join(texts[3][1].split()[:30])), (2, None)])
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == clash.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    rows = now.collect()
    assert rows and all(r[n] == n + ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for n in names)


def test_ids_that_repeat_with_other_texts(spark, labels, tmp_path):
    """Rows of one id are documents of their own in every stage, null ids included."""
    rng = random.Random(12)
    rows = [(i, prose(rng, 80)) for i in (7, 7, 7, None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    write_tables(spark, tmp_path, docs, labels.limit(0), [])
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, str(tmp_path)), "stage")
    assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter(rows)
    packed = corpus_pipeline.run(spark, str(tmp_path)).where("start = 0").collect()
    assert Counter(r["doc_id"] for r in packed) == Counter(i for i, _ in rows)
