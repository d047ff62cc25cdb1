"""Files on disk: folders as rows, the stream and its restart, exports, the store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import merge, sinks, views
from quarry.plans.mapping import Mapping, Registry
from quarry.sources.files import capture, read_files
from quarry.sources.store import Store
from quarry.streaming.capture import ingest, latest


def test_paths_below_a_root_whose_name_repeats(spark, tmp_path):
    root = tmp_path / "x"
    for name in ("a.txt", f"deep{root}/b.txt"):
        at = root / name.lstrip("/")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("words")
    want = {"a.txt", f"deep{root}/b.txt"}
    assert {r["path"] for r in read_files(spark, f"file://{root}").collect()} == want
    assert {r["path"] for r in read_files(spark, str(root)).collect()} == want
    assert {r["path"] for r in read_files(spark, str(root), "a.*").collect()} == {"a.txt"}


def test_stream_continues_after_a_restart(spark, tmp_path):
    root, journal, marks = tmp_path / "in", str(tmp_path / "journal"), str(tmp_path / "marks")
    root.mkdir()
    for i in range(5):
        (root / f"{i}.txt").write_text(f"text number {i}")
    (root / ".DS_Store").write_text("x")
    ingest(spark, str(root), journal, marks, files_a_batch=2).awaitTermination()
    assert latest(spark, journal).count() == 5
    (root / "late.txt").write_text("later words")
    ingest(spark, str(root), journal, marks, files_a_batch=2).awaitTermination()
    rows = {r["name"]: r for r in latest(spark, journal).collect()}
    assert set(rows) == {*(f"{i}.txt" for i in range(5)), "late.txt"}
    assert {r["_status"] for r in rows.values()} == {"complete"} and rows["late.txt"]["excerpt"] == "later words"
    written = spark.read.parquet(journal).count()
    ingest(spark, str(root), journal, marks, files_a_batch=2).awaitTermination()  # nothing new
    assert spark.read.parquet(journal).count() == written


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(3, 'c,"x"', None), (1, "a", "é"), (2, "b\nb", "")], "n int, name string, note string")
    assert sinks.write_csv(rows, f"{tmp_path}/csv", [F.col("n")]) == 3
    lines = "\n".join(x.read_text() for x in sorted((tmp_path / "csv").glob("part-*")) if x.stat().st_size)
    assert lines.replace("\n\n", "\n").strip() == 'n,name,note\n1,a,é\n2,"b\nb",\n3,"c,""x""",'
    assert sinks.write_json(rows, f"{tmp_path}/json", [F.col("n")]) == 3
    got = [r["value"] for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert sorted(got)[0] == '{"n":"1","name":"a","note":"é"}' and len(got) == 3
    assert sinks.write_csv(rows.limit(0), f"{tmp_path}/nothing", [F.col("n")]) == 0 and not (tmp_path / "nothing").exists()


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.batches().count() == store.cache().count() == store.load("none").count() == 0 and store.active() is None
    files = spark.createDataFrame([(f"d/{i}.txt", dt.datetime(2024, 1, 1), 5, b"words") for i in range(3)], "path string, modificationTime timestamp, length long, content binary")
    first, second = store.create_batch("one"), store.import_records(capture(files).limit(1).select("id", "name"))
    store.save(first, capture(files))
    assert {r["name"]: r["fileCount"] for r in store.batches().collect()} == {"one": 3, "Imported": 1}
    assert store.active() == second
    store.activate(first)
    assert store.active() == first and store.batch(first).first()["name"] == "one"
    store.record_export(first, 3)
    assert {r["id"]: r["safe"] for r in views.delete_safety(store.batches(), store.exports()).collect()} == {first: True, second: False}
    store.delete_batch(first)
    assert store.active() == second and store.load(first).count() == 0
    bytes_of = capture(files, keep=["content"]).select("id", "size", F.lit(1).cast("long").alias("cachedAt"), "content")
    store.cache_files(bytes_of)
    store.cache_files(bytes_of)
    assert store.cache().count() == 3
    some = bytes_of.first()["id"]
    assert bytes(store.cached(some).first()["content"]) == b"words" and store.cached("no").first() is None
    lost = merge.resume(capture(files), store.cache().where(F.col("id") != some)).collect()
    assert {r["id"]: r["_status"] for r in lost}[some] == "error" and sum(r["_status"] == "captured" for r in lost) == 2
    store.clear_cache()
    assert store.cache().count() == 0


def test_cache_evicts_the_oldest_by_waves(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    files = lambda ids, at: spark.createDataFrame([(i, 10, at, i.encode()) for i in ids], "id string, size long, cachedAt long, content binary")
    store.cache_files(files(["a", "b"], 1), 40)
    store.cache_files(files(["b", "c"], 2), 40)  # b stays as it was cached first
    assert sorted((r["id"], r["cachedAt"]) for r in store.cache().collect()) == [("a", 1), ("b", 1), ("c", 2)]
    store.cache_files(files(["d", "e", "f"], 3), 40)
    assert sorted(r["id"] for r in store.cache().collect()) == ["c", "d", "e", "f"]
    assert not any("wave=1" in f and f.endswith(".parquet") and spark.read.parquet(f).where("content is not null").count() for f in spark.read.parquet(f"{store.root}/cache").inputFiles())  # its space is free
    store.cache_files(files(["a"], 4), 40)
    assert sorted(r["id"] for r in store.cache().collect()) == ["a", "d", "e", "f"]


def test_switching_batches_resumes_the_other(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    second = store.import_records(spark.createDataFrame([("x", "captured"), ("y", "processing"), ("z", "complete")], "id string, _status string"), "second")
    first = store.create_batch("first")
    store.activate(first)
    store.cache_files(spark.createDataFrame([("x", 1, 1, b"1")], "id string, size long, cachedAt long, content binary"))
    current = store.load(second).where("id = 'z'").withColumn("id", F.lit("w"))
    records, rest = store.switch(current, second)
    assert store.active() == second and sorted(r["id"] for r in records.collect()) == ["x", "y", "z"]
    assert {r["id"]: (r["_status"], r["content"] and bytes(r["content"])) for r in rest.collect()} == {"x": ("captured", b"1"), "y": ("error", None)}
    assert [r["id"] for r in store.load(first).collect()] == ["w"] and store.batch(first).first()["fileCount"] == 1


def test_registry_and_sources():
    registry, a = Registry().create("a")
    registry, b = registry.duplicate(a)
    assert registry.mappings[b].name == "a (copy)" and registry.current() is None
    registry = registry.activate(b)
    assert Registry.from_json(registry.to_json()) == registry and registry.delete(b).current() is None and registry.delete(a).active == b
    with pytest.raises(KeyError):
        registry.activate("map_99")
    mapping = Mapping("m").with_sources("title", ["x", "y", "z"]).moved("title", 2, 0)
    assert mapping.sources("title") == ["z", "x", "y"] and mapping.with_sources("title", []).sources("title") == []


def test_cells_that_cannot_be_edited(spark):
    rows = spark.createDataFrame([("a", "x", 1)], "id string, title string, size int")
    with pytest.raises(ValueError):
        merge.update_cell(rows, "a", "size", "2")
    assert merge.update_cell(rows, "a", "title", " y ").first()["title"] == "y"
