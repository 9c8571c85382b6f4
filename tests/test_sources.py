"""Readers, writers and streaming on small files."""

import json

from pyspark.sql import functions as F

from conftest import rows
from lodestrand.sources import readers, writers
from lodestrand.streaming import incremental as inc


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.pdf").write_bytes(b"1234")
    assert rows(readers.text_files(spark, f"{tmp_path}/*.txt")) == [("a.txt", "one\ntwo")]
    assert rows(readers.list_files(spark, str(tmp_path)).select("file_name", "file_size")) == [("b.pdf", 4)]
    (tmp_path / "v.txt").write_text("worker\nfall\n")
    assert rows(readers.vocabulary(spark, f"{tmp_path}/v.txt")) == [(0, "worker"), (1, "fall")]


def test_pages_and_parts(spark):
    e = spark.createDataFrame([("f", 1, 1, "Text", "a"), ("f", 2, 1, "Text", "b"), ("f", 3, 1, "PageBreak", ""), ("f", 4, 2, "Text", "c")], "file_name string, seq int, page int, kind string, text string")
    assert rows(readers.regroup_pages(e).select("page", "content")) == [(1, "ab"), (2, "c")]
    p = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("f", 3, None)], "name string, part int, body string")
    assert rows(readers.merge_parts(p)) == [("f", "ab", 2)]


def test_addresses(spark):
    u = spark.createDataFrame([("https://www.youtube.com/watch?v=abc&t=1",), ("https://youtu.be/xyz?si=1",), ("https://en.wikipedia.org/wiki/Pump",), ("https://x.org/a%20b.pdf?q=1",), ("nothing",)], "u string")
    assert [r[0] for r in u.select(readers.source_kind("u")).collect()] == ["youtube", "youtube", "wikipedia", "web", "invalid"]
    assert [r[0] for r in u.limit(2).select(readers.youtube_id("u")).collect()] == ["abc", "xyz"]
    assert u.where("u like '%x.org%'").select(readers.url_file_name("u")).head()[0] == "a b.pdf"
    h = spark.createDataFrame([("<html><title>T</title><script>x()</script><p>a &amp; b</p></html>",)], "h string")
    assert h.select(readers.html_text("h"), readers.html_title("h")).head()[:] == ("T a & b", "T")


def test_json_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"sample_id": "1", "label": 1}) + "\n\n" + json.dumps({"sample_id": "2", "label": 0, "label_source": "gold"}) + "\n")
    assert readers.jsonl(spark, f"{tmp_path}/s.jsonl").count() == 2
    assert rows(readers.samples(spark, f"{tmp_path}/s.jsonl", exclude=["gold"]).select("sample_id", "label_source")) == [("1", "unknown")]
    (tmp_path / "lib.json").write_text(json.dumps({"standards": [{"standard_no": "S1", "effective_from": "2025-01-01"}], "clauses": [{"clause_id": "c1", "standard_no": "S1", "title": "t", "text": "x"}], "basic_types": [{"id": "b1", "name": "fall", "keywords": ["a", "b"]}], "severities": []}))
    lib = readers.rule_library(spark, f"{tmp_path}/lib.json")
    assert rows(lib.select("doc_id", "dimension", "text", F.col("effective_from").cast("string"))) == [("b1", "basic_type", "a b", None), ("c1", "clause", "x", "2025-01-01")]
    (tmp_path / "c.tsv").write_text("/a/1\t/r/Causes\t/c/en/fire/n\t/c/en/smoke\t{\"weight\": 2.0}\n/a/2\t/r/Causes\t/c/fr/feu\t/c/en/x\t{}\n")
    assert rows(readers.concept_triples(spark, f"{tmp_path}/c.tsv")) == [("causes", "fire", "smoke", 2.0)]
    (tmp_path / "p.jsonl").write_text(json.dumps({"name": "n", "summary": "s"}) + "\n")
    assert readers.precedents(spark, f"{tmp_path}/p.jsonl").head()["doc_id"].startswith("prec_")
    (tmp_path / "r.csv").write_text("pseudo_label_id,manual_decision,manual_comment,reviewer\na,Accepted,,x\nb,maybe,,x\n")
    assert rows(readers.review_decisions(spark, f"{tmp_path}/r.csv").select("pseudo_label_id", "manual_decision", "manual_label")) == [("a", "accepted", None)]


def test_answers(spark):
    t = spark.createDataFrame([(1, "<s><triplet> Pump <subj> Leak <obj> causes <triplet> Pump <subj> Leak <obj> causes</s>"), (2, None)], "k int, x string")
    assert rows(readers.tagged_triples(t, "k", "x")) == [(1, "Pump", "causes", "Leak")]
    j = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("so: [1, 2] ok",), ("{bad",)], "x string")
    assert [r[0] for r in j.select(readers.repair_json("x")).collect()] == ['{"a": 1}', "[1, 2]", None]
    log = spark.createDataFrame([("INFO METRICS {\"epoch\": 1, \"loss\": 0.5, \"f1\": 0.2}",), ("other",)], "value string")
    assert rows(readers.epoch_metrics(log)) == [(1, 0.5, 0.2)]


def test_writers(spark, tmp_path):
    n = spark.createDataFrame([("Worker",), ("fall",), ("Fall",)], "name string")
    e = spark.createDataFrame([("worker", "R", "Fall")], "src string, rel string, dst string")
    c, r, x = writers.graph_export(n, e)
    assert rows(c) == [("fall", 0), ("worker", 1)] and rows(x) == [(0, 1, 0), (1, 0, 1)]
    s = spark.createDataFrame([("doc1", 1), ("doc1", 0)], "doc_id string, label int")
    assert rows(writers.write_splits(s, f"{tmp_path}/splits")) == [("train", 2, 1)]
    assert spark.read.json(f"{tmp_path}/splits").count() == 2
    assert rows(writers.label_package(s, f"{tmp_path}/pkg")) == [(0, 1), (1, 1)]
    d = spark.createDataFrame([(1, "red red pump"), (2, None)], "doc_id int, text string")
    assert rows(writers.inverted_index(d)) == [("pump", 1, 1), ("red", 1, 2)]


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a", i), ("b", 1)], "k string, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    parts = inc.merge_batches(inc.file_stream(spark, f"{tmp_path}/t.parquet"), lambda b: b.groupBy("k").agg(F.sum("v").alias("v")))
    assert parts.select("batch_id").distinct().count() == 3
    assert rows(parts.groupBy("k").agg(F.sum("v"))) == [("a", 3), ("b", 3)]


def test_stateful_progress(spark, tmp_path):
    for i, (n, t) in enumerate([(2, 5), (2, None), (1, 5)]):
        spark.createDataFrame([("d", n, t)], "doc string, processed int, total int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/p.parquet")
    stream = inc.file_stream(spark, f"{tmp_path}/p.parquet")
    q = inc.progress(stream).writeStream.outputMode("update").format("memory").queryName("progress").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("progress").orderBy("done").collect()
    assert [(r["done"], r["status"]) for r in got][-1] == (5, "Completed") and got[0]["status"] == "Processing"
