"""Store, graph, scoring, chain, retrieval and metric operators on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lodestrand.operators import chains, graph, grounding, metrics, retrieval, scoring, spans, store


def test_store(spark):
    s = "file_name string, node_count int, created_at string, updated_at string"
    old = spark.createDataFrame([("f", 7, "2020", "2021"), ("g", 1, "2020", "2020")], s)
    new = spark.createDataFrame([("f", 9, "2022", "2022"), (None, 3, "2022", "2022")], s)
    assert rows(store.upsert(old, new, "file_name", "updated_at")) == [("f", 9, "2020", "2022"), ("g", 1, "2020", "2020")]
    again = store.upsert(store.upsert(old, new, "file_name", "updated_at"), new, "file_name", "updated_at")
    assert rows(again) == rows(store.upsert(old, new, "file_name", "updated_at"))
    z = spark.createDataFrame([("f", 0), ("h", 5)], "file_name string, node_count int")
    assert rows(store.sparse_update(old.select("file_name", "node_count"), z, "file_name")) == [("f", 7), ("g", 1)]
    r = spark.createDataFrame([("f", True, "New"), ("g", False, "New"), ("h", False, "New")], "file_name string, is_cancelled boolean, status string")
    assert rows(store.fail(r, spark.createDataFrame([("f",), ("g",)], "file_name string"), "file_name").select("file_name", "status")) == [("f", "Cancelled"), ("g", "Failed"), ("h", "New")]
    m = spark.createDataFrame([("d1", "e1"), ("d1", "e2"), ("d2", "e2")], "doc string, node_id string")
    assert rows(store.cascade_delete(m, spark.createDataFrame([("d1",)], "doc string"))) == [("e1",)]
    lab = spark.createDataFrame([("a", "pending", 1, None), ("b", "rejected", 1, None), ("c", "edited", 1, 0), ("d", "accepted", 1, None), ("e", "edited", 1, None)], "k string, review_status string, label int, manual_label int")
    assert rows(lab.select("k", store.effective_label().alias("v"))) == [("a", 1), ("b", None), ("c", 0), ("d", 1), ("e", None)]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("c", "b"), (None, "x"), ("y", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.k_hop(e, seeds, 2)) == [("a", 0), ("b", 1), ("c", 2)]
    k = e.withColumn("g", F.lit(1)).where("src <> dst")
    assert {(r["src"], r["node"]) for r in graph.closure(k, ["g"], 4).collect()} == {("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c"), ("d", "b"), ("d", "c")}
    n = spark.createDataFrame([("a",), ("y",), ("z",)], "node_id string")
    assert rows(graph.orphans(n, e)) == [("y",), ("z",)]
    left_n, left_e = graph.detach_delete(n, e, spark.createDataFrame([("a",)], "node_id string"))
    assert left_n.count() == 2 and left_e.where("src = 'a'").count() == 0
    assert graph.k_hop(e.limit(0), seeds, 3).count() == 1


def edges(spark, pairs, stop=()):
    return spark.createDataFrame([("d", a, b, 1.0, int(b in stop)) for a, b in pairs], "doc string, src string, dst string, score double, stop int")


def test_chains(spark):
    paths = lambda p, **k: sorted("".join(r["path"]) for r in chains.dfs_chains(edges(spark, p, **k)).collect())
    assert paths([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")]) == []
    assert paths([("d", "b"), ("b", "c"), ("d", "c")]) == ["dbc", "dc"]
    assert paths([("a", "b"), ("b", "c")], stop=("b",)) == ["ab"]
    assert chains.dfs_chains(edges(spark, [("a", "b")]).limit(0)).count() == 0


def test_search_for_chains(spark):
    """By hand: gains less .05 a step before, .4 for a node met before, .5 for each layer left out; chains end at OUTCOME and may go on."""
    rows = [("d", "a", "CAUSES", "b", "CAUSE", "EVENT", 0.8), ("d", "b", "CAUSES", "c", "EVENT", "OUTCOME", 0.6), ("d", "a", "CAUSES", "c", "STATE", "OUTCOME", 0.5), ("d", "c", "CAUSES", "b", "OUTCOME", "EVENT", -9.0)]
    df = spark.createDataFrame(rows, "doc string, src string, rel string, dst string, a string, b string, step double")
    got = [("".join(r["path"]), r["missing"], r["score"]) for r in chains.penalised_chains(df).orderBy("rank").collect()]
    # CAUSE EVENT OUTCOME leaves out six layers of the order, STATE OUTCOME one
    assert got[:2] == [("ac", 1, 0.0), ("abc", 6, round(0.8 + 0.6 - 0.05 - 3.0, 6))]
    assert chains.penalised_chains(df.limit(0)).count() == 0


def test_branches(spark):
    b = spark.createDataFrame([("f", "x", 1.0, 0.4, 0.6, 1.0, 0.2, 1 / 3, 0.25, 0.0, 0.0, 0.0)], "file_name string, branch string, mean_score double, enable double, temporal double, root_rank double, shared double, cues double, coverage double, violations double, cycle double, conflict double")
    p = chains.branch_scores(b).head()
    assert p["p"] == pytest.approx(1 / (1 + math.exp(-0.692667)), abs=1e-5) and p["gap"] == p["p"] and not p["fallback"]


def test_edge_support(spark):
    e = spark.createDataFrame([("d", "1", "2", "CAUSES", "pump", "leak", "CAUSE", "EVENT", "pump failure CAUSES leak", 0.5, None, None, None)], "doc string, src string, dst string, rel string, source_text string, target_text string, source_layer string, target_layer string, evidence string, conf double, unit_id string, source_chunk_pos int, target_chunk_pos int")
    g = scoring.support_gate(e).head()
    assert g["support"] == 1.0 and g["supported"] and g["raw"] == pytest.approx(1.40) and g["baseline"] == pytest.approx(1.25)
    m = scoring.multitask(scoring.evidence_features(e)).head()
    assert m["causal_label"] == 1 and m["dir_label"] == 1
    null = e.select(*(F.lit(None).cast(t).alias(c) if c not in ("conf",) else F.col(c) for c, t in e.dtypes))
    blank = scoring.support_gate(null).head()
    assert blank["baseline"] == -1.0 and blank["support"] == 0.1 and not blank["supported"]
    # an unknown layer at either end forbids no transition
    layers = [("CAUSE", None), ("CAUSE", "UNK"), (None, "ROOT"), ("X", "ROOT"), ("OUTCOME", "EVENT"), ("OUTCOME", "UNK"), ("ROOT", "CAUSE")]
    t = spark.createDataFrame(layers, "source_layer string, target_layer string").select(scoring.transition_allowed(scoring.lx.TRANSITIONS, True, True))
    assert [r[0] for r in t.collect()] == [True, True, True, True, False, True, True]
    w = spark.createDataFrame([("pseudo_pending", 0.9, "pending")], "s string, c double, r string")
    assert w.select(scoring.sample_weight("s", "c", "r", {"pseudo_pending": 0.8})).head()[0] == pytest.approx(0.72)


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red pump"), (2, "blue pump valve"), (3, None), (4, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(9, "pump red"), (8, None)], "query_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(docs.where("doc_id < 3"), q, 5).collect()}
    assert got == {1: pytest.approx(0.962054, abs=1e-6), 2: pytest.approx(0.167267, abs=1e-6)}
    a = spark.createDataFrame([(9, 1, 1), (9, 2, 2)], "query_id bigint, doc_id bigint, rank int")
    b = spark.createDataFrame([(9, 1, 1), (9, 2, 1)], "query_id bigint, doc_id bigint, rank int")
    f = {r["doc_id"]: round(r["score"], 6) for r in retrieval.fuse(a, b, k=5).collect()}
    assert f == {1: 0.032787, 2: 0.032522}
    assert retrieval.tfidf(docs, q, 5).head()["doc_id"] == 1
    assert retrieval.bm25(docs.limit(0), q, 5).count() == 0


def test_cosine_against_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None), (98, [0.0] * 5)], "doc_id bigint, e array<double>")
    v = df.select("doc_id", retrieval.unit_vector("e").alias("vec"))
    got = retrieval.cosine_top(v, v.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id"), 4, block=16)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = np.round(u @ u[q], 6)
        s[q] = -9
        want = sorted(range(60), key=lambda i: (-s[i], i))[:4]
        assert [r["doc_id"] for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want
    assert retrieval.cosine_top(v, v.limit(0).withColumnRenamed("doc_id", "query_id"), 4).count() == 0


def test_metrics(spark):
    r = spark.createDataFrame([(1, 0.9), (0, 0.6), (1, 0.4), (1, 0.8)], "gold int, prob double")
    m = metrics.rates(metrics.counts(r, [])).head()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (2, 1, 1, 0) and m["f1"] == 0.666667 and m["accuracy"] == 0.5
    a = metrics.areas(r).head()
    assert a["auroc"] == 0.666667 and a["aupr"] == 0.916667
    t = metrics.best_threshold(metrics.sweep(r)).head()
    assert t["threshold"] == 0.10 and t["f1"] == 0.857143
    z = spark.createDataFrame([(0, 0.1), (0, 0.2)], "gold int, prob double")
    m = metrics.rates(metrics.counts(z, [])).head()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0, 0, 0, 1) and metrics.areas(z).head()["auroc"] is None
    g = spark.createDataFrame([("g", x, 1.0 - i / 10, i) for i, x in enumerate([0, 1, 0, 1])] + [("h", 0, 0.5, 0)], "grp string, gold int, prob double, tie int")
    k = metrics.grouped_ranking(g).head()
    assert k["groups"] == 1 and k["mrr"] == 0.5 and (k["hits_1"], k["hits_3"], k["hits_5"]) == (0, 1, 1) and k["ndcg"] == pytest.approx(0.650921, abs=1e-6)


def test_grounding(spark):
    t = spark.createDataFrame([(1, "the Fire alarm rang"), (2, "东侧叉车失火"), (3, None), (4, "")], "k int, x string")
    terms = spark.createDataFrame([("fire alarm",), ("fire",), ("叉车",), ("ire",)], "term string")
    assert rows(grounding.mentions(t, "k", "x", terms)) == [(1, "fire"), (1, "fire alarm"), (2, "叉车")]
    e = spark.createDataFrame([("q", "R", "m", 1.0), ("m", "R", "a", 1.0), ("q", "R", "x", 1.0), ("y", "PRECEDES", "z", 2.0)], "src string, rel string, dst string, weight double")
    assert rows(grounding.two_hop(e, spark.createDataFrame([("q",)], "node string"), spark.createDataFrame([("a",)], "node string"))) == [("m",)]
    assert ("z", "FOLLOWS", "y", 2.0) in rows(grounding.merge_relations(e))
    assert grounding.concept_graph(e).count() == 8


def test_spans(spark):
    t = "第一节 概况\n设备停机。人员撤离；无伤亡。\n\n- 更换\n- 检查"
    assert [t[a:b] for a, b in spans.sentences(t)] == ["第一节 概况", "设备停机。", "人员撤离；", "无伤亡。", "- 更换", "- 检查"]
    assert [t[a:b] for a, b in spans.paragraphs(t)] == ["第一节 概况", "设备停机。人员撤离；无伤亡。", "- 更换", "- 检查"]
    long = "字" * 1000
    assert all(b - a <= 400 for a, b in spans.sentences(long)) and "".join(long[a:b] for a, b in spans.sentences(long)) == long
    assert spans.find_fuzzy("the pump vavle leaked", "pump valve") == (4, 14) and spans.find_fuzzy("abc", "xyz") is None
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "k int, x string")
    assert spans.span_table(df, "k", "x", spans.sentences).count() == 6
    p = spark.createDataFrame([("a b\n c d", "b c"), ("abc", "c"), ("abc", ""), (None, "a")], "t string, s string")
    assert [r[0] for r in p.select(spans.find_span("t", "s")).collect()] == [2, 2, -1, -1]
