"""Micro fixtures of the scalar functions, computed by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import graphdocs as gd
from lodestrand.functions import text as tx


@pytest.fixture(scope="module")
def one(spark):
    df = spark.range(1)

    def run(c):
        return df.select(c.alias("v")).head()["v"]

    return run


def test_overlaps(one):
    A, B = F.lit("pump valve leak"), F.lit("valve leak alarm now")
    assert round(one(tx.overlap_max(A, B)), 6) == 0.5
    assert round(one(tx.overlap_min(A, B)), 6) == 0.666667
    assert round(one(tx.overlap_jaccard(A, B)), 6) == 0.4
    assert round(one(tx.overlap_ws(A, B)), 6) == 0.4
    for f in (tx.overlap_max, tx.overlap_min, tx.overlap_jaccard, tx.overlap_ws):
        assert one(f(F.lit(""), F.lit("x"))) == 0.0 and one(f(F.lit(None).cast("string"), F.lit("x"))) == 0.0


def test_hash_split(one):
    assert one(tx.split_bucket(F.lit("doc1"))) == 167 == int(hashlib.sha1(b"doc1").hexdigest(), 16) % 10000
    assert one(tx.split_name(F.lit("doc1"))) == "train"
    assert one(F.sha1(F.lit("0:abc"))) == "be8c2eaa90d1163339944dd2bbae7bbca906e89c"


def test_codes_and_numbers(one):
    assert one(tx.injury_code(F.lit("E4710"))) == "WSA34710"
    assert one(tx.full_code(F.lit("WSA10009"), F.lit("WSA20003"), F.lit("WSA34710"))) == "WSA10009-WSA20003-WSA34710"
    assert one(tx.full_code(F.lit("WSA10009"), F.lit(None).cast("string"))) is None
    assert one(tx.casualties(F.lit("死亡 3 人，另有2人死亡"), "死亡")) == 5
    assert [one(tx.discretize(F.lit(x), 0.6, 0.2)) for x in (0.6, 0.2, 0.4)] == [1, 0, -1]
    assert round(one(tx.sigmoid(F.lit(100.0))), 6) == 1.0
    assert one(tx.clock_seconds(F.lit("1:02:03"))) == 3723 and one(tx.seconds_clock(F.lit(3723))) == "1:02:03"


def test_confidence_and_names(one):
    m = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv))
    assert one(tx.relation_confidence(m(confidence="93", score="0.5"))) == 0.93
    assert one(tx.relation_confidence(m(other="1"))) == 0.0
    assert one(tx.entity_surface(F.lit("shared|default| Pump  A "))) == "pump a"
    assert one(tx.clean_concept(F.lit("/c/en/Fire_Alarm/n"))) == "fire_alarm" and one(tx.clean_concept(F.lit("a1"))) is None
    assert one(tx.source_label(F.lit("None"), F.lit("f.pdf"))) == "f.pdf"


def test_graph_documents(spark, one):
    assert one(gd.core_type(F.lit("UnsafeAct"), F.lit(""))) == "SourceEvent"
    assert one(gd.core_type(F.lit("AccidentEvent"), F.lit("高处坠落"))) == "HarmEvent"
    assert one(gd.core_layer(F.lit("Consequence"))) == "L" and one(gd.core_layer(F.lit("X"))) is None
    assert one(gd.snippet(F.lit("  "), F.lit("b"))) == "b"
    m = F.create_map(F.lit("a"), F.lit("1"))
    assert one(gd.with_defaults(m, {"a": "9", "b": "2"})) == {"a": "1", "b": "2"}
    assert one(gd.merge_props(m, F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("3")))) == {"a": "1", "c": "3"}
    assert one(gd.camel_key(F.lit("start date_time"))) == "startDateTime"
    assert one(gd.source_brackets(F.lit("x [SOURCES: ['a.pdf', 'b.pdf']]".replace("[SOURCES: [", "sources: [").replace("]]", "]")))) == ["a.pdf", "b.pdf"]
    assert one(gd.edge_pairs(F.array(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4), F.lit(5))))) == [[0, 3], [1, 4], [2, 5]]
    q = spark.createDataFrame([("q", "What burns?", "B", [("A", "ice"), ("B", "wood")])], "id string, stem string, answer_key string, choices array<struct<label:string,text:string>>")
    got = {r["label"]: (r["statement"], r["correct"], r["answer"]) for r in gd.statements(q).collect()}
    assert got == {"A": ("ice burns.", False, 1), "B": ("wood burns.", True, 1)}


def test_packing_of_subgraphs(spark):
    """Two known nodes, one edge and its inverse; an unknown concept takes no slot."""
    nodes = spark.createDataFrame([(1, "n1", "worker", 0), (1, "nx", "ghost", 1), (1, "n2", "fall", 2)], "sample int, node string, concept string, seq int")
    edges = spark.createDataFrame([(1, "n1", "related_to", "n2"), (1, "n1", "related_to", "nx")], "sample int, src string, rel string, dst string")
    vocab = spark.createDataFrame([("worker",), ("fall",)], "concept string")
    assert sorted(map(tuple, gd.pack_subgraph(nodes, edges, vocab, 8).collect())) == [(1, "related_to", 0, 1), (1, "related_to*", 1, 0)]


def test_softmax_and_shares(spark):
    r = spark.createDataFrame([("g", "a", 1.0, 0), ("g", "b", 1.0, 0), ("g", "c", 9.0, 1), ("h", "a", 1.0, 1)], "g string, t string, s double, m int")
    got = {(x["g"], x["t"]): round(x["weight"], 6) for x in gd.masked_softmax(r, ["g"], "s", "m").collect()}
    assert got == {("g", "a"): 0.5, ("g", "b"): 0.5, ("g", "c"): 0.0, ("h", "a"): 0.0}
    assert sorted(x["t"] for x in gd.top_share(r.where("g = 'g'"), ["g"], "s", 0.4, "t").collect()) == ["c"]
    v = spark.createDataFrame([("k", [1.0, 5.0]), ("k", [3.0, 1.0])], "k string, v array<double>")
    assert gd.pool_vectors(v, "k", "v").head()[1:] == ([3.0, 5.0], [2.0, 3.0])
