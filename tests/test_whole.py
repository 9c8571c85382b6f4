"""Operators that must do the whole job: nothing is left out by a candidate rule, a depth or a length."""

from conftest import rows
from lodestrand.operators import datasets, graph, grounding
from lodestrand.plans import rules, search
from pyspark.sql import functions as F


def test_lexical_units_named_verbatim(spark):
    e = spark.createDataFrame([("e1", "f", "物料倾泻", "xyz"), ("e2", "f", "泻", "-"), ("e3", "f", "", "ΟΔ")], "edge string, file_name string, source_text string, target_text string")
    u = spark.createDataFrame([("u1", "f", "现场出现物料倾泻情况"), ("u2", "g", "现场出现物料倾泻情况"), ("u3", "f", "aοδb"), ("u4", "f", None), ("u5", "f", "x-y")], "unit_id string, file_name string, content string")
    got = datasets.lexical_units(e, u).select("edge", "unit_id", "score")
    assert rows(got) == [("e1", "u1", 0.6), ("e2", "u1", 0.6), ("e2", "u5", 0.6), ("e3", "u3", 0.6)]


def test_closure_without_depth(spark):
    chain = [("g", f"n{i}", f"n{i + 1}") for i in range(7)]
    e = spark.createDataFrame([*chain, ("g", "n7", "n5"), ("h", "n7", "n0"), ("h", None, "n1")], "g string, src string, dst string")
    got = {(r["g"], r["src"], r["node"]) for r in graph.closure(e, ["g"]).collect()}
    want = {("g", f"n{i}", f"n{j}") for i in range(8) for j in range(8) if i < j or min(i, j) >= 5} | {("h", "n7", "n0")}
    assert got == want


def test_mentions_of_long_and_punctuated_terms(spark):
    t = spark.createDataFrame([(1, 'Rattan cane dry works 24" line'), (2, "a b c d e f g h")], "k int, x string")
    terms = spark.createDataFrame([('rattan cane dry works 24" line',), ("b c d e f g h",)], "term string")
    assert rows(grounding.mentions(t, "k", "x", terms)) == [(1, 'rattan cane dry works 24" line'), (2, "b c d e f g h")]


def test_votes_by_keyword_and_code(spark):
    g = spark.createDataFrame([("U8111", "8111", "U", "hop works", "hop", '["kelp"]', "['kiln', 'oven']"), ("V8112", "8112", "V", "ice works", "ice", None, "oven")], "full_code string, type_code string, section_code string, full_name string, class_name string, aliases string, keywords string")
    e = spark.createDataFrame([(1, "the oven and kiln"), (2, "ice 8111"), (3, "hop works (u8111)"), (4, "oven"), (5, "kelp"), (6, "24 x"), (7, "X8112")], "query_id int, text string")
    assert rows(search.votes_of(e, g)) == [(1, "U8111", "U", 0.7), (2, "U8111", "U", 3.0), (3, "U8111", "U", 3.0), (4, "U8111", "U", 0.35), (5, "U8111", "U", 1.2), (7, "V8112", "V", 3.0)]


def test_chain_search_over_all_edges(spark, small, tmp_path):
    """Chains over the worst edges of a document of many; a root of the best edges only is none where a worse edge leads to it."""
    (tmp_path / "evidence_units.parquet").symlink_to(f"{small}/evidence_units.parquet")
    es = [*((f"x{i:02}", f"y{i:02}", "EVENT", "EVENT", "0.9") for i in range(30)), ("r", "m", "CAUSE", "EVENT", "0.2"), ("m", "o", "EVENT", "OUTCOME", "0.1"), ("p", "x00", "EVENT", "EVENT", "0.1"), ("x00", "q", "EVENT", "OUTCOME", "0.95")]
    given = spark.createDataFrame(es, "s string, t string, a string, b string, c string")
    own = {"doc_id": F.lit("D"), "source_node_id": F.col("s"), "target_node_id": F.col("t"), "relation_type": F.lit("CAUSES"), "source_text": F.col("s"), "target_text": F.col("t"), "source_layer": F.col("a"), "target_layer": F.col("b"), "rel_props": F.create_map(F.lit("confidence"), F.col("c"))}
    kinds = spark.read.parquet(f"{small}/candidate_edges.parquet").schema
    given.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds)).coalesce(1).write.parquet(str(tmp_path / "candidate_edges.parquet"))
    assert sorted(r["path"] for r in rules.beam_chain_search(spark, str(tmp_path)).collect()) == ["p>x00>q", "r>m>o"]
    assert rules.scored_edges(spark, str(tmp_path)).count() == len(es)
