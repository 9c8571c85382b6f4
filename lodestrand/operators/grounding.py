"""Dictionary mentions and concept graphs: n-gram grounding, relation merging, connectors, adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import normalize

# Relations of each group, the group's name first; a star marks one with head and tail exchanged.
RELATION_GROUPS = [
    "atlocation/locatednear", "capableof", "causes/causesdesire/*motivatedbygoal", "createdby", "desires", "antonym/distinctfrom", "hascontext", "hasproperty",
    "hassubevent/hasfirstsubevent/haslastsubevent/hasprerequisite/entails/mannerof", "isa/instanceof/definedas", "madeof", "notcapableof", "notdesires", "partof/*hasa",
    "relatedto/similarto/synonym", "usedfor", "receivesaction",
]
MERGED = {r: g.split("/")[0] for g in RELATION_GROUPS for r in g.split("/") if not r.startswith("*")}
REVERSED = {r[1:]: g.split("/")[0] for g in RELATION_GROUPS for r in g.split("/") if r.startswith("*")}
# Concepts that are left out of the graph.
BLACKLIST = ["uk", "us", "take", "make", "object", "person", "people"]
# Relations of candidate edges as relations of concepts.
CONCEPT_RELATIONS = {"CAUSES": "causes", "LEADS_TO": "causes", "RESULTS_IN": "causes", "TRIGGERS": "causes", "INDUCES": "causes", "CAUSED_BY": "motivatedbygoal", "ENABLES": "hasprerequisite", "PRECEDES": "hassubevent", "PART_OF": "partof", "HAS": "hasa", "UNK": "relatedto"}


def _words(c: str) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}'/&+\-]+", " "), " "), lambda w: w != "")


def mentions(texts: DataFrame, key: str, column: str, terms: DataFrame, max_words: int | None = None, small: bool = False) -> DataFrame:
    """``key``, ``term`` for every term (``term``, normalised) that is a run of words of a text, or, in CJK script,
    a run of characters. Texts are cut into runs that meet the terms in an equi-join, so texts and terms are never crossed.
    Runs are as long as the longest term unless ``max_words`` says less; ``small`` terms are a list that does not grow.
    """
    t = texts.where(F.col(key).isNotNull()).select(key, normalize(column).alias("x")).distinct()
    sent = F.broadcast if small else lambda x: x
    known = terms.select("term", _words("term").alias("tw")).distinct()
    longest = known.agg(F.coalesce(F.max(F.size("tw")), F.lit(1)).alias("most")) if max_words is None else texts.sparkSession.range(1).select(F.lit(max_words).alias("most"))
    n = F.size("ws")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.col("most"), n - i + 1), F.lit(1))), lambda k: F.array_join(F.slice("ws", i, k), " "))))
    latin = t.select(key, _words("x").alias("ws")).where(n > 0).join(F.broadcast(longest)).select(key, F.explode(F.array_distinct(runs)).alias("run"))
    latin = latin.join(sent(known.select("term", F.array_join("tw", " ").alias("run"))), "run").select(key, "term")
    wide = known.where(F.col("term").rlike(r"[\x{4e00}-\x{9fff}]")).select("term", F.length("term").alias("n"))
    sizes = wide.select("n").distinct()
    spans = t.where(F.col("x").rlike(r"[\x{4e00}-\x{9fff}]")).join(F.broadcast(sizes.agg(F.collect_set("n").alias("ns"))))
    cut = F.flatten(F.transform("ns", lambda k: F.when(F.length("x") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length("x") - k + 1, F.lit(1))), lambda i: F.substring(F.col("x"), i, k))).otherwise(F.array().cast("array<string>"))))
    cjk = spans.select(key, F.explode(F.array_distinct(cut)).alias("term")).join(sent(wide.select("term")), "term").select(key, "term")
    return latin.unionByName(cjk).distinct()


def merge_relations(edges: DataFrame) -> DataFrame:
    """Relations merged into their group, reversed ones with head and tail exchanged, others left out (``src``, ``rel``, ``dst``, ``weight``)."""
    rel = F.col("rel")
    back = rel.isin(list(REVERSED))
    named = None
    for k, v in (MERGED | REVERSED).items():
        named = F.when(rel == k, v) if named is None else named.when(rel == k, v)
    return edges.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"), named.alias("rel"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst"), "weight").where("rel is not null")


def concept_graph(edges: DataFrame, prune: bool = True) -> DataFrame:
    """Each (src, rel, dst) once with its largest weight, loops left out, and the inverse of each edge; ``prune`` leaves
    out blacklisted concepts and the relation of contexts."""
    e = edges.where("src is not null and dst is not null and src <> dst")
    if prune:
        e = e.where(~F.col("src").isin(BLACKLIST) & ~F.col("dst").isin(BLACKLIST) & (F.col("rel") != "hascontext"))
    e = e.groupBy("src", "rel", "dst").agg(F.max("weight").alias("weight"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.concat("rel", F.lit("*")).alias("rel"), F.col("src").alias("dst"), "weight"))


def concept_relation(rel: str = "rel") -> Column:
    """Relations of candidate edges as relations of concepts; others are related only."""
    out = None
    for k, v in CONCEPT_RELATIONS.items():
        out = F.when(F.col(rel) == k, v) if out is None else out.when(F.col(rel) == k, v)
    return out.otherwise("relatedto")


def simple_graph(graph: DataFrame) -> DataFrame:
    """Undirected edges with the sum of the weights of all edges between two nodes."""
    return graph.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.round(F.sum("weight"), 6).alias("weight"))


def in_degree_normalized(graph: DataFrame) -> DataFrame:
    """weight of each edge over the sum of weights into its head (1e-5 for a sum of 0)."""
    total = graph.groupBy("dst").agg(F.sum("weight").alias("s"))
    return graph.join(total, "dst").select("src", "rel", "dst", F.round(F.col("weight") / F.when(F.col("s") == 0, 1e-5).otherwise(F.col("s")), 6).alias("p"))


def two_hop(graph: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Middle nodes (``node``) on a path of two steps from a node of ``left`` to one of ``right``."""
    e = graph.select("src", "dst").distinct()
    a = e.join(left.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    b = e.join(right.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return a.join(b, "node", "left_semi")


def three_hop(graph: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes (``node``) on a path of three steps from a node of ``left`` to one of ``right``, the ends left out."""
    e = graph.select("src", "dst").distinct()
    first = e.join(left.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("m")).distinct()
    last = e.join(right.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("n")).distinct()
    mid = e.select(F.col("src").alias("m"), F.col("dst").alias("n")).join(first, "m", "left_semi").join(last, "n", "left_semi")
    ends = left.select("node").unionByName(right.select("node")).distinct()
    return mid.select(F.col("m").alias("node")).unionByName(mid.select(F.col("n").alias("node"))).distinct().join(ends, "node", "left_anti")
