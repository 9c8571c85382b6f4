"""Operators on tables with one large group: right results without rows for every pair of its members."""

import heapq
import math
import random
import time
from collections import Counter

from conftest import rows
from lodestrand.operators import chains, datasets, graph, retrieval
from lodestrand.plans import pairs, rules
from pyspark.sql import functions as F


def shuffled(spark, df):
    """The rows of ``df`` and the bytes shuffled for them."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = written()
    return rows(df()), written() - before


def test_lexical_units_of_a_large_file(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    names = ["the " + " ".join(r.sample(words, 2)) for _ in range(25)]
    es = [(f"e{i:03}", "f", a, b) for i, (a, b) in enumerate((a, b) for a in names for b in names)]
    us = [(f"u{i:04}", "f", "the " + " ".join(r.sample(words, 3))) for i in range(700)]
    e = spark.createDataFrame(es, "edge string, file_name string, source_text string, target_text string")
    u = spark.createDataFrame(us, "unit_id string, file_name string, content string")
    got, size = shuffled(spark, lambda: datasets.lexical_units(e, u).select("edge", "rank", "unit_id", "score"))

    def share(a, c):
        x, y = set(a.split()), set(c.split())
        return 1.2 * len(x & y) / min(len(x), len(y))

    want = []
    for i, _, a, b in es:
        s = sorted((-round(share(a, c) + share(b, c) + 0.6 * (a in c) + 0.6 * (b in c), 6), k) for k, _, c in us)[:5]
        want += [(i, n + 1, k, -x) for n, (x, k) in enumerate(s)]
    assert got == want
    assert size < 3_000_000


def test_bm25_of_many_documents(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(r.sample(words, r.randint(0, 30)))) for i in range(3000)]
    docs = spark.createDataFrame([*texts, (7, "w1 w2"), (8, None)], "doc_id bigint, text string")
    q = spark.createDataFrame([*texts[::10], (10, "w3")], "query_id bigint, text string")
    got, size = shuffled(spark, lambda: retrieval.bm25(docs, q, 4).select("query_id", "rank", "doc_id", F.round("score", 4)))
    rows_ = [(i, set(t.split())) for i, t in [*texts, (7, "w1 w2")]]
    mean = sum(len(t) for _, t in rows_) / len(rows_)
    df = Counter(w for _, t in rows_ for w in t)
    idf = {w: math.log(1 + (len(rows_) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    asked = {}
    for i, t in [*texts[::10], (10, "w3")]:
        asked.setdefault(i, Counter()).update(set(t.split()))
    want = []
    for i in list(asked)[:12]:
        s = Counter()
        for k, t in rows_:
            s[k] += sum(asked[i][w] * idf[w] for w in t) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(t) / mean))
        best = sorted((-round(x, 6), k) for k, x in s.items() if x > 0)[:4]
        want += [(i, n + 1, k, round(-x, 4)) for n, (x, k) in enumerate(best)]
    first = set(list(asked)[:12])
    assert [x for x in got if x[0] in first] == want
    assert size < 4_000_000


def test_edge_evidence_of_unknown_and_empty_documents(spark, small, tmp_path):
    for t in ("evidence_units", "evidence_chunks"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    e = spark.read.parquet(f"{small}/candidate_edges.parquet").where("source_node_id is not null and target_node_id is not null and source_chunk_id is not null").limit(1)
    e = e.unionByName(e.withColumn("doc_id", F.lit(None).cast("string"))).unionByName(e.withColumn("doc_id", F.lit("")))
    e.withColumn("rel_props", F.lit(None).cast(e.schema["rel_props"].dataType)).coalesce(1).write.parquet(str(tmp_path / "candidate_edges.parquet"))
    got = pairs.edge_evidence(spark, str(tmp_path)).collect()
    assert len({r["doc"] for r in got}) == 3
    assert len(got) == len(set(got))


def test_chain_search_drops_what_never_arrives(spark):
    es = [("d", f"n{i}", r, f"n{j}", "EVENT", "EVENT", -0.1) for i in range(4) for j in range(4) if i != j for r in ("A", "B", "C", "D", "E", "F")]
    e = spark.createDataFrame([*es, ("d", "x", "R", "y", "EVENT", "OUTCOME", 0.5), ("f", "x", "R", "y", "EVENT", "OUTCOME", 0.5)], "doc string, src string, rel string, dst string, a string, b string, step double")
    began = time.time()
    assert rows(chains.penalised_chains(e).select("doc", "rank", "path", "missing")) == [("d", 1, ["x", "y"], 0), ("f", 1, ["x", "y"], 0)]
    assert time.time() - began < 40


def test_chain_search_of_a_large_document(spark):
    """Seven levels of forty nodes, every node before all of the next: of four billion chains alike, the first by path."""
    es = [("d", f"{'abcdefg'[k]}{i:02}", "R", f"{'abcdefg'[k + 1]}{j:02}", "EVENT", "OUTCOME" if k == 5 else "EVENT", -0.1) for k in range(6) for i in range(40) for j in range(40)]
    e = spark.createDataFrame(es, "doc string, src string, rel string, dst string, a string, b string, step double")
    began = time.time()
    got = rows(chains.penalised_chains(e).select("rank", F.array_join("path", ">"), "missing", "score"))
    assert got == [(n + 1, f"a00>b00>c00>d00>e00>f00>g{n:02}", 0, round(-6 * 0.1 - 15 * 0.05, 6)) for n in range(8)]
    assert time.time() - began < 40


def test_chain_search_takes_states_in_order():
    """As a search that walks all states, in the same order."""
    r = random.Random(4)

    def plain(succ, starts, most, max_hops, hop, again, stop):
        heap, done = [(0, (s,), (), ()) for s in sorted(starts)], []
        while heap and len(done) < most:
            cost, path, rels, layers = heapq.heappop(heap)
            if rels and layers[-1] == stop:
                done.append((cost, path, rels, layers))
            for t, q, a, b, w in succ.get(path[-1], ()) if len(rels) < max_hops else ():
                heapq.heappush(heap, (cost - w + hop * len(rels) + (again if t in path else 0), (*path, t), (*rels, q), (*layers[:-1], a, b)))
        return done

    found = 0
    for _ in range(1500):
        gains = r.choice([[-1], [0], [2], [-5, 3], range(-9, 9)])
        pairs_ = {(f"n{r.randrange(6)}", f"n{r.randrange(6)}", r.choice("RS")) for _ in range(r.randint(1, 12))}
        succ = {}
        for s, t, q in sorted(pairs_):
            succ.setdefault(s, []).append((t, q, "EVENT", r.choice(["EVENT", "STATE", "OUTCOME"]), r.choice(gains)))
        x = (succ, succ.keys() - {t for _, t, _ in pairs_} or succ.keys(), r.choice([1, 5, 40]), r.choice([1, 3, 5]), r.choice([0, 1]), r.choice([0, 1, 4]), "OUTCOME")
        want = plain(*x)
        assert chains._first_finished(*x) == want
        found += len(want)
    assert found > 4000


def test_shared_nodes_of_a_large_document(spark):
    r = random.Random(3)
    es = [("big", f"n{r.randrange(900)}", f"n{r.randrange(900)}") for _ in range(1500)] + [("a", "x", "y"), ("a", "z", "y"), ("a", "y", "w"), ("b", "x", "y"), ("c", "x", "x"), ("c", "y", "x")]
    ss = [("big", f"n{i}") for i in range(0, 900, 2)] + [("a", "x"), ("a", "z"), ("b", "x"), ("c", "x"), ("c", "y"), ("c", "q")]
    e, s = spark.createDataFrame(es, "doc string, src string, dst string"), spark.createDataFrame(ss, "doc string, src string")
    want = []
    for d in {x[0] for x in es}:
        succ = {}
        for g, a, b in es:
            if g == d:
                succ.setdefault(a, set()).add(b)
        reach = {}
        for g, a in ss:
            if g == d:
                seen, todo = set(), [a]
                while todo:
                    new = succ.get(todo.pop(), set()) - seen
                    seen |= new
                    todo += new
                reach[a] = seen
        met = Counter(x for xs in reach.values() for x in xs)
        want += [(d, a, n) for a, xs in reach.items() if (n := sum(met[x] > 1 for x in xs))]
    for width in (1 << 29, 1 << 14):
        got, size = shuffled(spark, lambda: graph.shared_below(e, s, "doc", width))
        assert got == sorted(want)
        assert size < 200_000


def test_shared_nodes_of_a_document_in_many_batches(spark):
    e = spark.createDataFrame([(d, f"n{i}", f"n{i + 1}") for d in ("a", "b", "c") for i in range(30)], "doc string, src string, dst string")
    s = spark.createDataFrame([(d, f"n{i}") for d in ("a", "b", "d") for i in (0, 10, 20)], "doc string, src string")
    rows_of = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_of)
    spark.conf.set(rows_of, "7")
    try:
        got = rows(graph.shared_below(e, s, "doc"))
    finally:
        spark.conf.set(rows_of, before)
    assert got == [(d, f"n{i}", 20 if i < 20 else 10) for d in ("a", "b") for i in (0, 10, 20)]


def test_priors_shuffle_no_texts_of_edges(spark, small, tmp_path):
    (tmp_path / "causal_nodes.parquet").symlink_to(f"{small}/causal_nodes.parquet")
    e = spark.read.parquet(f"{small}/candidate_edges.parquet")
    text = F.concat(*(F.sha2(F.concat_ws("|", "source_node_id", "target_node_id", "copy", F.lit(i)), 512) for i in range(8)))
    e.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("evidence_text", text).drop("copy").write.parquet(str(tmp_path / "candidate_edges.parquet"))
    got, size = shuffled(spark, lambda: rules.node_first_prior(spark, str(tmp_path)))
    assert got == rows(rules.node_first_prior(spark, small))
    assert size < 1_000_000
    assert "ExistingRDD" not in rules.node_first_prior(spark, small)._jdf.queryExecution().toString()  # no checkpoint of edges on disk


def test_cyclic_chains(spark):
    es = [("a", "x", "y"), ("a", "y", "x"), ("b", "x", "y"), ("b", "y", "z"), ("b", "x", "z"), ("c", "x", "x"), ("d", "x", None), (None, "x", "x"), *(("l", f"n{i}", f"n{i + 1}") for i in range(3000)), ("l", "n3000", "n0")]
    assert rows(graph.cyclic(spark.createDataFrame(es, "g string, src string, dst string"), "g")) == [("a",), ("c",), ("l",)]
