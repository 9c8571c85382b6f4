"""Graph operators over edge tables: expansion, closure, components of a view, orphans, deletes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut, fan_out


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``a``, ``b``: every edge in both directions, once."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Q08: ``node``, ``hop``: nodes within ``k`` undirected steps of the seeds (``node``), with their distance.

    Each step joins the frontier with the edges and leaves out what was reached before, so a node is expanded once.
    """
    both = cut(undirected(edges))
    reached = cut(seeds.select("node").where("node is not null").distinct().withColumn("hop", F.lit(0)))
    frontier = reached
    for step in range(1, k + 1):
        nxt = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(reached, "node", "left_anti")
        frontier = cut(nxt.withColumn("hop", F.lit(step)))
        reached = reached.unionByName(frontier)
    return reached


def closure(edges: DataFrame, keys: list[str], depth: int | None = None) -> DataFrame:
    """``keys``, ``src``, ``node``: everything reachable in up to ``depth`` directed steps, in any number without one; a node on
    a cycle reaches itself."""
    e = cut(edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct())
    found = e.withColumnRenamed("dst", "node")
    frontier = found
    for _ in count() if depth is None else range(depth - 1):
        hop = e.withColumnRenamed("src", "mid").withColumnRenamed("dst", "node")
        nxt = frontier.withColumnRenamed("node", "mid").join(hop, [*keys, "mid"]).select(*keys, "src", "node").distinct()
        frontier = cut(nxt.join(found, [*keys, "src", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def _bucketed(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """``df`` with the bucket ``__b`` of its ``key``; the rows of a key are in one bucket."""
    n = max(df.count() // rows, df.sparkSession.sparkContext.defaultParallelism)
    return df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def _components(succ: list[list[int]]) -> tuple[list[int], int]:
    """The strongly connected component of each node, numbered so that a component comes after all that it reaches; how many there are."""
    n = len(succ)
    low, comp, stack, count_, clock = [0] * n, [-1] * n, [], 0, 0
    for root in range(n):
        if low[root]:
            continue
        clock += 1
        low[root] = clock
        stack.append(root)
        work = [(root, clock, iter(succ[root]))]
        while work:
            v, at, rest = work[-1]
            for x in rest:
                if not low[x]:
                    clock += 1
                    low[x] = clock
                    stack.append(x)
                    work.append((x, clock, iter(succ[x])))
                    break
                if comp[x] < 0:
                    low[v] = min(low[v], low[x])
            else:
                work.pop()
                if low[v] == at:
                    while True:
                        x = stack.pop()
                        comp[x] = count_
                        if x == v:
                            break
                    count_ += 1
                elif work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return comp, count_


def _shared_below(edges: list[tuple[str, str]], sources: set[str], width: int) -> dict[str, int]:
    """For each of ``sources`` how many of the nodes it reaches another of them reaches too; none is left out."""
    ids: dict[str, int] = {}
    for a, b in edges:
        ids.setdefault(a, len(ids))
        ids.setdefault(b, len(ids))
    succ: list[list[int]] = [[] for _ in ids]
    for a, b in edges:
        succ[ids[a]].append(ids[b])
    comp, n = _components(succ)
    below: list[set[int]] = [set() for _ in range(n)]
    for v, ts in enumerate(succ):
        below[comp[v]].update(comp[t] for t in ts)  # a component with a cycle is below itself
    members: list[list[int]] = [[] for _ in range(n)]
    for place, v in enumerate(sorted(range(len(comp)), key=comp.__getitem__)):
        members[comp[v]].append(place)
    own = [0] * n
    for s in sources:
        if s in ids:
            own[comp[ids[s]]] += 1
    found = [0] * n
    step = max(64, width // max(n, 1))
    for lo in range(0, len(comp), step):
        reach, once, twice = [0] * n, 0, 0
        for c in range(n):
            r = 0
            for x in below[c]:
                if x != c:
                    r |= reach[x]
                a, z = max(members[x][0] - lo, 0), min(members[x][-1] + 1 - lo, step)
                if a < z:
                    r |= ((1 << (z - a)) - 1) << a
            reach[c] = r
            if own[c]:
                twice |= r if own[c] > 1 else once & r
                once |= r
        for c in range(n):
            if own[c]:
                found[c] += (reach[c] & twice).bit_count()
    return {s: found[comp[ids[s]]] for s in sources if s in ids}


def shared_below(edges: DataFrame, sources: DataFrame, key: str, width: int = 1 << 29) -> DataFrame:
    """``key``, ``src``, ``shared``: for each of the ``sources`` (``key``, ``src``) the number of nodes downstream, in any number of
    directed steps of its group, that another source of the group reaches too, where there is one. A node on a cycle reaches itself.

    Groups are whole in one task, which holds one at a time. Inside one, nodes that reach each other are one component, and a
    component's nodes downstream are bits of a number, ``width`` bits at a time; pairs of nodes are never rows.
    """
    both = edges.select(key, "src", "dst").where("src is not null and dst is not null").unionByName(sources.select(key, "src", F.lit(None).cast("string").alias("dst"))).where(F.col(key).isNotNull())

    def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, es, ss = None, [], set()

        def counted() -> list[tuple[str, str, int]]:
            return [(at, s, n) for s, n in _shared_below(es, ss, width).items() if n]

        def batch(out: list[tuple[str, str, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], [key, "src", "shared"])

        for b in batches:
            out = []
            for g, s, t in zip(*(c.to_pylist() for c in b.columns)):
                if g != at:
                    out += counted()
                    at, es, ss = g, [], set()
                if t is None:
                    ss.add(s)
                else:
                    es.append((s, t))
            yield batch(out)
        yield batch(counted())

    return fan_out(both, 3, key).sortWithinPartitions(key).mapInArrow(count_shared, f"{key} string, src string, shared bigint")


def cyclic(edges: DataFrame, key: str) -> DataFrame:
    """The ``key`` of each group of edges that has a directed cycle. Groups are whole in one task, many to a bucket."""
    e = edges.select(key, "src", "dst").where(f"{key} is not null and src is not null and dst is not null")

    def with_cycle(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict[str, list] = {}
        for g, s, t in zip(pdf[key], pdf["src"], pdf["dst"]):
            groups.setdefault(g, []).append((s, t))
        found = []
        for g, es in groups.items():
            ids = {x: i for i, x in enumerate({x for st in es for x in st})}
            succ: list[list[int]] = [[] for _ in ids]
            for s, t in es:
                succ[ids[s]].append(ids[t])
            if _components(succ)[1] < len(ids) or any(s == t for s, t in es):
                found.append(g)
        return pd.DataFrame({key: pd.Series(found, dtype=object)})

    return _bucketed(e, key).groupBy("__b").applyInPandas(with_cycle, f"{key} string")


def roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Sources that are no target."""
    s = edges.select(*keys, F.col("src").alias("node")).where("node is not null").distinct()
    t = edges.select(*keys, F.col("dst").alias("node")).where("node is not null").distinct()
    return s.join(t, [*keys, "node"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (``node_id``) at neither end of an edge to another node."""
    ends = undirected(edges).select(F.col("a").alias("node_id")).distinct()
    return nodes.join(ends, "node_id", "left_anti")


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ``gone`` nodes (``node_id``) and the edges at them."""
    g = gone.select("node_id").distinct()
    left = edges.join(g.withColumnRenamed("node_id", "src"), "src", "left_anti").join(g.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(g, "node_id", "left_anti"), left
