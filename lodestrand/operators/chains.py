"""Chain search over small per-document edge sets: path enumeration, best-first search, branch decisions."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand import lexicons as lx
from lodestrand.functions.text import sigmoid
from lodestrand.session import cut, fan_out

STOP_LAYERS = ["OUTCOME", "CONSEQUENCE"]


def top_edges(edges: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` best edges of each document, loops left out."""
    order = Window.partitionBy("doc").orderBy(F.desc("quality"), "src", "rel", "dst")
    e = edges.where("doc is not null and src <> dst").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    one = e.groupBy("doc", "src", "dst").agg(F.max("quality").alias("score"), F.max(F.upper("target_layer").isin(STOP_LAYERS).cast("int")).alias("stop"))
    return one.withColumn("stop", F.coalesce("stop", F.lit(0)))


def dfs_chains(edges: DataFrame, depth: int = 4) -> DataFrame:
    """Paths from the roots of a document (all sources where there is none), by steps of one join each.

    A path ends at a node without successors, at a stop node, or at the depth; it repeats no node, and one whose every
    further step would repeat a node is dropped. ``doc``, ``path`` (array), ``hops``, ``score`` (mean).
    """
    e = cut(edges.select("doc", "src", "dst", "score", "stop"))
    targets = e.select("doc", F.col("dst").alias("src")).distinct()
    sources = e.select("doc", "src").distinct()
    rooted = sources.join(targets, ["doc", "src"], "left_anti")
    rootless = sources.join(rooted.select("doc").distinct(), "doc", "left_anti")
    live = rooted.unionByName(rootless).select("doc", F.col("src").alias("last"), F.array("src").alias("path"), F.lit(0.0).alias("total"))
    going = sources.select("doc", F.col("src").alias("dst"), F.lit(1).alias("more"))
    out = None
    for k in range(1, depth + 1):
        step = live.join(e.withColumnRenamed("src", "last"), ["doc", "last"]).where(~F.array_contains("path", F.col("dst")))
        step = step.join(going, ["doc", "dst"], "left").select("doc", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"), (F.col("total") + F.col("score")).alias("total"), "stop", F.coalesce("more", F.lit(0)).alias("more"))
        step = cut(step)
        ends = step.where(F.lit(k == depth) | (F.col("stop") == 1) | (F.col("more") == 0)).select("doc", "path", F.lit(k).alias("hops"), F.round(F.col("total") / k, 6).alias("score"))
        out = ends if out is None else out.unionByName(ends)
        live = step.where("stop = 0 and more = 1").select("doc", "last", "path", "total")
    return out


def _missing(layers: list[str]) -> int:
    """Layers of the order between the first and last of a chain that it leaves out."""
    seen = {x for x in layers if x in lx.LAYERS}
    if not seen:
        return 0
    at = [i for i, x in enumerate(lx.LAYERS) if x in seen]
    return at[-1] - at[0] + 1 - len(seen)


Edge = tuple[str, str, str, str, int]


def _ahead(succ: dict[str, list[Edge]], max_hops: int, hop: int, again: int, stop: str) -> list[dict[str, int]]:
    """For each number of steps made, and each node from which the steps left arrive at ``stop``: how far the cost has to rise on the way.

    A node met before is not known here and costs nothing (or its gain), so this is never more than the true rise.
    """
    ahead: list[dict[str, int]] = [{} for _ in range(max_hops + 1)]
    for k in reversed(range(max_hops)):
        below, base = ahead[k + 1], hop * k + min(again, 0)
        for s, out in succ.items():
            rises = [(0 if b == stop or below[t] < 0 else below[t]) - w for t, _, _, b, w in out if b == stop or t in below]
            if rises:
                ahead[k][s] = base + min(rises)
    return ahead


def _first_finished(succ: dict[str, list[Edge]], starts: Iterable[str], most: int, max_hops: int, hop: int, again: int, stop: str) -> list[tuple]:
    """The first ``most`` finished states (cost, path, relations, layers) of the best-first search, in its order, without walking the others.

    A state is taken after all that the largest state on its way is taken after; from there on, the largest of the rest decides, and so
    on. So the search's order is that of these largest states, and ``_ahead`` bounds those to come: only what may be next is looked at.
    """
    ahead = _ahead(succ, max_hops, hop, again, stop)
    ranked: dict[tuple[int, str], list[tuple]] = {}
    heap: list[tuple] = []
    ids = count()

    def steps(k: int, path: tuple) -> list[tuple]:
        """Steps on from a path as (rise, node, relation, layers, cost), the one that may finish first before the others."""
        at = (k, path[-1])
        if at not in ranked:
            below = ahead[k + 1]
            ranked[at] = sorted((hop * k - w + (0 if b == stop else max(0, below[t])), t, r, a, b, hop * k - w) for t, r, a, b, w in succ.get(path[-1], ()) if b == stop or t in below)
        out = ranked[at]
        if again and any(x[1] in path for x in out):
            out = sorted((v + again, t, r, a, b, c + again) if t in path else (v, t, r, a, b, c) for v, t, r, a, b, c in out)
        return out

    def wait(state: tuple, largest: tuple, out: list[tuple], i: int) -> None:
        if i < len(out):
            cost, path, rels, layers = state
            v, t, r, a, b, _ = out[i]
            top = (cost + v, (*path, t), (*rels, r), (*layers[:-1], a, b))
            heapq.heappush(heap, ((*(x for x in largest if x > top), top), next(ids), state, largest, out, i))

    for s in starts:
        if s in ahead[0]:
            heap.append((((max(0, ahead[0][s]), (s,), (), ()),), next(ids), (0, (s,), (), ()), (), (), -1))
    heapq.heapify(heap)
    done: list[tuple] = []
    while heap and len(done) < most:
        key, _, state, largest, out, i = heapq.heappop(heap)
        if i >= 0:
            wait(state, largest, out, i + 1)
            state = (state[0] + out[i][5], *key[-1][1:])
            if out[i][4] == stop:
                done.append(state)
        k = len(state[2])
        if k < max_hops:
            wait(state, (*(x for x in largest if x > state), state), steps(k, state[1]), 0)
    return done


def penalised_chains(edges: DataFrame, top_k: int = 8, max_hops: int = 6, hop: float = 0.05, again: float = 0.40, left_out: float = 0.50, stop: str = "OUTCOME") -> DataFrame:
    """Best-first search in each document, over all its edges, from its roots (all sources where there is none).

    A step gains ``step`` (the edge's weighted probabilities less the penalties of its layers, support, direction and time) and costs
    ``hop`` for each step before it and ``again`` for a node met before. A chain is finished whenever it arrives at the
    ``stop`` layer, and may go on; the search ends when five times ``top_k`` are finished or nothing is left. Finished chains lose
    ``left_out`` for every layer they leave out; of equal chains (by their edges) the best counts. States are taken by score, then path;
    scores are whole billionths, so that equal ones are equal in whatever order they were summed.
    Edges have ``doc``, ``src``, ``rel``, ``dst``, ``a`` and ``b`` (layers), ``step``; ``doc``, ``rank``, ``path``, ``missing``, ``score``.
    A document's edges are in one task, which holds one document at a time; see ``_first_finished`` for how few of its states are looked at.
    """
    unit = 10**9
    hop_, again_, left_ = (round(x * unit) for x in (hop, again, left_out))

    def search(doc: str | None, es: list[tuple]) -> list[tuple]:
        succ: dict[str, list[Edge]] = {}
        for s, *e in es:
            succ.setdefault(s, []).append(tuple(e))
        starts = succ.keys() - {e[1] for e in es} or succ.keys()
        best: dict[tuple, tuple] = {}
        done = [(c + left_ * (gone := _missing(list(layers))), path, rels, gone) for c, path, rels, layers in _first_finished(succ, starts, 5 * top_k, max_hops, hop_, again_, stop)]
        for cost, path, rels, gone in sorted(done):
            best.setdefault((path, rels), (path, gone, round(-cost / unit, 6)))
        return [(doc, n, *x) for n, x in enumerate(list(best.values())[:top_k], 1)]

    kinds = {"doc": pa.string(), "rank": pa.int32(), "path": pa.list_(pa.string()), "missing": pa.int32(), "score": pa.float64()}

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, es, names = None, [], {}

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds.values())], list(kinds))

        for x in batches:
            found = []
            for doc, *ends, w in zip(*(c.to_pylist() for c in x.columns)):
                if doc != at:
                    found += search(at, es)
                    at, es, names = doc, [], {}
                es.append((*(names.setdefault(n, n) for n in ends), round(w * unit)))
            yield batch(found)
        yield batch(search(at, es))

    e = edges.select("doc", "src", "dst", "rel", "a", "b", "step")
    return fan_out(e, 3, "doc").sortWithinPartitions("doc").mapInArrow(search_all, "doc string, rank int, path array<string>, missing int, score double")


def branch_scores(branches: DataFrame, w: dict[str, float] = lx.BRANCH_WEIGHTS, gap: float = 0.15) -> DataFrame:
    """Probability, rank and decision of each branch of a file.

    Branches have ``file_name``, ``branch``, the features in ``w`` and ``violations``, ``cycle``, ``conflict``. The best is selected;
    a gap to the second below ``gap`` asks for the severity fallback; a single branch's gap is its probability.
    """
    raw = F.lit(0.0)
    for k, v in w.items():
        raw = raw + v * F.coalesce(F.col(k), F.lit(0.0))
    penalty = 0.8 * F.col("violations") + 1.2 * F.col("cycle") + 0.6 * F.col("conflict")
    p = branches.withColumn("p", F.round(sigmoid(raw - penalty), 6))
    order = Window.partitionBy("file_name").orderBy(F.desc("p"), "branch")
    r = p.withColumns({"rank": F.row_number().over(order), "second": F.lead("p").over(order)})
    return r.withColumn("gap", F.when(F.col("rank") == 1, F.round(F.col("p") - F.coalesce("second", F.lit(0.0)), 6))).withColumn("fallback", F.col("gap") < gap)
