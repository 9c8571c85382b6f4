"""Documents laid into containers of fixed capacity.

Items go to shards of bounded size, like ones together: they are ordered by the smallest hashes of their token ids, which
two items share as often as they are alike, and every ``SHARD_ITEMS`` of that order are a shard. In a shard a BM25 inverted
index over the items' token ids returns, for the largest unused item as a seed, its unused neighbours by all of its
terms; they fill the seed's container greedily, the most alike first, and what space is left goes to the largest unused
items that fit. The containers a shard leaves slack are taken apart and packed again with those of other shards, by other
hashes, ``LEVELS`` times at most; a shard never grows, so the last level may leave a slack container a shard.

An item larger than the capacity is cut into full containers and a rest; no other is cut. Items without tokens take no
space and lie in the container their shard fills last; if there is none, in one of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.ordering import numbered
from lodestrand.session import cut

#: Items of a shard, times the slack containers are packed again, and the fill below which a container is slack.
SHARD_ITEMS, LEVELS, SLACK = 2000, 4, 0.98
K1, B = 1.2, 0.75


class Bm25:
    """An inverted index over token ids."""

    def __init__(self, docs: list[np.ndarray]):
        self.sizes = np.array([len(d) for d in docs], float)
        terms, owners, counts = [], [], []
        for i, d in enumerate(docs):
            t, c = np.unique(d, return_counts=True)
            terms.append(t)
            counts.append(c)
            owners.append(np.full(len(t), i))
        self.own_terms, self.own_counts = terms, counts
        term = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.vocabulary, begin, df = np.unique(term[order], return_index=True, return_counts=True)
        self.begin, self.df = begin, df
        owner, tf = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64), np.concatenate(counts)[order] if counts else np.zeros(0)
        mean = max(self.sizes.mean(), 1.0) if len(docs) else 1.0
        n = len(docs)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.sizes[owner] / mean)) if len(owner) else np.zeros(0)
        self.owner, self.weight = owner, weight * np.repeat(self.idf, df)
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused items that share a term with the seed, the highest score first."""
        at = np.searchsorted(self.vocabulary, self.own_terms[seed])
        size = self.df[at]
        # the places of all the terms' postings, one stretch after the other
        places = np.arange(size.sum()) + np.repeat(self.begin[at] - np.cumsum(size) + size, size)
        score = np.bincount(self.owner[places], self.weight[places], self.n)
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))]


def pack_shard(docs: list[np.ndarray], sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0 in the order they are filled."""
    index = Bm25(docs)
    unused = sizes > 0
    at = np.full(len(sizes), -1)
    by_size = np.argsort(-sizes, kind="stable")
    # the largest unused item of at most s tokens: items by size, with pointers over the used ones
    ascending = np.argsort(sizes, kind="stable")
    ordered = sizes[ascending]
    skip = np.arange(len(sizes) + 1)

    def largest(space: int) -> int:
        j = int(np.searchsorted(ordered, space, "right"))
        path = []
        while j > 0 and not unused[ascending[j - 1]]:
            path.append(j)
            j = skip[j] if skip[j] < j else j - 1
        for p in path:
            skip[p] = j
        return int(ascending[j - 1]) if j > 0 else -1

    number = 0
    for seed in by_size:
        if not unused[seed]:
            continue
        unused[seed] = False
        at[seed] = number
        space = capacity - int(sizes[seed])
        if space > 0:
            for i in index.neighbours(seed, unused):
                if sizes[i] <= space:
                    unused[i] = False
                    at[i] = number
                    space -= int(sizes[i])
                    if space == 0:
                        break
        while space > 0 and (i := largest(space)) >= 0:
            unused[i] = False
            at[i] = number
            space -= int(sizes[i])
        number += 1
    at[at < 0] = max(number - 1, 0)
    return at


def items(tokens: DataFrame, key: str, ids: str, capacity: int) -> DataFrame:
    """``key``, ``part`` (from 0), ``start`` (token), ``size``, ``ids`` of every item; only what exceeds the capacity is cut."""
    rows = tokens.where(F.col(key).isNotNull()).select(key, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    last = F.greatest(F.ceil(F.size("ids") / capacity).cast("int") - 1, F.lit(0))
    cutup = rows.select(key, "ids", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    start = F.col("part") * capacity
    return cutup.select(key, "part", start.alias("start"), F.slice("ids", start + 1, F.lit(capacity)).alias("ids")).select(key, "part", "start", F.size("ids").alias("size"), "ids")


def _packer(key: str, capacity: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs a shard; the token ids stay with the items of slack containers only, since no other is packed again."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([key, "part"], kind="stable").reset_index(drop=True)
        sizes = group["size"].to_numpy(np.int64)
        at = pack_shard([np.asarray(x, np.int64) for x in group["ids"]], sizes, capacity)
        fill = np.bincount(at, sizes, at.max() + 1)
        slack = (fill < SLACK * capacity)[at]
        group["container"] = [f"{level}-{group['shard'].iat[0]}-{c}" for c in at]
        group["slack"] = slack
        group["ids"] = [x if y else None for x, y in zip(group["ids"], slack)]
        return group[[key, "part", "start", "size", "ids", "container", "slack"]]

    return run


def _likeness(level: int) -> list[Column]:
    """The smallest and the second smallest hash of an item's token ids."""
    hashes = F.array_sort(F.transform(F.array_distinct("ids"), lambda x: F.xxhash64(F.lit(level), x)))
    return [F.get(hashes, F.lit(0)).alias("h1"), F.get(hashes, F.lit(1)).alias("h2")]


def pack(tokens: DataFrame, key: str, ids: str = "ids", capacity: int = 4096, shard_items: int = SHARD_ITEMS, levels: int = LEVELS) -> DataFrame:
    """``key``, ``part``, ``start``, ``size``, ``container``: where every item, and every part of an oversized one, lies.

    ``key`` must name one row.
    """
    kind = tokens.schema[key].dataType.simpleString()
    done = []
    rows = items(tokens, key, ids, capacity)
    place = [key, "part", "start", "size", "container"]
    for level in range(levels):
        sketched = cut(rows.select(key, "part", "start", "size", "ids", *_likeness(level)))
        if level == 0:
            full = F.concat_ws("-", F.lit("full"), F.col(key).cast("string"), "part")
            done.append(sketched.where(F.col("size") == capacity).select(key, "part", "start", "size", full.alias("container")))
            sketched = sketched.where(F.col("size") < capacity)
        order = numbered(sketched.select(key, "part", "h1", "h2"), ["h1", "h2", key, "part"])
        shard = order.select(key, "part", F.floor((F.col("rn") - 1) / shard_items).alias("shard"))
        packed = cut(sketched.drop("h1", "h2").join(shard, [key, "part"]).groupBy("shard").applyInPandas(_packer(key, capacity, level), f"`{key}` {kind}, part int, start int, size int, ids array<int>, container string, slack boolean"))
        slack = packed.where("slack")
        if level == levels - 1 or slack.isEmpty() or packed.agg(F.countDistinct(F.split("container", "-")[1])).head()[0] < 2:
            done.append(packed.select(place))
            break
        done.append(packed.where("not slack").select(place))
        rows = slack.drop("container", "slack")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
