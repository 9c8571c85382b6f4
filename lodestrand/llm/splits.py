"""Train, validation and test splits that keep linked records together.

Documents that share a group id, directly or through other documents, form a component; a component lies in one split as
a whole. A persisted table of components is kept up batch by batch: hooking to the smallest neighbour and pointer jumping
merge components, existing components keep their split, new ones fill what the splits lack, and a merge of components of
different splits is quarantined, since no choice of split would keep one of its sides from leaking.

Ids compare trimmed and in lower case. Null, blank and placeholder group ids link nothing; a null document id belongs to
no component. Every table that a round reads again is a file in the checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut

# What stands for a missing group id.
PLACEHOLDERS = ["", "-", "--", "nan", "null", "none", "n/a", "na", "nil", "unknown", "undefined", "?"]
QUARANTINE = "quarantine"
#: Components of more than this share of a batch are placed one by one, largest first; there are at most 1 / SHARE.
SHARE = 0.005
BUCKETS = 512


def clean_id(c: str | Column) -> Column:
    """An id trimmed, in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"^[\s\u00a0\u3000]+|[\s\u00a0\u3000]+$", ""))


def clean_group(c: str) -> Column:
    """A group id trimmed, in lower case; null where it is a placeholder."""
    v = clean_id(c)
    return F.when(~v.isin(PLACEHOLDERS), v)


def star_edges(members: DataFrame, group: str, node: str) -> DataFrame:
    """``a``, ``b``: every node of a group to the group's smallest node, so a group of n nodes gives n - 1 edges."""
    m = members.where(F.col(group).isNotNull() & F.col(node).isNotNull()).select(F.col(group).alias("g"), F.col(node).alias("b")).distinct()
    least = m.groupBy("g").agg(F.min("b").alias("a"))
    return m.join(least, "g").where("a <> b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: every node of an edge with the smallest node of its component.

    Each round hooks every node to its smallest neighbour, jumps pointers to the roots, and contracts the edges to roots;
    a round leaves at most the nodes that are smaller than all their neighbours, so rounds grow with the logarithm of the
    nodes. Neighbour minima are partly aggregated before the shuffle, so a node with many edges costs no large task.
    """
    left = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b"))
    label = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")))
        while True:
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jumped = cut(hook.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            hook = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = hook.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            up = hook.select(F.col("v").alias("root"), F.col("p").alias("r2"))
            label = cut(label.join(up, "root", "left").select("node", F.coalesce("r2", "root").alias("root")))
        a, b = hook.select(F.col("v").alias("a"), F.col("p").alias("ra")), hook.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        left = cut(left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label


@dataclass
class Splits:
    """The splits and their shares; the first is the one rounding goes to."""

    shares: dict[str, float] = field(default_factory=lambda: {"train": 0.8, "validation": 0.1, "test": 0.1})


def assign(comps: DataFrame, have: dict[str, float], splits: Splits) -> DataFrame:
    """``comp``, ``split`` for new components (``comp``, ``w``), filling what the splits lack.

    Components of more than ``SHARE`` of the batch go largest first to the split that lacks most; the rest are laid end to
    end in the order of a hash and cut where each split is full.
    """
    total = comps.agg(F.sum("w")).head()[0] or 0
    whole = total + sum(have.get(s, 0) for s in splits.shares)
    lack = {s: p * whole - have.get(s, 0) for s, p in splits.shares.items()}
    big = {}
    limit = max(total * SHARE, 1)
    for r in comps.where(F.col("w") > limit).orderBy(F.desc("w"), "comp").limit(int(1 / SHARE) + 1).collect():
        s = max(lack, key=lambda k: lack[k])
        big[r["comp"]] = s
        lack[s] -= r["w"]
    rest = comps.where(F.col("w") <= limit)
    lack = {s: max(x, 0.0) for s, x in lack.items()}
    # the smaller splits first, so that rounding goes to the first named
    order = list(splits.shares)[1:] + list(splits.shares)[:1]
    hashed = rest.select("comp", "w", F.xxhash64("comp").alias("h")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    sums = {r["bucket"]: r["w"] for r in hashed.groupBy("bucket").agg(F.sum("w").alias("w")).collect()}
    size = sum(sums.values())
    scale = size / sum(lack.values()) if sum(lack.values()) else 0.0
    before, at = {}, 0
    for b in range(BUCKETS):
        before[b] = at
        at += sums.get(b, 0)
    offset = F.array(*(F.lit(float(before[b])) for b in range(BUCKETS)))
    run = F.sum("w").over(Window.partitionBy("bucket").orderBy("h", "comp").rowsBetween(Window.unboundedPreceding, 0))
    placed = hashed.select("comp", (F.element_at(offset, F.col("bucket") + 1) + run - F.col("w") / 2).alias("at"))
    split, edge = None, 0.0
    for s in order[:-1]:
        edge += lack[s] * scale
        split = F.when(F.col("at") < edge, s) if split is None else split.when(F.col("at") < edge, s)
    out = placed.select("comp", (split.otherwise(order[-1]) if split is not None else F.lit(order[-1])).alias("split"))
    if big:
        out = out.unionByName(comps.sparkSession.createDataFrame(list(big.items()), "comp string, split string"))
    return out


def empty_state(spark) -> DataFrame:
    """A component table without documents: ``doc_id``, ``comp`` (its smallest document), ``split``, ``w`` (rows)."""
    return spark.createDataFrame([], "doc_id string, comp string, split string, w bigint")


def update(state: DataFrame, docs: DataFrame, members: DataFrame, splits: Splits | None = None) -> DataFrame:
    """The component table after a batch.

    ``docs``: ``doc_id`` and ``w``, the rows the batch adds to each document. ``members``: ``doc_id`` and ``group_id`` of
    all links known, old ones included or not. Documents of the table that the batch does not name stay in it.
    """
    splits = splits or Splits()
    new = docs.where("doc_id is not null").groupBy("doc_id").agg(F.sum("w").alias("dw"))
    known = state.select("doc_id", F.col("comp").alias("old"), F.col("split").alias("old_split"), F.col("w").alias("ow"))
    linked = members.where("doc_id is not null").select("doc_id", "group_id").distinct()
    named = new.select("doc_id").unionByName(linked.select("doc_id")).distinct()
    all_docs = cut(known.join(named.join(new, "doc_id", "left"), "doc_id", "full").select("doc_id", F.coalesce("old", "doc_id").alias("c0"), "old_split", (F.coalesce("ow", F.lit(0)) + F.coalesce("dw", F.lit(0))).cast("bigint").alias("w")))
    through = linked.join(all_docs.select("doc_id", "c0"), "doc_id")
    roots = components(star_edges(through, "group_id", "c0"))
    merged = all_docs.join(roots.select(F.col("node").alias("c0"), "root"), "c0", "left").select("doc_id", F.coalesce("root", "c0").alias("comp"), "old_split", "w")
    comps = cut(merged.groupBy("comp").agg(F.sum("w").alias("w"), F.collect_set("old_split").alias("was")))
    kept = comps.where(F.size("was") > 0).select("comp", "w", F.when(F.size("was") > 1, F.lit(QUARANTINE)).otherwise(F.element_at("was", 1)).alias("split"))
    have = {r["split"]: float(r["w"]) for r in kept.groupBy("split").agg(F.sum("w").alias("w")).collect()}
    fresh = assign(comps.where(F.size("was") == 0).select("comp", "w"), have, splits)
    chosen = kept.select("comp", "split").unionByName(fresh)
    return merged.select("doc_id", "comp", "w").join(chosen, "comp").select("doc_id", "comp", "split", "w")


class Store:
    """Component tables kept in a shared folder, one version per batch."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(done)

    def load(self) -> DataFrame:
        """The newest complete version, or an empty table."""
        v = self._versions()
        return self.spark.read.parquet(f"{self.path}/v={v[-1]}") if v else empty_state(self.spark)

    def apply(self, docs: DataFrame, members: DataFrame, splits: Splits | None = None) -> DataFrame:
        """Updates the newest version with a batch, writes the result as the next version and returns it."""
        v = self._versions()
        target = f"{self.path}/v={(v[-1] if v else 0) + 1}"
        update(self.load(), docs, members, splits).write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)
