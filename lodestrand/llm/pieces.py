"""Oversized texts as overlapping pieces cut at natural boundaries.

Every place a piece may end is a boundary. A piece that ends at a boundary decides where the next one begins (the overlap
before it, or the first boundary in the first half of the overlap) and so the farthest boundary the next piece may reach: the
boundary's successor. Squaring the successor table gives the cuts of all texts in parallel, in rounds that grow with the
logarithm of the pieces of the longest text.

Boundaries are ranked: paragraph or line ends, sentence ends, clause marks, white space, any other mark. Within reach the
farthest of the highest rank that fills at least half a piece is taken, else the farthest of any. A stretch without a
boundary longer than a piece is cut by length. Offsets count characters; a text of at most the limit is one piece; null
and blank texts have none. All pieces of one text are worked out in one group, which is as large as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut

# White space and marks a piece may end at.
SPACE = r"\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = r".!?;:,。！？；：，、।…"
STOPS = [".", "!", "?", "。", "！", "？", "।", "…"]
WIDE_STOPS = ["。", "！", "？", "।", "…"]
CLAUSES = [";", ":", ",", "；", "：", "，", "、"]
CLOSERS = ["”", "’", "」", "』", "）", ")", '"', "'", "»"]


def boundaries(df: DataFrame, key: str, column: str, limit: int, overlap: int) -> DataFrame:
    """``key``, ``pos``, ``rank`` (0 for a cut by length), ``forced`` (of the whole text) of every boundary, text end included."""
    parts = F.split(F.col(column), rf"(?<=[{SPACE}{MARKS}])", -1)
    seg = df.select(key, F.posexplode(parts).alias("i", "s")).select(key, "i", F.length("s").alias("n"), F.substring("s", -1, 1).alias("last"), F.substring("s", 1, 1).alias("first"))
    order = Window.partitionBy(key).orderBy("i")
    seg = seg.select(key, "n", "last", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("pos"), F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"), F.sum("n").over(Window.partitionBy(key)).alias("size"))
    blank: Column = F.col("last").rlike(f"^[{SPACE}]$")
    mark: Column = F.col("last").rlike(f"^[{MARKS}]$")
    rank = (
        F.when(F.col("pos") == F.col("size"), 6)
        .when(F.col("last").isin("\n", "\r", "\u2028", "\u2029"), 5)
        .when(F.col("last").isin(WIDE_STOPS) & ~F.col("after").isin(CLOSERS + WIDE_STOPS), 4)
        .when(blank & F.col("before").isin(STOPS), 4)
        .when(F.col("last").isin([c for c in CLAUSES if ord(c) > 127]), 3)
        .when(blank & F.col("before").isin(CLAUSES), 3)
        .when(blank, 2)
        .otherwise(1)
    )
    stretch = F.col("n") - F.when(blank | mark, 1).otherwise(0)
    marked = seg.select(key, "pos", "n", rank.alias("rank"), F.max((stretch > limit).cast("int")).over(Window.partitionBy(key)).alias("forced"))
    step = limit - overlap
    steps = F.when(F.col("n") > step, F.transform(F.sequence(F.lit(1), F.floor((F.col("n") - 1) / step).cast("int")), lambda k: F.struct((F.col("pos") - F.col("n") + k * step).cast("bigint").alias("pos"), F.lit(0).alias("rank"))))
    every = F.concat(F.array(F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("rank").alias("rank"))), F.coalesce(steps, F.array().cast("array<struct<pos:bigint,rank:int>>")))
    return marked.where("n > 0").select(key, "forced", F.explode(every).alias("b")).select(key, "b.pos", "b.rank", "forced")


def successors(bounds: DataFrame, key: str, limit: int, overlap: int) -> DataFrame:
    """``key``, ``pos``, ``start`` (of the piece after the boundary), ``nxt`` (its end), ``forced``; the text's end has none.

    One ordered pass over each text: boundaries and the farthest places they reach, in the order of their offsets.
    """
    begin = bounds.groupBy(key).agg(F.max("forced").alias("forced")).select(key, F.lit(0).cast("bigint").alias("pos"), F.lit(9).alias("rank"), "forced")
    at = bounds.unionByName(begin)
    near = Window.partitionBy(key).orderBy("pos").rangeBetween(-overlap, -max(1, overlap // 2))
    at = at.select(key, "pos", "rank", "forced", F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.coalesce(F.min(F.when(F.col("rank").between(2, 5), F.col("pos"))).over(near), F.greatest(F.lit(0), F.col("pos") - overlap))).cast("bigint").alias("start"))
    reach = F.explode(F.array(F.struct(F.col("pos").alias("x"), F.lit(0).alias("ask")), F.struct((F.col("start") + limit).alias("x"), F.lit(1).alias("ask"))))
    events = at.select("*", reach.alias("e")).select(key, "pos", "rank", "forced", "start", "e.x", "e.ask")
    so_far = Window.partitionBy(key).orderBy("x", "ask").rowsBetween(Window.unboundedPreceding, 0)
    last = {r: F.last(F.when((F.col("ask") == 0) & (F.col("rank") >= r) & (F.col("rank") < 9), F.col("x")), ignorenulls=True).over(so_far) for r in (0, 2, 3, 4, 5, 6)}
    asked = events.select("*", *(c.alias(f"r{r}") for r, c in last.items())).where("ask = 1")
    half = F.greatest(F.col("pos"), F.col("start") + limit // 2)
    nxt = F.when(F.col("r6") > F.col("pos"), F.col("r6"))
    for r in (5, 4, 3, 2):
        nxt = nxt.when(F.col(f"r{r}") > half, F.col(f"r{r}"))
    nxt = nxt.when(F.col("r2") > F.col("pos"), F.col("r2")).when(F.col("r0") > F.col("pos"), F.col("r0"))
    return asked.select(key, "pos", "start", nxt.alias("nxt"), "forced").where("nxt is not null")


def cuts(links: DataFrame, key: str) -> DataFrame:
    """The boundaries that pieces end at, with the links between them: ``key``, ``pos``, ``start``, ``nxt``, ``forced``.

    Round k holds the places reached in fewer than 2**k steps and the table of 2**k steps.
    """
    table = cut(links.select(key, "pos", "nxt"))
    reached = table.where("pos = 0").select(key, "pos")
    while not table.isEmpty():
        reached = cut(reached.unionByName(reached.join(table, [key, "pos"]).select(key, F.col("nxt").alias("pos"))))
        hop = table.select(key, F.col("pos").alias("nxt"), F.col("nxt").alias("far"))
        table = cut(table.join(hop, [key, "nxt"]).select(key, "pos", F.col("far").alias("nxt")))
    return links.join(reached, [key, "pos"])


def split_texts(df: DataFrame, key: str, column: str, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """``key``, ``piece`` (from 0), ``start_char``, ``end_char``, ``text``, ``forced`` of every text over the limit.

    ``key`` must name one row; the other columns of ``df`` do not matter.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than a piece")
    long = df.where((F.length(column) > limit) & F.col(column).rlike(f"[^{SPACE}]")).select(key, column)
    links = cut(successors(boundaries(long, key, column, limit, overlap), key, limit, overlap))
    number = F.row_number().over(Window.partitionBy(key).orderBy("nxt")) - 1
    spans = cuts(links, key).select(key, number.alias("piece"), F.col("start").alias("start_char"), F.col("nxt").alias("end_char"), "forced")
    text = F.substring(F.col(column), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    return spans.join(long, key).select(key, "piece", F.col("start_char").cast("int"), F.col("end_char").cast("int"), text.alias("text"), "forced")
