"""Dataset building, label resolution, local subgraphs, votes and hooks for models that are inputs here."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand import lexicons as lx
from lodestrand.functions.text import contains_any, overlap_min
from lodestrand.operators.graph import undirected
from lodestrand.session import cut


def safe_list(c: str | Column) -> Column:
    """a text as a list: JSON list, else comma-separated values, else one value; null and blank are empty."""
    t = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.array(t))).when(t.contains(","), F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(t))


def digest_id(prefix: str, *parts: str | Column, length: int = 40) -> Column:
    """A prefix and the first hexadecimal digits of the sha1 of the parts joined by bars."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *cols).cast("binary")), 1, length))


def infer_relation(text: str | Column, default: str = "UNK") -> Column:
    """CAUSES, ENABLES or PRECEDES by the first kind of cue that occurs, else the default."""
    out = None
    for name, cues in lx.CANDIDATE_CUES:
        hit = contains_any(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), cues)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def naming_units(names: DataFrame, units: DataFrame, part: int = 1000) -> DataFrame:
    """``file_name``, ``name``, ``unit_id`` for each name (``file_name``, ``name``) that a unit of its file contains, in any case and script.

    The names of a file, once each, are an array that meets the units of the file; the units of a file of more than ``part`` are
    shared out over parts that each get the array. Empty names are in no unit.
    """
    nm = names.where("file_name is not null and name <> ''").select("file_name", "name").distinct().groupBy("file_name").agg(F.collect_list(F.struct("name", F.lower("name").alias("low"))).alias("ns"))
    u = units.where("file_name is not null and content <> ''").select("unit_id", "file_name", F.lower("content").alias("low"))
    large = F.broadcast(u.groupBy("file_name").agg(F.ceil(F.count("*") / part).alias("parts")).where("parts > 1"))
    split = lambda x: x.join(large, "file_name", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = split(u).withColumn("part", F.pmod(F.xxhash64("unit_id"), "parts")).join(split(nm).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))), ["file_name", "part"])
    return met.select("file_name", "unit_id", F.explode(F.filter("ns", lambda n: F.col("low").contains(n["low"]))["name"]).alias("name")).select("file_name", "name", "unit_id")


def lexical_units(edges: DataFrame, units: DataFrame, k: int = 5, least: float = 0.25) -> DataFrame:
    """The ``k`` units of an edge's file that name its ends best: edges have ``edge``, ``file_name``, ``source_text``,
    ``target_text``; units ``unit_id``, ``file_name``, ``content``. Ties go to the smaller unit.

    A unit is scored once for each name of its file, however many edges have that name: by the tokens they share (an equi-join on
    file and token) and by whether it contains the name. An edge's best units score by one end only, and then are among the
    ``k`` best of that name, or by both; those come from the names of each unit that an edge joins. No unit that scores is left out.
    """
    from lodestrand.functions.text import label_tokens

    e = edges.select("edge", "file_name", "source_text", "target_text")
    ends = e.select("file_name", F.col("source_text").alias("name")).unionByName(e.select("file_name", F.col("target_text").alias("name"))).distinct()
    nm = cut(ends.where("name <> ''").select(F.monotonically_increasing_id().alias("nid"), "file_name", "name", F.array_distinct(label_tokens("name")).alias("ts")))
    u = cut(units.where("content is not null").join(nm.select("file_name").distinct(), "file_name", "left_semi").select("unit_id", "file_name", "content", F.array_distinct(label_tokens("content")).alias("ts")))
    id_of = lambda c, i: nm.select("file_name", F.col("name").alias(c), F.col("nid").alias(i))
    e = cut(e.join(id_of("source_text", "s"), ["file_name", "source_text"], "left").join(id_of("target_text", "t"), ["file_name", "target_text"], "left").select("edge", "s", "t"))

    nt = nm.select("nid", "file_name", F.size("ts").alias("nl"), F.explode("ts").alias("w"))
    ut = u.select("unit_id", "file_name", F.size("ts").alias("ul"), F.explode("ts").alias("w"))
    alike = nt.join(ut, ["file_name", "w"]).select("nid", "unit_id", F.lit(1).alias("m"), F.least("nl", "ul").alias("q"), F.lit(0).alias("named"))
    named = naming_units(nm, u).join(nm, ["file_name", "name"]).select("nid", "unit_id", F.lit(0).alias("m"), F.lit(0).alias("q"), F.lit(1).alias("named"))
    g = alike.unionByName(named).groupBy("nid", "unit_id").agg(F.sum("m").alias("m"), F.max("q").alias("q"), F.max("named").alias("named"))
    g = cut(g.select("nid", "unit_id", F.when(F.col("q") > 0, F.col("m") / F.col("q")).otherwise(0.0).alias("o"), F.when(F.col("named") == 1, 0.6).otherwise(0.0).alias("n")))

    def total(so: str, to: str, sn: str, tn: str) -> Column:
        return F.round(1.2 * F.col(so) + 1.2 * F.col(to) + F.col(sn) + F.col(tn), 6)

    zero = lambda *cs: [F.lit(0.0).alias(c) for c in cs]
    best = g.withColumn("rn", F.row_number().over(Window.partitionBy("nid").orderBy(F.round(1.2 * F.col("o") + F.col("n"), 6).desc(), "unit_id"))).where(F.col("rn") <= k).select("nid", "unit_id", "o", "n")
    by_s = e.join(best.withColumnRenamed("nid", "s"), "s").select("edge", "unit_id", F.col("o").alias("so"), F.col("n").alias("sn"), *zero("to", "tn"))
    by_t = e.join(best.withColumnRenamed("nid", "t"), "t").select("edge", "unit_id", *zero("so", "sn"), F.col("o").alias("to"), F.col("n").alias("tn"))

    of = g.groupBy("unit_id").agg(F.collect_list(F.struct("nid", "o", "n")).alias("ws")).where(F.size("ws") > 0)
    of = of.select("unit_id", F.posexplode("ws.nid").alias("at", "s"), F.col("ws.nid").alias("ids"), F.col("ws.o").alias("os"), F.col("ws.n").alias("ns"))
    of = of.select("unit_id", "s", "ids", "os", "ns", F.col("os")[F.col("at")].alias("so"), F.col("ns")[F.col("at")].alias("sn"))
    after = e.where("s is not null and t is not null").groupBy("s").agg(F.collect_set("t").alias("after"))
    two = of.join(after, "s").withColumn("t", F.explode(F.array_intersect("ids", "after"))).withColumn("at", F.array_position("ids", F.col("t")).cast("int") - 1)
    two = two.select("s", "t", "unit_id", "so", "sn", F.col("os")[F.col("at")].alias("to"), F.col("ns")[F.col("at")].alias("tn"))
    two = two.withColumn("rn", F.row_number().over(Window.partitionBy("s", "t").orderBy(total("so", "to", "sn", "tn").desc(), "unit_id"))).where(F.col("rn") <= k)
    by_both = e.join(two, ["s", "t"]).select("edge", "unit_id", "so", "sn", "to", "tn")

    c = by_s.unionByName(by_t).unionByName(by_both).groupBy("edge", "unit_id").agg(*(F.max(x).alias(x) for x in ("so", "to", "sn", "tn")))
    s = c.select("edge", "unit_id", total("so", "to", "sn", "tn").alias("score")).where(F.col("score") > least)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("edge").orderBy(F.desc("score"), "unit_id"))).where(F.col("rank") <= k)


def resolve_labels(pairs: DataFrame, gold: DataFrame, pseudo: DataFrame) -> DataFrame:
    """The label of each (``doc``, ``src``, ``dst``, ``rel``): of the gold pair, else of the exact pseudo label, else of the pair's
    only pseudo label; other rows are dropped."""
    g = gold.groupBy("doc", "src", "dst").agg(F.max("label").alias("g"))
    exact = pseudo.where("label is not null").groupBy("doc", "src", "dst", "rel").agg(F.max("label").alias("x"))
    only = pseudo.where("label is not null").groupBy("doc", "src", "dst").agg(F.count("*").alias("n"), F.max("label").alias("o")).where("n = 1").drop("n")
    key = ["doc", "src", "dst"]
    j = pairs.join(g, key, "left").join(exact, [*key, "rel"], "left").join(only, key, "left")
    how = F.when(F.col("g").isNotNull(), "gold").when(F.col("x").isNotNull(), "pseudo").when(F.col("o").isNotNull(), "pair")
    return j.select(*key, "rel", F.coalesce("g", "x", "o").alias("label"), how.alias("label_source")).where("label is not null")


def pair_subgraph(pairs: DataFrame, edges: DataFrame, max_nodes: int = 32) -> DataFrame:
    """Q14: nodes of the subgraph around each pair (``doc``, ``src``, ``dst``): both ends first, then neighbours of either in the
    document in the order of their names, at most ``max_nodes``; ``place`` counts from 0."""
    both = edges.select("doc", "src", "dst").where("doc is not null")
    near = both.select("doc", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(both.select("doc", F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b").distinct()
    p = pairs.select("doc", "src", "dst").distinct()
    ends = p.select("*", F.col("src").alias("node"), F.lit(0).alias("o")).unionByName(p.select("*", F.col("dst").alias("node"), F.lit(1).alias("o")))
    around = ends.select("doc", "src", "dst", F.col("node").alias("a")).join(near, ["doc", "a"]).select("doc", "src", "dst", F.col("b").alias("node"), F.lit(2).alias("o"))
    n = ends.unionByName(around).groupBy("doc", "src", "dst", "node").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy("doc", "src", "dst").orderBy("o", "node")) - 1
    return n.select("doc", "src", "dst", "node", place.alias("place")).where(F.col("place") < max_nodes)


def weighted_vote(votes: DataFrame) -> DataFrame:
    """Votes (``item``, ``code``, ``weight``) summed; the winner with confidence .5 + (first - second) / (2 first), at most 1."""
    s = votes.groupBy("item", "code").agg(F.round(F.sum("weight"), 6).alias("score"))
    w = Window.partitionBy("item").orderBy(F.desc("score"), "code")
    r = s.withColumns({"rn": F.row_number().over(w), "second": F.lead("score").over(w)}).where("rn = 1")
    return r.select("item", "code", "score", F.round(F.least(F.lit(1.0), 0.5 + F.try_divide(F.col("score") - F.coalesce("second", F.lit(0.0)), 2 * F.col("score"))), 6).alias("confidence"))


def fused_decode(branch: DataFrame, retrieval: DataFrame) -> DataFrame:
    """.55 of the branch score, .25 of the retrieval score and .20 where both name a code (``item``, ``code``, ``score``)."""
    b, r = branch.select("item", "code", F.col("score").alias("b")), retrieval.select("item", "code", F.col("score").alias("r"))
    j = b.join(r, ["item", "code"], "full")
    both = F.when(F.col("b").isNotNull() & F.col("r").isNotNull(), 0.20).otherwise(0.0)
    return j.select("item", "code", F.round(0.55 * F.coalesce("b", F.lit(0.0)) + 0.25 * F.coalesce("r", F.lit(0.0)) + both, 6).alias("score"))


def keyword_ratio(text: str | Column, words: list[str]) -> Column:
    """The share of the words that occur, to four places."""
    n = sum((F.when(contains_any(text, [w]), 1).otherwise(0) for w in words), F.lit(0))
    return F.round(n / max(len(words), 1), 4)


def is_probability_question(text: str | Column) -> Column:
    """Whether a question asks for a likelihood."""
    return F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))).rlike("概率|可能性|几率|probability|likelihood|how likely")


def joint_score(m: dict[str, Column]) -> Column:
    """.40 of the causal score and .10 of each of six others; missing ones count as 0."""
    names = ["causal", "enable", "dir", "temporal", "first_src", "first_dst", "relation"]
    return sum((F.coalesce(m.get(k, F.lit(0.0)), F.lit(0.0)) * (0.4 if k == "causal" else 0.1) for k in names), F.lit(0.0))


def recall_at(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Exact and section accuracy, recall and coverage of ranked codes (``gold``, ``codes`` array)."""
    first = F.try_element_at("codes", F.lit(1))
    at = [F.round(F.avg(F.array_contains(F.slice("codes", 1, k), F.col("gold")).cast("double")), 6).alias(f"recall_{k}") for k in ks]
    same = lambda a, b: F.coalesce((a == b).cast("double"), F.lit(0.0))
    return rows.agg(F.round(F.avg(same(first, F.col("gold"))), 6).alias("exact"), F.round(F.avg(same(F.substring(first, 1, 1), F.substring("gold", 1, 1))), 6).alias("section"), *at, F.round(F.avg((F.size("codes") > 0).cast("double")), 6).alias("coverage"))


def embed(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 1000) -> DataFrame:
    """``key`` and ``embedding`` of each text by a model given as a function of a list of texts; null is empty.

    The function travels to the workers and is called on ``batch`` texts at a time.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield pd.DataFrame({"k": part["k"], "embedding": pd.Series([list(map(float, v)) for v in model(part["t"].fillna("").tolist())], index=part.index, dtype=object)})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)


def hashing_model(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """The default model: words hashed into a vector of length 1."""

    def model(texts: list[str]) -> list[list[float]]:
        import xxhash

        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % size] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return model


def nearest_segment(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """For each chunk (``doc``, ``chunk``, ``text``) the segment of its document (``seq``, ``start``, ``text``) most alike its first
    forty characters. A document's chunks meet its segments in one group, which is one transcript."""

    def run(key: tuple, c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, t in zip(c["chunk"], c["text"].fillna("")):
            scored = [(SequenceMatcher(None, t[:40], x or "").ratio(), -q, st) for q, st, x in zip(s["seq"], s["start"], s["text"])]
            best = max(scored, default=None)
            out.append((key[0], k, None if best is None else best[2]))
        return pd.DataFrame(out, columns=["doc", "chunk", "start"])

    return chunks.groupBy("doc").cogroup(segments.groupBy("doc")).applyInPandas(run, "doc string, chunk string, start double")


def prune_stems(concepts: DataFrame) -> DataFrame:
    """Concepts (``sent``, ``concept``) without those whose stem (less a final -er or -e) is there too."""
    stem = F.regexp_replace("concept", "(er|e)$", "")
    s = concepts.withColumn("stem", stem).where("stem <> concept")
    gone = s.join(concepts.select("sent", F.col("concept").alias("stem")), ["sent", "stem"], "left_semi").select("sent", "concept")
    return concepts.join(gone, ["sent", "concept"], "left_anti")


def concept_pattern_ok(c: str | Column, stop: list[str]) -> Column:
    """Fewer than five words, no pronoun at either end, not only stop words."""
    w = F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"[_\s]+")
    pronouns = ["my", "you", "it", "its", "your", "i", "he", "she", "his", "her", "they", "them", "their", "our", "we"]
    return (F.size(w) < 5) & ~F.element_at(w, 1).isin(pronouns) & ~F.element_at(w, -1).isin(pronouns) & ~F.forall(w, lambda x: x.isin(stop))


def path_graph(paths: DataFrame) -> DataFrame:
    """Edges between neighbours on each path (``id``, ``path`` array, ``q``, ``a`` ends), the edge between its ends where it has none."""
    p = paths.select("id", F.explode(F.when(F.size("path") > 1, F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).otherwise(F.array(F.struct(F.col("q").alias("src"), F.col("a").alias("dst"))))).alias("e"))
    return p.select("id", "e.src", "e.dst").distinct()


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """Successors and all neighbours of each node, sorted."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("successors"))
    near = undirected(edges).groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_set("b")).alias("neighbours"))
    return near.join(out, "node", "left")


def number_tokens(c: str | Column) -> Column:
    """Lower-case words with numbers as <NUM>."""
    return F.transform(F.filter(F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"\s+"), lambda w: w != ""), lambda w: F.when(w.rlike(r"^\d+([.,]\d+)*$"), "<NUM>").otherwise(w))


def listing(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have the wanted values; None wants any value."""
    for c, v in wanted.items():
        if v is not None:
            rows = rows.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return rows
