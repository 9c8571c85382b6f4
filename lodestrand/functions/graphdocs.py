"""Projections of extracted graphs: types, properties, scopes, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand import lexicons as lx
from lodestrand.functions.text import contains_any


def core_type(t: str | Column, text: str | Column) -> Column:
    """P25: legacy type names as core types; an accident event is a harm event by its words, else an intermediate one."""
    t = F.lower(F.trim(F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit(""))))
    out = None
    for k, v in lx.LEGACY_TYPES.items():
        out = F.when(t == k, v) if out is None else out.when(t == k, v)
    for v in lx.CORE_LAYERS:
        out = out.when(t == v.lower(), v)
    harm = contains_any(text, ["坠落", "侧翻", "坍塌", "打击", "触电", "爆炸", "着火"])
    return out.when(t == "accidentevent", F.when(harm, "HarmEvent").otherwise("IntermediateEvent")).otherwise("SourceEvent")


def core_layer(t: str | Column) -> Column:
    """The default layer of a core type; null for another type."""
    out = None
    for k, v in lx.CORE_LAYERS.items():
        here = (F.col(t) if isinstance(t, str) else t) == k
        out = F.when(here, v) if out is None else out.when(here, v)
    return out


def first_rule(text: str | Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first rule one of whose words occurs."""
    out = None
    for name, words in rules:
        out = F.when(contains_any(text, words), name) if out is None else out.when(contains_any(text, words), name)
    return out.otherwise(default) if out is not None else F.lit(default)


def snippet(*props: str | Column, limit: int = 120) -> Column:
    """The first of the properties that is not blank, cut to ``limit`` characters."""
    cols = [F.nullif(F.trim(F.col(p) if isinstance(p, str) else p), F.lit("")) for p in props]
    return F.substring(F.coalesce(*cols), 1, limit)


def with_defaults(props: str | Column, defaults: dict[str, str]) -> Column:
    """A property map with defaults for the missing keys; a key that is there keeps its value."""
    p = F.coalesce(F.col(props) if isinstance(props, str) else props, F.create_map().cast("map<string,string>"))
    d = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    return F.map_concat(p, F.map_filter(d, lambda k, _: ~F.map_contains_key(p, k)))


def merge_props(old: str | Column, new: str | Column) -> Column:
    """A property map overwritten by the values of another that are not null."""
    o, n = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.create_map().cast("map<string,string>")) for x in (old, new))
    n = F.map_filter(n, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)


def camel_key(c: str | Column) -> Column:
    """A property name in camel case."""
    words = F.filter(F.split(F.col(c) if isinstance(c, str) else c, r"[\s_]+"), lambda w: w != "")
    return F.concat(F.lower(F.element_at(words, 1)), F.array_join(F.transform(F.slice(words, 2, 1000), lambda w: F.initcap(w)), ""))


def drop_heavy(props: str | Column) -> Column:
    """Properties without embedding and text."""
    return F.map_filter(F.col(props) if isinstance(props, str) else props, lambda k, _: ~k.isin("embedding", "text"))


def page_range(meta: str | Column) -> Column:
    """``first``, ``last`` page of metadata with a page or a two-number list; null otherwise."""
    m = F.col(meta) if isinstance(meta, str) else meta
    one = F.get_json_object(m, "$.page").try_cast("int")
    a, b = F.get_json_object(m, "$.page_range[0]").try_cast("int"), F.get_json_object(m, "$.page_range[1]").try_cast("int")
    return F.when(one.isNotNull(), F.struct(one.alias("first"), one.alias("last"))).when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("first"), b.alias("last")))


def match_filters(docs: DataFrame, dimensions: list[str] | None = None, standards: list[str] | None = None, effective_on: str | None = None) -> DataFrame:
    """Documents that pass all filters; a null standard fails a filter of standards, a null date passes any date."""
    if dimensions:
        docs = docs.where(F.col("dimension").isin(dimensions))
    if standards:
        docs = docs.where(F.coalesce(F.col("standard_no").isin(standards), F.lit(False)))
    if effective_on:
        docs = docs.where(F.col("effective_from").isNull() | (F.col("effective_from") <= F.lit(effective_on).cast("date")))
    return docs


def boost(hits: DataFrame, facts: dict[str, str], weights: dict[str, float], least: float = 0.0) -> DataFrame:
    """Scores raised for every metadata field that has the value of the facts, ranked again, those below ``least`` left out."""
    s = F.col("score")
    for k, v in facts.items():
        s = s + F.when(F.element_at("metadata", k) == v, weights.get(k, 0.0)).otherwise(0.0)
    b = hits.withColumn("score", F.round(s, 6)).where(F.col("score") >= least)
    return b.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def example_text(title: str, query: str, source: str, relation: str, target: str, evidence: str) -> Column:
    """The training text of an edge with its tags and at most three pieces of evidence."""
    return F.concat_ws(" ", F.lit("[DOC]"), title, F.lit("[QUERY]"), query, F.lit("[SOURCE]"), source, F.lit("[RELATION]"), relation, F.lit("[TARGET]"), target, F.lit("[EVIDENCE]"), F.array_join(F.slice(evidence, 1, 3), " "))


def edge_pairs(index: str | Column) -> Column:
    """An edge index as pairs, from pairs or from two rows of ends."""
    x = F.col(index) if isinstance(index, str) else index
    coo = (F.size(x) == 2) & (F.size(F.element_at(x, 1)) != 2)
    return F.when(coo, F.zip_with(F.element_at(x, 1), F.element_at(x, 2), lambda a, b: F.array(a, b))).otherwise(x)


def statements(questions: DataFrame) -> DataFrame:
    """Each choice of a question as a statement: the question word becomes the choice, else the choice follows."""
    q = questions.select("id", "stem", "answer_key", F.explode("choices").alias("c"))
    blank = F.regexp_replace("stem", r"(?i)\b(what|where|which|who|when|how)\b", "___")
    first = F.regexp_replace(blank, r"\?\s*$", "")
    text = F.when(first.contains("___"), F.concat(F.split_part(first, F.lit("___"), F.lit(1)), F.col("c.text"), F.element_at(F.split(first, "___", 2), 2))).otherwise(F.concat_ws(" ", first, "c.text"))
    return q.select("id", F.col("c.label").alias("label"), (F.ascii("answer_key") - F.ascii(F.lit("A"))).alias("answer"), (F.col("c.label") == F.col("answer_key")).alias("correct"), F.concat(F.trim(text), F.lit(".")).alias("statement"))


def source_brackets(answer: str | Column) -> Column:
    """The sources an answer names in its last square brackets."""
    inner = F.regexp_extract(F.col(answer) if isinstance(answer, str) else answer, r"(?i)sources?:?\s*\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(x, r"[\"']", ""))), lambda x: x != "")


def masked_softmax(rows: DataFrame, keys: list[str], score: str, mask: str) -> DataFrame:
    """Softmax of scores within the keys, masked rows (1) left out with weight 0."""
    w = Window.partitionBy(*keys)
    e = F.when(F.col(mask) == 0, F.exp(F.col(score) - F.max(F.when(F.col(mask) == 0, F.col(score))).over(w))).otherwise(0.0)
    return rows.withColumn("e", e).withColumn("weight", F.coalesce(F.try_divide(F.col("e"), F.sum("e").over(w)), F.lit(0.0))).drop("e")


def top_share(rows: DataFrame, keys: list[str], score: str, share: float, tie: str) -> DataFrame:
    """Of each group the best ``share`` by score, rounded down; a share that comes to no row keeps all."""
    w = Window.partitionBy(*keys)
    r = rows.withColumns({"rn": F.row_number().over(w.orderBy(F.desc(score), tie)), "k": F.floor(F.count("*").over(w) * share)})
    return r.where((F.col("k") <= 0) | (F.col("rn") <= F.col("k"))).drop("rn", "k")


def max_merge(a: str | Column, b: str | Column) -> Column:
    """Two score maps as one with the larger score of each key."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def pool_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise largest and mean of the vectors of each key."""
    x = rows.select(key, F.posexplode(vector).alias("i", "v")).groupBy(key, "i").agg(F.max("v").alias("m"), F.avg("v").alias("a"))
    g = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m", "a"))).alias("xs"))
    return g.select(key, F.transform("xs", lambda e: e["m"]).alias("max_vec"), F.transform("xs", lambda e: e["a"]).alias("mean_vec"))


def scope_graph(nodes: DataFrame, edges: DataFrame, scope: str, kg: str) -> tuple[DataFrame, DataFrame]:
    """P20: node ids and edge ends with the scope and graph they belong to in front, bars in them as underscores."""
    p = F.lit(f"{scope.replace('|', '_')}|{kg.replace('|', '_')}")
    full = lambda c: F.concat_ws("|", p, F.replace(F.col(c), F.lit("|"), F.lit("_")))
    return nodes.withColumn("id", full("id")), edges.withColumns({"src": full("src"), "dst": full("dst")})


def pack_subgraph(nodes: DataFrame, edges: DataFrame, vocabulary: DataFrame, max_nodes: int) -> DataFrame:
    """Edges between the first ``max_nodes`` known concepts of each sample by slot, both ways, the inverse relation
    marked: nodes have ``sample``, ``node``, ``concept``, ``seq``; edges ``sample``, ``src``, ``rel``, ``dst``."""
    known = nodes.join(vocabulary.select("concept").distinct(), "concept", "left_semi")
    slot = (F.row_number().over(Window.partitionBy("sample").orderBy("seq", "node")) - 1).alias("slot")
    s = known.select("sample", "node", slot).where(F.col("slot") < max_nodes)
    a, b = s.select("sample", F.col("node").alias("src"), F.col("slot").alias("i")), s.select("sample", F.col("node").alias("dst"), F.col("slot").alias("j"))
    e = edges.join(a, ["sample", "src"]).join(b, ["sample", "dst"]).select("sample", "rel", "i", "j")
    return e.unionByName(e.select("sample", F.concat("rel", F.lit("*")).alias("rel"), F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
