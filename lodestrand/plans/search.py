"""Retrieval, classification and concept graphs (V*, C*, N*, K20-K22, F28, F29)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators import grounding as gr
from lodestrand.operators import retrieval as rv
from lodestrand.operators.ordering import numbered
from lodestrand.operators.packed import unpack_fields
from lodestrand.operators.views import CTE, edges, units, with_
from lodestrand.sources import readers
from lodestrand.session import table


def classes(spark: SparkSession, d: str) -> DataFrame:
    """The list of classes as documents: ``doc_id`` (code), ``title`` and ``text`` (class, full, group and section name)."""
    g = table(spark, d, "gbt4754_codes").where("full_code is not null")
    return g.select(F.col("full_code").alias("doc_id"), F.col("class_name").alias("title"), F.concat_ws(" ", "class_name", "full_name", "division_name", "section_name").alias("text")).distinct()


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the names of all entries whose id is divisible by 100."""
    m = table(spark, d, "gb6441_industry_map").where("entry_id % 100 = 0 and industry_name is not null")
    return m.select(F.col("entry_id").alias("query_id"), F.col("industry_name").alias("text")).distinct()


_CL = "cl as (select distinct full_code as doc_id, class_name as title, concat_ws(' ', class_name, full_name, division_name, section_name) as text from gbt4754_codes where full_code is not null), aq as (select distinct entry_id as query_id, industry_name as text from gb6441_industry_map where entry_id % 100 = 0 and industry_name is not null)"


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    """For every document whose id is divisible by 100 the ten most alike other documents by BM25."""
    t = table(spark, d, "documents").where("text is not null")
    docs, q = t.select("doc_id", "text"), t.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return rv.bm25(docs, q, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def bm25_classes(spark: SparkSession, d: str) -> DataFrame:
    """The five best classes of each asked name by BM25."""
    return rv.bm25(classes(spark, d), asked(spark, d), 5).select("query_id", "doc_id", "score", "rank")


def tfidf_classes(spark: SparkSession, d: str) -> DataFrame:
    """The five best classes of each asked name by character n-grams."""
    return rv.tfidf(classes(spark, d), asked(spark, d), 5).select("query_id", "doc_id", "score", "rank")


def rrf_classes(spark: SparkSession, d: str) -> DataFrame:
    """Both lists of sixty fused, the best twenty."""
    c, q = classes(spark, d), asked(spark, d)
    return rv.fuse(rv.bm25(c, q, 60), rv.tfidf(c, q, 60), k=20).select("query_id", "doc_id", "score", "rank")


def hybrid_classes(spark: SparkSession, d: str) -> DataFrame:
    """Fused candidates ranked again by overlap, the best five."""
    c, q = classes(spark, d), asked(spark, d)
    return rv.rerank(rv.fuse(rv.bm25(c, q, 60), rv.tfidf(c, q, 60), k=20), q, c, 5).select("query_id", "doc_id", "score", "rank")


def knn_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 100; the score is (1 + cosine) / 2."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), rv.unit_vector("embedding").alias("vec"))
    q = v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return rv.cosine_top(v, q, 5).select("query_id", "doc_id", F.round((1 + F.col("score")) / 2, 5).alias("score"), "rank")


def vector_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The twenty nearest of each query by label: mean score and number."""
    v = table(spark, d, "embeddings")
    k = v.select(F.col("vec_id").alias("doc_id"), rv.unit_vector("embedding").alias("vec"))
    top = rv.cosine_top(k, k.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 20)
    return top.join(v.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").groupBy("query_id", "label").agg(F.round(F.avg("score"), 10).alias("mean_score"), F.count("*").alias("n"))


def exact_codes(texts: DataFrame, key: str, column: str, codes: DataFrame) -> DataFrame:
    """``key``, ``full_code`` of each code (``full_code``, ``type_code``) that is a run of two to five letters and digits of a text, in
    any case; a run that is no full code counts by its digits as a type code."""
    tok = F.explode(F.array_distinct(F.regexp_extract_all(F.upper(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    t = texts.where(F.col(column).isNotNull()).select(key, tok.alias("tok")).where(F.length("tok").between(2, 5) & F.col("tok").rlike(r"\p{Nd}"))
    g = codes.where("full_code is not null").select("full_code", "type_code").distinct()
    full = t.join(F.broadcast(g.select(F.upper("full_code").alias("tok"), "full_code")), "tok", "left")
    kind = g.where("type_code <> ''").groupBy(F.col("type_code").alias("digits")).agg(F.max("full_code").alias("other"))
    j = full.withColumn("digits", F.regexp_replace("tok", r"\P{Nd}", "")).join(F.broadcast(kind), "digits", "left")
    return j.select(key, F.coalesce("full_code", "other").alias("full_code")).where("full_code is not null").distinct()


def votes_of(entries: DataFrame, g: DataFrame) -> DataFrame:
    """The best class of each entry (``query_id``, ``text``), with its section, from the table of classes: full name 2.2,
    class name 1.8, alias 1.2 and keyword .35 each; a class whose code the entry has counts 3.0 and nothing else, as in the reference."""
    w = g.select(tx.normalize("full_name").alias("term"), "full_code", F.lit(2.2).alias("w")).unionByName(g.select(tx.normalize("class_name").alias("term"), "full_code", F.lit(1.8).alias("w")))
    packed = unpack_fields(g, "gbt4754_codes", "full_code", ["aliases", "keywords"])
    al = packed.select(tx.normalize("val").alias("term"), F.col("rec_id").alias("full_code"), F.when(F.col("field") == "aliases", 1.2).otherwise(0.35).alias("w"))
    w = w.unionByName(al).where("term <> ''").distinct()
    m = gr.mentions(entries, "query_id", "text", w, small=True)
    named = m.join(F.broadcast(w), "term").groupBy("query_id", "full_code").agg(F.sum("w").alias("s"))
    coded = exact_codes(entries, "query_id", "text", g).withColumn("exact", F.lit(3.0))
    s = named.join(coded, ["query_id", "full_code"], "full").select("query_id", "full_code", F.round(F.coalesce("exact", "s"), 6).alias("score"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "full_code"))
    return s.withColumn("rn", rn).where("rn = 1").join(F.broadcast(g.select("full_code", "section_code").distinct()), "full_code").select("query_id", "full_code", "section_code", "score")


def industry_keyword_votes(spark: SparkSession, d: str) -> DataFrame:
    """Class of every entry by what its name mentions; entries that mention nothing have no row."""
    m = table(spark, d, "gb6441_industry_map").where("industry_name is not null")
    return votes_of(m.select(F.col("entry_id").alias("query_id"), F.col("industry_name").alias("text")).distinct(), table(spark, d, "gbt4754_codes"))


def code_composition(spark: SparkSession, d: str) -> DataFrame:
    """Composed codes of classes: injury part from the type code, full code where every part is there."""
    g = table(spark, d, "gbt4754_codes").where("full_code is not null").select("full_code", "type_code", "class_code").distinct()
    return g.select("full_code", tx.injury_code("type_code").alias("wsa"), tx.full_code(F.lit("WSA10009"), tx.injury_code("class_code"), tx.injury_code("type_code")).alias("composed"))


def _concept_edges(spark: SparkSession, d: str) -> DataFrame:
    """Candidate edges as assertions between concepts, weighted by their confidence."""
    return edges(spark, d).select("src", gr.concept_relation().alias("rel"), "dst", F.col("conf").alias("weight"))


def concept_merge(spark: SparkSession, d: str) -> DataFrame:
    """The merged concept graph with inverse edges, by relation."""
    g = gr.concept_graph(gr.merge_relations(_concept_edges(spark, d)))
    return g.groupBy("rel").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 5).alias("weight"))


def simple_weights(spark: SparkSession, d: str) -> DataFrame:
    """Undirected weights of all pairs of joined nodes."""
    return gr.simple_graph(gr.concept_graph(gr.merge_relations(_concept_edges(spark, d))))


def adjacency_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the concept graph with their share of the weight into their head."""
    return gr.in_degree_normalized(gr.concept_graph(gr.merge_relations(_concept_edges(spark, d))))


def two_hop_connectors(spark: SparkSession, d: str) -> DataFrame:
    """Nodes between a node of layer ROOT and one of layer OUTCOME."""
    g = gr.concept_graph(gr.merge_relations(_concept_edges(spark, d)))
    n = table(spark, d, "causal_nodes")
    return gr.two_hop(g, n.where("layer = 'ROOT'").select(F.col("node_id").alias("node")), n.where("layer = 'OUTCOME'").select(F.col("node_id").alias("node")))


def three_hop_connectors(spark: SparkSession, d: str) -> DataFrame:
    """Nodes on paths of three steps between nodes of layer ROOT and of layer CONSEQUENCE."""
    g = gr.concept_graph(gr.merge_relations(_concept_edges(spark, d)))
    n = table(spark, d, "causal_nodes")
    return gr.three_hop(g, n.where("layer = 'ROOT'").select(F.col("node_id").alias("node")), n.where("layer = 'CONSEQUENCE'").select(F.col("node_id").alias("node")))


def _assertions(spark: SparkSession, d: str) -> DataFrame:
    """Assertions in the raw form of a concept dump, from the dimension tables: ``uri``, ``rel``, ``head``, ``tail``, ``info``."""
    t = lambda n: table(spark, d, n)
    low = lambda c: F.concat(F.lit("/c/en/"), F.replace(F.lower(F.col(c)), F.lit(" "), F.lit("_")))
    nr = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda df, rel, h, tl, w: df.select(F.concat(F.lit("/a/"), F.lit(rel)).alias("uri"), F.lit(f"/r/{rel}").alias("rel"), h.alias("head"), tl.alias("tail"), F.format_string('{"weight": %s}', F.lit(w)).alias("info"))
    part = t("part")
    parts = [
        row(nr, "PartOf", F.concat(low("n_name"), F.lit("/n")), low("r_name"), "1.0"), row(nr, "HasA", low("r_name"), low("n_name"), "2.5"), row(nr, "LocatedNear", low("n_name"), low("r_name"), "0.5"),
        row(part, "InstanceOf", low("p_type"), low("p_name"), "1.0"), row(part, "HasContext", low("p_name"), low("p_type"), "1.0"), row(part, "UsedFor", low("p_type"), F.lit("/c/en/object"), "1.0"), row(part, "NoSuchRelation", low("p_type"), low("p_name"), "1.0"), row(part, "Synonym", low("p_type"), low("p_type"), "1.0"),
        row(t("customer"), "MotivatedByGoal", low("c_mktsegment"), F.lit("/c/en/trade/v"), "1.5"), row(t("customer"), "IsA", F.lit("/c/fr/client"), low("c_mktsegment"), "1.0"),
    ]
    return reduce(DataFrame.unionByName, parts)


def concept_extraction(spark: SparkSession, d: str) -> DataFrame:
    """The concept graph of raw assertions: English heads and tails of letters, merged groups, reversed relations,
    blacklist, contexts and loops left out, inverses added."""
    raw = readers.clean_assertions(_assertions(spark, d).distinct())
    g = gr.concept_graph(gr.merge_relations(raw.select(F.col("head").alias("src"), "rel", F.col("tail").alias("dst"), "weight")))
    return g.select("src", "rel", "dst", F.round("weight", 6).alias("weight"))


def concept_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Concepts (normalised node texts) with their line number from 0, and how many edges name them."""
    e = edges(spark, d)
    t = e.select(tx.normalize("source_text").alias("concept")).unionByName(e.select(tx.normalize("target_text").alias("concept"))).where("concept <> ''")
    c = numbered(t.groupBy("concept").agg(F.count("*").alias("n")), ["concept"], "id")
    return c.withColumn("id", F.col("id") - 1)


def node_unit_support(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by the units that edges point at: SUPPORTED_BY edges, with the unit's kind."""
    e = edges(spark, d).where("unit_id is not null")
    s = e.select("unit_id", F.col("src").alias("node_id")).unionByName(e.select("unit_id", F.col("dst").alias("node_id"))).where("node_id is not null").distinct()
    return s.join(units(spark, d).select("unit_id", F.lower("unit_kind").alias("kind")), "unit_id").groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("node_id").alias("nodes"))


QUERIES = {f.__name__: f for f in (bm25_documents, bm25_classes, tfidf_classes, rrf_classes, hybrid_classes, knn_similar, vector_by_label, industry_keyword_votes, code_composition, concept_merge, simple_weights, adjacency_normalized, two_hop_connectors, three_hop_connectors, concept_extraction, concept_vocabulary, node_unit_support)}

_TOK = r"list_distinct(regexp_extract_all(lower({}), '[\x{{4e00}}-\x{{9fff}}]|[a-z0-9_]+'))"
_NORM = r"regexp_replace(lower(trim(regexp_replace(coalesce({}, ''), '\s', ' ', 'g'))), ' +', ' ', 'g')"


def _bm25(docs: str, queries: str, k: int, p: str) -> str:
    return f"""{p}d as (select doc_id, {_TOK.format('text')} as ts from {docs} where text is not null), {p}p as (select doc_id, len(ts) as l, unnest(ts) as t from {p}d), {p}s as (select count(*) as n, avg(len(ts)) as a from {p}d),
        {p}i as (select t, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf, max(a) as a from {p}p, {p}s group by t), {p}q as (select query_id, unnest({_TOK.format('text')}) as t from {queries} where text is not null),
        {p}c as (select query_id, doc_id, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * l / a))), 6) as score from {p}q join {p}i using (t) join {p}p using (t) group by 1, 2),
        {p}r as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from {p}c where score > 0), {p}k as (select * from {p}r where rank <= {k})"""


def _grams(c: str) -> str:
    w = f"list_transform(list_filter(string_split({_NORM.format(c)}, ' '), lambda w: w <> ''), lambda w: ' ' || w || ' ')"
    return "flatten(list_transform(" + w + ", lambda w: list_concat(" + ", ".join(f"case when length(w) >= {n} then list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n})) else [] end" for n in (2, 3, 4)) + ")))"


def _tfidf(docs: str, queries: str, k: int, p: str) -> str:
    tf = lambda t, i: f"select {i}, g, 1 + ln(count(*)) as tf from (select {i}, unnest({_grams('text')}) as g from {t} where text is not null) group by 1, 2"
    return f"""{p}d as ({tf(docs, 'doc_id')}), {p}n as (select count(*) as n from {docs} where text is not null), {p}i as (select g, ln((1 + max(n)) / (1 + count(*))) + 1 as idf from {p}d, {p}n group by g),
        {p}w as (select doc_id, g, tf * idf as w from {p}d join {p}i using (g)), {p}v as (select query_id, g, tf * idf as v from ({tf(queries, 'query_id')}) join {p}i using (g)),
        {p}dn as (select doc_id, sqrt(sum(w * w)) as dn from {p}w group by 1), {p}qn as (select query_id, sqrt(sum(v * v)) as qn from {p}v group by 1),
        {p}c as (select query_id, doc_id, round(sum(v * w) / (max(dn) * max(qn)), 6) as score from {p}v join {p}w using (g) join {p}dn using (doc_id) join {p}qn using (query_id) group by 1, 2),
        {p}r as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from {p}c), {p}k as (select * from {p}r where rank <= {k})"""


_RRF = f"with {_CL}, {_bm25('cl', 'aq', 60, 'b')}, {_tfidf('cl', 'aq', 60, 't')}, u as (select query_id, doc_id, rank from bk union all select query_id, doc_id, rank from tk), fs as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 8) as score from u group by 1, 2), fr as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from fs), fk as (select * from fr where rank <= 20)"
_JAC = lambda a, b: f"(case when len({_TOK.format(a)}) = 0 or len({_TOK.format(b)}) = 0 then 0.0 else len(list_intersect({_TOK.format(a)}, {_TOK.format(b)})) / cast(len(list_distinct(list_concat({_TOK.format(a)}, {_TOK.format(b)}))) as double) end)"
_KNN = lambda k: f"with v as (select vec_id, cast(embedding as double[]) as e from embeddings), c as (select q.vec_id as query_id, v.vec_id as doc_id, round(list_cosine_similarity(q.e, v.e), 6) as score from v q, v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id), r as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from c), k as (select * from r where rank <= {k})"
_CONCEPT = "case " + " ".join(f"when rel = '{k}' then '{v}'" for k, v in gr.CONCEPT_RELATIONS.items()) + " else 'relatedto' end"
_GROUPS = ", ".join(f"('{r.lstrip('*')}', '{g.split('/')[0]}', {'true' if r.startswith('*') else 'false'})" for g in gr.RELATION_GROUPS for r in g.split("/"))


def _merge_sql(assertions: str, prefix: str = "g") -> str:
    """The merged graph ``g`` of ``assertions`` (a query of src, rel, dst, weight): groups, reversals, blacklist, no contexts, no loops, inverses."""
    black = ", ".join(repr(x) for x in gr.BLACKLIST)
    return (
        f"rg as (select * from (values {_GROUPS}) v(r, grp, rev)), g0 as (select case when rev then dst else src end as src, grp as rel, case when rev then src else dst end as dst, weight from ({assertions}) join rg on rg.r = rel), "
        f"g1 as (select src, rel, dst, max(weight) as weight from g0 where src <> dst and src not in ({black}) and dst not in ({black}) and rel <> 'hascontext' group by 1, 2, 3), {prefix} as (select * from g1 union all select dst, rel || '*', src, weight from g1)"
    )


_MERGE = _merge_sql(f"select src, {_CONCEPT} as rel, dst, conf as weight from edges")
SQL = {
    "bm25_documents": f"with dd as (select doc_id, text from documents where text is not null), qq as (select doc_id as query_id, text from dd where doc_id % 100 = 0), {_bm25('dd', 'qq', 10, 'x')} select query_id, doc_id, round(score, 4) as score, rank from xk",
    "bm25_classes": f"with {_CL}, {_bm25('cl', 'aq', 5, 'b')} select query_id, doc_id, score, rank from bk",
    "tfidf_classes": f"with {_CL}, {_tfidf('cl', 'aq', 5, 't')} select query_id, doc_id, score, rank from tk",
    "rrf_classes": f"{_RRF} select query_id, doc_id, score, rank from fk",
    "hybrid_classes": f"{_RRF}, h as (select f.query_id, f.doc_id, round(f.score + {_JAC('q.text', 'c.text')} + case when {_JAC('q.text', 'c.title')} > 0.5 then 0.2 else 0 end, 6) as score from fk f join aq q using (query_id) join cl c using (doc_id)), hr as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from h) select * from hr where rank <= 5",
    "knn_similar": _KNN(5) + " select query_id, doc_id, round((1 + score) / 2, 5) as score, rank from k",
    "vector_by_label": _KNN(20) + " select query_id, label, round(avg(score), 10) as mean_score, count(*) as n from k join embeddings e on e.vec_id = k.doc_id group by 1, 2",
    "code_composition": r"with g as (select distinct full_code, regexp_replace(type_code, '\D', '', 'g') as t, regexp_replace(class_code, '\D', '', 'g') as c from gbt4754_codes where full_code is not null), p as (select full_code, case when t <> '' then 'WSA3' || lpad(right(t, 4), 4, '0') end as wsa, case when c <> '' then 'WSA3' || lpad(right(c, 4), 4, '0') end as cc from g) select full_code, wsa, case when wsa is not null and cc is not null then 'WSA10009-' || cc || '-' || wsa end as composed from p",
    "concept_merge": f"with {CTE['edges']}, {_MERGE} select rel, count(*) as edges, round(sum(weight), 5) as weight from g group by rel",
    "simple_weights": f"with {CTE['edges']}, {_MERGE} select least(src, dst) as a, greatest(src, dst) as b, round(sum(weight), 6) as weight from g group by 1, 2",
    "adjacency_normalized": f"with {CTE['edges']}, {_MERGE}, s as (select dst, sum(weight) as s from g group by 1) select src, rel, g.dst, round(weight / case when s = 0 then 1e-5 else s end, 6) as p from g join s using (dst)",
    "two_hop_connectors": f"with {CTE['edges']}, {_MERGE} select distinct a.dst as node from g a join g b on b.src = a.dst where a.src in (select node_id from causal_nodes where layer = 'ROOT') and b.dst in (select node_id from causal_nodes where layer = 'OUTCOME')",
    "three_hop_connectors": f"with {CTE['edges']}, {_MERGE}, q as (select node_id as n from causal_nodes where layer = 'ROOT'), z as (select node_id as n from causal_nodes where layer = 'CONSEQUENCE'), e as (select distinct src, dst from g), p as (select b.src as x, b.dst as y from e a join e b on b.src = a.dst join e c on c.src = b.dst where a.src in (select n from q) and c.dst in (select n from z)) select distinct node from (select x as node from p union select y from p) where node not in (select n from q) and node not in (select n from z)",
    "concept_extraction": "with l as (select lower(replace(n_name, ' ', '_')) as n, lower(replace(r_name, ' ', '_')) as r from nation join region on n_regionkey = r_regionkey), p as (select lower(replace(p_type, ' ', '_')) as t, lower(replace(p_name, ' ', '_')) as n from part), c as (select lower(replace(c_mktsegment, ' ', '_')) as s from customer), a as (select n as src, 'partof' as rel, r as dst, 1.0 as weight from l union all select r, 'hasa', n, 2.5 from l union all select n, 'locatednear', r, 0.5 from l union all select t, 'instanceof', n, 1.0 from p union all select n, 'hascontext', t, 1.0 from p union all select t, 'usedfor', 'object', 1.0 from p union all select t, 'synonym', t, 1.0 from p union all select s, 'motivatedbygoal', 'trade', 1.5 from c), ok as (select * from a where regexp_matches(replace(replace(src, '_', ''), '-', ''), '^[a-z]+$') and regexp_matches(replace(replace(dst, '_', ''), '-', ''), '^[a-z]+$')), " + _merge_sql("select * from ok") + " select src, rel, dst, round(weight, 6) as weight from g",
    "concept_vocabulary": with_("edges") + f", t as (select {_NORM.format('source_text')} as concept from edges union all select {_NORM.format('target_text')} from edges) select concept, count(*) as n, row_number() over (order by concept) - 1 as id from t where concept <> '' group by concept",
    "node_unit_support": with_("edges", "units") + ", s as (select distinct unit_id, node_id from (select unit_id, src as node_id from edges union all select unit_id, dst from edges) where unit_id is not null and node_id is not null) select lower(unit_kind) as kind, count(*) as edges, count(distinct node_id) as nodes from s join units using (unit_id) group by 1",
}
