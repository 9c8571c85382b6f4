"""Functions of stored graphs, questions, vectors and scores as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand import lexicons as lx
from lodestrand.functions import graphdocs as gd
from lodestrand.functions import text as tx
from lodestrand.operators import datasets as ds
from lodestrand.operators import scoring as sc
from lodestrand.operators import store
from lodestrand.operators.views import CTE, chunks, doc_key, edges, labels, nodes, units, with_
from lodestrand.plans.paths import _NORM
from lodestrand.plans.scores import _FEAT, _MULTI, _PRE, with_evidence
from lodestrand.plans.texts import any_sql
from lodestrand.session import table

DEFAULTS = {"kg_scope": "shared", "kg_id": "default"}
# Words of the kinds of harm, and rules of modules and scenarios.
HARM_WORDS = ["坠落", "侧翻", "坍塌", "打击", "触电", "爆炸", "着火"]
MODULE_RULES = [("construction_safety", ["施工", "脚手架", "吊装", "塔吊", "坍塌"])]
SCENARIO_RULES = [("high_place_fall", ["坠落", "高处", "脚手架"]), ("collapse", ["坍塌", "倒塌", "塌落"]), ("lifting_injury", ["吊装", "起重", "塔吊"])]
PROCESS_TERMS = ["施工", "吊装", "运输", "检修", "安装", "生产", "掘进"]
BASIC_TYPES = {"高处坠落": ["坠落", "高处", "脚手架", "平台", "坠下"], "坍塌": ["坍塌", "塌落", "垮塌", "倒塌"], "起重伤害": ["起重", "吊装", "塔吊", "吊物", "吊钩"], "中毒和窒息": ["中毒", "窒息", "有毒", "缺氧"], "触电": ["触电", "带电", "漏电"], "爆炸": ["爆炸", "爆燃"]}


def node_projection(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with core type, the layer of that type, module and scenario by words, and a snippet of at most 20 characters."""
    n = nodes(spark, d).withColumn("core", gd.core_type("canonical_type", "text"))
    return n.select("node_id", "core", gd.core_layer("core").alias("core_layer"), gd.first_rule("text", MODULE_RULES, "production_safety").alias("module"), gd.first_rule("text", SCENARIO_RULES, "none").alias("scenario"), gd.snippet("text", "canonical_type", limit=20).alias("snippet"))


def edge_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties of edges: heavy ones out, defaults for missing ones, new values over old, names in camel case; as sorted text."""
    e = table(spark, d, "candidate_edges").select("source_node_id", "target_node_id", "relation_type", "rel_props")
    p = gd.with_defaults(gd.merge_props(gd.drop_heavy("rel_props"), F.create_map(F.lit("kg_id"), F.lit(None).cast("string"), F.lit("label source"), F.lit("graph"))), DEFAULTS)
    items = F.transform(F.array_sort(F.map_entries(F.transform_keys(p, lambda k, _: gd.camel_key(k)))), lambda x: F.concat_ws("=", x["key"], F.coalesce(x["value"], F.lit("null"))))
    return e.select("source_node_id", "target_node_id", "relation_type", F.array_join(items, ";").alias("props")).distinct()


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of files as safe names, their labels and digests."""
    f = table(spark, d, "documents").select("file_name", "source").where("file_name is not null").distinct()
    return f.select("file_name", "source", tx.safe_name("file_name").alias("safe"), tx.source_label("source", "file_name").alias("label"), ds.digest_id("f_", "source", "file_name", length=16).alias("digest"))


def clock_times(spark: SparkSession, d: str) -> DataFrame:
    """the second of the day of events as a clock, and back."""
    e = table(spark, d, "events").select("event_id", (F.unix_timestamp("ts") % 86400).cast("int").alias("s"))
    return e.select("event_id", tx.seconds_clock("s").alias("clock")).withColumn("seconds", tx.clock_seconds("clock"))


def unit_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of units that their metadata names."""
    u = units(spark, d).select("unit_id", gd.page_range("meta_json").alias("p"))
    return u.where("p is not null").select("unit_id", "p.first", "p.last")


def scoped_graph(spark: SparkSession, d: str) -> DataFrame:
    """P20: edges with the scope and graph in front of both ends, by ends."""
    e = edges(spark, d).where("src is not null and dst is not null").select("src", "dst").distinct()
    _, out = gd.scope_graph(e.select(F.col("src").alias("id")), e, "sha|red", "default")
    return out.select("src", "dst")


def choice_statements(spark: SparkSession, d: str) -> DataFrame:
    """Questions about parts as statements of each choice."""
    p = table(spark, d, "part")
    pick = lambda a, b: F.struct(F.lit(a).alias("label"), F.col(b).alias("text"))
    q = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Which brand makes "), "p_name", F.lit("?"))).otherwise(F.concat(F.lit("The type of "), "p_name", F.lit(" is"))).alias("stem"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("answer_key"), F.array(pick("A", "p_brand"), pick("B", "p_type")).alias("choices"))
    return gd.statements(q)


def training_texts(spark: SparkSession, d: str) -> DataFrame:
    """The training text of each edge."""
    e = sc.dedup_edges(edges(spark, d)).where("doc is not null")
    z = lambda c: F.coalesce(F.col(c), F.lit(""))
    e = e.select("doc", "src", "rel", "dst", z("file_name").alias("title"), z("source_text").alias("s"), z("target_text").alias("t"), F.array(z("evidence_text")).alias("ev")).withColumn("q", F.lit("why"))
    return e.select("doc", "src", "rel", "dst", gd.example_text("title", "q", "s", "rel", "t", "ev").alias("text"))


def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources an answer names in its last brackets, for answers that name the files of a document's source."""
    f = table(spark, d, "documents").where("file_name is not null and source is not null").select("doc_id", F.concat(F.lit("It failed. Sources: ['"), "file_name", F.lit("', \""), "source", F.lit("\"]")).alias("answer"))
    return f.select("doc_id", F.posexplode(gd.source_brackets("answer")).alias("k", "name"))


def attention_weights(spark: SparkSession, d: str) -> DataFrame:
    """Softmax of the values of a user's events, those of type click left out with weight 0."""
    e = table(spark, d, "events").where("user_id is not null").select("event_id", "user_id", (F.coalesce("value", F.lit(0.0)) / 100).alias("v"), (F.coalesce("event_type", F.lit("")) == "click").cast("int").alias("m"))
    return gd.masked_softmax(e, ["user_id"], "v", "m").select("event_id", F.round("weight", 6).alias("weight"))


def top_share_events(spark: SparkSession, d: str) -> DataFrame:
    """The best tenth of each event type by value."""
    e = table(spark, d, "events").where("event_type is not null and value is not null")
    return gd.top_share(e, ["event_type"], "value", 0.1, "event_id").select("event_type", "event_id", "value")


def merged_signals(spark: SparkSession, d: str) -> DataFrame:
    """Severity signals of a document's nodes with those of layer EVENT, the larger value of each key."""
    n = table(spark, d, "causal_nodes").where("node_id is not null and doc_id is not null").select(doc_key().alias("doc"), F.coalesce(F.col("layer") == "EVENT", F.lit(False)).alias("event"), F.explode("severity_signals").alias("k", "v"))
    side = lambda c, name: n.where(c).groupBy("doc", "k").agg(F.max("v").alias("v")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))
    none = F.create_map().cast("map<string,double>")
    j = side(F.col("event"), "a").join(side(~F.col("event"), "b"), "doc", "full")
    return j.select("doc", F.explode(gd.max_merge(F.coalesce("a", none), F.coalesce("b", none))).alias("signal", "value"))


def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The largest and the mean value of each place of the vectors of a label."""
    p = gd.pool_vectors(table(spark, d, "embeddings").where("label is not null and embedding is not null"), "label", "embedding")
    z = p.select("label", F.posexplode(F.arrays_zip("max_vec", "mean_vec")).alias("i", "x"))
    return z.select("label", "i", F.round("x.max_vec", 5).cast("double").alias("top"), (F.round("x.mean_vec", 4) + 0.0).alias("mean"))


def numbered_tokens(spark: SparkSession, d: str) -> DataFrame:
    """How often each token occurs in node texts, numbers as one."""
    return nodes(spark, d).where("text is not null").select(F.explode(ds.number_tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def neighbour_lists(spark: SparkSession, d: str) -> DataFrame:
    """Successors and neighbours of every node."""
    s = ds.neighbour_sets(edges(spark, d).where("src is not null and dst is not null and src <> dst").select("src", "dst"))
    return s.select("node", F.array_join("successors", ",").alias("successors"), F.array_join("neighbours", ",").alias("neighbours"))


def type_scores(spark: SparkSession, d: str) -> DataFrame:
    """The share of each basic type's words that a unit names."""
    u = units(spark, d).where("content is not null")
    scored = F.explode(F.array(*(F.struct(F.lit(k).alias("basic_type"), ds.keyword_ratio("content", ws).alias("score")) for k, ws in BASIC_TYPES.items()))).alias("x")
    return u.select("unit_id", scored).select("unit_id", "x.basic_type", "x.score").where("score > 0")


def probability_questions(spark: SparkSession, d: str) -> DataFrame:
    """Units that ask or tell of a likelihood, by kind."""
    u = units(spark, d)
    return u.groupBy(F.coalesce("unit_kind", F.lit("")).alias("unit_kind")).agg(F.count_if(ds.is_probability_question("content")).alias("asking"), F.count("*").alias("units"))


def joint_scores(spark: SparkSession, d: str) -> DataFrame:
    """The joint score of each edge's task confidences."""
    m = sc.multitask(sc.evidence_features(with_evidence(spark, d)))
    s = ds.joint_score({"causal": F.col("causal_conf"), "enable": F.col("enable_conf"), "dir": F.col("dir_conf"), "temporal": F.col("temporal_conf"), "first_src": F.col("first_src_conf"), "first_dst": F.col("first_dst_conf")})
    return m.select("doc", "src", "rel", "dst", F.round(s, 6).alias("joint"))


def module_recall(spark: SparkSession, d: str) -> DataFrame:
    """How often the module of a node is among the first modules of its document."""
    n = nodes(spark, d).where("doc_id is not null and module_id is not null").select(doc_key().alias("doc"), "module_id")
    c = n.groupBy("doc", "module_id").agg(F.count("*").alias("n"))
    ranked = c.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "module_id"))), lambda x: x["module_id"]).alias("codes"))
    return ds.recall_at(n.join(ranked, "doc").select(F.col("module_id").alias("gold"), "codes"))


def pruned_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names as concepts: those of an allowed pattern, without those whose stem is there too."""
    w = table(spark, d, "part").select(F.col("p_partkey").alias("sent"), F.explode(F.split(F.lower("p_name"), " ")).alias("concept")).distinct()
    both = w.unionByName(w.where(F.col("sent") % 2 == 0).select("sent", F.concat("concept", F.lit("er")).alias("concept"))).distinct()
    return ds.prune_stems(both.where(ds.concept_pattern_ok("concept", ["the", "a", "it"])))


def chain_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The edges between neighbours on the path of each stored chain, and the edge between its ends where the path has none."""
    e = table(spark, d, "causal_chain_edges").where("edge_id is not null and chain_id is not null and source_node_id is not null and target_node_id is not null").groupBy("edge_id").agg(F.max(F.struct("updated_at", "chain_id", "seq", "source_node_id", "target_node_id")).alias("x"))
    p = e.select("x.chain_id", "edge_id", "x.seq", "x.source_node_id", "x.target_node_id").groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("seq", "edge_id", "source_node_id", "target_node_id"))).alias("xs"))
    path = F.when(F.size("xs") > 1, F.transform("xs", lambda x: x["source_node_id"])).otherwise(F.array().cast("array<string>"))
    return ds.path_graph(p.select(F.col("chain_id").alias("id"), path.alias("path"), F.element_at("xs", 1)["source_node_id"].alias("q"), F.element_at("xs", -1)["target_node_id"].alias("a")))


def listed_values(spark: SparkSession, d: str) -> DataFrame:
    """the lists that canonical type ids of samples hold, however written."""
    s = labels(spark, d).select("sample_id", F.posexplode(ds.safe_list("canonical_type_ids_json")).alias("k", "v"))
    return s.select("sample_id", "k", "v")


def sample_weights(spark: SparkSession, d: str) -> DataFrame:
    """the weight of each sample by where its label comes from, its confidence and its review."""
    s = labels(spark, d).select("sample_id", F.when(F.col("silver_edge_causal") == 1, "gold_chain").when(F.col("silver_edge_causal") == 0, "pseudo_accepted").otherwise("pseudo_pending").alias("src"), F.col("sample_weight").alias("conf"), F.when(F.col("silver_edge_enable") == 1, "accepted").when(F.col("silver_edge_enable") == 0, "edited").otherwise("pending").alias("st"))
    return s.select("sample_id", F.round(sc.sample_weight("src", "conf", F.col("st"), {"gold_chain": 1.0, "pseudo_accepted": 0.9, "pseudo_pending": 0.8}), 6).alias("weight"))


def reviewed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels after review decisions: rejected ones out, edited ones with the reviewer's label, others as they are."""
    rows = labels(spark, d).where("silver_edge_causal in (0, 1)").select("sample_id", F.col("silver_edge_causal").alias("label"), F.lit("pending").alias("review_status"), F.lit(None).cast("int").alias("manual_label"))
    k = F.ascii(F.substring("sample_id", 5, 1)) % 4
    decided = labels(spark, d).select("sample_id", F.when(k == 0, "Accepted").when(k == 1, "rejected").when(k == 2, "EDITED").otherwise("later").alias("manual_decision"), F.when(k == 2, F.lit(0)).alias("manual_label"))
    out = store.review(rows, decided, "sample_id").withColumn("label", store.effective_label())
    return out.where("label is not null").select("sample_id", "review_status", "label")


def upserted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after a second load of the odd positions: the newest content, the oldest creation."""
    old = table(spark, d, "evidence_chunks").select("evidence_id", "file_name", "position", "content", "created_at", "updated_at")
    new = old.where("position % 2 = 1").select("evidence_id", "file_name", "position", F.concat("content", F.lit(" (2)")).alias("content"), F.lit("2030-01-01T00:00:00").alias("created_at"), F.lit("2030-01-01T00:00:00").alias("updated_at"))
    return store.upsert(old, new, "evidence_id", "updated_at").select("evidence_id", F.md5("content").alias("content"), "created_at", "updated_at")


def packed_subgraphs(spark: SparkSession, d: str) -> DataFrame:
    """The edges of each document between its first eight known concepts, by slot, both ways."""
    n = nodes(spark, d).where("doc_id is not null and text is not null").select(doc_key().alias("sample"), F.col("node_id").alias("node"), tx.normalize("text").alias("concept")).withColumn("seq", F.lit(0))
    e = edges(spark, d).where("doc is not null and src is not null and dst is not null").select(F.col("doc").alias("sample"), "src", "rel", "dst").distinct()
    words = nodes(spark, d).where("layer <> 'UNK' and text is not null").select(tx.normalize("text").alias("concept")).where("concept <> ''")
    return gd.pack_subgraph(n, e, words, 8).select("sample", "rel", "i", "j")


def best_documents(spark: SparkSession, d: str) -> DataFrame:
    """The five longest documents of each language."""
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("lang"), "n_chars")
    rn = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc_nulls_last("n_chars"), "doc_id"))
    return docs.where("lang is not null").select("lang", "doc_id", "n_chars", rn.alias("rank")).where("rank <= 5")


QUERIES = {
    f.__name__: f
    for f in (
        node_projection, edge_properties, file_names, clock_times, unit_pages, scoped_graph, choice_statements, training_texts, answer_sources, attention_weights, top_share_events, merged_signals, pooled_vectors,
        numbered_tokens, neighbour_lists, type_scores, probability_questions, joint_scores, module_recall, pruned_concepts, chain_graphs, listed_values, sample_weights, reviewed_labels, upserted_chunks, packed_subgraphs, best_documents,
    )
}

_rules = lambda t, rules, default: "case " + " ".join(f"when {any_sql(t, ws)} then '{n}'" for n, ws in rules) + f" else '{default}' end"
_TYPE = "case " + " ".join(f"when t = '{k}' then '{v}'" for k, v in lx.LEGACY_TYPES.items()) + " " + " ".join(f"when t = '{v.lower()}' then '{v}'" for v in lx.CORE_LAYERS) + f" when t = 'accidentevent' then case when {any_sql('coalesce(text, chr(0))', HARM_WORDS)} then 'HarmEvent' else 'IntermediateEvent' end else 'SourceEvent' end"
_LAYER = "case " + " ".join(f"when core = '{k}' then '{v}'" for k, v in lx.CORE_LAYERS.items()) + " end"
_camel = "list_aggregate(list_transform(list_filter(regexp_split_to_array(k, '[\\s_]+'), lambda w: w <> ''), lambda w, i: case when i = 1 then lower(w) else upper(w[1]) || lower(w[2:]) end), 'string_agg', '')"
_BT = ", ".join(f"('{k}', [{', '.join(repr(w) for w in ws)}])" for k, ws in BASIC_TYPES.items())
SQL = {
    "node_projection": with_("nodes") + f", n as (select *, lower(trim(coalesce(canonical_type, ''))) as t from nodes), c as (select *, {_TYPE} as core from n) select node_id, core, {_LAYER} as core_layer, {_rules('coalesce(text, chr(0))', MODULE_RULES, 'production_safety')} as module, {_rules('coalesce(text, chr(0))', SCENARIO_RULES, 'none')} as scenario, substr(coalesce(nullif(trim(text), ''), nullif(trim(canonical_type), '')), 1, 20) as snippet from c",
    "edge_properties": rf"""with e as (select source_node_id, target_node_id, relation_type, rel_props, row_number() over () as rid from candidate_edges), u as (select rid, source_node_id, target_node_id, relation_type, unnest(list_concat(list_filter(map_entries(coalesce(rel_props, map {{}})), lambda x: x.key not in ('embedding', 'text', 'label source')), [{{'key': 'label source', 'value': 'graph'}}],
        case when rel_props is null or not map_contains(rel_props, 'kg_scope') then [{{'key': 'kg_scope', 'value': 'shared'}}] else [] end, case when rel_props is null or not map_contains(rel_props, 'kg_id') then [{{'key': 'kg_id', 'value': 'default'}}] else [] end)) as x from e),
        v as (select *, x.key as k, x.value as val from u), w as (select *, {_camel} as ck from v) select distinct source_node_id, target_node_id, relation_type, props from (select source_node_id, target_node_id, relation_type, rid, string_agg(ck || '=' || coalesce(val, 'null'), ';' order by ck) as props from w group by 1, 2, 3, 4)""",
    "file_names": r"""select distinct file_name, source, regexp_replace(trim(file_name), '[\\/:*?"<>|\s]+', '_', 'g') as safe, case when contains(source, 'None') then file_name else coalesce(source, file_name) end as label, 'f_' || substr(sha1(coalesce(source, '') || '|' || file_name), 1, 16) as digest from documents where file_name is not null""",
    "clock_times": "with e as (select event_id, cast(floor(epoch(ts)) as bigint) % 86400 as s from events) select event_id, printf('%d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) as clock, cast(s as integer) as seconds from e",
    "unit_pages": with_("units") + ", m as (select unit_id, case when json_valid(meta_json) then meta_json end as j from units), p as (select unit_id, try_cast(json_extract_string(j, '$.page') as integer) as one, try_cast(json_extract_string(j, '$.page_range[0]') as integer) as a, try_cast(json_extract_string(j, '$.page_range[1]') as integer) as b from m) select unit_id, coalesce(one, a) as first, coalesce(one, b) as last from p where one is not null or (a is not null and b is not null)",
    "scoped_graph": with_("edges") + " select distinct 'sha_red|default|' || replace(src, '|', '_') as src, 'sha_red|default|' || replace(dst, '|', '_') as dst from edges where src is not null and dst is not null",
    "choice_statements": "select p_partkey as id, label, case when p_partkey % 2 = 0 then 0 else 1 end as answer, label = case when p_partkey % 2 = 0 then 'A' else 'B' end as correct, case when p_partkey % 2 = 0 then txt || ' brand makes ' || p_name else 'The type of ' || p_name || ' is ' || txt end || '.' as statement from (select p_partkey, p_name, 'A' as label, p_brand as txt from part union all select p_partkey, p_name, 'B', p_type from part)",
    "training_texts": "with " + CTE["edges"] + ", best as (select * from (select *, row_number() over (partition by doc, src, rel, dst order by round(conf + case when coalesce(evidence_text, '') <> '' then 0.1 else 0 end + case when unit_id is not null then 0.1 else 0 end + case when source_chunk_pos is not null and target_chunk_pos is not null then 0.05 else 0 end, 6) desc, evidence_text desc nulls last, unit_id desc nulls last, source_text desc nulls last, target_text desc nulls last, source_layer desc nulls last, target_layer desc nulls last, source_chunk_pos desc nulls last, target_chunk_pos desc nulls last) as k from edges where src is not null and dst is not null) where k = 1) select doc, src, rel, dst, '[DOC] ' || coalesce(file_name, '') || ' [QUERY] why [SOURCE] ' || coalesce(source_text, '') || ' [RELATION] ' || rel || ' [TARGET] ' || coalesce(target_text, '') || ' [EVIDENCE] ' || coalesce(evidence_text, '') as text from best where doc is not null",
    "answer_sources": "select doc_id, cast(generate_subscripts(xs, 1) - 1 as integer) as k, unnest(xs) as name from (select doc_id, list_filter(list_transform(string_split(file_name || ',' || source, ','), lambda x: trim(replace(replace(x, '''', ''), '\"', ''))), lambda x: x <> '') as xs from documents where file_name is not null and source is not null)",
    "attention_weights": "with e as (select event_id, user_id, coalesce(value, 0.0) / 100 as v, coalesce(event_type, '') = 'click' as m from events where user_id is not null), x as (select *, case when m then 0.0 else exp(v - max(case when not m then v end) over (partition by user_id)) end as w from e) select event_id, round(case when sum(w) over (partition by user_id) = 0 then 0.0 else w / sum(w) over (partition by user_id) end, 6) as weight from x",
    "top_share_events": "with r as (select *, row_number() over (partition by event_type order by value desc, event_id) as rn, floor(count(*) over (partition by event_type) * 0.1) as k from events where event_type is not null and value is not null) select event_type, event_id, value from r where k <= 0 or rn <= k",
    "merged_signals": "with n as (select lower(trim(doc_id)) as doc, unnest(map_entries(severity_signals)) as x from causal_nodes where node_id is not null and doc_id is not null) select doc, x.key as signal, max(x.value) as value from n group by 1, 2",
    "pooled_vectors": "with x as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings where label is not null and embedding is not null) select label, cast(i as integer) as i, round(cast(max(v) as double), 5) as top, round(avg(cast(v as double)), 4) + 0.0 as mean from x group by 1, 2",
    "numbered_tokens": with_("nodes") + r" , t as (select unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) as w from nodes where text is not null) select case when regexp_matches(w, '^[0-9]+([.,][0-9]+)*$') then '<NUM>' else w end as token, count(*) as n from t group by 1",
    "neighbour_lists": with_("edges") + ", e as (select distinct src, dst from edges where src is not null and dst is not null and src <> dst), b as (select src as node, dst as x from e union select dst, src from e), o as (select src as node, string_agg(dst, ',' order by dst) as successors from e group by 1) select node, max(successors) as successors, string_agg(x, ',' order by x) as neighbours from b left join o using (node) group by node",
    "type_scores": with_("units") + f", s as (select unit_id, k as basic_type, round(len(list_filter(ws, lambda w: contains(content, w))) / len(ws), 4) as score from units, (values {_BT}) v(k, ws) where content is not null) select * from s where score > 0",
    "probability_questions": with_("units") + " select coalesce(unit_kind, '') as unit_kind, count(*) filter (where regexp_matches(lower(coalesce(content, '')), '概率|可能性|几率|probability|likelihood|how likely')) as asking, count(*) as units from units group by 1",
    "joint_scores": f"{_PRE}, {_FEAT}, {_MULTI} select doc, src, rel, dst, round(0.4 * causal_conf + 0.1 * (enable_conf + dir_conf + temporal_conf + first_src_conf + first_dst_conf), 6) as joint from m",
    "module_recall": with_("nodes") + ", n as (select lower(trim(doc_id)) as doc, module_id from nodes where doc_id is not null and module_id is not null), c as (select doc, module_id, row_number() over (partition by doc order by count(*) desc, module_id) as k from n group by 1, 2), j as (select k, (select substr(f.module_id, 1, 1) from c f where f.doc = n.doc and f.k = 1) = substr(n.module_id, 1, 1) as sec from n join c using (doc, module_id)) select round(avg(case when k = 1 then 1.0 else 0 end), 6) as exact, round(avg(case when sec then 1.0 else 0 end), 6) as section, round(avg(case when k <= 1 then 1.0 else 0 end), 6) as recall_1, round(avg(case when k <= 3 then 1.0 else 0 end), 6) as recall_3, round(avg(case when k <= 5 then 1.0 else 0 end), 6) as recall_5, 1.0 as coverage from j",
    "pruned_concepts": "with w as (select distinct p_partkey as sent, unnest(string_split(lower(p_name), ' ')) as concept from part), b as (select * from w union select sent, concept || 'er' from w where sent % 2 = 0), ok as (select * from b where concept not in ('my', 'you', 'it', 'its', 'your', 'i', 'he', 'she', 'his', 'her', 'they', 'them', 'their', 'our', 'we', 'the', 'a') and len(string_split(replace(concept, '_', ' '), ' ')) < 5) select sent, concept from ok x where not exists (select 1 from ok y where y.sent = x.sent and y.concept = regexp_replace(x.concept, '(er|e)$', '') and y.concept <> x.concept)",
    "chain_graphs": "with e as (select * from (select *, row_number() over (partition by edge_id order by updated_at desc) as k from causal_chain_edges where edge_id is not null and chain_id is not null and source_node_id is not null and target_node_id is not null) where k = 1), o as (select chain_id, source_node_id as s, target_node_id as t, lead(source_node_id) over z as nxt, row_number() over z as i, count(*) over (partition by chain_id) as n from e window z as (partition by chain_id order by seq, edge_id)) select distinct chain_id as id, s as src, nxt as dst from o where n > 1 and nxt is not null union select chain_id, s, t from o where n = 1",
    "listed_values": with_("labels") + " , t as (select sample_id, trim(coalesce(canonical_type_ids_json, '')) as t from labels), l as (select sample_id, case when t = '' then [] when starts_with(t, '[') and json_valid(t) then cast(from_json(t, '[\"VARCHAR\"]') as varchar[]) when starts_with(t, '[') then [t] when contains(t, ',') then list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') else [t] end as xs from t) select sample_id, cast(generate_subscripts(xs, 1) - 1 as integer) as k, unnest(xs) as v from l",
    "sample_weights": with_("labels") + ", s as (select sample_id, sample_weight as c, silver_edge_causal as x, silver_edge_enable as y from labels), w as (select *, case when x = 1 then 1.0 when x = 0 then 0.9 * coalesce(greatest(0.5, least(1.0, c)), 1.0) else 0.8 * coalesce(greatest(0.5, least(1.0, c)), 1.0) end as w from s) select sample_id, round(case when y = 0 then greatest(w, 1.0) when y = 1 then greatest(w, 0.95) when x = 1 then w else least(w, 0.85) end, 6) as weight from w",
    "reviewed_labels": with_("labels") + ", s as (select sample_id, silver_edge_causal as l, ascii(substr(sample_id, 5, 1)) % 4 as k from labels where silver_edge_causal in (0, 1)) select sample_id, case k when 0 then 'accepted' when 2 then 'edited' else 'pending' end as review_status, case when k = 2 then 0 else l end as label from s where k <> 1",
    "upserted_chunks": "with o as (select evidence_id, max(case when position % 2 = 1 then content || ' (2)' end) as n, arg_max(content, (updated_at, file_name, position, content)) as c, min(created_at) as created_at, max(updated_at) as updated_at, max(case when position % 2 = 1 then 1 else 0 end) as again from evidence_chunks where evidence_id is not null group by 1) select evidence_id, md5(case when again = 1 then n else c end) as content, created_at, case when again = 1 then '2030-01-01T00:00:00' else updated_at end as updated_at from o",
    "packed_subgraphs": with_("nodes", "edges") + f", v as (select distinct {_NORM.format('text')} as c from nodes where layer <> 'UNK' and text is not null), n as (select lower(trim(doc_id)) as sample, node_id, {_NORM.format('text')} as c from nodes where doc_id is not null and text is not null), s as (select * from (select sample, node_id, row_number() over (partition by sample order by node_id) - 1 as slot from n where c in (select c from v where c <> '')) where slot < 8), e as (select distinct doc, src, rel, dst from edges where doc is not null and src is not null and dst is not null), p as (select e.doc as sample, rel, a.slot as i, b.slot as j from e join s a on a.sample = e.doc and a.node_id = e.src join s b on b.sample = e.doc and b.node_id = e.dst) select sample, rel, cast(i as integer) as i, cast(j as integer) as j from p union select sample, rel || '*', cast(j as integer), cast(i as integer) from p",
    "best_documents": "select * from (select lower(substr(lang, 1, 2)) as lang, doc_id, n_chars, cast(row_number() over (partition by lower(substr(lang, 1, 2)) order by n_chars desc nulls last, doc_id) as integer) as rank from documents where lang is not null) where rank <= 5",
}
