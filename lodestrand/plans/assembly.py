"""Graph overlays, contexts, chains from labels, industry evidence and registrations as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand import lexicons as lx
from lodestrand.functions import text as tx
from lodestrand.operators import chains as ch
from lodestrand.operators import scoring as sc
from lodestrand.operators.views import CTE, chunks, doc_key, edges, labels, nodes, units, with_
from lodestrand.plans.paths import _NORM
from lodestrand.plans.projections import PROCESS_TERMS
from lodestrand.plans.scores import _FEAT, _MULTI, _PRE, with_evidence
from lodestrand.session import cut, table

# Canonical event types of layers, and the types that stand as they are.
LAYER_TYPES = {"STATE": "SourceState", "CAUSE": "SourceEvent", "FACTOR": "SourceEvent", "CONDITION": "SourceEvent", "ACTION": "SourceEvent", "INTERMEDIATE": "IntermediateEvent", "MECHANISM": "IntermediateEvent", "EVENT": "HarmEvent", "OUTCOME": "HarmEvent", "CONSEQUENCE": "Consequence"}
EVENT_TYPES = ["SourceState", "SourceEvent", "IntermediateEvent", "HarmEvent", "Consequence"]
# Relations no extraction may give, those an implicit edge may have, and those that project to the next level.
BANNED_RELATIONS = ["NEXT_LEVEL_CAUSES", "SUPPORTED_BY", "CO_OCCURS_IN_EVIDENCE"]
IMPLICIT_RELATIONS = ["POTENTIAL_CAUSE", "POTENTIAL_ENABLE", "PRECEDES"]
# What the title of an accident looks like, what is none, and words of consequences.
TITLE_EXCLUDE, TITLE_PATTERN = ["原因", "措施"], "事故|accident|Unfall"
CONSEQUENCE_WORDS, TERMINAL = ["死亡", "受伤", "损失", "伤亡"], ["OUTCOME", "CONSEQUENCE"]


def _map(c, table_: dict[str, str], default):
    out = None
    for k, v in table_.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def event_types(spark: SparkSession, d: str) -> DataFrame:
    """The event type of each node: its canonical type if it is one, else that of its layer, else a source event."""
    t = F.when(F.col("canonical_type").isin(EVENT_TYPES), F.col("canonical_type")).otherwise(_map(F.upper(F.coalesce("layer", F.lit("UNK"))), LAYER_TYPES, "SourceEvent"))
    return nodes(spark, d).select("node_id", t.alias("event_type"))


def next_level(spark: SparkSession, d: str) -> DataFrame:
    """Edges that project to the next level: of a causal relation, both ends on the main chain (tagged ``main``) with a
    layer; relations no extraction may give are left out. With the preview of the projection."""
    n = nodes(spark, d).where(F.array_contains("role_tags", "main") & F.col("layer").isNotNull()).select("node_id", "layer", F.coalesce("text", "node_id").alias("name"))
    e = edges(spark, d).where(~F.col("rel").isin(BANNED_RELATIONS) & F.col("rel").isin(lx.RELATION_WHITELIST)).select("src", "dst").distinct()
    a, b = n.select(F.col("node_id").alias("src"), F.concat_ws(":", "layer", "name").alias("x")), n.select(F.col("node_id").alias("dst"), F.concat_ws(":", "layer", "name").alias("y"))
    return e.join(a, "src").join(b, "dst").select("src", "dst", F.concat_ws(" -> ", "x", "y").alias("preview"))


def evidence_context(spark: SparkSession, d: str) -> DataFrame:
    """The first eight units of each chunk as the lines of a prompt: ``parent_evidence_id``, ``context``."""
    u = units(spark, d).where("content is not null")
    order = Window.partitionBy("parent_evidence_id").orderBy(F.col("start_char").asc_nulls_last(), "unit_id")
    u = u.withColumn("k", F.row_number().over(order)).where("k <= 8")
    line = F.concat(F.lit("[EU"), F.col("k"), F.lit("] id="), "unit_id", F.lit(" kind="), F.coalesce("unit_kind", F.lit("None")), F.lit(" triggers="), F.array_join(tx.hits("content", lx.UNIT_TRIGGERS), ","), F.lit(" text="), "content")
    return u.groupBy("parent_evidence_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("xs")).select("parent_evidence_id", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("context"))


def title_filter(spark: SparkSession, d: str) -> DataFrame:
    """Texts of edges that look like an accident's title (no excluded word, one of the patterns), and those of consequences."""
    e = edges(spark, d)
    t = e.select(F.col("source_text").alias("text"), F.col("source_layer").alias("layer")).unionByName(e.select(F.col("target_text").alias("text"), F.col("target_layer").alias("layer"))).where("text is not null").distinct()
    title = (F.trim("text") != "") & ~tx.contains_any("text", TITLE_EXCLUDE) & F.col("text").rlike(TITLE_PATTERN)
    end = F.upper(F.coalesce("layer", F.lit(""))).isin(TERMINAL) | tx.contains_any("text", CONSEQUENCE_WORDS)
    return t.select("text", "layer", title.alias("title_like"), end.alias("consequence_like"))


def implicit_edges(spark: SparkSession, d: str) -> DataFrame:
    """Explicit edges of the three types an implicit edge may have, keyed by their ends' ids or, without one, texts."""
    e = edges(spark, d).withColumn("rel", F.when(F.col("rel").isin("CAUSES", "TRIGGERS"), "POTENTIAL_CAUSE").when(F.col("rel") == "ENABLES", "POTENTIAL_ENABLE").otherwise(F.col("rel"))).where(F.col("rel").isin(IMPLICIT_RELATIONS))
    a, b = F.coalesce("src", "source_text"), F.coalesce("dst", "target_text")
    return e.where(a.isNotNull() & b.isNotNull()).groupBy(a.alias("source"), "rel", b.alias("target")).agg(F.max("conf").alias("score"), F.count("*").alias("merged"))


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    """Causal edges merged by relation, ends, document, scope, graph and evidence unit; the highest confidence stays."""
    e = table(spark, d, "candidate_edges").where("source_node_id is not null and target_node_id is not null")
    rel = F.upper(F.trim(F.coalesce("relation_type", F.lit(""))))
    key = [rel.alias("rel"), F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), doc_key().alias("doc"), "kg_scope", "kg_id", F.element_at("rel_props", "evidence_unit_id").alias("unit_id")]
    return e.where(rel.isin(lx.RELATION_WHITELIST)).groupBy(*key).agg(F.round(F.max(tx.relation_confidence("rel_props")), 6).alias("confidence"))


def persisted_units(spark: SparkSession, d: str) -> DataFrame:
    """Units as they are stored under the chunks that are there; a unit whose chunk is missing is skipped."""
    c = chunks(spark, d).select(F.col("evidence_id").alias("parent_evidence_id"), "file_name")
    u = units(spark, d).join(c, "parent_evidence_id")
    return u.select("unit_id", "parent_evidence_id", "file_name", F.coalesce("unit_kind", F.lit("paragraph")).alias("unit_kind"), F.coalesce("start_char", F.lit(-1)).alias("start_char"), F.length(F.coalesce("content", F.lit(""))).alias("chars"))


def registered_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents registered by file name, the last one read replacing the others, with their status, and counts of each."""
    docs = table(spark, d, "documents").where("file_name is not null").select("file_name", "doc_id", "source", F.coalesce("n_chars", F.lit(0)).alias("chars"))
    best = docs.groupBy("file_name").agg(F.max(F.struct("doc_id", "source", "chars")).alias("x"), F.count("*").alias("rows"))
    s = best.select("x.source", F.when(F.col("x.chars") > 0, "Success").otherwise("Failed").alias("status"), "rows")
    return s.groupBy("source", "status").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


def source_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 50 new files of the table of sources, the longest first."""
    f = table(spark, d, "documents").where("file_name is not null").groupBy("file_name").agg(F.max("n_chars").alias("chars"), F.max("source").alias("source"))
    new = f.where("chars is not null and chars > 0")
    return new.orderBy(F.desc("chars"), "file_name").offset(50).limit(50)


def scored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the best score of the edges that start in them, and their place by it within the file; chunks without one come last."""
    s = edges(spark, d).where("source_chunk_id is not null").groupBy(F.col("source_chunk_id").alias("evidence_id")).agg(F.max("conf").alias("score"))
    j = chunks(spark, d).where("file_name is not null").select("file_name", "evidence_id").join(s, "evidence_id", "left")
    order = Window.partitionBy("file_name").orderBy(F.col("score").desc_nulls_last(), "evidence_id")
    return j.select("file_name", "evidence_id", "score", F.row_number().over(order).alias("place"))


def risk_context(spark: SparkSession, d: str) -> DataFrame:
    """For every node of layer EVENT the actors, sites and risk factors within one or two steps, each once, as sorted text."""
    n = nodes(spark, d).select("node_id", F.coalesce("text", "node_id").alias("name"), "layer", "canonical_type", "role_tags")
    e = edges(spark, d).where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    both = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    asked = n.where("layer = 'EVENT'").select("node_id")
    one = both.join(asked.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("src").alias("node_id"), F.col("dst").alias("o"))
    two = one.select("node_id", F.col("o").alias("src")).join(both, "src").select("node_id", F.col("dst").alias("o"))
    near = one.unionByName(two).where("node_id <> o").distinct().join(n.select(F.col("node_id").alias("o"), "name", "layer", "canonical_type", "role_tags"), "o")
    has = lambda t: F.array_contains(F.coalesce("role_tags", F.array().cast("array<string>")), t)
    pick = lambda c, name: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("name")))), "; ").alias(name)
    risk = F.when(F.col("canonical_type").isNotNull(), F.concat_ws("/", "name", "layer"))
    return near.groupBy("node_id").agg(pick(has("actor"), "actors"), pick(has("site"), "sites"), F.array_join(F.sort_array(F.collect_set(risk)), "; ").alias("risks"))


def label_chain_edges(spark: SparkSession, d: str, least: float = 0.55) -> DataFrame:
    """Edges of chains from the labels: supported ones, turned into the likelier direction, allowed between their layers and not
    from a title, with score confidence + .05 x enabling label; where a document has none, its edges of at least ``least`` stand in."""
    m = sc.support_label(sc.multitask(sc.evidence_features(with_evidence(spark, d)))).where("doc is not null")
    tasks = ["causal_conf", "enable_label", "support_label", "dir_conf", "first_src_conf", "first_dst_conf"]
    m = cut(m.select("doc", "src", "dst", "source_layer", "target_layer", "source_text", "target_text", *tasks))  # so that no score is worked out twice
    m = m.withColumns({"dir_prob": F.col("dir_conf"), "src_first": F.col("first_src_conf"), "dst_first": F.col("first_dst_conf")})
    m = sc.normalize_direction(m)
    ends = m.withColumns({"a": F.when(F.col("swapped"), F.col("target_layer")).otherwise(F.col("source_layer")), "b": F.when(F.col("swapped"), F.col("source_layer")).otherwise(F.col("target_layer")), "name": F.when(F.col("swapped"), F.col("target_text")).otherwise(F.col("source_text"))})
    title = ~tx.contains_any("name", TITLE_EXCLUDE) & F.coalesce(F.col("name").rlike(TITLE_PATTERN), F.lit(False))
    ok = ends.where(~title).select("doc", F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("a").alias("source_layer"), F.col("b").alias("target_layer"), "causal_conf", "enable_label", "support_label")
    ok = cut(ok.where(sc.transition_allowed(lx.TRANSITIONS, True, True)))
    hard = ok.where("support_label = 1")
    rest = ok.where(F.col("causal_conf") >= least).join(hard.select("doc").distinct(), "doc", "left_anti")
    score = F.round(F.col("causal_conf") + 0.05 * F.greatest("enable_label", F.lit(0)), 6)
    return hard.unionByName(rest).groupBy("doc", "src", "dst").agg(F.max(score).alias("score"))


def label_chains(spark: SparkSession, d: str) -> DataFrame:
    """Paths of up to four steps over the twenty best of those edges of each document."""
    e = label_chain_edges(spark, d)
    rn = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "src", "dst"))
    e = e.where("src <> dst").withColumn("rn", rn).where("rn <= 20").select("doc", "src", "dst", "score", F.lit(0).alias("stop"))
    return ch.dfs_chains(e).select("doc", F.array_join("path", ">").alias("path"), "hops", "score")


def industry_cues(spark: SparkSession, d: str) -> DataFrame:
    """Of each chain the first ten distinct texts of its edges, the process terms they name, and how many of its edges name each."""
    e = table(spark, d, "causal_chain_edges").where("edge_id is not null and chain_id is not null").groupBy("edge_id").agg(F.max(F.struct("updated_at", "chain_id", "seq", "source_node_id", "target_node_id")).alias("x")).select("edge_id", "x.*")
    n = nodes(spark, d).select("node_id", "text")
    s, t = n.select(F.col("node_id").alias("source_node_id"), F.col("text").alias("a")), n.select(F.col("node_id").alias("target_node_id"), F.col("text").alias("b"))
    j = e.join(s, "source_node_id", "left").join(t, "target_node_id", "left").select("chain_id", "edge_id", "seq", F.concat_ws(" ", "a", "b").alias("block"), "a", "b")
    texts = F.array_distinct(F.filter(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "edge_id", F.array("a", "b").alias("ts")))), lambda x: x["ts"])), lambda x: x.isNotNull() & (x != "")))
    per = j.groupBy("chain_id").agg(F.array_join(F.slice(texts, 1, 10), " | ").alias("cues"), *(F.count_if(F.col("block").contains(w)).alias(f"t{i}") for i, w in enumerate(PROCESS_TERMS)))
    terms = F.filter(F.array(*(F.when(F.col(f"t{i}") > 0, F.concat(F.lit(w + "="), F.col(f"t{i}"))) for i, w in enumerate(PROCESS_TERMS))), lambda x: x.isNotNull())
    return per.select("chain_id", "cues", F.array_join(terms, ",").alias("terms"))


def concept_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id of the type or brand of each part in the list of types, cleaned as concepts are; -1 where it is unknown or no word."""
    under = lambda c: F.replace(F.lower(F.col(c)), F.lit(" "), F.lit("_"))
    p = table(spark, d, "part")
    ids = p.select(under("p_type").alias("c")).distinct().select("c", (F.row_number().over(Window.orderBy("c")) - 1).alias("id"))
    k = F.col("p_partkey") % 3
    asked = p.select("p_partkey", tx.clean_concept(F.when(k == 0, F.concat(under("p_type"), F.lit("/n"))).when(k == 1, F.concat(F.lit("c/en/"), F.replace("p_type", F.lit(" "), F.lit("_")))).otherwise(F.col("p_brand"))).alias("c"))
    return asked.join(ids, "c", "left").select("p_partkey", F.coalesce("id", F.lit(-1)).alias("concept_id"))


def batch_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Edges of documents as one batch: slots moved by the document's place times 32, and the relation one-hot over four."""
    e = edges(spark, d).where("doc is not null and src is not null and dst is not null").select("doc", "src", "rel", "dst").distinct()
    docs = e.select("doc").distinct().orderBy("doc").limit(1000)
    docs = docs.select("doc", (F.row_number().over(Window.orderBy("doc")) - 1).alias("g"))
    n = e.select("doc", F.col("src").alias("node")).unionByName(e.select("doc", F.col("dst").alias("node"))).distinct().join(docs, "doc")
    slot = n.select("doc", "g", "node", (F.row_number().over(Window.partitionBy("doc").orderBy("node")) - 1).alias("s")).where("s < 32").withColumn("at", F.col("g") * 32 + F.col("s"))
    a, b = slot.select("doc", F.col("node").alias("src"), F.col("at").alias("i")), slot.select("doc", F.col("node").alias("dst"), F.col("at").alias("j"))
    hot = [(F.col("rel") == r).cast("int").alias(f"is_{r.lower()}") for r in ("CAUSES", "ENABLES", "PRECEDES", "LEADS_TO")]
    return e.join(a, ["doc", "src"]).join(b, ["doc", "dst"]).select("i", "j", "rel", *hot)


def answer_entities(spark: SparkSession, d: str) -> DataFrame:
    """Of each chunk up to five entities by name and how many sources name them."""
    e = edges(spark, d)
    m = e.select(F.col("source_chunk_id").alias("chunk"), F.col("source_text").alias("n"), "file_name").unionByName(e.select(F.col("target_chunk_id").alias("chunk"), F.col("target_text").alias("n"), "file_name")).where("chunk is not null and n is not null")
    g = m.groupBy("chunk").agg(F.sort_array(F.collect_set("n")).alias("ns"), F.countDistinct("file_name").alias("sources"))
    return g.select("chunk", F.array_join(F.slice("ns", 1, 5), "; ").alias("entities"), "sources")


def role_names(spark: SparkSession, d: str) -> DataFrame:
    """Roles of counterfactual samples, given as text or as a number, as positive, negative or none."""
    k = F.col("silver_edge_causal")
    raw = F.when(F.ascii(F.substring("sample_id", 5, 1)) % 3 == 0, k.cast("string")).when(k == 1, " Positive ").when(k == 0, "NEGATIVE").otherwise("both")
    r = F.lower(F.trim(raw))
    role = F.when(r.isin("positive", "1"), "positive").when(r.isin("negative", "0"), "negative").otherwise("none")
    return labels(spark, d).select("sample_id", role.alias("role"))


def node_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions of nodes (text, else id) and the order of their kinds in a legend: documents and chunks first, then by name."""
    n = nodes(spark, d).select(F.coalesce("layer", F.lit("UNK")).alias("kind"), F.coalesce(F.nullif("text", F.lit("")), "node_id").alias("caption"))
    k = n.groupBy("kind").agg(F.count("*").alias("nodes"), F.min("caption").alias("first_caption"))
    c = chunks(spark, d).agg(F.lit("Chunk").alias("kind"), F.count("*").alias("nodes"), F.min("evidence_id").alias("first_caption"))
    f = chunks(spark, d).agg(F.lit("Document").alias("kind"), F.countDistinct("file_name").alias("nodes"), F.min("file_name").alias("first_caption"))
    every = k.unionByName(c).unionByName(f)
    return every.select("kind", "nodes", "first_caption", F.row_number().over(Window.orderBy(F.when(F.col("kind") == "Document", 0).when(F.col("kind") == "Chunk", 1).otherwise(2), "kind")).alias("place"))


def aligned_pairs(spark: SparkSession, d: str, least: float = 0.2) -> DataFrame:
    """Cells of a matrix of at least a threshold: places of the vectors of ``embeddings`` whose value reaches it."""
    v = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.posexplode("embedding").alias("j", "x"))
    return v.where(F.col("x") >= F.lit(least).cast("float")).select("vec_id", "j", F.round(F.col("x").cast("double"), 5).alias("score"))


def size_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How many windows and characters chunking by 200, 500 and 1,000 characters with a tenth of overlap gives, by language."""
    docs = table(spark, d, "documents").where("text is not null and text <> ''").select(F.lower(F.substring("lang", 1, 2)).alias("lang"), F.length("text").alias("n"))
    g = docs.select("lang", "n", F.explode(F.array(*map(F.lit, (200, 500, 1000)))).alias("size"))
    step = F.col("size") * 9 / 10
    w = F.when(F.col("n") <= F.col("size"), 1).otherwise(F.ceil((F.col("n") - F.col("size")) / step) + 1)
    return g.groupBy("lang", "size").agg(F.sum(w).cast("bigint").alias("windows"), F.sum(F.col("n") + (w - 1) * F.col("size") / 10).cast("bigint").alias("chars"))


def concept_difference(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of the sources of a file that are no targets there, and those that are both."""
    e = edges(spark, d).where("file_name is not null")
    s = e.groupBy("file_name").agg(F.collect_set(F.nullif(tx.normalize("source_text"), F.lit(""))).alias("a"), F.collect_set(F.nullif(tx.normalize("target_text"), F.lit(""))).alias("b"))
    return s.select("file_name", F.array_join(F.sort_array(F.array_except("a", "b")), "; ").alias("only_sources"), F.size(F.array_intersect("a", "b")).alias("both"))


def retrieval_texts(spark: SparkSession, d: str) -> DataFrame:
    """The question of each chain for its type of accident: roots, harm and consequences joined, parts that are missing left out."""
    e = table(spark, d, "causal_chain_edges").where("edge_id is not null and chain_id is not null").groupBy("edge_id").agg(F.max(F.struct("updated_at", "chain_id", "seq", "source_node_id", "target_node_id", "target_layer")).alias("x")).select("edge_id", "x.*")
    ends = e.groupBy("chain_id").agg(F.min(F.struct("seq", "edge_id", "source_node_id")).alias("f"), F.max(F.struct("seq", "edge_id", "target_node_id")).alias("l"))
    n = nodes(spark, d).select("node_id", F.nullif("text", F.lit("")).alias("text"))
    j = ends.select("chain_id", F.col("f.source_node_id").alias("r"), F.col("l.target_node_id").alias("h")).join(n.select(F.col("node_id").alias("r"), F.col("text").alias("rt")), "r", "left").join(n.select(F.col("node_id").alias("h"), F.col("text").alias("ht")), "h", "left")
    return j.select("chain_id", F.concat_ws("\n", F.lit("检索任务: type"), F.concat(F.lit("原始查询: "), F.nullif(F.concat_ws("；", "rt", "ht"), F.lit("")))).alias("query"))


def effective_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents in force on a day (taken in on or before it, or without a time), of the languages of a task and of a user together."""
    wanted = ["zh", "en"] + ["de"]
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("lang"), F.to_date("ingested_at").alias("day"))
    return docs.where(F.col("lang").isin(wanted) & (F.col("day").isNull() | (F.col("day") <= F.lit("2024-06-30").cast("date")))).select("doc_id", "lang")


def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines of chunks under the numbered heading above them (``正文`` without one): sections with their lines and characters."""
    c = chunks(spark, d).where("content is not null").select("evidence_id", F.posexplode(F.split("content", "\n")).alias("k", "line")).select("evidence_id", "k", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")).where("line <> ''")
    head = F.col("line").rlike(r"^([一二三四五六七八九十]+、|[0-9]+[.、])\s*.+$")
    title = F.regexp_extract("line", r"^(?:[一二三四五六七八九十]+、|[0-9]+[.、])\s*(.+)$", 1)
    order = Window.partitionBy("evidence_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    c = c.select("evidence_id", "line", head.alias("head"), F.sum(head.cast("int")).over(order).alias("section"), F.last(F.when(head, title), ignorenulls=True).over(order).alias("title"))
    return c.where("not head").groupBy("evidence_id", F.col("section").cast("bigint").alias("section"), F.coalesce("title", F.lit("正文")).alias("title")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def failed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Results of a model cleared for the files whose runs all failed; what is left by model."""
    r = table(spark, d, "llm_results").where("result_id is not null").dropDuplicates(["result_id"])
    bad = r.where("file_name is not null").groupBy("file_name").agg(F.max(F.coalesce("node_count", F.lit(0))).alias("n")).where("n <= 1").select("file_name")
    return r.join(bad, "file_name", "left_anti").groupBy("llm").agg(F.count("*").alias("results"))


_ALL = (
    event_types, next_level, evidence_context, title_filter, implicit_edges, merged_edges, persisted_units, registered_sources, source_page, scored_chunks, risk_context, label_chain_edges, label_chains, industry_cues,
    concept_ids, batch_offsets, answer_entities, role_names, node_captions, aligned_pairs, size_sweep, concept_difference, retrieval_texts, effective_documents, report_sections, failed_documents,
)
QUERIES = {f.__name__: f for f in _ALL}

_q = lambda xs: ", ".join(repr(x) for x in xs)
_l = lambda xs: f"[{_q(xs)}]"
_has = lambda t, ws: f"(len(list_filter({_l(ws)}, lambda w: contains({t}, w))) > 0)"
_CCE = "ce as (select * from (select *, row_number() over (partition by edge_id order by updated_at desc) as k from causal_chain_edges where edge_id is not null and chain_id is not null) where k = 1)"
_ORDER = ", ".join(repr(x) for x in lx.LAYERS)
_AT = f"coalesce(nullif(list_position([{_ORDER}], upper({{}})), 0), 1000000)"
_OK = "case when coalesce(upper(b), 'UNK') = 'UNK' then true " + " ".join(f"when upper(a) = '{k}' then coalesce(upper(b) in ({_q(v)}), false)" if v else f"when upper(a) = '{k}' then false" for k, v in lx.TRANSITIONS.items()) + " else true end"
_LABELLED = f"""{_PRE.replace('with ', 'with recursive ', 1)}, {_FEAT}, {_MULTI}, d0 as (select *, case when dir_conf <= 0.45 then 'r' when dir_conf >= 0.55 then 'f' when first_dst_conf > first_src_conf then 'r' when first_src_conf > first_dst_conf then 'f' else 'l' end as why from m where doc is not null),
    d1 as (select *, why = 'r' or (why = 'l' and {_AT.format('source_layer')} > {_AT.format('target_layer')}) as sw from d0),
    d2 as (select doc, case when sw then dst else src end as src, case when sw then src else dst end as dst, case when sw then target_layer else source_layer end as a, case when sw then source_layer else target_layer end as b, case when sw then target_text else source_text end as name, causal_conf, enable_label, case when causal_label = 1 or causal_conf >= 0.55 then 1 else 0 end as sup from d1),
    d3 as (select * from d2 where not (not {_has("coalesce(name, '')", TITLE_EXCLUDE)} and coalesce(regexp_matches(name, '{TITLE_PATTERN}'), false)) and {_OK}),
    lc as (select doc, src, dst, max(round(causal_conf + 0.05 * greatest(enable_label, 0), 6)) as score from d3 where sup = 1 or (causal_conf >= 0.55 and doc not in (select doc from d3 where sup = 1)) group by 1, 2, 3)"""
SQL = {
    "event_types": with_("nodes") + f" select node_id, case when canonical_type in ({_q(EVENT_TYPES)}) then canonical_type " + " ".join(f"when upper(layer) = '{k}' then '{v}'" for k, v in LAYER_TYPES.items()) + " else 'SourceEvent' end as event_type from nodes",
    "next_level": with_("nodes", "edges") + f", n as (select node_id, layer || ':' || coalesce(text, node_id) as x from nodes where list_contains(role_tags, 'main') and layer is not null), e as (select distinct src, dst from edges where rel in ({_q(lx.RELATION_WHITELIST)})) select src, dst, a.x || ' -> ' || b.x as preview from e join n a on a.node_id = src join n b on b.node_id = dst",
    "evidence_context": with_("units") + f", k as (select *, row_number() over (partition by parent_evidence_id order by start_char nulls last, unit_id) as k from units where content is not null) select parent_evidence_id, string_agg('[EU' || k || '] id=' || unit_id || ' kind=' || coalesce(unit_kind, 'None') || ' triggers=' || array_to_string(list_filter({_l(lx.UNIT_TRIGGERS)}, lambda w: contains(content, w)), ',') || ' text=' || content, chr(10) order by k) as context from k where k <= 8 group by 1",
    "title_filter": with_("edges") + f", t as (select source_text as text, source_layer as layer from edges where source_text is not null union select target_text, target_layer from edges where target_text is not null) select text, layer, trim(text) <> '' and not {_has('text', TITLE_EXCLUDE)} and regexp_matches(text, '{TITLE_PATTERN}') as title_like, coalesce(upper(layer) in ({_q(TERMINAL)}), false) or {_has('text', CONSEQUENCE_WORDS)} as consequence_like from t",
    "implicit_edges": with_("edges") + ", e as (select *, case when rel in ('CAUSES', 'TRIGGERS') then 'POTENTIAL_CAUSE' when rel = 'ENABLES' then 'POTENTIAL_ENABLE' else rel end as r from edges) select coalesce(src, source_text) as source, r as rel, coalesce(dst, target_text) as target, max(conf) as score, count(*) as merged from e where r in ('POTENTIAL_CAUSE', 'POTENTIAL_ENABLE', 'PRECEDES') and coalesce(src, source_text) is not null and coalesce(dst, target_text) is not null group by 1, 2, 3",
    "merged_edges": with_("edges") + f", c as (select upper(trim(coalesce(relation_type, ''))) as rel, source_node_id as src, target_node_id as dst, lower(trim(doc_id)) as doc, kg_scope, kg_id, rel_props['evidence_unit_id'] as unit_id, try_cast(rel_props['confidence'] as double) as c from candidate_edges where source_node_id is not null and target_node_id is not null) select rel, src, dst, doc, kg_scope, kg_id, unit_id, round(max(case when c is null or c < 0 then 0.0 when c > 1 then least(1.0, c / 100) else c end), 6) as confidence from c where rel in ({_q(lx.RELATION_WHITELIST)}) group by 1, 2, 3, 4, 5, 6, 7",
    "persisted_units": with_("units", "chunks") + " select unit_id, parent_evidence_id, file_name, coalesce(unit_kind, 'paragraph') as unit_kind, cast(coalesce(start_char, -1) as integer) as start_char, length(coalesce(u.content, '')) as chars from units u join (select evidence_id, file_name from chunks) c on c.evidence_id = parent_evidence_id",
    "registered_sources": "with f as (select file_name, arg_max(source, doc_id) as source, arg_max(coalesce(n_chars, 0), doc_id) as chars, count(*) as n from documents where file_name is not null group by 1) select source, case when chars > 0 then 'Success' else 'Failed' end as status, count(*) as files, sum(n) as rows from f group by 1, 2",
    "source_page": "select file_name, max(n_chars) as chars, max(source) as source from documents where file_name is not null group by 1 having max(n_chars) > 0 order by chars desc, file_name limit 50 offset 50",
    "scored_chunks": with_("edges", "chunks") + ", s as (select source_chunk_id as evidence_id, max(conf) as score from edges where source_chunk_id is not null group by 1) select file_name, evidence_id, score, cast(row_number() over (partition by file_name order by score desc nulls last, evidence_id) as integer) as place from (select file_name, evidence_id from chunks where file_name is not null) left join s using (evidence_id)",
    "risk_context": with_("nodes", "edges") + ", b as (select src as x, dst as y from edges where src <> dst union select dst, src from edges where src <> dst), o as (select x as node_id, y as o from b where x in (select node_id from nodes where layer = 'EVENT')), t as (select node_id, o from o union select o.node_id, b.y from o join b on b.x = o.o), j as (select t.node_id, coalesce(text, n.node_id) as name, layer, canonical_type, coalesce(role_tags, []) as tags from t join nodes n on n.node_id = t.o where t.node_id <> t.o) select node_id, coalesce(string_agg(distinct name, '; ' order by name) filter (where list_contains(tags, 'actor')), '') as actors, coalesce(string_agg(distinct name, '; ' order by name) filter (where list_contains(tags, 'site')), '') as sites, coalesce(string_agg(distinct name || coalesce('/' || layer, ''), '; ' order by name || coalesce('/' || layer, '')) filter (where canonical_type is not null), '') as risks from j group by 1",
    "label_chain_edges": f"{_LABELLED} select doc, src, dst, score from lc",
    "label_chains": f"""{_LABELLED}, te as (select doc, src, dst, score from (select *, row_number() over (partition by doc order by score desc, src, dst) as k from lc where src <> dst) where k <= 20),
        s1 as (select distinct doc, src from te), rt as (select doc, src from s1 where (doc, src) not in (select doc, dst from te)), st as (select * from rt union all select * from s1 where doc not in (select doc from rt)),
        p as (select doc, src as last, [src] as path, cast(0.0 as double) as total, 0 as hops, 1 as more from st union all
              select p.doc, te.dst, list_append(p.path, te.dst), p.total + te.score, p.hops + 1, case when exists (select 1 from s1 where s1.doc = te.doc and s1.src = te.dst) then 1 else 0 end from p join te on te.doc = p.doc and te.src = p.last where p.hops < 4 and p.more = 1 and not list_contains(p.path, te.dst))
        select doc, array_to_string(path, '>') as path, hops, round(total / hops, 6) as score from p where hops > 0 and (hops = 4 or more = 0)""",
    "industry_cues": with_("nodes") + f", {_CCE}, j as (select chain_id, edge_id, seq, s.text as a, t.text as b, concat_ws(' ', s.text, t.text) as block from ce left join nodes s on s.node_id = source_node_id left join nodes t on t.node_id = target_node_id), x as (select chain_id, edge_id, seq, 0 as o, a as t from j union all select chain_id, edge_id, seq, 1, b from j), f as (select chain_id, t, min((seq, edge_id, o)) as pos from x where t is not null and t <> '' group by 1, 2), c as (select chain_id, string_agg(t, ' | ' order by pos) as cues from (select *, row_number() over (partition by chain_id order by pos) as k from f) where k <= 10 group by 1), w as (select chain_id, u.w as w, u.o as o, count(*) as n from j, (select unnest({_l(PROCESS_TERMS)}) as w, generate_subscripts({_l(PROCESS_TERMS)}, 1) as o) u where contains(block, u.w) group by 1, 2, 3), g as (select chain_id, string_agg(w || '=' || n, ',' order by o) as terms from w group by 1) select chain_id, coalesce(cues, '') as cues, coalesce(terms, '') as terms from (select distinct chain_id from j) left join c using (chain_id) left join g using (chain_id)",
    "concept_ids": "with c as (select c, row_number() over (order by c) - 1 as id from (select distinct lower(replace(p_type, ' ', '_')) as c from part)), a as (select p_partkey, lower(replace(case when p_partkey % 3 < 2 then p_type else p_brand end, ' ', '_')) as c from part) select p_partkey, cast(coalesce(case when regexp_matches(replace(replace(a.c, '_', ''), '-', ''), '^[a-z]+$') then id end, -1) as integer) as concept_id from a left join c using (c)",
    "batch_offsets": with_("edges") + ", e as (select distinct doc, src, rel, dst from edges where doc is not null and src is not null and dst is not null), g as (select doc, row_number() over (order by doc) - 1 as g from (select distinct doc from e order by doc limit 1000)), s as (select doc, node, g * 32 + s as at from (select doc, node, row_number() over (partition by doc order by node) - 1 as s from (select doc, src as node from e union select doc, dst from e)) join g using (doc) where s < 32) select cast(a.at as integer) as i, cast(b.at as integer) as j, rel, cast(rel = 'CAUSES' as integer) as is_causes, cast(rel = 'ENABLES' as integer) as is_enables, cast(rel = 'PRECEDES' as integer) as is_precedes, cast(rel = 'LEADS_TO' as integer) as is_leads_to from e join s a on a.doc = e.doc and a.node = src join s b on b.doc = e.doc and b.node = dst",
    "answer_entities": with_("edges") + ", m as (select source_chunk_id as chunk, source_text as n, file_name from edges union all select target_chunk_id, target_text, file_name from edges), g as (select chunk, list_sort(list_distinct(list(n))) as ns, count(distinct file_name) as sources from m where chunk is not null and n is not null group by 1) select chunk, array_to_string(ns[1:5], '; ') as entities, sources from g",
    "role_names": with_("labels") + " select sample_id, case when silver_edge_causal = 1 then 'positive' when silver_edge_causal = 0 then 'negative' else 'none' end as role from labels",
    "node_captions": with_("nodes", "chunks") + ", k as (select coalesce(layer, 'UNK') as kind, count(*) as nodes, min(coalesce(nullif(text, ''), node_id)) as first_caption from nodes group by 1 union all select 'Chunk', count(*), min(evidence_id) from chunks union all select 'Document', count(distinct file_name), min(file_name) from chunks) select *, cast(row_number() over (order by case kind when 'Document' then 0 when 'Chunk' then 1 else 2 end, kind) as integer) as place from k",
    "aligned_pairs": "select vec_id, cast(i - 1 as integer) as j, round(cast(x as double), 5) as score from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings where embedding is not null) where x >= cast(0.2 as float)",
    "size_sweep": "with g as (select lower(substr(lang, 1, 2)) as lang, length(text) as n, unnest([200, 500, 1000]) as size from documents where text is not null and text <> ''), w as (select *, case when n <= size then 1 else ceil((n - size) / (size * 9 / 10)) + 1 end as w from g) select lang, size, cast(sum(w) as bigint) as windows, cast(sum(n + (w - 1) * size / 10) as bigint) as chars from w group by 1, 2",
    "concept_difference": with_("edges") + f", a as (select distinct file_name, {_NORM.format('source_text')} as c from edges where file_name is not null), b as (select distinct file_name, {_NORM.format('target_text')} as c from edges where file_name is not null), f as (select distinct file_name from edges where file_name is not null), o as (select file_name, string_agg(c, '; ' order by c) as s from a where c <> '' and (file_name, c) not in (select file_name, c from b) group by 1), x as (select file_name, count(*) as n from a join b using (file_name, c) where c <> '' group by 1) select file_name, coalesce(s, '') as only_sources, cast(coalesce(n, 0) as integer) as both from f left join o using (file_name) left join x using (file_name)",
    "retrieval_texts": with_("nodes") + f", {_CCE}, z as (select chain_id, arg_min(source_node_id, (seq, edge_id)) as r, arg_max(target_node_id, (seq, edge_id)) as h from ce group by 1), t as (select chain_id, nullif(concat_ws('；', nullif(a.text, ''), nullif(b.text, '')), '') as q from z left join nodes a on a.node_id = r left join nodes b on b.node_id = h) select chain_id, '检索任务: type' || coalesce(chr(10) || '原始查询: ' || q, '') as query from t",
    "effective_documents": "select doc_id, lower(substr(lang, 1, 2)) as lang from documents where lower(substr(lang, 1, 2)) in ('zh', 'en', 'de') and (ingested_at is null or cast(ingested_at as date) <= date '2024-06-30')",
    "report_sections": with_("chunks") + r", l as (select evidence_id, unnest(string_split(content, chr(10))) as x, generate_subscripts(string_split(content, chr(10)), 1) as k from chunks where content is not null), m as (select evidence_id, k, regexp_replace(x, '^\s+|\s+$', '', 'g') as line from l), h as (select *, regexp_matches(line, '^([一二三四五六七八九十]+、|[0-9]+[.、])\s*.+$') as head from m where line <> ''), s as (select evidence_id, line, head, sum(cast(head as integer)) over w as section, last_value(case when head then regexp_extract(line, '^(?:[一二三四五六七八九十]+、|[0-9]+[.、])\s*(.+)$', 1) end ignore nulls) over w as title from h window w as (partition by evidence_id order by k rows between unbounded preceding and current row)) select evidence_id, cast(section as bigint) as section, coalesce(title, '正文') as title, count(*) as lines, sum(length(line)) as chars from s where not head group by 1, 2, 3",
    "failed_documents": "with r as (select distinct on (result_id) * from llm_results where result_id is not null), b as (select file_name from r where file_name is not null group by 1 having max(coalesce(node_count, 0)) <= 1) select llm, count(*) as results from r where file_name is null or file_name not in (select file_name from b) group by 1",
}
