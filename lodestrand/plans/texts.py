"""Text layer: cleaning, chunking, units, features, overlaps (P*, F*, A21, A22, W01-W03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand import lexicons as lx
from lodestrand.functions import text as tx
from lodestrand.operators.ordering import numbered
from lodestrand.operators.views import chunks, edges, units, with_
from lodestrand.session import table

_arr = lambda ws: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


def any_sql(column: str, words) -> str:
    return "(" + " or ".join(f"contains(coalesce({column}, ''), '" + w.replace("'", "''") + "')" for w in words) + ")"


def doc_clean_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents, cleaned characters and distinct normalised texts of each source."""
    t = table(spark, d, "documents").select("source", tx.clean_page("text").alias("c"))
    return t.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("c")).alias("chars"), F.countDistinct("c").alias("texts"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 200 white-space tokens with 20 of overlap, their sha1 ids and offsets."""
    tok = table(spark, d, "documents").select("doc_id", F.filter(F.split(F.regexp_replace("text", r"[ \t\n\r\f]+", " "), " "), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(180))
    win = tok.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(200)), " "))).alias("idx", "content"))
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return win.select("doc_id", "idx", F.sha1(F.concat_ws(":", F.col("idx").cast("string"), "content").cast("binary")).alias("chunk_hash"), F.length("content").alias("len"), F.coalesce(F.sum(F.length("content")).over(before), F.lit(0)).alias("content_offset"))


def chunk_combine(spark: SparkSession, d: str) -> DataFrame:
    """Every five chunks of a file in order, joined without separator."""
    c = chunks(spark, d).where("file_name is not null and position is not null and content is not null")
    n = c.withColumn("rn", F.row_number().over(Window.partitionBy("file_name").orderBy("position", "evidence_id")) - 1)
    g = n.groupBy("file_name", F.floor(F.col("rn") / 5).cast("int").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("rn", "content", "evidence_id"))).alias("xs"))
    return g.select("file_name", "grp", F.size("xs").alias("n"), F.md5(F.array_join(F.transform("xs", lambda x: x["content"]), "")).alias("content_md5"), F.element_at("xs", 1)["evidence_id"].alias("first_id"))


def unit_split_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Structural pieces of chunks by kind: a short one is a heading, one with a mark a sentence, else a paragraph."""
    c = chunks(spark, d).where("content is not null")
    p = c.select("evidence_id", F.explode(F.split("content", r"\n\s*\n")).alias("p")).select("evidence_id", F.trim(F.regexp_replace("p", r"\s", " ")).alias("p")).where("p <> ''")
    marked = F.col("p").rlike(r"[。！？.!?]")
    kind = F.when(F.col("p").rlike(r"^(第[0-9一二三四五六七八九十]+[章节部分]|[一二三四五六七八九十]+[、.]|[0-9]+[、.）)])") & (F.length("p") <= 80), "heading").when(marked, "sentence").otherwise("paragraph")
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"), F.countDistinct("evidence_id").alias("chunks"))


def cue_tags(spark: SparkSession, d: str) -> DataFrame:
    """Trigger words, temporal phrases and actors of units, by unit kind."""
    u = units(spark, d).where("content is not null")
    t = u.select(F.coalesce("unit_kind", F.lit("<NONE>")).alias("unit_kind"), F.size(tx.hits("content", lx.UNIT_TRIGGERS)).alias("tr"), F.size(F.regexp_extract_all("content", F.lit(lx.TEMPORAL_PATTERN), F.lit(0))).alias("te"), F.size(F.regexp_extract_all("content", F.lit(lx.ACTOR_PATTERN), F.lit(0))).alias("ac"))
    return t.groupBy("unit_kind").agg(F.count("*").alias("units"), F.sum("tr").alias("triggers"), F.sum("te").alias("temporals"), F.sum("ac").alias("actors"))


def _role(c: str):
    out = None
    for name, cues in lx.ROLES:
        cond = tx.contains_any(c, cues)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(lx.MAIN_ROLE)


_ROLE_SQL = "case " + " ".join(f"when {any_sql('content', cues)} then '{n}'" for n, cues in lx.ROLES) + f" else '{lx.MAIN_ROLE}' end"


def anchor_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The role of each unit, and the last main event before it in its chunk."""
    u = units(spark, d).select("unit_id", "parent_evidence_id", "start_char", _role("content").alias("role"))
    order = Window.partitionBy("parent_evidence_id").orderBy(F.col("start_char").asc_nulls_last(), "unit_id").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.last(F.when(F.col("role") == lx.MAIN_ROLE, F.col("unit_id")), ignorenulls=True).over(order)
    t = u.select("unit_id", "role", anchor.alias("anchor"))
    return t.select("unit_id", "role", "anchor", F.when(F.col("role").isin("cause_supplement", "investigation_conclusion"), F.col("anchor")).alias("supplement_to"))


def trigger_merge_islands(spark: SparkSession, d: str) -> DataFrame:
    """Units joined to the one before when they hold a trigger or follow a heading, as islands of a running sum."""
    u = units(spark, d).select("unit_id", "parent_evidence_id", F.lower("unit_kind").alias("k"), "start_char", tx.contains_any("content", lx.UNIT_TRIGGERS).alias("tr"))
    order = Window.partitionBy("parent_evidence_id").orderBy(F.col("start_char").asc_nulls_last(), "unit_id")
    prev = F.lag("k").over(order)
    first = F.row_number().over(order) == 1
    t = u.select("*", F.when(first | ~(F.col("tr") | F.coalesce(prev == "heading", F.lit(False))), 1).otherwise(0).alias("starts"))
    t = t.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("parent_evidence_id", "island").agg(F.count("*").alias("units"), F.min("unit_id").alias("first_unit")).select("parent_evidence_id", F.col("island").cast("bigint").alias("island"), "units", "first_unit")


def unit_links(spark: SparkSession, d: str) -> DataFrame:
    """Previous and next unit within the chunk, units without a start last."""
    order = Window.partitionBy("parent_evidence_id").orderBy(F.col("start_char").asc_nulls_last(), "unit_id")
    return units(spark, d).select("unit_id", F.lag("unit_id").over(order).alias("prev_unit"), F.lead("unit_id").over(order).alias("next_unit"))


def next_chunk_edges(spark: SparkSession, d: str) -> DataFrame:
    """FIRST_CHUNK and NEXT_CHUNK edges of files, chunks in order of position."""
    c = chunks(spark, d).where("file_name is not null")
    order = Window.partitionBy("file_name").orderBy(F.col("position").asc_nulls_last(), "evidence_id")
    t = c.select("file_name", "evidence_id", F.row_number().over(order).alias("rn"), F.lead("evidence_id").over(order).alias("nxt"))
    first = t.where("rn = 1").select(F.lit("FIRST_CHUNK").alias("rel"), F.col("file_name").alias("src"), F.col("evidence_id").alias("dst"))
    return first.unionByName(t.where("nxt is not null").select(F.lit("NEXT_CHUNK").alias("rel"), F.col("evidence_id").alias("src"), F.col("nxt").alias("dst")))


def overlap_functions(spark: SparkSession, d: str) -> DataFrame:
    """The four token overlaps of source and target of each distinct pair of texts."""
    p = edges(spark, d).select(F.col("source_text").alias("a"), F.col("target_text").alias("b")).where("a is not null and b is not null").distinct()
    return p.select("a", "b", *(F.round(f("a", "b"), 6).alias(n) for n, f in (("ov_max", tx.overlap_max), ("ov_min", tx.overlap_min), ("ov_jaccard", tx.overlap_jaccard), ("ov_ws", tx.overlap_ws))))


def deterministic_split(spark: SparkSession, d: str) -> DataFrame:
    """the split of each document by the hash of its key."""
    k = edges(spark, d).select(F.col("doc").alias("doc_key")).where("doc_key is not null").distinct()
    return k.select("doc_key", tx.split_bucket("doc_key").alias("bucket"), tx.split_name("doc_key").alias("split"))


def token_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Words of at least five documents with their counts and rank."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("w"))
    c = w.groupBy("w").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("docs >= 5")
    return numbered(c, [F.desc("n"), "w"], "rank")


def casualty_counts(spark: SparkSession, d: str) -> DataFrame:
    """people hurt that units name, by word."""
    u = units(spark, d).where("content is not null")
    words = ["死亡", "重伤", "轻伤", "工人"]
    return u.agg(*(F.sum(tx.casualties("content", w)).alias(f"n_{i}") for i, w in enumerate(words)), F.count("*").alias("units"))


def span_to_unit(spark: SparkSession, d: str) -> DataFrame:
    """The unit of a chain edge's evidence span: the first of its chunk that touches the span, else the chunk's first."""
    e = table(spark, d, "causal_chain_edges").where("edge_id is not null and evidence_start is not null and evidence_end is not null").select("edge_id", F.regexp_extract("evidence_unit_id", r"^(.*)::(?:evu::\d+|chunk)$", 1).alias("parent"), "evidence_start", "evidence_end").dropDuplicates(["edge_id"])
    u = units(spark, d).where("start_char is not null and end_char is not null").select("unit_id", F.col("parent_evidence_id").alias("parent"), "start_char", "end_char")
    j = e.join(u, "parent").withColumn("touch", (F.least("evidence_end", "end_char") >= F.greatest("evidence_start", "start_char")).cast("int"))
    best = j.groupBy("edge_id").agg(F.min(F.struct((1 - F.col("touch")).alias("miss"), "start_char", "unit_id")).alias("x"))
    return best.select("edge_id", F.col("x.unit_id").alias("unit_id"), (F.lit(1) - F.col("x.miss")).alias("touch"))


def scope_infer(spark: SparkSession, d: str) -> DataFrame:
    """Document, scope and kg of a chunk from its metadata, else from its id."""
    c = chunks(spark, d)
    doc = F.coalesce(F.get_json_object("meta_json", "$.doc_id"), F.regexp_extract("evidence_id", r"^(.*)\|[^|]*$", 1))
    scope = F.coalesce(F.get_json_object("meta_json", "$.kg_scope"), F.element_at(F.split("evidence_id", r"\|"), 1))
    return c.groupBy(doc.alias("doc"), scope.alias("scope")).agg(F.count("*").alias("chunks"))


QUERIES = {f.__name__: f for f in (doc_clean_stats, chunk_windows, chunk_combine, unit_split_kinds, cue_tags, anchor_carry_forward, trigger_merge_islands, unit_links, next_chunk_edges, overlap_functions, deterministic_split, token_vocab, casualty_counts, span_to_unit)}
QUERIES["scope_infer"] = scope_infer

_SET = "list_distinct({})"
_GATE = r"list_distinct(regexp_extract_all(lower({}), '[\x{{4e00}}-\x{{9fff}}a-z0-9_\-]+'))"
_NORM = r"regexp_replace(lower(trim(regexp_replace({}, '\s', ' ', 'g'))), ' +', ' ', 'g')"
_LAB = "list_distinct(list_concat(regexp_extract_all(" + _NORM + r", '[a-z0-9_]+'), flatten(list_transform(regexp_extract_all(" + _NORM + r", '[\x{{4e00}}-\x{{9fff}}]{{2,}}'), lambda r: case when length(r) <= 4 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end))))"
_RET = r"list_distinct(regexp_extract_all(lower({}), '[\x{{4e00}}-\x{{9fff}}]|[a-z0-9_]+'))"
_WS = "list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda x: x <> ''))"


def _ov(tok: str, bottom: str) -> str:
    a, b = tok.format("a", "a") if tok.count("{}") == 2 else tok.format("a"), tok.format("b", "b") if tok.count("{}") == 2 else tok.format("b")
    common = f"len(list_intersect({a}, {b}))"
    low = {"max": f"greatest(len({a}), len({b}))", "min": f"least(len({a}), len({b}))", "union": f"(len({a}) + len({b}) - {common})"}[bottom]
    return f"round(case when len({a}) = 0 or len({b}) = 0 then 0.0 else {common} / cast({low} as double) end, 6)"


SQL = {
    "doc_clean_stats": "select source, count(*) as docs, sum(length(replace(replace(replace(text, '\"', ''), '''', ''), chr(10), ' '))) as chars, count(distinct replace(replace(replace(text, '\"', ''), '''', ''), chr(10), ' ')) as texts from documents group by source",
    "chunk_windows": r"""
        with t as (select doc_id, list_filter(string_split(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents),
        i as (select doc_id, w, unnest(range(0, len(w), 180)) as s from t where len(w) > 0),
        c as (select doc_id, cast(s // 180 as integer) as idx, array_to_string(w[s + 1 : s + 200], ' ') as content from i)
        select doc_id, idx, sha1(idx || ':' || content) as chunk_hash, length(content) as len, coalesce(sum(length(content)) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as content_offset from c""",
    "chunk_combine": with_("chunks") + """, n as (select file_name, evidence_id, content, row_number() over (partition by file_name order by position, evidence_id) - 1 as r from chunks where file_name is not null and position is not null and content is not null)
        select file_name, cast(r // 5 as integer) as grp, count(*) as n, md5(string_agg(content, '' order by r)) as content_md5, arg_min(evidence_id, r) as first_id from n group by file_name, r // 5""",
    "unit_split_kinds": with_("chunks") + r""", p as (select evidence_id, trim(regexp_replace(x, '\s', ' ', 'g')) as p from (select evidence_id, unnest(string_split_regex(content, '\n\s*\n')) as x from chunks where content is not null)),
        k as (select *, case when regexp_matches(p, '^(第[0-9一二三四五六七八九十]+[章节部分]|[一二三四五六七八九十]+[、.]|[0-9]+[、.）)])') and length(p) <= 80 then 'heading' when regexp_matches(p, '[。！？.!?]') then 'sentence' else 'paragraph' end as kind from p where p <> '')
        select kind, count(*) as n, sum(length(p)) as chars, count(distinct evidence_id) as chunks from k group by kind""",
    "cue_tags": with_("units") + f""" select coalesce(unit_kind, '<NONE>') as unit_kind, count(*) as units, sum(len(list_filter({_arr(lx.UNIT_TRIGGERS)}, lambda w: contains(content, w)))) as triggers,
        sum(len(regexp_extract_all(content, '{lx.TEMPORAL_PATTERN}'))) as temporals, sum(len(regexp_extract_all(content, '{lx.ACTOR_PATTERN}'))) as actors from units where content is not null group by 1""",
    "anchor_carry_forward": with_("units") + f""", r as (select unit_id, parent_evidence_id, start_char, {_ROLE_SQL} as role from units),
        a as (select unit_id, role, last_value(case when role = '{lx.MAIN_ROLE}' then unit_id end ignore nulls) over (partition by parent_evidence_id order by start_char nulls last, unit_id rows between unbounded preceding and current row) as anchor from r)
        select unit_id, role, anchor, case when role in ('cause_supplement', 'investigation_conclusion') then anchor end as supplement_to from a""",
    "trigger_merge_islands": with_("units") + f""", s as (select unit_id, parent_evidence_id, start_char, case when row_number() over w = 1 or not ({any_sql('content', lx.UNIT_TRIGGERS)} or coalesce(lag(lower(unit_kind)) over w = 'heading', false)) then 1 else 0 end as starts from units window w as (partition by parent_evidence_id order by start_char nulls last, unit_id)),
        i as (select *, cast(sum(starts) over (partition by parent_evidence_id order by start_char nulls last, unit_id rows between unbounded preceding and current row) as bigint) as island from s)
        select parent_evidence_id, island, count(*) as units, min(unit_id) as first_unit from i group by parent_evidence_id, island""",
    "unit_links": with_("units") + " select unit_id, lag(unit_id) over w as prev_unit, lead(unit_id) over w as next_unit from units window w as (partition by parent_evidence_id order by start_char nulls last, unit_id)",
    "next_chunk_edges": with_("chunks") + """, t as (select file_name, evidence_id, row_number() over w as r, lead(evidence_id) over w as nxt from chunks where file_name is not null window w as (partition by file_name order by position nulls last, evidence_id))
        select 'FIRST_CHUNK' as rel, file_name as src, evidence_id as dst from t where r = 1 union all select 'NEXT_CHUNK', evidence_id, nxt from t where nxt is not null""",
    "overlap_functions": f"with p as (select distinct source_text as a, target_text as b from candidate_edges where source_text is not null and target_text is not null) select a, b, {_ov(_GATE, 'max')} as ov_max, {_ov(_LAB, 'min')} as ov_min, {_ov(_RET, 'union')} as ov_jaccard, {_ov(_WS, 'union')} as ov_ws from p",
    "deterministic_split": """
        with k as (select distinct lower(trim(doc_id)) as doc_key from candidate_edges where doc_id is not null),
        b as (select doc_key, cast(list_reduce(list_concat([0], list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(sha1(doc_key), i, 1)) - 1)), lambda s, d: (s * 16 + d) % 10000) as integer) as bucket from k)
        select doc_key, bucket, case when bucket / 10000.0 < 0.8 then 'train' when bucket / 10000.0 < 0.9 then 'dev' else 'test' end as split from b""",
    "token_vocab": """
        with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as w from documents),
        c as (select w, count(*) as n, count(distinct doc_id) as docs from w group by w having count(distinct doc_id) >= 5)
        select w, n, docs, row_number() over (order by n desc, w) as rank from c""",
    "casualty_counts": with_("units") + " select " + ", ".join(rf"sum(coalesce(list_sum(list_transform(list_concat(regexp_extract_all(content, '{w}\s*(\d+)\s*人', 1), regexp_extract_all(content, '(\d+)\s*人\s*{w}', 1)), lambda x: cast(x as bigint))), 0)) as n_{i}" for i, w in enumerate(["死亡", "重伤", "轻伤", "工人"])) + ", count(*) as units from units where content is not null",
    "span_to_unit": with_("units") + r""", e as (select distinct edge_id, regexp_extract(evidence_unit_id, '^(.*)::(?:evu::\d+|chunk)$', 1) as parent, evidence_start, evidence_end from causal_chain_edges where edge_id is not null and evidence_start is not null and evidence_end is not null),
        j as (select edge_id, unit_id, start_char, case when least(evidence_end, end_char) >= greatest(evidence_start, start_char) then 1 else 0 end as touch from e join units u on u.parent_evidence_id = e.parent where start_char is not null and end_char is not null)
        select edge_id, unit_id, touch from (select *, row_number() over (partition by edge_id order by touch desc, start_char, unit_id) as rn from j) where rn = 1""",
    "scope_infer": with_("chunks") + r""" select coalesce(case when json_valid(meta_json) then json_extract_string(meta_json, '$.doc_id') end, regexp_extract(evidence_id, '^(.*)\|[^|]*$', 1)) as doc, coalesce(case when json_valid(meta_json) then json_extract_string(meta_json, '$.kg_scope') end, split_part(evidence_id, '|', 1)) as scope, count(*) as chunks from chunks group by 1, 2""",
}
