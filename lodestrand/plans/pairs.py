"""Candidate pairs from units, the views of the stored graph, structural units and the evidence of an edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators import datasets as ds
from lodestrand.operators import scoring as sc
from lodestrand.operators.views import CTE, chunks, edges, units, with_
from lodestrand.plans.paths import _NORM, _TOK
from lodestrand.plans.scores import _BEST
from lodestrand.plans.texts import any_sql, next_chunk_edges
from lodestrand import lexicons as lx
from lodestrand.session import cut

# Relations of candidates by the kind of cue.
POTENTIAL = {"CAUSES": "POTENTIAL_CAUSE", "ENABLES": "POTENTIAL_ENABLE", "PRECEDES": "PRECEDES"}
#: Overlap from which a unit names a node that it does not contain verbatim.
NAMED_FROM = 0.24
#: Units of a file that are read for one edge (a bounded scan).
SCAN = 500


def _relation(text: str | Column) -> Column:
    """The relation of a candidate by the cues of a text, enabling without any."""
    named = ds.infer_relation(text, "ENABLES")
    out = None
    for k, v in POTENTIAL.items():
        out = F.when(named == k, v) if out is None else out.when(named == k, v)
    return out


def scored_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that each unit of a chunk names, with how well: ``unit_id``, ``parent``, ``start_char``, ``node_id``, ``name``, ``score``.

    Of several names of a node in a unit the best counts, of equals the smallest.
    """
    e = edges(spark, d)
    ends = e.select(F.col("source_chunk_id").alias("parent"), F.col("src").alias("node_id"), F.col("source_text").alias("name")).unionByName(e.select(F.col("target_chunk_id").alias("parent"), F.col("dst").alias("node_id"), F.col("target_text").alias("name")))
    m = ends.where("parent is not null and node_id is not null").where(F.trim("name") != "").distinct()
    u = units(spark, d).where("content is not null").select("unit_id", F.col("parent_evidence_id").alias("parent"), "start_char", "content")
    j = m.join(u, "parent").withColumn("score", F.round(tx.overlap_min("name", "content"), 6))
    j = j.where(F.lower("content").contains(F.lower("name")) | (F.col("score") >= NAMED_FROM))
    best = j.groupBy("unit_id", "parent", "start_char", "node_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("x"))
    return best.select("unit_id", "parent", "start_char", "node_id", F.col("x.name").alias("name"), (-F.col("x.s")).alias("score"))


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate edges between the nodes of a unit (both ways unless one precedes the other), of neighbouring
    units, and in the order of neighbouring units, each source, relation and target once, the best scored; explicit edges are left out.

    The pairs of a unit's nodes are the result asked for; a unit names the nodes of its own chunk only.
    """
    m = cut(scored_mentions(spark, d))
    # the order of a unit's nodes: the best named first
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("score"), "node_id")))
    text = m.groupBy("unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), " ").alias("t")).select("unit_id", _relation("t").alias("rel"))
    a = m.select("unit_id", F.col("node_id").alias("a"), F.col("score").alias("sa"), F.col("k").alias("ka"))
    b = m.select("unit_id", F.col("node_id").alias("b"), F.col("score").alias("sb"), F.col("k").alias("kb"))
    within = a.join(b, "unit_id").where("a <> b").join(text, "unit_id").where("rel <> 'PRECEDES' or ka < kb")
    within = within.select(F.col("a").alias("src"), "rel", F.col("b").alias("dst"), F.lit("same_unit").alias("rule"), F.greatest("sa", "sb").alias("score"))
    u = units(spark, d).select("unit_id", F.col("parent_evidence_id").alias("parent"), "start_char", "content")
    order = Window.partitionBy("parent").orderBy(F.col("start_char").asc_nulls_last(), "unit_id")
    nxt = u.select("unit_id", F.lead("unit_id").over(order).alias("next_unit"), _relation(F.lead("content").over(order)).alias("rel")).where("next_unit is not null")
    j = nxt.join(a, "unit_id").join(b.withColumnRenamed("unit_id", "next_unit"), "next_unit").where("a <> b")
    score = F.round((F.col("sa") + F.col("sb")) / 2, 6)
    near = j.select(F.col("a").alias("src"), F.explode(F.array(F.struct("rel", F.lit("adjacent_unit").alias("rule")), F.struct(F.lit("PRECEDES").alias("rel"), F.lit("temporal_precedes").alias("rule")))).alias("x"), F.col("b").alias("dst"), score.alias("score")).select("src", "x.rel", "dst", "x.rule", "score")
    explicit = edges(spark, d).select("src", "rel", "dst").distinct()
    place = F.when(F.col("rule") == "same_unit", 0).when(F.col("rule") == "adjacent_unit", 1).otherwise(2)
    best = within.unionByName(near).groupBy("src", "rel", "dst").agg(F.min(F.struct((-F.col("score")).alias("s"), place.alias("p"), "rule")).alias("x"))
    return best.join(explicit, ["src", "rel", "dst"], "left_anti").select("src", "rel", "dst", "x.rule", F.round(-F.col("x.s"), 4).alias("score"))


# Where structural units are cut, and what a heading looks like.
_HEAD = r"(?:第[一二三四五六七八九十0-9]+[章节部分]|[一二三四五六七八九十]+[、.]|[0-9]+[、.）)])"


def structural_units(spark: SparkSession, d: str) -> DataFrame:
    """Chunks cut after sentence marks before white space, at blank lines and before headings: ``evidence_id``, ``seq``
    (from 0), ``start_char``, ``end_char``, ``kind``. Pieces are without outer white space; blank ones do not count."""
    c = chunks(spark, d).where("content is not null").select("evidence_id", "content")
    parts = F.split("content", rf"(?m)(?<=[。；;!?])\s+|\n{{2,}}|(?=^\s*{_HEAD})")
    trimmed = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    c = c.select("evidence_id", "content", trimmed.alias("ps"))
    placed = F.expr(
        "aggregate(ps, named_struct('at', 0, 'xs', cast(array() as array<struct<a:int,b:int,p:string>>)), "
        "(acc, p) -> named_struct('at', locate(p, content, acc.at + 1) - 1 + length(p), 'xs', concat(acc.xs, array(named_struct('a', locate(p, content, acc.at + 1) - 1, 'b', locate(p, content, acc.at + 1) - 1 + length(p), 'p', p))))).xs"
    )
    out = c.select("evidence_id", F.posexplode(placed).alias("seq", "x")).select("evidence_id", "seq", F.col("x.a").alias("start_char"), F.col("x.b").alias("end_char"), F.col("x.p").alias("p"))
    kind = F.when((F.length("p") <= 80) & F.col("p").rlike(rf"^{_HEAD}\s*.+"), "heading").when(F.col("p").rlike("[。；;]"), "sentence").otherwise("paragraph")
    return out.select("evidence_id", "seq", "start_char", "end_char", kind.alias("kind"))


def bounded_units(spark: SparkSession, d: str) -> DataFrame:
    """The first ``SCAN`` units of each file in the order of chunk and place (the bound is the feature): ``file_name``, ``unit_id``, ``rn``."""
    c = chunks(spark, d).where("file_name is not null").select("file_name", F.col("evidence_id").alias("parent_evidence_id"), "position")
    u = units(spark, d).select("unit_id", "parent_evidence_id", "start_char").join(c, "parent_evidence_id")
    order = Window.partitionBy("file_name").orderBy(F.col("position").asc_nulls_last(), "parent_evidence_id", F.col("start_char").asc_nulls_last(), "unit_id")
    return u.select("file_name", "unit_id", F.row_number().over(order).alias("rn")).where(F.col("rn") <= SCAN)


#: Views of the stored graph and the kinds of edges each shows.
VIEWS = {
    "document": [],
    "chunks": ["NEXT_CHUNK"],
    "entities": ["HAS_ENTITY", "ENTITY"],
    "docEntities": ["PART_OF", "HAS_ENTITY", "ENTITY"],
    "docChunks": ["PART_OF", "FIRST_CHUNK", "NEXT_CHUNK"],
    "chunksEntities": ["NEXT_CHUNK", "HAS_ENTITY", "ENTITY"],
    "docChunkEntities": ["PART_OF", "FIRST_CHUNK", "NEXT_CHUNK", "HAS_ENTITY", "ENTITY"],
}


def graph_views(spark: SparkSession, d: str) -> DataFrame:
    """The edges of each view of the stored graph: ``view``, ``rel``, ``src``, ``dst``. Entities are those that a
    chunk of a file names, with the relations between them and any other node."""
    c = chunks(spark, d).where("file_name is not null").select("evidence_id", "file_name")
    part = c.select(F.lit("PART_OF").alias("kind"), F.lit("PART_OF").alias("rel"), F.col("evidence_id").alias("src"), F.col("file_name").alias("dst"))
    order = next_chunk_edges(spark, d).select(F.col("rel").alias("kind"), "rel", "src", "dst")
    e = edges(spark, d).select("source_chunk_id", "target_chunk_id", "src", "dst", "rel").where("src is not null and dst is not null")
    named = e.select(F.col("source_chunk_id").alias("c"), F.col("src").alias("n")).unionByName(e.select(F.col("target_chunk_id").alias("c"), F.col("dst").alias("n"))).where("c is not null").distinct()
    has = cut(named.join(c.select(F.col("evidence_id").alias("c")), "c", "left_semi"))
    ent = has.select("n").distinct()
    rel = e.select("src", "rel", "dst").distinct()
    seen = rel.join(ent.withColumnRenamed("n", "src"), "src", "left_semi").unionByName(rel.join(ent.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "rel", "dst")).distinct()
    every = part.unionByName(order).unionByName(has.select(F.lit("HAS_ENTITY").alias("kind"), F.lit("HAS_ENTITY").alias("rel"), F.col("c").alias("src"), F.col("n").alias("dst"))).unionByName(seen.select(F.lit("ENTITY").alias("kind"), "rel", "src", "dst"))
    by_kind = {k: [v for v, ks in VIEWS.items() if k in ks] for k in {x for ks in VIEWS.values() for x in ks}}
    shown = None
    for k, vs in sorted(by_kind.items()):
        a = F.array(*map(F.lit, vs))
        shown = F.when(F.col("kind") == k, a) if shown is None else shown.when(F.col("kind") == k, a)
    return every.select(F.explode(shown).alias("view"), "rel", "src", "dst")


def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of each edge: the unit it points at, else the first five units of its chunk, else the chunk itself, else
    the five units of its file that name its ends best: ``doc``, ``src``, ``rel``, ``dst``, ``how``, ``unit_id``."""
    key = ["doc", "src", "rel", "dst"]
    e = cut(sc.dedup_edges(edges(spark, d)).select(*key, "file_name", "source_text", "target_text", F.col("unit_id").alias("pointer"), F.coalesce("source_chunk_id", "target_chunk_id").alias("chunk"), F.monotonically_increasing_id().alias("edge")))
    u = units(spark, d).select("unit_id", F.col("parent_evidence_id").alias("chunk"), "start_char", "content")
    pointed = e.join(u.select(F.col("unit_id").alias("pointer")), "pointer", "left_semi").select("edge", F.lit("pointer").alias("how"), F.col("pointer").alias("unit_id"))
    rest = e.join(pointed.select("edge"), "edge", "left_anti")
    first = u.withColumn("rn", F.row_number().over(Window.partitionBy("chunk").orderBy(F.col("start_char").asc_nulls_last(), "unit_id"))).where("rn <= 5")
    known = chunks(spark, d).select(F.col("evidence_id").alias("chunk"))
    rest = cut(rest.join(known.withColumn("there", F.lit(1)), "chunk", "left"))
    of_chunk = rest.where("there = 1").join(first.select("chunk", F.col("unit_id").alias("u")), "chunk", "left")
    of_chunk = of_chunk.select("edge", F.when(F.col("u").isNull(), "chunk").otherwise("chunk_units").alias("how"), F.coalesce("u", F.concat(F.lit("chunk::"), "chunk")).alias("unit_id"))
    asked = rest.where("there is null and file_name is not null").select("edge", "file_name", F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("target_text", F.lit("")).alias("target_text"))
    file = F.regexp_extract("chunk", r"^[^|]*\|[^|]*\|([^|]*)", 1).alias("file_name")
    lexical = ds.lexical_units(asked, u.select("unit_id", file, "content")).select("edge", F.lit("lexical").alias("how"), "unit_id")
    found = reduce(DataFrame.unionByName, [pointed, of_chunk, lexical])
    return e.select("edge", *key).join(found, "edge").select(*key, "how", "unit_id")


QUERIES = {f.__name__: f for f in (candidate_pairs, structural_units, bounded_units, graph_views, edge_evidence)}

_REL = lambda t: "case " + " ".join(f"when {any_sql(f'lower(coalesce({t}, {chr(39)}{chr(39)}))', c)} then '{POTENTIAL[n]}'" for n, c in lx.CANDIDATE_CUES) + " else 'POTENTIAL_ENABLE' end"
_OVM = lambda a, b: f"(case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / cast(least(len({a}), len({b})) as double) end)"
_MENTIONS = f"""m as (select distinct parent, node_id, name from (select source_chunk_id as parent, src as node_id, source_text as name from edges union all select target_chunk_id, dst, target_text from edges) where parent is not null and node_id is not null and trim(name) <> ''),
    mt as (select *, {_TOK.format('tn')} as a from (select *, {_NORM.format('name')} as tn from m)), ut as (select *, {_TOK.format('tc')} as b from (select unit_id, parent_evidence_id as parent, start_char, content, {_NORM.format('content')} as tc from units where content is not null)),
    mu as (select unit_id, mt.parent, start_char, node_id, name, content, round({_OVM('a', 'b')}, 6) as score from mt join ut using (parent)),
    ms as (select unit_id, parent, start_char, node_id, arg_min(name, (-score, name)) as name, max(score) as score from mu where contains(lower(content), lower(name)) or score >= {NAMED_FROM} group by 1, 2, 3, 4)"""
_VIEW_ROWS = ", ".join(f"('{v}', '{k}')" for v, ks in VIEWS.items() for k in ks)
SQL = {
    "candidate_pairs": with_("units", "edges") + f""", {_MENTIONS}, mk as (select *, row_number() over (partition by unit_id order by score desc, node_id) as k from ms),
        tr as (select unit_id, {_REL('t')} as rel from (select unit_id, string_agg(name, ' ' order by k) as t from mk group by 1)),
        w as (select a.node_id as src, rel, b.node_id as dst, 'same_unit' as rule, 0 as p, greatest(a.score, b.score) as score from mk a join mk b on a.unit_id = b.unit_id and a.node_id <> b.node_id join tr on tr.unit_id = a.unit_id where rel <> 'PRECEDES' or a.k < b.k),
        nx as (select unit_id, lead(unit_id) over z as nu, lead(content) over z as nc from units window z as (partition by parent_evidence_id order by start_char nulls last, unit_id)), nr as (select unit_id, nu, {_REL('nc')} as rel from nx where nu is not null),
        n as (select a.node_id as src, rel, b.node_id as dst, round((a.score + b.score) / 2, 6) as score from nr join mk a on a.unit_id = nr.unit_id join mk b on b.unit_id = nr.nu where a.node_id <> b.node_id),
        c as (select * from w union all select src, rel, dst, 'adjacent_unit', 1, score from n union all select src, 'PRECEDES', dst, 'temporal_precedes', 2, score from n)
        select src, rel, dst, arg_min(rule, (-score, p)) as rule, round(max(score), 4) as score from c where not exists (select 1 from edges e where e.src = c.src and e.rel = c.rel and e.dst = c.dst) group by 1, 2, 3""",
    "structural_units": "with recursive " + CTE["chunks"] + rf""", s as (select evidence_id, content, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(content, '(?m)^(\s*{_HEAD})', chr(30) || '\1', 'g'), '([。；;!?])\s+', '\1' || chr(30), 'g'), '\n{{2,}}', chr(30), 'g'), chr(30)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') as ps from chunks where content is not null),
        r as (select evidence_id, content, ps, 0 as seq, strpos(content, ps[1]) - 1 as a, ps[1] as p from s where len(ps) > 0 union all
              select evidence_id, content, ps, seq + 1, a + length(p) + strpos(substr(content, a + length(p) + 1), ps[seq + 2]) - 1, ps[seq + 2] from r where seq + 1 < len(ps))
        select evidence_id, seq, cast(a as integer) as start_char, cast(a + length(p) as integer) as end_char, case when length(p) <= 80 and regexp_matches(p, '^{_HEAD}\s*.+') then 'heading' when regexp_matches(p, '[。；;]') then 'sentence' else 'paragraph' end as kind from r""",
    "bounded_units": with_("chunks", "units") + f" select * from (select file_name, unit_id, cast(row_number() over (partition by file_name order by position nulls last, parent_evidence_id, start_char nulls last, unit_id) as integer) as rn from units join (select file_name, evidence_id, position from chunks where file_name is not null) c on c.evidence_id = parent_evidence_id) where rn <= {SCAN}",
    "graph_views": with_("chunks", "edges") + f""", c as (select * from chunks where file_name is not null), o as (select file_name, evidence_id, row_number() over z as k, lead(evidence_id) over z as nxt from c window z as (partition by file_name order by position nulls last, evidence_id)),
        h as (select distinct s as src, t as dst from (select source_chunk_id as s, src as t from edges where src is not null and dst is not null union all select target_chunk_id, dst from edges where src is not null and dst is not null) where s in (select evidence_id from c)),
        x as (select 'PART_OF' as kind, 'PART_OF' as rel, evidence_id as src, file_name as dst from c union all select 'FIRST_CHUNK', 'FIRST_CHUNK', file_name, evidence_id from o where k = 1 union all select 'NEXT_CHUNK', 'NEXT_CHUNK', evidence_id, nxt from o where nxt is not null union all
              select 'HAS_ENTITY', 'HAS_ENTITY', src, dst from h union all select distinct 'ENTITY', rel, src, dst from edges where src is not null and dst is not null and (src in (select dst from h) or dst in (select dst from h)))
        select v.view, rel, src, dst from x join (values {_VIEW_ROWS}) v(view, kind) using (kind)""",
    "edge_evidence": f"""with {CTE['chunks']}, {CTE['units']}, {CTE['edges']}, {_BEST}, b as (select *, coalesce(source_chunk_id, target_chunk_id) as chunk from best),
        p as (select doc, src, rel, dst, 'pointer' as how, unit_id from b where unit_id in (select unit_id from units)), r as (select * from b where unit_id is null or unit_id not in (select unit_id from units)),
        f as (select * from (select unit_id as u, parent_evidence_id as pid, row_number() over (partition by parent_evidence_id order by start_char nulls last, unit_id) as k from units) where k <= 5),
        q as (select doc, src, rel, dst, case when u is null then 'chunk' else 'chunk_units' end as how, coalesce(u, 'chunk::' || chunk) as unit_id from r left join f on pid = chunk where chunk in (select evidence_id from chunks)),
        a as (select doc, src, rel, dst, file_name, coalesce(source_text, '') as st, coalesce(target_text, '') as tt, {_NORM.format('source_text')} as ns, {_NORM.format('target_text')} as nt from r where (chunk is null or chunk not in (select evidence_id from chunks)) and file_name is not null),
        ax as (select *, {_TOK.format('ns')} as ta, {_TOK.format('nt')} as tb from a), w as (select unit_id, regexp_extract(parent_evidence_id, '^[^|]*\\|[^|]*\\|([^|]*)', 1) as file_name, content, {_NORM.format('content')} as nc from units where content is not null), wt as (select *, {_TOK.format('nc')} as c from w),
        l as (select doc, src, rel, dst, unit_id, round(1.2 * {_OVM('ta', 'c')} + 1.2 * {_OVM('tb', 'c')} + case when st <> '' and contains(lower(content), lower(st)) then 0.6 else 0 end + case when tt <> '' and contains(lower(content), lower(tt)) then 0.6 else 0 end, 6) as score from ax join wt using (file_name)),
        k as (select *, row_number() over (partition by doc, src, rel, dst order by score desc, unit_id) as rn from l where score > 0.25)
        select * from p union all select * from q union all select doc, src, rel, dst, 'lexical', unit_id from k where rn <= 5""",
}
