"""Readers (S01-S23). Each gives a DataFrame; object stores differ from local files by the scheme of the path only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.text import clean_concept


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``file_name``, ``content``."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("content"))


def list_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files under a path that match, with size and time; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), "modificationTime")


def regroup_pages(elements: DataFrame) -> DataFrame:
    """Elements (``file_name``, ``seq``, ``page``, ``kind``, ``text``) joined to pages; a PageBreak or another number begins one."""
    w = Window.partitionBy("file_name").orderBy("seq")
    e = elements.withColumn("new", F.when((F.lag("kind").over(w) == "PageBreak") | ~F.lag("page").over(w).eqNullSafe(F.col("page")), 1).otherwise(0))
    e = e.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'PageBreak'")
    g = e.groupBy("file_name", "part").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("xs"))
    return g.select("file_name", "part", "page", F.array_join(F.transform("xs", lambda x: x["text"]), "").alias("content"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """Uploaded parts (``name``, ``part``, ``body``) joined in order; missing ones are skipped."""
    g = parts.where("body is not null").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("part", "body"))).alias("xs"))
    return g.select("name", F.array_join(F.transform("xs", lambda x: x["body"]), "").alias("content"), F.size("xs").alias("parts"))


def html_text(c: str | Column) -> Column:
    """The text of an HTML page: scripts, styles and tags out, common entities resolved, white space as one space."""
    t = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(t, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for e, x in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(e), F.lit(x))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_title(c: str | Column) -> Column:
    """The title of an HTML page; null if it has none."""
    return F.nullif(F.trim(F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def source_kind(url: str | Column) -> Column:
    """What a source address is: youtube, wikipedia, web or invalid."""
    u = F.col(url) if isinstance(url, str) else url
    return F.when(u.rlike(r"^(https?://)?(www\.)?(youtube\.com/watch\?|youtu\.be/)\S+"), "youtube").when(u.rlike(r"^https?://[a-z\-]{2,12}\.wikipedia\.org/wiki/\S+"), "wikipedia").when(u.rlike(r"^https?://\S+\.\S+"), "web").otherwise("invalid")


def youtube_id(url: str | Column) -> Column:
    """The ``v`` of the query, else the last part of the path."""
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.nullif(F.regexp_extract(u, r"[?&]v=([^&#]+)", 1), F.lit("")), F.element_at(F.split(F.regexp_replace(u, r"[?#].*$", ""), "/"), -1))


def url_file_name(url: str | Column) -> Column:
    """The last part of an address without query, decoded."""
    u = F.col(url) if isinstance(url, str) else url
    return F.try_url_decode(F.element_at(F.split(F.regexp_replace(u, r"[?#].*$", ""), "/"), -1))


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None, max_rows: int | None = None) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, unreadable ones give null fields."""
    r = spark.read.option("mode", "PERMISSIVE")
    out = (r.schema(schema) if schema else r).json(path)
    return out.limit(max_rows) if max_rows is not None else out


def samples(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Training samples with label source and weight filled in, of the sources asked for."""
    s = spark.read.schema("sample_id string, doc_id string, label int, label_source string, label_confidence double, review_status string").json(path)
    s = s.withColumns({"label_source": F.coalesce("label_source", F.lit("unknown")), "label_confidence": F.coalesce("label_confidence", F.lit(1.0))})
    if include:
        s = s.where(F.col("label_source").isin(include))
    return s.where(~F.col("label_source").isin(exclude)) if exclude else s


def clean_assertions(raw: DataFrame) -> DataFrame:
    """Assertions (``rel``, ``head``, ``tail``, ``info``) as ``rel``, ``head``, ``tail``, ``weight``; only English ones of letters."""
    e = raw.where(F.col("head").startswith("/c/en/") & F.col("tail").startswith("/c/en/"))
    part = lambda c: clean_concept(F.regexp_replace(F.regexp_replace(c, r"^/c/en/", ""), r"/[navr](/.*)?$", ""))
    t = e.select(F.lower(F.element_at(F.split("rel", "/"), -1)).alias("rel"), part("head").alias("head"), part("tail").alias("tail"), F.get_json_object("info", "$.weight").try_cast("double").alias("weight"))
    return t.where("head is not null and tail is not null")


def concept_triples(spark: SparkSession, path: str) -> DataFrame:
    """The assertions of a tab-separated file."""
    raw = spark.read.option("sep", "\t").option("quote", "").schema("uri string, rel string, head string, tail string, info string").csv(path)
    return clean_assertions(raw)


def rule_library(spark: SparkSession, path: str) -> DataFrame:
    """A rule library document as retrieval documents: clauses, basic types and severities, dated by their standard."""
    schema = "standards array<struct<standard_no:string,effective_from:string>>, clauses array<struct<clause_id:string,standard_no:string,title:string,text:string>>, basic_types array<struct<id:string,name:string,keywords:array<string>>>, severities array<struct<id:string,name:string>>"
    lib = spark.read.option("multiLine", True).schema(schema).json(path)
    std = lib.select(F.explode("standards").alias("s")).select("s.standard_no", F.to_date("s.effective_from").alias("effective_from"))
    none = F.lit(None).cast("string")
    c = lib.select(F.explode("clauses").alias("x")).select(F.col("x.clause_id").alias("doc_id"), F.lit("clause").alias("dimension"), F.col("x.standard_no").alias("standard_no"), F.col("x.title").alias("title"), F.col("x.text").alias("text"))
    b = lib.select(F.explode("basic_types").alias("x")).select(F.col("x.id").alias("doc_id"), F.lit("basic_type").alias("dimension"), none.alias("standard_no"), F.col("x.name").alias("title"), F.array_join("x.keywords", " ").alias("text"))
    s = lib.select(F.explode("severities").alias("x")).select(F.col("x.id").alias("doc_id"), F.lit("severity").alias("dimension"), none.alias("standard_no"), F.col("x.name").alias("title"), F.col("x.name").alias("text"))
    return c.unionByName(b).unionByName(s).join(F.broadcast(std), "standard_no", "left")


def precedents(spark: SparkSession, path: str) -> DataFrame:
    """Precedents with the first field there is for title and text, and an id from their content where they have none."""
    p = spark.read.schema("id string, doc_id string, title string, name string, text string, summary string, description string").json(path)
    text = F.coalesce("text", "summary", "description", F.lit(""))
    title = F.coalesce("title", "name", F.lit(""))
    return p.select(F.coalesce("doc_id", "id", F.concat(F.lit("prec_"), F.substring(F.sha1(F.concat_ws("|", title, text)), 1, 16))).alias("doc_id"), title.alias("title"), text.alias("text"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a vocabulary file with their number from 0. The lines of one file are numbered in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("id", "concept"))
    return lines.where("concept <> ''")


def review_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Review decisions of a CSV file, only accepted, rejected and edited ones."""
    c = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = set(c.columns)
    opt = lambda n, t: (F.col(n).try_cast(t) if n in have else F.lit(None).cast(t)).alias(n)
    out = c.select("pseudo_label_id", F.lower(F.trim("manual_decision")).alias("manual_decision"), opt("manual_label", "int"), opt("manual_relation_type", "string"), opt("manual_comment", "string"), opt("reviewer", "string"))
    return out.where(F.col("manual_decision").isin("accepted", "rejected", "edited"))


def tagged_triples(texts: DataFrame, key: str, column: str) -> DataFrame:
    """``head``, ``type``, ``tail`` of every ``<triplet> head <subj> tail <obj> type`` of a text, each once."""
    t = texts.select(key, F.explode(F.split(F.regexp_replace(column, r"</?s>|<pad>", ""), "<triplet>")).alias("x"))
    p = t.select(key, *(F.trim(F.regexp_extract("x", r"(?s)^(.*?)<subj>(.*?)<obj>(.*)$", i)).alias(n) for i, n in ((1, "head"), (2, "tail"), (3, "type"))))
    return p.where("head <> '' and tail <> '' and type <> ''").select(key, "head", "type", "tail").distinct()


def repair_json(c: str | Column) -> Column:
    """The JSON in a model's answer: code fences out, else the first object or array; null if it cannot be read."""
    t = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")
    inner = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    return F.when(F.try_parse_json(t).isNotNull() & t.rlike(r"^\s*[\[{]"), t).when(F.try_parse_json(inner).isNotNull(), inner)


def epoch_metrics(lines: DataFrame, column: str = "value", marker: str = "METRICS") -> DataFrame:
    """Metrics that log lines carry as JSON after a marker."""
    j = F.regexp_extract(column, rf"{marker}\s*(\{{.*\}})", 1)
    v = F.from_json(j, "epoch int, loss double, f1 double")
    return lines.where(F.col(column).contains(marker)).select(v.alias("m")).select("m.*").where("epoch is not null")
