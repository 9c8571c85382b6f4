"""Span queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import spans
from lodestrand.operators.views import chunks, edges, with_
from lodestrand.session import fan_out


def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of at most 400 characters."""
    return spans.span_table(fan_out(chunks(spark, d).select("evidence_id", "content")), "evidence_id", "content", spans.sentences)


def paragraph_spans(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of at most 1,200 characters."""
    return spans.span_table(fan_out(chunks(spark, d).select("evidence_id", "content")), "evidence_id", "content", spans.paragraphs)


def evidence_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each candidate edge's source text stands in its chunk."""
    e = edges(spark, d).where("source_chunk_id is not null and source_text is not null").select(F.col("source_chunk_id").alias("evidence_id"), "source_text").distinct()
    return e.join(chunks(spark, d).select("evidence_id", "content"), "evidence_id").select("evidence_id", "source_text", spans.find_span("content", "source_text").alias("place"))


QUERIES = {f.__name__: f for f in (sentence_spans, paragraph_spans, evidence_places)}
SQL = {
    "evidence_places": with_("edges", "chunks") + r""", e as (select distinct source_chunk_id as evidence_id, source_text from edges where source_chunk_id is not null and source_text is not null),
        j as (select evidence_id, source_text, content, trim(regexp_replace(content, '\s+', ' ', 'g')) as ft, substr(trim(regexp_replace(source_text, '\s+', ' ', 'g')), 1, 12) as fs from e join chunks using (evidence_id))
        select evidence_id, source_text, case when source_text = '' or content is null then -1 when strpos(content, source_text) > 0 then strpos(content, source_text) - 1 when strpos(ft, fs) > 0 then strpos(ft, fs) - 1 else -1 end as place from j""",
}
