"""Streaming queries (T01, T07) and event-time extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import table
from lodestrand.streaming import incremental as inc


def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums of each event type, folded from the partial sums of micro-batches."""
    parts = inc.merge_batches(inc.file_stream(spark, inc.table_path(d, "events")), lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Extension: daily windows."""
    return inc.tumbling(table(spark, d, "events"))


def ext_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Extension: two-day windows every day."""
    return inc.sliding(table(spark, d, "events"))


def ext_session(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sessions that end after twelve hours."""
    return inc.sessions(table(spark, d, "events"))


QUERIES = {f.__name__: f for f in (stream_progress, ext_tumbling, ext_sliding, ext_session)}
SQL = {
    "stream_progress": "select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type",
    "ext_tumbling": "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "ext_sliding": "with w as (select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as start, value from events) select cast(start as timestamp) as start, count(*) as n, round(max(value), 4) as top from w group by 1",
    "ext_session": "with g as (select user_id, ts, case when ts < lag(ts) over w + interval 12 hours then 0 else 1 end as s from events window w as (partition by user_id order by ts)), i as (select *, sum(s) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g) select user_id, min(ts) as start, max(ts) + interval 12 hours as end, count(*) as n from i group by user_id, k",
}
