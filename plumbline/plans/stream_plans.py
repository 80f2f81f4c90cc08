"""Streaming queries over ``events`` read as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.monitor_plans import ORACLE_SQL as BATCH_SQL
from plumbline.storage import table
from plumbline.streaming import changes as c


def _stream(spark, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def stream_change_events(spark, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 3
    rows = _stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") / 50).cast("long").alias("level"), k.alias("k"))
    return c.change_events_once(rows, "changes")


def stream_windowed_counts(spark, sf_dir: str) -> DataFrame:
    """Closed daily windows: the watermark holds the last days back."""
    out = c.run_once(c.windowed_counts(_stream(spark, sf_dir)), "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_once_per_key(spark, sf_dir: str) -> DataFrame:
    """Each user's types of events once: a repeated key within the watermark inserts nothing."""
    return c.run_once(c.once_per_key(_stream(spark, sf_dir), ["user_id", "event_type"], "400 days"), "once").select("user_id", "event_type")


QUERIES = {f.__name__: f for f in (stream_change_events, stream_windowed_counts, stream_once_per_key)}
ORACLE_SQL = {"stream_change_events": BATCH_SQL["change_events"], "stream_once_per_key": "SELECT DISTINCT user_id, event_type FROM events"}
