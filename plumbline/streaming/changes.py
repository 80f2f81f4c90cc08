"""Structured Streaming forms of the monitoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.storage import scratch_path

KEY = ["user_id", "event_type"]
FIELDS = ["level", "k"]


def _compared(rows: DataFrame) -> DataFrame:
    """Change events of snapshots (user_id, event_type, event_id, us, level, k, seen), each against the one before it."""
    window = Window.partitionBy(*KEY).orderBy(F.col("seen").desc(), "us", "event_id")
    at = rows.withColumns({f"last_{f}": F.lag(f).over(window) for f in FIELDS} | {"first": F.row_number().over(window) == 1})
    as_text = [F.struct(F.lit(f).alias("field"), F.col(f"last_{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after")) for f in FIELDS]
    out = at.where("not first").select(*KEY, "event_id", F.explode(F.array(*as_text)).alias("x")).select(*KEY, "event_id", "x.*")
    return out.where(~F.col("before").eqNullSafe(F.col("after")))


def change_events_once(events: DataFrame, label: str) -> DataFrame:
    """Change events of all that a stream of (event_id, ts, user_id, event_type, level, k) has, as a table in the shared folder.

    A batch is compared as a whole, by windows over its rows and one snapshot a key, the last that was seen. A first snapshot makes no event;
    rows that arrive in a later batch than newer ones are compared with what was last seen. Each batch writes folders of its own number,
    so that a batch that is run again replaces what it wrote.
    """
    spark: SparkSession = events.sparkSession
    out, last, checkpoint = (scratch_path(spark, f"{label}{x}") for x in ("", "-last", "-checkpoint"))
    order = F.struct("us", "event_id")

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select(*KEY, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *FIELDS, F.lit(False).alias("seen"))
        newest = rows.groupBy(*KEY).agg(F.max_by(F.struct("event_id", "us", *FIELDS), order).alias("x")).select(*KEY, "x.*", F.lit(True).alias("seen"))
        if number:
            known = spark.read.schema(newest.schema).parquet(f"{last}/{number - 1}")
            rows = rows.unionByName(known)
            newest = newest.unionByName(known.join(newest.select(*KEY), KEY, "left_anti").select(*newest.columns))
        _compared(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")
        newest.write.mode("overwrite").parquet(f"{last}/{number}")

    query = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = f"user_id {events.schema['user_id'].dataType.simpleString()}, event_type string, event_id long, field string, before string, after string"
    return spark.read.schema(f"{schema}, batch int").parquet(out).drop("batch")


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per window; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once_per_key(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark (idempotent inserts)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process all that is available and return what the stream has written, as a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
