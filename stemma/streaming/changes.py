"""Incremental work: change feeds, keyed upserts, anchors after edits; the streaming forms are extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def coalesced(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key; a key that was added and deleted in the same batch is left out."""
    others = [c for c in changes.columns if c != key]
    got = changes.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"), F.min_by("change", F.struct(*order)).alias("first"))
    kept = got.where(~((F.col("first") == "add") & (F.col("last.change") == "delete")))
    return kept.select(key, *[F.col(f"last.{c}").alias(c) for c in others])


def anchored(text: Column, exact: Column, prefix: Column, suffix: Column, start: Column, context: int = 8) -> Column:
    """Where a marked passage stands now (0-based): 4 points each for equal context before and after, less distance / 1000.

    Null where the passage is gone. Only the nearest place on either side can be the best of those with the same points, so
    each form of context is sought twice, from ``start`` on and, in the reversed text, back from it.
    """
    before, after, start, back = F.right(prefix, F.lit(context)), F.left(suffix, F.lit(context)), F.coalesce(start, F.lit(0)), F.reverse(text)

    def nearest(points: int, lead: Column, rest: Column) -> list[Column]:
        whole = F.concat(lead, exact, rest)
        later = F.position(whole, text, F.greatest(start - F.length(lead) + 1, F.lit(1)))
        past = F.length(text) - F.length(whole) + F.length(lead) + 1
        earlier = F.position(F.reverse(whole), back, F.greatest(past - start + 1, F.lit(1)))
        places = [(later, later - 1 + F.length(lead)), (earlier, past - earlier)]
        return [F.when(found > 0, F.struct((points - F.abs(at - start) / 1000.0).alias("points"), (-at).alias("at"))) for found, at in places]

    none = F.lit("")
    best = F.array_max(F.array(*nearest(8, before, after), *nearest(4, before, none), *nearest(4, none, after), *nearest(0, none, none)))
    return F.when(exact != "", -best.at)


def tumbling(events: DataFrame, size: str, late: str) -> DataFrame:
    """Counts and sums by window and type; on a stream, windows close once the watermark passes them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    got = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All available input through ``each`` (frame, batch id), exactly once a batch id."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
