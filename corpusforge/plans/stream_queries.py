"""Streaming queries, run to the end of a bounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.plans.registry import query, table
from corpusforge.scratch import keep, remove, shared_dir
from corpusforge.streaming import events as E


def run_stream(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Read the events as a stream, run all that is there, and return the sink's table. Executors write it, a folder a batch; nothing comes
    to the driver. A complete batch has the whole table, so the one before it goes."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, state = shared_dir(spark), shared_dir(spark)
    keep(spark, out)
    got = build(E.with_event_time(source))
    done: list[int] = []

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
        if mode == "complete":
            for old in set(done) - {i}:
                remove(spark, f"{out}/batch={old}")
            done.clear()
        done.append(i)

    try:
        got.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        remove(spark, state)
    return spark.read.schema(got.schema).parquet(*[f"{out}/batch={i}" for i in sorted(set(done))]) if done else spark.createDataFrame([], got.schema)


def _naive(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_stream(spark, sf_dir, E.tumbling_counts, "complete")
    return out.select(_naive("w.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT d + INTERVAL (k) DAY AS start_day, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, unnest([-1, 0]) AS k FROM events) GROUP BY 1")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stream(spark, sf_dir, E.sliding_counts, "complete").select(_naive("w.start").alias("start_day"), "n")


@query(
    """
    WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
    SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY user_id, s
    """
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stream(spark, sf_dir, E.sessions, "complete").select("user_id", _naive("w.start").alias("start"), "n")


@query("SELECT user_id, event_type, CAST(count(*) > 0 AS BOOLEAN) AS seen FROM events GROUP BY user_id, event_type")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_stream(spark, sf_dir, lambda e: E.deduplicated(e, ["user_id", "event_type"]), "append")
    return out.select("user_id", "event_type", F.lit(True).alias("seen"))
