"""Quota ledger: periods and their resets, billed hours, what is left, and verdicts on training so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_start(period: Column, at: Column) -> Column:
    """Start of the quota period that holds a time: weekly from Saturday, daily, or monthly, at midnight."""
    day = F.to_date(at)
    week = F.date_sub(day, F.dayofweek(at) % 7)  # Saturday is 7
    return F.when(period == "weekly", week).when(period == "daily", day).otherwise(F.trunc(day, "month"))


def next_reset(period: Column, at: Column) -> Column:
    start = period_start(period, at)
    return F.when(period == "weekly", F.date_add(start, 7)).when(period == "daily", F.date_add(start, 1)).otherwise(F.add_months(start, 1))


def usage(dispatches: DataFrame, budgets: DataFrame, now: Column) -> DataFrame:
    """A row a platform of ``budgets`` (platform, period, hours, session_hours, reserve): used and remaining hours of the current period,
    percentage, hours until the next reset. ``dispatches`` has platform, at and hours; a session is billed session_hours at most."""
    b = budgets.withColumn("_from", period_start(F.col("period"), now)).withColumn("_to", next_reset(F.col("period"), now))
    met = F.broadcast(b).join(dispatches.withColumnRenamed("hours", "_h"), "platform", "left")
    inside = F.col("at").between(F.col("_from"), now)
    billed = F.when(inside, F.least("_h", "session_hours")).otherwise(0.0)
    used = met.groupBy("platform", "period", "hours", "reserve", "_to").agg(F.coalesce(F.sum(billed), F.lit(0.0)).alias("used"), F.count(F.when(inside, 1)).alias("sessions"))
    left = F.greatest(F.col("hours") * (1 - F.col("reserve")) - F.col("used"), F.lit(0.0))
    return used.select("platform", "sessions", "used", left.alias("remaining"), (100 * F.col("used") / F.col("hours")).alias("pct"), ((F.unix_seconds(F.col("_to").cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) / 3600).alias("hours_to_reset"))


def verdict(tokens_per_parameter: Column) -> Column:
    # fixed values: edges of the classes
    t = tokens_per_parameter
    return F.when(t <= 0, "idle").when(t < 10, "bad").when(t < 20, "warn").when(t < 70, "ok").otherwise("good")


def stalled(sessions: DataFrame, key: str, order: str, least: int = 3) -> DataFrame:
    """(key, step, sessions, wasted_hours) of runs whose last ``least`` finished sessions (end_step is not null) all ended at the run's
    present step. ``sessions`` has end_step, wall seconds and the run's step; a session without wall seconds wasted none."""
    done = sessions.where(F.col("end_step").isNotNull())
    last = done.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= least)
    got = last.groupBy(key).agg(F.min("end_step").alias("_low"), F.max("end_step").alias("step"), F.max_by("step", order).alias("_now"), F.count("*").alias("sessions"), F.round(F.sum(F.coalesce("wall", F.lit(0.0))) / 3600, 2).alias("wasted_hours"))
    return got.where((F.col("_low") == F.col("step")) & (F.col("step") == F.col("_now")) & (F.col("sessions") == least)).drop("_low", "_now")


def close(dispatches: DataFrame, budgets: DataFrame, now: Column, held: bool) -> DataFrame:
    """Dispatches (platform, at, status, hours) with those closed that can't be running. While no lease is held, every running one has
    crashed; while one is, those beyond their platform's session_hours are unknown. They are billed the hours since, at most a session's."""
    b = F.broadcast(budgets.select(F.col("platform").alias("_p"), F.col("session_hours").alias("_most")))
    met = dispatches.join(b, F.col("platform") == F.col("_p"), "left")
    since = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 3.6e9
    running = F.col("status").eqNullSafe("running") & F.col("at").isNotNull()
    gone = F.coalesce(running & (since > F.col("_most")), F.lit(False)) if held else running
    bill = F.round(F.greatest(F.least(since, F.coalesce("_most", since)), F.lit(0.0)), 4)
    closed = met.withColumn("_gone", gone).withColumn("hours", F.when(F.col("_gone"), bill).otherwise(F.col("hours")))
    return closed.withColumn("status", F.when(F.col("_gone"), "unknown" if held else "crashed").otherwise(F.col("status"))).select(*dispatches.columns)


def soonest_reset(budgets: DataFrame, now: Column) -> DataFrame:
    """One row (platform, reset): the platform whose quota is next to be reset, the first by name of equal ones."""
    each = budgets.select("platform", next_reset(F.col("period"), now).alias("reset"))
    return each.agg(F.min(F.struct("reset", "platform")).alias("b")).select("b.platform", "b.reset")
