"""Corpus assembly: exact deduplication, caps, budgets, splits, sharding and packed windows, as DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text as T


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep the row with the least id of each normalised text; a 16-byte hash is shuffled, and minima are partial."""
    first = df.select(F.md5(T.normal_key(F.col(text_col))).alias("_k"), id_col).groupBy("_k").agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(first, id_col, "left_semi")


def cap_frequency(df: DataFrame, key: Column, order: Sequence[str], cap: int) -> DataFrame:
    """At most ``cap`` rows of each key, first by ``order``; Spark limits groups before the shuffle as well."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input to all cores, for chains that are all computing: its splits may be fewer than the cores, or, as row
    groups don't divide, empty but for one. An input of four splits a core or more stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * cores else df.repartition(2 * cores)


def bucketed(df: DataFrame, by: Sequence[str], order: str, buckets: int = 64) -> DataFrame:
    """Append ``_bucket``: ranges of the numeric column ``order`` in each group ``by``, about equally full; equal values share one."""
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = df.groupBy(*by).agg(F.percentile_approx(order, steps, F.lit(1000)).alias("_cuts"))
    names = [f"_by{i}" for i in range(len(by))]
    cuts = cuts.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], "_cuts")
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)]
    met = df.join(cuts, on) if on else df.join(F.broadcast(cuts))  # one row
    return met.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts", *names)


def prefix_sum(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, buckets: int = 64) -> DataFrame:
    """Append ``name``: the sum of ``value`` over the rows of the same group before this one. Ranges are summed first, so a task orders a
    range of a group at most, never all of it; ``order`` should be unique in a group."""
    df = bucketed(df.withColumn("_value", value), by, order, buckets)
    sums = df.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    names = [f"_key{i}" for i in range(len(by))]
    sums = sums.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("_bucket").alias("_range"), "_before")
    on = [F.col("_bucket") == F.col("_range"), *[F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)]]
    inside = F.sum("_value").over(Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(sums, on).withColumn(name, F.coalesce(inside, F.lit(0)) + F.col("_before")).drop("_value", "_bucket", "_range", "_before", *names)


def runs(df: DataFrame, order: str, value: str, name: str, buckets: int = 64) -> DataFrame:
    """Append ``name``: the number of the run of equal ``value`` (from 1) in the order of a unique numeric column. Ranges know the last
    value before them, so no task orders the whole table."""
    df = bucketed(df, (), order, buckets)
    ends = df.groupBy("_bucket").agg(F.max_by(value, order).alias("_last"))
    ends = ends.withColumn("_carry", F.lag("_last").over(Window.orderBy("_bucket"))).select(F.col("_bucket").alias("_range"), "_carry")
    own = Window.partitionBy("_bucket").orderBy(order)
    df = df.withColumn("_first", F.row_number().over(own) == 1).withColumn("_prev", F.lag(value).over(own))
    df = df.join(F.broadcast(ends), F.col("_bucket") == F.col("_range"))  # a row a range
    new = F.coalesce(F.col(value) != F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")), F.lit(True)).cast("int")
    return prefix_sum(df.withColumn("_new", new).drop("_bucket", "_range"), (), order, F.col("_new"), "_at", buckets).withColumn(name, (F.col("_at") + F.col("_new")).cast("bigint")).drop("_at", "_new", "_first", "_prev", "_carry")


def carried(df: DataFrame, order: str, value: str, name: str, buckets: int = 64) -> DataFrame:
    """Append ``name``: the last ``value`` that isn't null, up to this row and the others of its place, in the order of a numeric column.
    Ranges know the last value before them, so no task orders the whole table."""
    df = bucketed(df, (), order, buckets)
    there = df.where(F.col(value).isNotNull())
    ends = there.groupBy(F.col("_bucket").alias("_range")).agg(F.max_by(value, order).alias("_last"))
    own = Window.partitionBy("_bucket").orderBy(order)
    carry = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_range")).join(ends, "_range", "left")
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carry = carry.withColumn("_carry", before).drop("_last")  # a row a range
    df = df.join(F.broadcast(carry), F.col("_bucket") == F.col("_range"))
    last = F.last(value, ignorenulls=True).over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.coalesce(last, F.col("_carry"))).drop("_bucket", "_range", "_carry")


def count_between(ranges: DataFrame, points: DataFrame, key: str, low: str, high: str, at: str, name: str, buckets: int = 64) -> DataFrame:
    """ranges with ``name``: how many points of the same key lie between low and high, both included. No pair is made: points up to high
    less points below low, as sums over the distinct values of a key."""
    own = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(at).alias("_v")).agg(F.count("*").alias("_n"))
    ends = ranges.select(F.col(key).alias("_k"), F.explode(F.array(low, high)).alias("_v")).where("_k IS NOT NULL AND _v IS NOT NULL").distinct()
    values = own.unionByName(ends.withColumn("_n", F.lit(0).cast("long"))).groupBy("_k", "_v").agg(F.sum("_n").alias("_n"))
    sums = prefix_sum(values, ["_k"], "_v", F.col("_n"), "_below", buckets).withColumn("_upto", F.col("_below") + F.col("_n"))
    lows = sums.select(F.col("_k").alias(key), F.col("_v").alias(low), "_below")
    highs = sums.select(F.col("_k").alias(key), F.col("_v").alias(high), "_upto")
    met = ranges.join(lows, [key, low]).join(highs, [key, high])
    return met.select(*ranges.columns, F.greatest(F.col("_upto") - F.col("_below"), F.lit(0)).alias(name))


def budget(df: DataFrame, part: str, cost: Column, order: str, limit: Column) -> DataFrame:
    """Rows of each part until their cost reaches ``limit``, the row that crosses it included."""
    return prefix_sum(df, [part], order, cost, "_b").where(F.col("_b") < limit).drop("_b")


def split_by_hash(text: Column, share: float) -> Column:
    """val or train by the first 32 bits of md5."""
    u = F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint") % 100000
    return F.when(u < int(share * 100000), "val").otherwise("train")


def windows(tokens: DataFrame, doc_col: str, token_col: str, length: int, by: Sequence[str]) -> DataFrame:
    """(by, win, input_ids, labels): packed windows of ``length`` tokens with the next token as label; the tail without a label is dropped.

    ``tokens`` has a row a document with an array of ids. Offsets are summed over documents, not tokens, and a document is cut at the
    ends of windows before the group-by: its pieces are shuffled as arrays, and each window gathers ``length`` + 1 tokens.
    """
    own = tokens.withColumn("_n", F.size(token_col))
    own = prefix_sum(own, by, doc_col, F.col("_n"), "_at").where("_n > 0")
    at, n = F.col("_at"), F.col("_n")

    def piece(w: Column) -> Column:
        # a token that begins a window is the last label of the one before
        skip = F.greatest(w * length - at, F.lit(0))
        size = F.least(n.cast("long"), (w + 1) * length + 1 - at) - skip
        return F.struct(w.alias("win"), (at + skip).alias("_p"), F.slice(token_col, (skip + 1).cast("int"), size.cast("int")).alias("_t"))

    touched = F.sequence(F.greatest(F.floor((at - 1) / length), F.lit(0)), F.floor((at + n - 1) / length))
    rows = own.select(*by, F.inline(F.transform(touched, piece)))
    got = rows.groupBy(*by, "win").agg(F.sort_array(F.collect_list(F.struct("_p", "_t"))).alias("_s"))
    ids = got.select(*by, "win", F.flatten(F.transform("_s", lambda x: x["_t"])).alias("_ids")).where(F.size("_ids") == length + 1)
    return ids.select(*by, "win", F.slice("_ids", 1, length).alias("input_ids"), F.slice("_ids", 2, length).alias("labels"))
