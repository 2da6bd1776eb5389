"""Benchmark building and evaluation: nearest distractors, tokenizer metrics and their gate."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: targets of the tokenizer's metrics; fertility is an upper bound, the others are lower ones
TARGETS = (
    ("bytes_per_token_general", 4.0),
    ("bytes_per_token_genz", 3.2),
    ("bytes_per_token_hinglish", 2.8),
    ("fertility_chat", 1.6),
    ("roundtrip", 1.0),
    ("forced_single_token_rate", 0.95),
)
LEAST_SAMPLE_BYTES = 500_000_000


def nearest(items: DataFrame, k: int) -> DataFrame:
    """items (id, x, y) with other and place: for each item the k others nearest by \\|x - x'\\|, then \\|y - y'\\|, then id, of all items.

    Items of equal x and y share their candidates, of which only k + 1 ids count. Since each distinct x has an item, the k + 1 next
    distinct values on either side hold the nearest: an equi-join on x replaces all pairs.
    """
    least = items.withColumn("_r", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where(F.col("_r") <= k + 1).select("id", "x", "y")
    steps = [F.lag("x", i).over(Window.orderBy("x")) for i in range(-k - 1, k + 2)]
    around = items.select("x").distinct().select("x", F.array(*steps).alias("_near")).select("x", F.explode("_near").alias("x2")).where(F.col("x2").isNotNull())
    pool = least.select(F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = items.select("x", "y").distinct().join(around, "x").join(pool, "x2")
    best = F.row_number().over(Window.partitionBy("x", "y").orderBy(F.abs(F.col("x2") - F.col("x")), F.abs(F.col("y2") - F.col("y")), "other"))
    top = met.withColumn("_r", best).where(F.col("_r") <= k + 1)
    own = items.join(top.select("x", "y", "other", "_r"), ["x", "y"]).where(F.col("id") != F.col("other"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("_r")).cast("bigint")).where(F.col("place") <= k).drop("_r")


def token_metrics(docs: DataFrame, pool: str, n_bytes: Column, n_tokens: Column, n_words: Column) -> DataFrame:
    """(pool, bytes_per_token, fertility): sums over a pool's documents, not means of ratios; null where there are no tokens or words."""
    sums = docs.groupBy(pool).agg(F.sum(n_bytes).alias("_b"), F.sum(n_tokens).alias("_t"), F.sum(n_words).alias("_w"))
    return sums.select(pool, (F.col("_b") / F.nullif("_t", F.lit(0))).alias("bytes_per_token"), (F.col("_t") / F.nullif("_w", F.lit(0))).alias("fertility"))


def gate(metrics: DataFrame, sample_bytes: int | None = None) -> DataFrame:
    """metrics (metric, value) that have a target, with target and verdict: ok, failure, or warning where the sample is too small for any
    metric but the round trip to mean much."""
    targets = metrics.sparkSession.createDataFrame(list(TARGETS), "metric string, target double")
    small = sample_bytes is not None and sample_bytes < LEAST_SAMPLE_BYTES
    met = F.when(F.col("metric").startswith("fertility"), F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    missed = F.when((F.col("metric") != "roundtrip") & F.lit(small), "warning").otherwise("failure")
    return metrics.join(F.broadcast(targets), "metric").withColumn("verdict", F.when(met, "ok").otherwise(missed))


def elongated(word: Column) -> Column:
    """The word with its last character drawn out to 3, 4 and 6 of them."""
    return F.array(*[F.concat(word, F.repeat(F.right(word, F.lit(1)), F.lit(n - 1))) for n in (3, 4, 6)])


def forcing_repeats(total_bytes: Column, terms: Column, mean_length: Column) -> Column:
    """How often each forced term is written so that together they make a quarter of the sample; 400 times at least."""
    return F.greatest(F.lit(400), F.floor(total_bytes * 0.25 / (terms * mean_length)).cast("int"))


def count_spikes(values: Iterable[float], clip: float, window: int = 100, least: int = 20, factor: float = 10.0) -> int:
    """Values above ``factor`` times the upper median of the last ``window`` accepted ones and of the clip; spikes aren't accepted."""
    last, ordered, found = deque(), [], 0
    for v in values:
        if len(last) >= least and v > factor * ordered[len(ordered) // 2] and v > factor * clip:
            found += 1
            continue
        last.append(v)
        insort(ordered, v)
        if len(last) > window:
            del ordered[bisect_left(ordered, last.popleft())]
    return found


def spikes(rows: DataFrame, key: str, order: str, value: str, clip: float) -> DataFrame:
    """(key, spikes): :func:`count_spikes` of each key's values in order."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [g[key].iloc[0]], "spikes": [count_spikes(g.sort_values(order)[value], clip)]})

    return rows.groupBy(key).applyInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, spikes bigint")


def bootstrap_mean(rows: DataFrame, resamples: int = 4000, level: float = 0.95, seed: int = 5) -> DataFrame:
    """(low, high) of the mean of rows (id bigint, x double), by Poisson bootstrap: how often a resample takes a row follows from a hash of
    both, so reruns agree however rows are dealt; each task sends two sums a resample, never rows."""
    edges = np.cumsum([np.exp(-1) / f for f in np.cumprod([1.0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(resamples), np.zeros(resamples)
        r = (np.arange(resamples, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            for i in range(0, len(b), 500):
                h = b["id"].to_numpy()[i : i + 500, None].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) ^ r
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
                w = np.searchsorted(edges, (h >> np.uint64(11)) / float(1 << 53))
                total += b["x"].to_numpy()[i : i + 500] @ w
                weight += w.sum(axis=0)
        yield pd.DataFrame({"r": np.arange(resamples), "s": total, "w": weight})

    means = rows.mapInPandas(run, "r int, s double, w double").groupBy("r").agg((F.sum("s") / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))


DIMENSIONS = ("slang", "emoji", "abbrev", "elong", "formal")


def calibration_error(pairs: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """One row: the mean distance of requested (want_x) and produced (got_x) buckets, a column rce_x a dimension, and their sum rce; 0
    without pairs."""
    gaps = [F.coalesce(F.avg(F.abs(F.col(f"want_{d}") - F.col(f"got_{d}"))), F.lit(0.0)).alias(f"rce_{d}") for d in dims]
    got = pairs.agg(*gaps)
    return got.withColumn("rce", sum((F.col(f"rce_{d}") for d in dims), F.lit(0.0)))


def confusion(pairs: DataFrame, given: str, rated: str, classes: int = 5) -> DataFrame:
    """(given, rated, n): every cell of the grid, empty ones too."""
    types = dict(pairs.dtypes)
    n = pairs.groupBy(given, rated).agg(F.count("*").alias("n"))
    cells = F.sequence(F.lit(0), F.lit(classes - 1))
    grid = pairs.sparkSession.range(classes).select(F.col("id").cast(types[given]).alias(given), F.explode(cells.cast(f"array<{types[rated]}>")).alias(rated))
    return grid.join(F.broadcast(n), [given, rated], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def agreement(pairs: DataFrame, given: str, rated: str) -> DataFrame:
    """One row: exact, within_one and bias (given less rated)."""
    gap = F.col(given) - F.col(rated)
    share = lambda c: F.avg(c.cast("double"))
    return pairs.agg(share(gap == 0).alias("exact"), share(F.abs(gap) <= 1).alias("within_one"), F.avg(gap.cast("double")).alias("bias"))


def disagreements(pairs: DataFrame, key: str, given: str, rated: str, k: int = 8) -> DataFrame:
    """The k rows with the widest gap (a report), least key first; rows that agree aren't among them."""
    return pairs.withColumn("gap", F.abs(F.col(given) - F.col(rated))).where("gap > 0").orderBy(F.desc("gap"), key).limit(k)


def freshness(hits: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row: median_year of the first use of the hits' terms (term), n of hits in the lexicon (term, status, first_seen as text), and
    their share of each status. A first use without a year counts for the shares alone. Hits are counted by term before the join, and
    the median is one of years, of which there are few."""
    own = hits.groupBy("term").agg(F.count("*").alias("_n")).join(lexicon.select("term", "status", "first_seen"), "term")
    year = F.expr("try_cast(left(first_seen, 4) AS int)")
    share = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("_n"))) / F.sum("_n"), F.lit(0.0)).alias(f"frac_{s}")
    return own.withColumn("_y", year).agg(
        F.percentile("_y", F.lit(0.5), F.when(F.col("_y").isNotNull(), F.col("_n")).otherwise(0)).alias("median_year"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        *[share(s) for s in ("current", "aging", "dead")],
    )


def forced_tokens(tokens: DataFrame) -> DataFrame:
    """(token, place) of tokens (token, place): each once, at its least place; then each with a space before it that has none, after all."""
    plain = tokens.where(F.coalesce("token", F.lit("")) != "").select("token", F.col("place").cast("bigint").alias("place"))
    last = plain.agg(F.coalesce(F.max("place"), F.lit(0)).alias("_last"))
    spaced = plain.where(~F.col("token").startswith(" ")).join(F.broadcast(last)).select(F.concat(F.lit(" "), "token").alias("token"), (F.col("place") + F.col("_last") + 1).alias("place"))
    return plain.unionByName(spaced).groupBy("token").agg(F.min("place").alias("place"))
