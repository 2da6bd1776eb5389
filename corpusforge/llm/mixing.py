"""Mixing sources to target weights: subset-sum budget fitting over counts of documents by exact length."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import WORD, materialise

EXACT = 1 << 16
MOST = 3


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each distinct size to take so that their sizes sum to ``budget`` or, failing that, come closest below.

    Every size first gives its proportional share (floor), then the largest sizes fill up to about EXACT words, and a bounded-knapsack
    dynamic programme (binary splitting, reachable sums as bits) over what is left fits the rest. Where it can't, shares of the least
    sizes are given back, a little at first and EXACT words at most, and it fits again: up to EXACT words the result is the best there is.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (budget / total)).astype(np.int64) if budget > 0 else np.zeros_like(counts)
    rest = int(budget - (take * sizes).sum())
    while rest < 0:  # rounding of the share
        i = int(np.flatnonzero(take)[0])
        take[i] -= 1
        rest += int(sizes[i])
    for i in np.argsort(-sizes, kind="stable").tolist():
        if rest <= EXACT:
            break
        n = min(int(counts[i] - take[i]), (rest - EXACT) // int(sizes[i]) + 1, rest // int(sizes[i])) if sizes[i] else 0
        take[i] += n
        rest -= n * int(sizes[i])
    first, left, best = take, rest, take
    short = rest
    for room in (0, *(1 << k for k in range(8, EXACT.bit_length(), 2))):
        take, rest = first.copy(), left
        for i in np.argsort(sizes, kind="stable").tolist():
            n = min(int(take[i]), max(0, min(room, EXACT) - rest) // int(sizes[i])) if sizes[i] else 0
            take[i] -= n
            rest += n * int(sizes[i])
        take, missed = _fill(sizes, counts, take, rest)
        if missed < short or room == 0:
            best, short = take, missed
        if not short:
            break
    return best


def _fill(sizes: np.ndarray, counts: np.ndarray, take: np.ndarray, rest: int) -> tuple[np.ndarray, int]:
    """``take`` with more documents, as near to ``rest`` words more as there are, and what is missing."""
    if rest <= 0:
        return take, 0
    reach, full, steps = 1, (1 << (rest + 1)) - 1, []
    for i in np.argsort(sizes, kind="stable").tolist():
        size, left, part = int(sizes[i]), int(min(counts[i] - take[i], rest // sizes[i])) if sizes[i] else 0, 1
        while left > 0 and not reach >> rest & 1:
            n = min(part, left)
            steps.append((i, n, reach))
            reach |= reach << (n * size) & full
            left, part = left - n, part * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    missed = rest - at
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(sizes[i])
    return take, missed


def targets(sized: DataFrame, weights: Sequence[float], most: int = MOST) -> DataFrame:
    """skey, source_size, target: 100% of all sizes shared by weight, no target above ``most`` times its source's size.

    Resharing an excess until none is left ends where target = min(most * size, level * weight); the level comes from cumulative sums
    over the sources by cap/weight. The single-task windows hold a row a source.
    """
    src = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy("skey")) - 1).cast("int") % len(weights) + 1)
    src = src.withColumn("w", w).withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("at", F.col("cap") / F.col("w"))
    up = Window.orderBy("at", "skey")
    src = src.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    src = src.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "skey", "level"))).over(Window.partitionBy()).getField("level"))
    return src.select("skey", "source_size", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 17, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """id_col, size, source_size, target, taken (words taken, repeats counted): one row per input row.

    A source's documents are all taken as often as the target holds them whole (``most`` times at most); of the rest, documents are
    chosen by exact length: how many of each is :func:`fit_budget`'s, which ones goes by a seeded hash, so reruns agree. Null sources
    are a source of their own, last; null and empty texts have size 0. Rows that are equal in id are ranked in any order, with the same
    rows as a result. Columns other than the three named aren't read; an empty table gives none.

    The sized table (ids, sizes) is written once. A source's histogram has a row a distinct length. Choosing n of a length's
    documents, a hot one included, takes whole hash buckets; only the bucket at the boundary (1/``buckets``) is ranked.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("skey"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
            F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(buckets)).cast("int").alias("bucket"),
        )
    )
    fine = sized.groupBy("skey", "size", "bucket").agg(F.count("*").alias("n"))
    goal = materialise(targets(sized, weights, most))
    counts = fine.groupBy("skey", "size").agg(F.sum("n").alias("n")).join(goal, "skey")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("size")
        total, target = int(g["source_size"].iloc[0]), float(g["target"].iloc[0])
        copies = min(most, int(target // total)) if total else 0
        need = fit_budget(g["size"].to_numpy(), g["n"].to_numpy(), round(target - copies * total)) if total and copies < most else np.zeros(len(g), np.int64)
        return pd.DataFrame({"skey": g["skey"], "size": g["size"], "copies": np.int64(copies), "need": need})

    plan = counts.groupBy("skey").applyInPandas(solve, "skey string, size bigint, copies bigint, need bigint")
    by = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        fine.join(plan, ["skey", "size"])
        .withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0)))
        .where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("n")))
        .select("skey", "size", "bucket", (F.col("need") - F.col("before")).alias("part"))
    )
    plan = materialise(plan.join(edge.withColumnRenamed("bucket", "edge"), ["skey", "size"], "left"))
    # no edge: all of that length are needed
    rows = sized.join(plan, ["skey", "size"]).join(F.broadcast(goal) if goal.count() < 10_000 else goal, "skey")
    at_edge = F.col("bucket") == F.coalesce(F.col("edge"), F.lit(-1))
    sure = rows.where(~at_edge | (F.col("part") == 0)).withColumn("chosen", F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))
    rank = F.row_number().over(Window.partitionBy("skey", "size").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id"))
    unsure = rows.where(at_edge & (F.col("part") > 0)).withColumn("chosen", rank <= F.col("part"))
    return sure.unionByName(unsure).select(F.col("id").alias(id_col), "size", F.col("source_size").cast("bigint"), "target", (F.col("size") * (F.col("copies") + F.col("chosen").cast("bigint"))).alias("taken"), (F.col("copies") + F.col("chosen").cast("bigint")).cast("int").alias("copies"))
