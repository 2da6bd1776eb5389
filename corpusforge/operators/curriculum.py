"""Curriculum: quotas of each stage and pool, documents dealt to stages, document numbers inside packed windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.operators import corpus as C

# fixed values: share of the corpus, and mixture of pools, of each stage in turn; stage that takes what a pool has left
STAGE_SHARE = {"S1": 0.667, "S2": 0.300, "S3": 0.033}
STAGE_MIX = {
    "S1": {"general": 1.00},
    "S2": {"general": 0.40, "internet": 0.35, "genz": 0.20, "hinglish": 0.03, "lexicon": 0.02},
    "S3": {"general": 0.20, "internet": 0.25, "genz": 0.50, "hinglish": 0.03, "lexicon": 0.02},
}
LEFTOVER_STAGE = {"general": "S1", "internet": "S2", "hinglish": "S2", "lexicon": "S2", "genz": "S3"}


def quota_plan(counts: DataFrame) -> DataFrame:
    """(stage, pool, want, got, quota) of the pools' document counts (pool, n): a stage wants its share of the mixture and gets what
    earlier stages left of the pool; the leftover stage's quota takes the rest, so quotas sum to the documents. Pools that are in no
    mixture go to S2."""
    spark = counts.sparkSession
    mix = [(i, s, p, STAGE_SHARE[s], m) for i, s in enumerate(STAGE_MIX) for p, m in STAGE_MIX[s].items()]
    mix = spark.createDataFrame(mix, "_o int, stage string, pool string, _share double, _mix double")
    last = spark.createDataFrame(list(LEFTOVER_STAGE.items()), "pool string, _to string")
    total = counts.agg(F.sum("n").alias("_total"))
    order = Window.partitionBy("pool").orderBy("_o")
    stages = F.array(*[F.struct(F.lit(i).alias("_o"), F.lit(s).alias("stage")) for i, s in enumerate(STAGE_MIX)])
    grid = counts.select("pool", "n", F.inline(stages))
    all_ = grid.join(F.broadcast(mix.drop("_o")), ["stage", "pool"], "left").join(F.broadcast(total))
    want = F.coalesce(F.floor(F.floor(F.col("_total") * F.col("_share")) * F.col("_mix")), F.lit(0)).cast("bigint")
    before = F.coalesce(F.sum("want").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = all_.withColumn("want", want).withColumn("got", F.least("want", F.greatest(F.col("n") - before, F.lit(0))).cast("bigint"))
    got = got.join(F.broadcast(last), "pool", "left").withColumn("_left", F.col("n") - F.sum("got").over(Window.partitionBy("pool")))
    return got.select("stage", "pool", "want", "got", (F.col("got") + F.when(F.coalesce("_to", F.lit("S2")) == F.col("stage"), F.col("_left")).otherwise(0)).cast("bigint").alias("quota"))


def assign_stages(docs: DataFrame, plan: DataFrame, pool: str, order: str) -> DataFrame:
    """docs with stage: in each pool, in the order of a unique numeric column, the first stage whose quota isn't used up. Places in a pool
    are sums over ranges, so no task orders a whole pool."""
    ends = plan.withColumn("_to", F.sum("quota").over(Window.partitionBy("pool").orderBy("stage"))).withColumn("_from", F.col("_to") - F.col("quota"))
    ends = ends.where(F.col("quota") > 0).select(F.col("pool").alias("_pool"), "stage", "_from", "_to")
    placed = C.prefix_sum(docs, [pool], order, F.lit(1), "_place")
    return placed.join(F.broadcast(ends), (F.col(pool) == F.col("_pool")) & (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))).drop("_pool", "_from", "_to", "_place")


def document_ids(windows: DataFrame, eos: int, by: Sequence[str]) -> DataFrame:
    """Packed windows (by, win, input_ids) with doc_ids: how many ends of documents stand before each token in its window, so that
    attention can be kept inside a document; the count starts anew in each window, which is counted in its row."""

    def counted(ends: Column) -> Column:
        size = F.size("input_ids")
        cuts = F.concat(F.array(F.lit(-1)), ends, F.array(size - 1))
        runs = F.transform(F.sequence(F.lit(0), F.size(ends)), lambda k: F.array_repeat(k, F.get(cuts, k + 1) - F.get(cuts, k)))
        return F.when(size > 0, F.flatten(runs)).otherwise(F.array().cast("array<int>"))

    ends = F.filter(F.transform("input_ids", lambda t, i: F.when(t == eos, i)), lambda i: i.isNotNull())
    return windows.select(*by, "win", "input_ids", T.let(ends, counted).alias("doc_ids"))


def as_uint16(ids: DataFrame, column: str) -> DataFrame:
    """Rows unchanged; an id that a 16-bit shard can't hold is an error when the rows are read."""
    bad = F.exists(column, lambda x: (x < 0) | (x > 65_535))
    return ids.withColumn(column, F.when(bad, F.raise_error(F.lit("token id beyond 65535"))).otherwise(F.col(column)))
