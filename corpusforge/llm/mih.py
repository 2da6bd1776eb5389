"""Exact top-k Hamming search over binary codes: multi-index hashing with growing segment radii."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import materialise


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Bit i is set where component i is above 0; null unless the vector has ``bits`` components, all finite."""
    code = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("bigint"), lambda a, i: a.bitwiseOR(F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))))
    ok = (F.size(vector) == bits) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, code)


def segment(code: Column, j: int, width: int) -> Column:
    return F.call_function("shiftrightunsigned", code, F.lit(j * width)).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def topk(index: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, segments: int = 4) -> DataFrame:
    """(query_id, vec_id, distance, rank) of each query's k nearest others by Hamming distance, ties by vec_id. Exact.

    ``index`` and ``queries`` have vec_id and code (bigint). Rows with a null code or id take no part; a repeated vec_id counts once for
    each distinct code it has. Fewer than k others: all of them. Empty inputs give none.

    Codes are indexed once each, with the k + 1 smallest vec_ids that have it (more can't be in a result), so thousands of equal vectors
    are one entry. In round r every open query probes, in each of the segments, the values at exactly r bits; by the pigeonhole
    principle all codes within segments * (r + 1) - 1 are then verified, and a query closes once its k-th verified distance is that
    or less. Only verified codes within the k-th distance so far are kept between rounds.
    """
    width = bits // segments
    own = index.where(F.col("code").isNotNull() & F.col("vec_id").isNotNull()).select("code", "vec_id").distinct()
    ids = materialise(own.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("n") <= k + 1))
    codes = ids.groupBy("code").agg(F.max("n").cast("bigint").alias("n"))
    entries = materialise(codes.select("code", "n", F.explode(F.array(*[F.struct(F.lit(j).alias("seg"), segment(F.col("code"), j, width).alias("val")) for j in range(segments)])).alias("s")).select("s.*", "code", "n"))
    asked = materialise(queries.where(F.col("code").isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).distinct())
    active = asked.select("q").distinct()
    everything = codes.count()
    found = None
    for r in range(width + 1):
        masks = [sum(1 << i for i in c) for c in combinations(range(width), r)]
        probe = active.select("q", F.explode(F.lit(masks)).alias("mask"))
        probe = probe.select("q", F.explode(F.array(*[F.struct(F.lit(j).alias("seg"), segment(F.col("q"), j, width).bitwiseXOR(F.col("mask").cast("int")).alias("val")) for j in range(segments)])).alias("s")).select("q", "s.*")
        # the probes' size is known only after they are made: never broadcast them on the estimate
        new = probe.join(entries.hint("merge"), ["seg", "val"]).select("q", "code", "n", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int").alias("distance"))
        both = (new if found is None else new.unionByName(found)).distinct()
        nearer = Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        found = materialise(both.withColumn("closer", F.coalesce(F.sum("n").over(nearer), F.lit(0))).where(F.col("closer") <= k).drop("closer"))
        if r == width:
            break
        covered = segments * (r + 1) - 1
        done = found.where(F.col("distance") <= covered).groupBy("q").agg(F.sum("n").alias("have"), F.count("*").alias("codes")).where((F.col("have") > k) | (F.col("codes") == everything))
        active = materialise(active.join(done, "q", "left_anti"))
        if active.isEmpty():
            break
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    hits = asked.join(found, "q").join(ids.select("code", "vec_id"), "code").where(F.col("vec_id") != F.col("query_id"))
    hits = hits.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id", "distance", F.col("rank").cast("int"))
