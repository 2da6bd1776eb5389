"""Operators without SQL against plain versions, and corpus operators that order by ranges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import corpus, curriculum, evaluation
from corpusforge.sources import readers


def test_spikes():
    rng = random.Random(3)
    values = [rng.lognormvariate(0, 2) * 5 for _ in range(600)]
    kept, found = [], 0
    for v in values:
        last = sorted(kept[-100:])
        if len(last) >= 20 and v > 10 * last[len(last) // 2] and v > 10:
            found += 1
        else:
            kept.append(v)
    assert found > 5 and evaluation.count_spikes(values, 1.0) == found


def test_bootstrap_matches_the_normal_interval(spark):
    x = np.random.default_rng(1).normal(10, 3, 900)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id bigint, x double")
    low, high = evaluation.bootstrap_mean(df, 1000).first()
    half = 1.96 * x.std() / 30
    assert low == pytest.approx(x.mean() - half, abs=0.2 * half) and high == pytest.approx(x.mean() + half, abs=0.2 * half)


def test_prefix_sums_and_runs(spark):
    rng = random.Random(8)
    rows = [(i * 7, rng.choice("aab") if i % 50 else None, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g string, v long").repartition(5)
    got = {r.i: r.s for r in corpus.prefix_sum(df, ["g"], "i", F.col("v"), "s", 7).collect()}
    sums = {}
    for i, g, v in rows:
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    got = {r.i: r.run for r in corpus.runs(df.fillna("z"), "i", "g", "run", 7).collect()}
    run, last = 0, object()
    for i, g, _ in rows:
        run, last = run + ((g or "z") != last), g or "z"
        assert got[i] == run
    assert corpus.prefix_sum(df.limit(0), ["g"], "i", F.col("v"), "s").count() == 0


def test_quota_plan_gives_every_document_a_stage(spark):
    counts = spark.createDataFrame([("general", 700), ("internet", 200), ("genz", 90), ("hinglish", 10)], "pool string, n long")
    plan = curriculum.quota_plan(counts)
    assert {r.pool: r.q for r in plan.groupBy("pool").agg(F.sum("quota").alias("q")).collect()} == {"general": 700, "internet": 200, "genz": 90, "hinglish": 10}
    docs = spark.range(0, 90).select("id", F.lit("genz").alias("pool"))
    got = [r.stage for r in curriculum.assign_stages(docs, plan, "pool", "id").orderBy("id").collect()]
    assert len(got) == 90 and got == sorted(got)


def test_ids_beyond_16_bits_are_an_error(spark):
    assert curriculum.as_uint16(spark.createDataFrame([([0, 65535],)], "t array<int>"), "t").count() == 1
    with pytest.raises(Exception, match="65535"):
        curriculum.as_uint16(spark.createDataFrame([([65536],)], "t array<int>"), "t").collect()


def test_text_column_order(spark):
    schema = "Message string, message string, body string, translation struct<source:int,hi_ng:string>, note string"
    rows = [("upper", "lower", " ", None, None), (None, "lower", None, None, None), (None, None, None, (1, "below"), "x"), (None, None, None, None, "a remark that is long enough"), (None, None, None, None, "UgyRjrEdJIPrf68uND14AaABAg")]
    got = [r.text_found for r in readers.text_column(spark.createDataFrame(rows, schema)).select("text_found").collect()]
    assert got == ["upper", "lower", "below", "a remark that is long enough", ""]
