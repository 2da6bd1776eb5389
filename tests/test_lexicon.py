"""Lexicon operators on small literal frames."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from corpusforge.operators import lexicon as L


def test_build_admission_merge_and_refine(spark):
    rows = [("Rizz", "charm", "he has rizz", "2023-01-01T00:00:00+00:00", 5), ("rizz", "x", "y", "2022-01-01T00:00:00+00:00", 9), ("rizz", "z", "", "bad date", 7), ("old", "q https://a.b", "w", "2010-01-01T00:00:00+00:00", 3), ("low", "q", "w", "2020-01-01T00:00:00+00:00", 0)]
    d = spark.createDataFrame(rows, "word string, definition string, example string, time string, score int")
    lex = L.build(d, F.lit("2024-01-01").cast("date"))
    got = {r.term: r for r in lex.collect()}
    assert set(got) == {"rizz", "old"}
    assert (got["rizz"].n_defs, got["rizz"].median_score, got["rizz"].definition, got["rizz"].first_seen) == (2, 9.0, "x", datetime.date(2022, 1, 1))
    assert got["old"].status == "dead" and got["old"].definition == "q"
    stop = spark.createDataFrame([("the",), ("of",)], "word string")
    zipf = spark.createDataFrame([("cap", 4.0)], "word string, zipf double")
    terms = spark.createDataFrame([("of the", "d"), ("the cap", "d"), ("cap", "d"), ("Lily", "d"), ("x", "d"), ("yeet", ""), ("yeet", "to throw")], "term string, definition string")
    assert sorted(r.term for r in L.admissible(terms, stop, zipf).collect()) == ["the cap", "yeet"]
    merged = {r.term: r for r in L.merge_curated(lex, spark.createDataFrame([("old", "c", "c"), ("new", "n", "n")], "term string, definition string, example string")).collect()}
    assert (merged["old"].status, merged["old"].recency_weight, merged["new"].recency_weight, merged["rizz"].source) == ("current", 0.8, 0.85, "dated")
    counts = spark.createDataFrame([("rizz", 3)], "term string, n long")
    assert {r.term: r.status for r in L.refine_status(lex, counts, 1_000_000).collect()} == {"rizz": "current", "old": "dead"}
