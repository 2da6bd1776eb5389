"""Operators of manifests, benchmarks, ledgers and lexicon loading on edge cases: nulls, empty tables, ties, repeated rows."""

from __future__ import annotations

import hashlib
import json

import pytest
import regex
from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.operators import benchmark, evaluation, ledger, lexicon, manifest
from corpusforge.sources import readers

SHARD = "path string, stage string, n_tokens bigint, vocab_size bigint"


def test_merge_orders_and_refuses_other_vocabularies(spark):
    rows = [("x/b", "S2", 5, 9), ("y/a", "S2", 5, 9), ("z", "S9", 1, 9), ("c", None, 2, 9)]
    assert [r.path for r in manifest.merge(spark.createDataFrame(rows, SHARD)).collect()] == ["c", "y/a", "x/b", "z"]
    for bad in (8, None):
        with pytest.raises(Exception, match="vocab_size"):
            manifest.merge(spark.createDataFrame([*rows, ("d", "S1", 1, bad)], SHARD)).collect()
    assert manifest.merge(spark.createDataFrame([], SHARD)).collect() == []


def test_cursors_follow_a_plain_reader(spark):
    sizes, length = [10, 3, 4, 0, 23, 5], 4
    served = []
    for epoch in range(2):
        for i, n in enumerate(sizes):
            served += [(epoch, i, o) for o in range(0, n, length) if o + length + 1 <= n]
    m = spark.createDataFrame(list(enumerate(sizes)), "i long, n_tokens long")
    at = spark.range(len(served)).select(F.col("id").alias("windows"))
    assert [(r.epoch, r.shard, r.offset) for r in manifest.cursors(m, "i", at, length).orderBy("windows").collect()] == served
    assert manifest.cursors(m.where("n_tokens < 5"), "i", at, length).count() == 0


def test_prune_needs_a_run(spark):
    names = spark.createDataFrame([("ckpt-a-1",)], "name string")
    with pytest.raises(ValueError):
        manifest.to_prune(names, names, "ckpt-")
    assert manifest.to_prune(names, names, "ckpt-a-").count() == 0


def test_content_hash_is_that_of_json(spark):
    rows = [("t", 'a "q" \\ \n\t\x0b\x1f ü 🙂', None), ("t", "", "c\r\b\f"), ("u", None, "")]
    df = spark.createDataFrame(rows, "task string, prompt string, context string")
    got = [r[0] for r in df.select(benchmark.content_hash(F.col("task"), F.col("prompt"), F.col("context"))).collect()]
    blob = [json.dumps({"task": t, "prompt": p, "context": c}, sort_keys=True, ensure_ascii=False) for t, p, c in rows]
    assert got == [hashlib.sha256(b.encode()).hexdigest()[:16] for b in blob]


def test_likeliest_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([-4.0, -2.0, -2.0], ["a b", "c", "d"]), ([], []), ([-1.0], [""])], "s array<double>, o array<string>")
    assert [r[0] for r in df.select(benchmark.likeliest(F.col("s"), F.col("o"))).collect()] == [0, None, 0]


def test_quality_without_rows_or_attestation(spark):
    cols = "term string, definition string, example string, source string, status string, corpus_rate double, median_score double"
    english = spark.createDataFrame([("Dog",)], "word string")
    rows = [
        ("dog", "x", None, "dated", "dead", None, 900.0),
        ("DOG", "x", None, "curated", "dead", None, None),
        ("g2g", "got to go", "", "curated", "current", None, 1.0),
        ("rizz", "charm", "", "curated", "current", 0.0, 1.0),
        ("12", "n", "", "curated", "dead", 0.0, 900.0),
        ("zed", "n", "a Nazi", "curated", "dead", 0.0, 900.0),
        (None, None, None, None, None, None, None),
    ]
    got = benchmark.quality(spark.createDataFrame(rows, cols), english)
    assert sorted(r.term for r in got.collect()) == ["DOG", "rizz"]
    got = benchmark.quality(spark.createDataFrame([*rows, ("yeet", "throw", "", "dated", "current", 2.0, 0.0)], cols), english)
    assert sorted(r.term for r in got.collect()) == ["DOG", "yeet"]
    assert benchmark.quality(spark.createDataFrame([], cols), english).count() == 0


def test_lexicon_load_keeps_the_first_in_the_file(spark, tmp_path):
    lines = [{"term": t, "definition": d} for t, d in (("yeet", "one"), ("the of", "no"), ("yeet", "two"), ("w", "trivial"), ("tea", "gossip"), ("cat", "pet"), ("b&", "no"), ("gg", "jargon"), ("of yeet", "yes"))]
    path = tmp_path / "lex.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\n\n")
    one = lambda rows, cols: spark.createDataFrame(rows, cols)
    entries = readers.with_position(readers.read(spark, str(path), schema="term string, definition string"))
    words = one([("the",), ("of",), ("of",)], "word string")
    zipf = one([("tea", 5.0), ("cat", 5.0)], "word string, zipf double")
    drifted, slang = one([("tea", "x"), ("woke", "x")], "term string, definition string"), one([("woke", "y")], "term string, definition string")
    got = lexicon.load(entries, "position", words, one([("gg",)], "word string"), zipf, drifted, slang)
    assert {r.term: r.definition for r in got.collect()} == {"yeet": "one", "tea": "gossip", "of yeet": "yes", "woke": "y"}
    assert lexicon.load(entries.limit(0), "position", words, words, zipf, drifted, slang).count() == 2


def test_close_leaves_unknown_times_alone(spark):
    d = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2024-01-01 00:00:00', 'running', 0d), ('a', NULL, 'running', 0d), ('z', TIMESTAMP_NTZ'2024-01-01 00:00:00', 'running', 0d), ('a', TIMESTAMP_NTZ'2024-01-01 00:00:00', NULL, 7d) t(platform, at, status, hours)")
    b = spark.createDataFrame([("a", 2.0)], "platform string, session_hours double")
    now = F.expr("TIMESTAMP_NTZ'2024-01-01 05:00:00'")
    states = lambda held: sorted((r.platform, str(r.status), r.hours) for r in ledger.close(d, b, now, held).collect())
    assert states(True) == [("a", "None", 7.0), ("a", "running", 0.0), ("a", "unknown", 2.0), ("z", "running", 0.0)]
    assert states(False) == [("a", "None", 7.0), ("a", "crashed", 2.0), ("a", "running", 0.0), ("z", "crashed", 5.0)]


def test_freshness_and_errors_of_nothing(spark):
    lex = spark.createDataFrame([("a", "dead", None)], "term string, status string, first_seen string")
    r = evaluation.freshness(spark.createDataFrame([], "term string"), lex).first()
    assert (r.median_year, r.n, r.frac_dead) == (None, 0, 0.0)
    r = evaluation.freshness(spark.createDataFrame([("a",), ("a",), ("b",)], "term string"), lex).first()
    assert (r.median_year, r.n, r.frac_dead) == (None, 2, 1.0)
    empty = spark.createDataFrame([], ", ".join(f"want_{d} int, got_{d} int" for d in evaluation.DIMENSIONS))
    assert evaluation.calibration_error(empty).first().rce == 0


def test_sources(spark):
    df = spark.sql("SELECT 1 AS author, 2 AS Author, named_struct('source', 0.0d) AS a, named_struct('source', 1) AS b")
    assert readers.without_personal(df).columns == ["Author", "a", "b"]
    assert df.select(readers.human_annotated(df)).first()[0] is False
    assert readers.only_pools([("x", "genz"), ("y", "general")], "genz, internet") == [("x", "genz")]
    with pytest.raises(ValueError):
        readers.only_pools([("x", "genz")], "lexicon")


def test_pretokens_are_those_of_the_pattern(spark):
    texts = ["<|reg|>hey @you_2 r/ask :smile: don't  stop!!\r\n\n x 12345 #tag 👩‍💻🙂️ ok...  ", "", None, "nahi\tकैसे ‼️ a b", "naïve café'll  \n end"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.pretokens(F.col("t"))).collect()]
    want = [None if t is None else [m.group() for m in regex.finditer(text.PRETOKEN.replace(text.R.EMOJI, r"\p{Extended_Pictographic}").replace("(?U)", "").replace(r"\x{200D}", "‍").replace(r"\x{FE0F}", "️").replace(r"\x{20E3}", "⃣"), t)] for t in texts]
    assert got == want
    assert ["".join(g) for g in got if g is not None] == [t for t in texts if t is not None]
