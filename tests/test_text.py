"""Text functions and corpus operators on small literal frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.operators import clean as C
from corpusforge.operators import corpus
from corpusforge.sources import readers


def values(spark, rows, build):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("text"))).collect()]


def test_scrub_order_and_marks(spark):
    got = values(spark, ["mail a@b.co", "at 1.2.3.4", "call 555 123 4567", "n 123456789012345", "u/name and x@y @name"], T.scrub)
    assert got == ["mail <|email|>", "at <|redacted|>", "call <|phone|>", "n <|phone|>", "@user and x@y @user"]


def test_markup(spark):
    got = values(spark, ["[a](b) <b>c</b> https://x.io/1", "&amp;lt; it’s", "&gt; quoted\nkept"], T.strip_markup)
    assert got[0] == "a  c  http" and got[1] == "< it's" and got[2].strip() == "kept"


def test_repeats(spark):
    assert values(spark, ["sooooooo", "soooooo", "😀" * 9], T.cap_repeats) == ["soooooo", "soooooo", "😀" * 6]


@pytest.mark.parametrize(("text", "reason"), [(None, "deleted_or_empty"), ("", "deleted_or_empty"), (" [removed] ", "deleted_or_empty"), ("i am a bot and this", "bot"), ("use code XYZ now", "promo"), ("two words", "too_short(2)"), ("no no no no no no no no", "repetitive"), ("a b " + "xy" * 31, "hash_or_base64"), ("ich und nicht das ist gut", "lang(de)"), ("this is plain enough text", "ok"), ("bhai kya hai", "ok")])
def test_first_failure_names_the_reason(spark, text, reason):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert C.clean(df).first().reason == reason


def test_language(spark):
    df = spark.createDataFrame([("bhai kya hai",), ("Привет как дела сегодня",), ("les des une maison",), ("one two",)], "text string")
    assert [r[0] for r in df.select(T.language(T.words(F.col("text")), F.col("text"))).collect()] == ["hinglish", "non_latin", "fr", "en"]


def test_ngrams_and_buckets(spark):
    assert values(spark, ["a b c", "a"], lambda c: T.ngrams(T.words(c), 2)) == [["a b", "b c"], []]
    df = spark.createDataFrame([(0.4,), (0.5,), (10.0,)], "v double")
    assert [r[0] for r in df.select(T.bucket(F.col("v"), (0.5, 2.0, 5.0, 10.0))).collect()] == [0, 1, 4]


def test_html_unescape(spark):
    assert values(spark, ["&amp;lt;", "&eacute;", None], T.html_unescape) == ["<", "é", None]


def test_dedup_budget_and_windows(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "doc_id int, text string")
    assert sorted(r.doc_id for r in corpus.exact_dedup(df).collect()) == [1, 3]
    b = spark.createDataFrame([("x", i, 4) for i in range(5)], "p string, i int, c int")
    assert corpus.budget(b, "p", F.col("c"), "i", F.lit(9)).count() == 3
    t = spark.createDataFrame([("x", 0, list(range(5))), ("x", 1, list(range(5, 10)))], "p string, d int, ids array<int>")
    w = sorted(corpus.windows(t, "d", "ids", 4, ["p"]).collect(), key=lambda r: r.win)
    assert [(list(r.input_ids), list(r.labels)) for r in w] == [([0, 1, 2, 3], [1, 2, 3, 4]), ([4, 5, 6, 7], [5, 6, 7, 8])]


def test_readers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"text": "a", "community": "r/Rust/"}\nnot json\n{"text": " ", "body": "b"}\n')
    df = readers.text_column(readers.read(spark, str(p), schema="text string, body string, community string"))
    assert sorted(r.text_found for r in df.collect() if r.text_found) == ["a", "b"]
    assert df.where("community IS NOT NULL").select(readers.community("community")).first()[0] == "ust"
    readers.write_corpus(df.withColumn("split", F.lit("train")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()
