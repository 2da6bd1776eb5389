"""Queries on tables made for one case each, against their SQL."""

from __future__ import annotations

import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from corpusforge import plans
from corpusforge.functions import resources, text
from corpusforge.operators import benchmark, corpus, curriculum, manifest
from corpusforge.plans import text_queries
from test_queries import normal


@pytest.fixture
def agree(spark, tmp_path):
    def run(name, **tables):
        """The query's rows over the tables, which must be those of its SQL."""
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for t, rows in tables.items():
            pq.write_table(rows if isinstance(rows, pa.Table) else pa.table(rows), tmp_path / f"{t}.parquet")
            con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = plans.QUERIES[name](spark, str(tmp_path))
        want = con.sql(plans.ORACLE[name])
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        rows = normal(df.collect(), [df.columns.index(c) for c in cols])
        assert rows == normal(want.fetchall(), [want.columns.index(c) for c in cols])
        return rows

    return run


@pytest.mark.parametrize("texts", [["", "a!", None, "b"], ["", ""], ["a!", "b"]])
def test_formal_leakage_of_empty_texts(agree, texts):
    agree("formal_leakage", documents={"doc_id": list(range(len(texts))), "text": texts})


def test_resume_cursor_meets_positions_and_shards_by_ranges(spark, agree):
    """Positions at the ends of shards, of epochs and far beyond, many of them alike; no join of all positions with all shards."""
    n = 300
    pages = {"page_id": [i * 3 for i in range(n)], "html": ["x" * (512 * (i % 5) + i % 2) for i in range(n)]}
    chars = [*range(700), *[5] * 200, 10**6, 0, None]
    rows = agree("resume_cursor", pages=pages, documents={"doc_id": list(range(len(chars))), "n_chars": chars})
    assert len(rows) == len(chars) - 1


def test_cursors_have_no_nested_loop_of_positions_and_shards(spark):
    m = spark.range(50).select(F.col("id").alias("i"), F.lit(9).alias("n_tokens"))
    at = spark.range(500).select(F.col("id").alias("windows"))
    plan = manifest.cursors(m, "i", at, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "_from" in plan and not re.search(r"_at#\d+L? >= _from#", plan)
    assert manifest.cursors(m, "i", at, 4).count() == 500


def test_streams_leave_no_table_in_the_driver(spark):
    for name in ("stream_session", "stream_dedup_watermark"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert "parquet" in plan and "MemoryPlan" not in plan and "LocalRelation" not in plan


def test_a_stream_without_events_gives_no_rows(spark, tmp_path):
    pq.write_table(pq.read_table("/root/testdata/sf0.001/events.parquet").slice(0, 0), tmp_path / "events.parquet")
    for name in ("stream_session", "stream_dedup_watermark"):
        assert plans.QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["benchmark_quality", "benchmark_quality_unattested"])
def test_first_words_that_are_numbers(spark, agree, name):
    texts = ["4355709550244650 is a card", "word of its own", "12", "so"]
    ids = [i for i in range(1, 400) if i % 9 and i % 11] + [11, 9, 99]
    rows = agree(name, documents={"doc_id": ids, "text": [texts[i % 4] for i in ids]}, benchmark={"item_id": [1], "text": ["so it is"]})
    assert any(r[1].startswith("4355709550244650") or r[0] == "4355709550244650" for r in (tuple(map(str, x)) for x in rows))


def test_numbers_go_by_default(spark):
    e = spark.createDataFrame([("123", "d", "e", "curated", "dead", 0.0, 0.0), ("abc", "d", "e", "curated", "dead", 0.0, 0.0)], "term string, definition string, example string, source string, status string, corpus_rate double, median_score double")
    english = spark.createDataFrame([("is",)], "word string")
    assert [r.term for r in benchmark.quality(e, english).collect()] == ["abc"]


def test_runs_of_other_letters(spark, agree):
    agree("cap_repeats_runs", documents={"doc_id": [1, 2, 3, 4, 5], "text": ["-" * 9, "hmmmmmmmmmm", "oooooooo\noooooooo", "OOOOOOOOO", None]})
    assert spark.createDataFrame([("hmmmmmmmmmm",)], "t string").select(text.cap_repeats(F.col("t"))).first()[0] == "hmmmmmm"


def test_audit_has_the_words_of_its_sql(spark, agree):
    texts = ["12 Mein stöbe", "12 mein st", "5 lone roads", "5 lone ſtreet x", "5 lone Kroad", "é12345", "12345é", "٣٤٥٦٧", "a@b.coé", "a@bé.co", "x@Kb.com", "İ12345 drıve", "5 lone drıve", "5 lone drİve", "5 lıne drive",
             "1.2.3.4é", "é@handle", "@handleé", "my name is Bobé", "my name is Bob", "my name is\x0bBob", "dm me at\tJohn", "12\x0bxyz st", "x.com/joé", "K.com/abc", "inſtagram.com/abc", "123-45-6789é", "(20)\x0b555-1234", "4111 1111 1111 1111", "AB1 2CDé", "1/2/1999é", "", None, "linkedin.com/in/ab", "linKedin.com/in/abc", "lınkedin.com/in/abc", "+1 (555) 123 4567", "x5551234567"]
    mine = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[hit.alias(k) for k, hit in text.audit_hits(F.col("t")).items()]).collect()
    for row in mine:
        for k, p in text_queries._D_AUDIT.items():
            got = duckdb.execute(f"SELECT regexp_matches(?::VARCHAR, '{p}')", [row.t]).fetchall()[0][0]
            assert got == row[k], (row.t, k)
    agree("pii_audit_by_detector", documents={"doc_id": list(range(len(texts))), "text": texts})


def test_join_range_counts_without_pairs(spark, agree):
    keys, n = list(range(200)), 200
    part = {"p_partkey": [i // 2 for i in keys], "p_size": pa.array([None if i == 7 else i % 60 for i in keys], pa.int32()), "p_retailprice": [None if i == 8 else float("nan") if i == 9 else (-0.0 if i % 5 else 10.25 * i) for i in keys]}
    supplier = {"s_suppkey": list(range(n)), "s_nationkey": pa.array([None if i == 3 else i % 25 for i in range(n)], pa.int32()), "s_acctbal": [None if i == 4 else float("nan") if i in (9, 34) else [0.0, -0.0, 4000.0, 4000.01, 512.5, 4512.5][i % 6] for i in range(n)]}
    assert agree("join_range", part=pa.table(part), supplier=pa.table(supplier))
    plan = plans.QUERIES["join_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"s_acctbal#\d+ [<>]= ", plan)


def test_windows_and_document_numbers_follow_the_stream(spark):
    length, docs = 4, [[0], [], [5, 0], list(range(1, 12)) + [0], [0], [0], [7, 7, 7, 0], [1, 0]]
    t = spark.createDataFrame([("x", i, d) for i, d in enumerate(docs)], "p string, d int, ids array<int>")
    stream = [x for d in docs for x in d]
    want = {w: (stream[w * length : (w + 1) * length], stream[w * length + 1 : (w + 1) * length + 1]) for w in range((len(stream) - 1) // length)}
    win = corpus.windows(t, "d", "ids", length, ["p"])
    assert {r.win: (list(r.input_ids), list(r.labels)) for r in win.collect()} == want
    number = {r.win: list(r.doc_ids) for r in curriculum.document_ids(win, 0, ["p"]).collect()}
    assert number == {w: [ids[:i].count(0) for i in range(length)] for w, (ids, _) in want.items()}
    plan = curriculum.document_ids(win, 0, ["p"])._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_cheap_looks_change_nothing(spark):
    rows = ["", " ", "a", " a", "a\n", "a ", " a b　", "a  b", "a\tb", "a\t\tb", "a\n\n\nb", "&gt; q\n> q\nk", "gt; q\nk", "&amp;lt;b&amp;gt;x", "[a](b)", "x/y", "see www.a", "a.com/b", "u/abc @abc a@b.co", "at ١٢٣٤٥٦٧٨٩ +1 (555) 123-4567", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    t = F.col("t")
    plain = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    scrubbed = t
    for p, m in ((text.EMAIL, "<|email|>"), (text.IPV4, "<|redacted|>"), (text.PHONE, "<|phone|>"), (text.LONG_DIGITS, "<|number|>"), (text.USER_REF, "@user"), (text.MENTION, "@user")):
        scrubbed = F.regexp_replace(scrubbed, p, m)
    marked = text.unescape_common(text.unescape_common(text.fold_punctuation(t)))
    for p, m in ((text.MD_QUOTE, ""), (text.MD_LINK, "$1"), (text.HTML_TAG, " "), (text.URL, "http")):
        marked = F.regexp_replace(marked, p, m)
    tidied = plain(F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))
    for r in df.select(t, plain(t), text.strip(t), scrubbed, text.scrub(t), marked, text.strip_markup(t), tidied, text.tidy(t)).collect():
        assert r[1] == r[2] and r[3] == r[4] and r[5] == r[6] and r[7] == r[8], r
    plan = df.select(text.strip_markup(t))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains" in plan


def test_emoji_of_all_code_points(spark):
    every = "".join(chr(i) for i in range(1, 0x20000) if not 0xD800 <= i <= 0xDFFF)
    df = spark.createDataFrame([(every[i : i + 4096],) for i in range(0, len(every), 4096)], "t string")
    for r in df.select(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (resources.EMOJI, resources.EMOJI_JAVA)]).collect():
        assert r[0] == r[1]


def test_unescaping_sends_few_rows_at_once(spark):
    df = spark.createDataFrame([("a &amp;lt; &eacute;",), ("plain",), ("",), (None,), ("&",)], "t string").select(text.html_unescape(F.col("t")).alias("u"))
    assert [r.u for r in df.collect()] == ["a < é", "plain", "", None, "&"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
