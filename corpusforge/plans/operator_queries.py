"""Queries that call the library's operators; their SQL is written separately.

Languages stand for pools (en general, fr internet, de genz, others hinglish), event types for platforms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import resources as R
from corpusforge.functions import text as T
from corpusforge.operators import corpus as C
from corpusforge.operators import curriculum as Q
from corpusforge.operators import evaluation as E
from corpusforge.operators import ledger as G
from corpusforge.operators import lexicon as L
from corpusforge.plans.registry import query, table
from corpusforge.sources import readers

TOKEN = r"[\p{L}\p{N}']+"
POOL = "CASE lang WHEN 'en' THEN 'general' WHEN 'fr' THEN 'internet' WHEN 'de' THEN 'genz' ELSE 'hinglish' END"


@query(
    """
    SELECT source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(tok) AS BIGINT) AS tokens FROM (
        SELECT source, tok, coalesce(sum(tok) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT source, doc_id, CAST(floor(n_chars / 5 * 1.35) AS BIGINT) AS tok FROM documents)
    ) WHERE before < 15000 GROUP BY source
    """
)
def token_budget_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 5 * 1.35).alias("tok"))
    return C.budget(d, "source", F.col("tok"), "doc_id", F.lit(15000)).groupBy("source").agg(F.count("*").alias("docs"), F.sum("tok").alias("tokens"))


_MIX = ", ".join(f"({i}, '{s}', '{p}', CAST({Q.STAGE_SHARE[s]} AS DOUBLE), CAST({m} AS DOUBLE))" for i, s in enumerate(Q.STAGE_MIX) for p, m in Q.STAGE_MIX[s].items())
_PLAN = f"""
    c AS (SELECT {POOL} AS pool, count(*) AS n FROM documents GROUP BY ALL),
    s(o, stage) AS (VALUES (0, 'S1'), (1, 'S2'), (2, 'S3')),
    m(o, stage, pool, share, mix) AS (VALUES {_MIX}),
    t(pool, last) AS (VALUES ('general', 'S1'), ('internet', 'S2'), ('hinglish', 'S2'), ('lexicon', 'S2'), ('genz', 'S3')),
    w AS (SELECT c.pool, n, s.o, s.stage, CAST(coalesce(floor(floor((SELECT sum(n) FROM c) * share) * mix), 0) AS BIGINT) AS want FROM c CROSS JOIN s LEFT JOIN m ON m.stage = s.stage AND m.pool = c.pool),
    g AS (SELECT *, CAST(least(want, greatest(n - coalesce(sum(want) OVER (PARTITION BY pool ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS BIGINT) AS got FROM w),
    p AS (SELECT stage, g.pool, want, got, CAST(got + CASE WHEN stage = last THEN n - sum(got) OVER (PARTITION BY g.pool) ELSE 0 END AS BIGINT) AS quota FROM g JOIN t USING (pool))
"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quota_plan(table(spark, sf_dir, "documents").groupBy(F.expr(POOL).alias("pool")).agg(F.count("*").alias("n")))


@query(f"WITH {_PLAN} SELECT * FROM p")
def curriculum_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(
    f"""
    WITH {_PLAN},
    e AS (SELECT pool, stage, sum(quota) OVER (PARTITION BY pool ORDER BY stage) AS upto, quota FROM p),
    d AS (SELECT doc_id, {POOL} AS pool, row_number() OVER (PARTITION BY {POOL} ORDER BY doc_id) - 1 AS place FROM documents)
    SELECT doc_id, d.pool, stage FROM d JOIN e ON d.pool = e.pool AND place >= upto - quota AND place < upto
    """
)
def stage_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.assign_stages(table(spark, sf_dir, "documents").select("doc_id", F.expr(POOL).alias("pool")), _plan(spark, sf_dir), "pool", "doc_id")


# a document's tokens: the lengths of its words, at most 60, and 0 as its end
_D_TOKENS = r"list_append(list_transform(regexp_extract_all(text, '[\p{L}\p{N}'']+'), lambda x: least(length(x), 60)), 0)"
_D_PACKED = f"""
    d AS (SELECT doc_id, lang, {_D_TOKENS} AS t FROM documents),
    f AS (SELECT lang, doc_id, unnest(t) AS tok, unnest(range(len(t))) AS i, coalesce(s0, 0) AS s1 FROM (SELECT *, sum(len(t)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s0 FROM d)),
    n AS (SELECT lang, CAST(floor((s1 + i) / 256) AS BIGINT) AS win, (s1 + i) % 256 AS j, tok, lead(tok) OVER (PARTITION BY lang ORDER BY s1 + i) AS nxt, max(s1 + i) OVER (PARTITION BY lang) AS last FROM f)
"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(T.words(F.col("text"), TOKEN), lambda w: F.least(F.length(w), F.lit(60)))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.array_append(words, F.lit(0)).alias("ids"))
    return C.windows(Q.as_uint16(d, "ids"), "doc_id", "ids", 256, ["lang"])


@query(f"WITH {_D_PACKED} SELECT lang, win, md5(string_agg(tok, ',' ORDER BY j)) AS ids, md5(string_agg(nxt, ',' ORDER BY j)) AS next_ids FROM n WHERE (win + 1) * 256 <= last GROUP BY lang, win")
def packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return _packed(spark, sf_dir).select("lang", F.col("win").cast("bigint").alias("win"), digest("input_ids").alias("ids"), digest("labels").alias("next_ids"))


@query(
    f"""
    WITH {_D_PACKED},
    k AS (SELECT lang, win, j, last, coalesce(sum(CASE WHEN tok = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY lang, win ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS id FROM n)
    SELECT lang, win, md5(string_agg(CAST(id AS INTEGER), ',' ORDER BY j)) AS doc_ids, CAST(max(id) + 1 AS BIGINT) AS docs FROM k WHERE (win + 1) * 256 <= last GROUP BY lang, win
    """
)
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Q.document_ids(_packed(spark, sf_dir), 0, ["lang"])
    return d.select("lang", F.col("win").cast("bigint").alias("win"), F.md5(F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",")).alias("doc_ids"), (F.array_max("doc_ids") + 1).cast("bigint").alias("docs"))


_D_EMOJI = f"regexp_extract_all(text, '{R.EMOJI}')"


@query(f"SELECT emoji, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({_D_EMOJI}) AS emoji FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) GROUP BY emoji ORDER BY n DESC, emoji LIMIT 1000")
def emoji_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    e = texts.select(F.explode(F.regexp_extract_all("text", F.lit(R.EMOJI_JAVA), F.lit(0))).alias("emoji"))
    return e.groupBy("emoji").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "emoji").limit(1000)


_D_METRICS = rf"SELECT {POOL} AS pool, sum(strlen(text)) / nullif(sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}'']+'))), 0) AS bytes_per_token, sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}'']+'))) / nullif(sum(len(regexp_extract_all(text, '[^ \t\n]+'))), 0) AS fertility FROM documents GROUP BY ALL"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.expr(POOL).alias("pool"), "text")
    return E.token_metrics(d, "pool", F.octet_length("text"), F.size(T.words(F.col("text"), TOKEN)), F.size(T.words(F.col("text"), "[^ \\t\\n]+")))


@query(f"SELECT pool, round(bytes_per_token, 6) AS bytes_per_token, round(fertility, 6) AS fertility FROM ({_D_METRICS})")
def token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("pool", F.round("bytes_per_token", 6).alias("bytes_per_token"), F.round("fertility", 6).alias("fertility"))


@query(
    f"""
    WITH m AS ({_D_METRICS}),
    v AS (SELECT 'bytes_per_token_' || pool AS metric, bytes_per_token AS value FROM m UNION ALL SELECT 'fertility_chat', fertility FROM m WHERE pool = 'hinglish' UNION ALL SELECT 'roundtrip', 0.5),
    t(metric, target) AS (VALUES ('bytes_per_token_general', 4.0), ('bytes_per_token_genz', 3.2), ('bytes_per_token_hinglish', 2.8), ('fertility_chat', 1.6), ('roundtrip', 1.0), ('forced_single_token_rate', 0.95))
    SELECT metric, round(value, 6) AS value, CAST(target AS DOUBLE) AS target, CASE WHEN CASE WHEN metric LIKE 'fertility%' THEN value <= target ELSE value >= target END THEN 'ok' WHEN metric = 'roundtrip' THEN 'failure' ELSE 'warning' END AS verdict FROM v JOIN t USING (metric)
    """
)
def tokenizer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    v = m.select(F.concat(F.lit("bytes_per_token_"), "pool").alias("metric"), F.col("bytes_per_token").alias("value"))
    v = v.unionByName(m.where("pool = 'hinglish'").select(F.lit("fertility_chat").alias("metric"), F.col("fertility").alias("value")))
    v = v.unionByName(spark.createDataFrame([("roundtrip", 0.5)], "metric string, value double"))
    return E.gate(v, 1000).select("metric", F.round("value", 6).alias("value"), "target", "verdict")


@query(r"WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}'']+'))) AS w FROM benchmark) SELECT w || repeat(right(w, 1), CAST(n - 1 AS INTEGER)) AS form, CAST(count(*) AS BIGINT) AS n FROM w CROSS JOIN (VALUES (3), (4), (6)) t(n) GROUP BY form")
def elongated_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.lower("text"), TOKEN)).alias("w")).distinct()
    return w.select(F.explode(E.elongated(F.col("w"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query("SELECT lang, CAST(greatest(400, CAST(floor(sum(n_chars) * 0.25 / (count(*) * avg(n_chars) / 100)) AS INTEGER)) AS INTEGER) AS repeats FROM documents GROUP BY lang")
def forcing_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("b"), F.count("*").alias("n"), (F.avg("n_chars") / 100).alias("m"))
    return s.select("lang", E.forcing_repeats(F.col("b"), F.col("n"), F.col("m")).alias("repeats"))


# fixed times of the queries: now, and budgets of three made-up platforms
_BUDGETS = (("click", "weekly", 30000.0, 50.0, 0.1), ("view", "monthly", 90000.0, 60.0, 0.0), ("purchase", "daily", 20.0, 5.0, 0.1))
_NOW = "2024-01-24 15:30:00"


@query(
    f"""
    WITH b(platform, period, hours, cap, reserve) AS (VALUES {", ".join(f"('{p}', '{q}', CAST({h} AS DOUBLE), CAST({c} AS DOUBLE), CAST({r} AS DOUBLE))" for p, q, h, c, r in _BUDGETS)}),
    t AS (SELECT *, TIMESTAMP '{_NOW}' AS now FROM b),
    s AS (SELECT *, CASE period WHEN 'weekly' THEN CAST(now AS DATE) - CAST((dayofweek(now) + 1) % 7 AS INTEGER) WHEN 'daily' THEN CAST(now AS DATE) ELSE CAST(date_trunc('month', now) AS DATE) END AS f FROM t),
    e AS (SELECT *, CASE period WHEN 'weekly' THEN f + 7 WHEN 'daily' THEN f + 1 ELSE CAST(f + INTERVAL 1 MONTH AS DATE) END AS u FROM s),
    x AS (SELECT platform, hours, reserve, u, now, count(ts) FILTER (ts BETWEEN f AND now) AS sessions, coalesce(sum(least(value, cap)) FILTER (ts BETWEEN f AND now), 0) AS used FROM e LEFT JOIN events ON event_type = platform GROUP BY ALL)
    SELECT platform, CAST(sessions AS BIGINT) AS sessions, round(used, 4) AS used, round(greatest(hours * (1 - reserve) - used, 0), 4) AS remaining, round(100 * used / hours, 4) AS pct, round(date_diff('second', now, CAST(u AS TIMESTAMP)) / 3600, 4) AS hours_to_reset FROM x
    """
)
def quota_used_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = spark.createDataFrame(list(_BUDGETS), "platform string, period string, hours double, session_hours double, reserve double")
    d = table(spark, sf_dir, "events").select(F.col("event_type").alias("platform"), F.col("ts").alias("at"), F.col("value").alias("hours"))
    u = G.usage(d, budgets, F.expr(f"TIMESTAMP_NTZ'{_NOW}'"))
    return u.select("platform", "sessions", *[F.round(c, 4).alias(c) for c in ("used", "remaining", "pct", "hours_to_reset")])


@query("SELECT event_id, CAST(ts AS DATE) - CAST((dayofweek(ts) + 1) % 7 AS INTEGER) AS week, CAST(CAST(date_trunc('month', ts) AS DATE) + INTERVAL 1 MONTH AS DATE) AS month_reset, CASE WHEN value / 2 - 1 <= 0 THEN 'idle' WHEN value / 2 - 1 < 10 THEN 'bad' WHEN value / 2 - 1 < 20 THEN 'warn' WHEN value / 2 - 1 < 70 THEN 'ok' ELSE 'good' END AS verdict FROM events")
def reset_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", G.period_start(F.lit("weekly"), F.col("ts")).alias("week"), G.next_reset(F.lit("monthly"), F.col("ts")).alias("month_reset"), G.verdict(F.col("value") / 2 - 1).alias("verdict"))


@query(
    r"""
    WITH z AS (SELECT w AS word, count(*) / 100.0 AS zipf FROM (SELECT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}'']+'))) AS w FROM conversations) GROUP BY w),
    t AS (SELECT DISTINCT lower(p_type) AS term FROM part UNION SELECT DISTINCT lower(text[1:12]) FROM benchmark),
    e AS (SELECT term, unnest(regexp_split_to_array(term, '\s+')) AS word FROM t)
    SELECT term, round(coalesce(max(zipf), 0), 6) AS zipf FROM e LEFT JOIN z USING (word) GROUP BY term
    """
)
def term_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "conversations").select(F.explode(T.words(F.lower("text"), TOKEN)).alias("word")).groupBy("word").agg((F.count("*") / 100.0).alias("zipf"))
    t = table(spark, sf_dir, "part").select(F.lower("p_type").alias("term")).union(table(spark, sf_dir, "benchmark").select(F.lower(F.substring("text", 1, 12)))).distinct()
    return L.term_zipf(t, z).select("term", F.round("zipf", 6).alias("zipf"))


@query("SELECT page_id, CASE WHEN trim(url) <> '' THEN url ELSE '' END AS text_found FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '  ' ELSE 'm' || page_id END AS url FROM pages) WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 'inner ' || url FROM pages WHERE page_id % 3 = 0")
def text_column_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    p = p.select("page_id", F.when(F.col("page_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("m"), F.col("page_id").cast("string"))).alias("Message"), F.struct(F.concat(F.lit("inner "), "url").alias("hi_ng")).alias("translation"))
    return readers.text_column(p).select("page_id", "text_found")
