"""Analytics: mixture and budgets, packing, curriculum, evaluation metrics, lexicon statistics, quota and run logs.

SQL that both engines read is stated once; tables stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.functions import resources as R
from corpusforge.operators import corpus as C
from corpusforge.operators import evaluation as E
from corpusforge.operators import lexicon as L
from corpusforge.plans.registry import query, sql, table

B = "BIGINT"


def both(name: str, text: str, **swap: tuple[str, str]) -> None:
    """One SQL text with $name parts that differ: (Spark, DuckDB)."""
    spark_sql, duck = text, text
    for k, (s, d) in swap.items():
        spark_sql, duck = spark_sql.replace(f"${k}", s), duck.replace(f"${k}", d)
    sql(name, spark_sql, duck)


# --- splits, budgets and mixtures --------------------------------------------------------------------------------------

both(
    "byte_mixture_sample",
    """
    SELECT doc_id, lang FROM (
        SELECT doc_id, lang, coalesce(sum(b) OVER (PARTITION BY lang ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT doc_id, lang, $bytes AS b, md5(concat('7|', CAST(doc_id AS $str))) AS h FROM {documents})
    ) WHERE before < 1000000 * CASE lang WHEN 'en' THEN 0.4 WHEN 'fr' THEN 0.2 WHEN 'de' THEN 0.2 ELSE 0.1 END
    """,
    bytes=("octet_length(text)", "strlen(text)"),
    str=("STRING", "VARCHAR"),
)
both("pool_reassign", "SELECT pool, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN lang <> 'en' THEN lang WHEN n_chars % 5 >= 2 THEN 'genz' ELSE 'internet' END AS pool FROM {documents}) GROUP BY pool")
both("tokens_by_pool", "SELECT lang, CAST(sum(tok) AS BIGINT) AS tokens, round(1e2 * sum(tok) / sum(sum(tok)) OVER (), 6) AS share FROM (SELECT lang, CAST(floor(n_chars * 1.35) AS BIGINT) AS tok FROM {documents}) GROUP BY lang")
both("modulo_fanout", "SELECT CAST(doc_id % 7 AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS n FROM {documents} GROUP BY doc_id % 7")
both("shard_boundaries", "SELECT doc_id, CAST(floor((sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) - 1) / 50000) AS BIGINT) AS shard FROM {documents}")
both("round_robin_pick", "SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('r', CAST(doc_id AS $str)))) AS r FROM {documents}) ORDER BY r, source LIMIT 55", str=("STRING", "VARCHAR"))
both(
    "manifest_order",
    "SELECT source, CAST(row_number() OVER (ORDER BY st, source) AS BIGINT) AS pos FROM (SELECT DISTINCT source, CASE WHEN source < 'src13' THEN 1 WHEN source < 'src2' THEN 2 ELSE 9 END AS st FROM {documents})",
)
both(
    "balanced_class_sample",
    """
    SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat('11|', CAST(doc_id AS $str)))) AS r FROM {labels}) WHERE r <= 30
    """,
    str=("STRING", "VARCHAR"),
)
both("stratified_sample", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS $str))) AS r FROM {documents} WHERE n_chars BETWEEN 40 AND 600) WHERE r <= 12", str=("STRING", "VARCHAR"))


@query(
    """
    SELECT event_id, CAST(island AS BIGINT) AS island, CAST(row_number() OVER (PARTITION BY island ORDER BY md5(concat('3|', CAST(event_id AS VARCHAR)))) AS BIGINT) AS pos FROM (
        SELECT event_id, sum(CASE WHEN event_type = prev THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS island
        FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS prev FROM events))
    """
)
def stage_run_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.runs(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", "island")
    order = F.md5(F.concat(F.lit("3|"), F.col("event_id").cast("string")))
    return e.select("event_id", "island", F.row_number().over(Window.partitionBy("island").orderBy(order)).cast("bigint").alias("pos"))


# --- schedules -----------------------------------------------------------------------------------------------------------

both(
    "lr_schedule_wsd",
    """
    SELECT CAST(s AS BIGINT) AS step, CASE WHEN s < 20 THEN 'warmup' WHEN s < 150 THEN 'stable' ELSE 'decay' END AS phase,
           round(CASE WHEN s < 20 THEN 0.001 * (s + 1) / 20 WHEN s < 150 THEN 0.001 ELSE 0.0001 + 0.0009 * (1 - sqrt(least((s - 150) / 50.0, 1.0))) END, 9) AS one_minus_sqrt,
           round(CASE WHEN s < 20 THEN 0.001 * (s + 1) / 20 WHEN s < 150 THEN 0.001 ELSE 0.0001 + 0.0009 * (1 - least((s - 150) / 50.0, 1.0)) END, 9) AS linear,
           round(CASE WHEN s < 20 THEN 0.001 * (s + 1) / 20 WHEN s < 150 THEN 0.001 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * least((s - 150) / 50.0, 1.0))) END, 9) AS cosine
    FROM (SELECT CAST(s AS DOUBLE) AS s FROM $steps)
    """,
    steps=("(SELECT explode(sequence(0, 219)) AS s)", "(SELECT unnest(range(220)) AS s)"),
)
both("curriculum_boundaries", "SELECT stage, CAST(floor(f * 25757) AS BIGINT) AS until_step FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS stage, CAST({f} AS DOUBLE) AS f" for s, f, _ in R.CURRICULUM) + ") t")
both("stage_of_step", "SELECT event_id, CASE WHEN event_id < floor(0.667 * n) THEN 'S1' WHEN event_id < floor(0.967 * n) THEN 'S2' ELSE 'S3' END AS stage FROM {events} CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM {events}) t")

# --- lexicon (event type and user stand for a term, value for a score) -------------------------------------------------

_TERM = "concat(event_type, '_', CAST(user_id AS $str))"
both(
    "lexicon_aggregate",
    f"""
    SELECT term, CAST(max(c) AS BIGINT) AS n_defs, min(d) AS first_seen, max(d) AS last_seen, max(CASE WHEN r = floor(c / 2) + 1 THEN value END) AS upper_median, max(CASE WHEN best = 1 THEN event_id END) AS best_definition
    FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY term) AS c, row_number() OVER (PARTITION BY term ORDER BY value DESC, event_id) AS best
          FROM (SELECT {_TERM} AS term, value, event_id, CAST(ts AS DATE) AS d FROM {{events}}))
    GROUP BY term
    """,
    str=("STRING", "VARCHAR"),
)
_AGE = "greatest($days, 0) / 365.25"
both(
    "recency_status",
    f"""
    SELECT event_id, round(pow(2, -y / 3), 4) AS recency, CASE WHEN y <= 4 THEN 'current' WHEN y <= 8 THEN 'aging' ELSE 'dead' END AS status,
           round((CASE WHEN y <= 4 THEN 1.0 WHEN y <= 8 THEN 0.5 ELSE 0.0 END) * (0.5 + 0.5 * round(pow(2, -y / 3), 4)), 6) AS weight
    FROM (SELECT event_id, {_AGE} AS y FROM (SELECT event_id, CAST(ts AS DATE) AS d, user_id FROM {{events}}))
    """,
    days=("(datediff(DATE'2024-06-01', d) + user_id * 40)", "(date_diff('day', d, DATE '2024-06-01') + user_id * 40)"),
)

@query(
    """
    WITH l AS (SELECT concat(event_type, '_', CAST(user_id AS VARCHAR)) AS term, max(value) AS recency, CAST(count(*) AS DOUBLE) AS median FROM events GROUP BY 1),
    c(term, definition, drifted) AS (VALUES ('click_1', 'one', false), ('view_3', 'three', true), ('brand new', 'new', false), ('odd sense', 'odd', true))
    SELECT coalesce(l.term, c.term) AS term, CASE WHEN c.term IS NOT NULL THEN 'current' ELSE 'aging' END AS status,
           CASE WHEN c.term IS NULL THEN recency / 100 WHEN l.term IS NULL THEN CASE WHEN drifted THEN 0.95 ELSE 0.85 END ELSE greatest(recency / 100, CASE WHEN drifted THEN 0.9 ELSE 0.8 END) END AS recency_weight,
           CASE WHEN l.term IS NOT NULL THEN median WHEN drifted THEN 60 ELSE 50 END AS median_score,
           CASE WHEN l.term IS NULL THEN definition ELSE 'd' END AS definition, CASE WHEN l.term IS NULL THEN 'curated' ELSE 'dated' END AS source
    FROM l FULL OUTER JOIN c ON l.term = c.term
    """
)
def lexicon_merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("term")).agg((F.max("value") / 100).alias("recency_weight"), F.count("*").cast("double").alias("median_score"))
    lexicon = e.select("*", F.lit("aging").alias("status"), F.lit("d").alias("definition"), F.lit("e").alias("example"))
    curated = [("click_1", "one", "", False), ("view_3", "three", "", True), ("brand new", "new", "", False), ("odd sense", "odd", "", True)]
    return L.merge_curated(lexicon, spark.createDataFrame(curated, "term string, definition string, example string, drifted boolean")).drop("example")


both("rate_per_million", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1e6 / sum(count(*)) OVER (), 3) AS rate FROM {events} GROUP BY event_type")
both("lexicon_stats_rollup", "SELECT coalesce(status, 'all') AS status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN value < 20 THEN 'dead' WHEN value < 60 THEN 'aging' ELSE 'current' END AS status FROM {events}) GROUP BY ROLLUP (status)")
both("year_histogram", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY year(o_orderdate)")
TERMS = (("g2g", "Got to go"), ("rizz", "Charm or attraction"), ("brb", "Be right back"), ("glow up", "Great looks opened"), ("aamof", "As a matter of fact"), ("w", "Win"), ("l8r", "Later"), ("tl;dr", "Too long; didn't read"))
_INITIALS = "substring(array_to_string(list_transform(w, lambda x: x[1]), ''), 1, length(t) + 1)"


@query(f"""
    WITH v(term, definition) AS (VALUES {", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in TERMS)}),
    x AS (SELECT *, regexp_replace(lower(term), '[^a-z0-9]', '', 'g') AS t, regexp_extract_all(lower(definition), '[a-z0-9]+') AS w FROM v)
    SELECT term, t <> '' AND length(t) <= 6 AND NOT contains(trim(term), ' ') AND len(w) >= 2
        AND (starts_with({_INITIALS}, t[:4]) OR starts_with({_INITIALS}, translate(t, '248', 'tfa')[:4])) AS initialism FROM x
    """)
def initialism_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame(TERMS, "term string, definition string")
    return v.select("term", L.initialism(F.col("term"), F.col("definition")).alias("initialism"))


@query("""
    WITH d AS (SELECT event_type || '_' || CAST(user_id AS VARCHAR) AS term, CAST(floor(value) AS BIGINT) AS score, ts FROM events WHERE floor(value) >= 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY term) AS n FROM d),
    g AS (SELECT term, CAST(min(ts) AS DATE) AS first_seen, CAST(max(ts) AS DATE) AS last_seen, CAST(max(n) AS BIGINT) AS n_defs, CAST(max(CASE WHEN i = n // 2 THEN score END) AS DOUBLE) AS median_score FROM r GROUP BY term)
    SELECT *, round(pow(2, -(date_diff('day', first_seen, DATE '2029-01-01') / 365.25) / 3), 4) AS recency_weight, 'aging' AS status FROM g
    """)
def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("word"), F.lit("d").alias("definition"), F.lit("e").alias("example"), F.col("ts").alias("time"), F.floor("value").alias("score"))
    return L.build(e, F.lit("2029-01-01").cast("date")).drop("definition", "example")


@query(
    """
    SELECT target, other, CAST(r AS BIGINT) AS place FROM (
        SELECT a.p_partkey AS target, b.p_partkey AS other, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(length(a.p_name) - length(b.p_name)), abs(a.p_size - b.p_size), b.p_partkey) AS r
        FROM part a JOIN part b ON a.p_partkey <> b.p_partkey
    ) WHERE r <= 3
    """
)
def distractor_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.length("p_name").alias("x"), F.col("p_size").alias("y"))
    return E.nearest(p, 3).select(F.col("id").alias("target"), "other", "place")


# --- evaluation ------------------------------------------------------------------------------------------------------------

_PAIRS = "(SELECT u.conv_id, u.turn, length(u.text) AS a, length(v.text) AS b FROM {conversations} u JOIN {conversations} v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user')"
both("context_adaptation_pearson", f"SELECT CAST(count(*) AS BIGINT) AS n, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 6) AS r FROM {_PAIRS} t")
both(
    "spearman_quality_length",
    """
    SELECT round(corr(ra, rb), 6) AS rho, round(avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END), 6) AS exact, round(avg(CASE WHEN abs(quality - toxic) <= 1 THEN 1e0 ELSE 0e0 END), 6) AS within_one, round(avg(CAST(quality - toxic AS DOUBLE)), 6) AS bias FROM (
        SELECT quality, toxic, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS ra, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rb
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id)
    """,
)
both(
    "wasserstein_1d",
    """
    WITH a AS (SELECT n_chars AS x, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i FROM {documents} WHERE lang = 'fr'),
    b AS (SELECT n_chars AS x, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i FROM {documents} WHERE lang = 'de'),
    k AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
    q AS (SELECT CAST(i AS BIGINT) AS i, na, nb, greatest(na, nb) AS n FROM $grid)
    SELECT round(avg(abs(a.x - b.x)), 6) AS w1 FROM q JOIN a ON a.i = least(floor(q.i * na / n), na - 1) JOIN b ON b.i = least(floor(q.i * nb / n), nb - 1)
    """,
    grid=("(SELECT explode(sequence(0, greatest(na, nb) - 1)) AS i, na, nb FROM k)", "(SELECT unnest(range(greatest(na, nb))) AS i, na, nb FROM k)"),
)
both("type_token_ratio", "SELECT lang, round(count(DISTINCT w) / count(*), 6) AS ttr FROM (SELECT lang, $words AS w FROM {documents}) GROUP BY lang", words=("explode(split(text, ' '))", "unnest(string_split(text, ' '))"))
both(
    "formal_leakage",
    "SELECT round(avg(d), 6) AS mean_density, round(avg(CASE WHEN d = 0 THEN 1e0 ELSE 0e0 END), 6) AS frac_zero FROM (SELECT $d AS d FROM {documents})",
    d=(  # of an empty text it is 0 / 0, which DuckDB has as NaN and Spark as an error
        "CASE WHEN length(text) = 0 THEN double('NaN') ELSE 1e2 * (length(text) - length(replace(text, '!', ''))) / length(text) END",
        "1e2 * (length(text) - length(replace(text, '!', ''))) / length(text)",
    ),
)
both("content_hash", "SELECT item_id, $h AS h FROM {benchmark}", h=("left(sha2(concat('{{\"id\": ', CAST(item_id AS STRING), ', \"prompt\": ', text, '}}'), 256), 16)", "left(sha256(concat('{{\"id\": ', CAST(item_id AS VARCHAR), ', \"prompt\": ', text, '}}')), 16)"))
both("props_json_extract", "SELECT event_id, CAST($k AS BIGINT) AS k FROM {events}", k=("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"))

# --- quota, dispatches and runs (events as dispatches) ----------------------------------------------------------------------

_WEEK = "date_trunc('week', ts)"
both(
    "quota_since_reading",
    """
    WITH r AS (SELECT user_id, max(ts) AS at FROM {events} WHERE event_type = 'signup' GROUP BY user_id)
    SELECT e.user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS used FROM {events} e LEFT JOIN r ON e.user_id = r.user_id WHERE r.at IS NULL OR e.ts >= r.at GROUP BY e.user_id
    """,
)
both("latest_open_dispatch", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events} WHERE event_type <> 'error') WHERE r = 1")
both("metrics_downsample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM {events}) WHERE r % (CAST(floor(n / 100) AS BIGINT) + 1) = 0")
both("session_efficiency", "SELECT user_id, round(avg(CASE WHEN value > 0 THEN least(value / 50, 1) END), 6) AS efficiency FROM {events} GROUP BY user_id")
both(
    "loss_divergence_windows",
    """
    SELECT event_type, CAST(sum(CASE WHEN n = 100 AND newer > 1.5 * older THEN 1 ELSE 0 END) AS BIGINT) AS diverged, round(max(CASE WHEN n = 100 THEN newer END), 6) AS worst FROM (
        SELECT event_type, $med(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)), $at) AS newer,
               $med(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND 50 PRECEDING)), $at) AS older,
               count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS n
        FROM {events}) GROUP BY event_type
    """,
    med=("get(sort_array(collect_list", "list_extract(list_sort(list"),
    at=("25", "26"),
)
both("progress_eta", "SELECT round(sum(value), 4) AS tokens, round(1e2 * sum(value) / 1000000, 6) AS pct, round((1000000 - sum(value)) / (sum(value) / 30), 6) AS days_left, CASE WHEN sum(value) / 1000 < 10 THEN 'starved' WHEN sum(value) / 1000 < 20 THEN 'low' ELSE 'fine' END AS verdict FROM {events}")
both("perplexity", "SELECT event_type, round(exp(least(avg(value) / 10, 20)), 6) AS ppl FROM {events} GROUP BY event_type")
both("platform_rank", "SELECT event_type, CAST(row_number() OVER (ORDER BY sum(value) DESC, event_type) AS BIGINT) AS place FROM {events} WHERE event_type <> 'error' GROUP BY event_type")
both("redact_secret_tail", "SELECT event_id, concat(left(md5(props), 6), '…', right(md5(props), 4)) AS shown FROM {events}")


@query()
def grad_spike_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes of each user's values: above 10 times the (upper) median of the last 100 accepted ones, of which there are 20 at least, and
    above 10 times the clip. A spike isn't accepted, so the state is sequential in each key."""
    return E.spikes(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", clip=1.0)


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("id"), F.col("n_chars").cast("double").alias("x"))
    return E.bootstrap_mean(d).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
