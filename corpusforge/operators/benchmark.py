"""Benchmark items: which entries may become one, what they are known by, and how answers to them are scored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators import lexicon as L

# fixed values: words that keep an entry out of a published benchmark
OFFENSIVE = (
    r"(?i)\b(pedophile|paedophile|rape|rapist|molest|nigg|fag|tranny|retard|"
    r"kike|spic|chink|coon|whore|slut|incest|bestiality|clitoris|penis|vagina|"
    r"genitals|masturbat|porn|nazi|hitler|holocaust|kill (yourself|himself))\b"
)
LEAST_MEDIAN = 150.0

# fixed values: sources (last part of their path) that make the strata of a calibration sheet
STRATA = {
    "formal": ("fineweb-edu", "smollm-corpus", "cosmopedia"),
    "prose": ("REDDIT_comments",),
    "social": ("reddit_dataset_157", "reddit_dataset_232", "reddit_dataset_94", "youtube-comment-sentiment"),
    "chat": ("twitch_chat", "discord-messages"),
}


def safe(term: Column, definition: Column, example: Column) -> Column:
    """Whether none of the three (null: empty) holds an offensive word."""
    return reduce(lambda a, b: a & b, [~F.coalesce(c, F.lit("")).rlike(OFFENSIVE) for c in (term, definition, example)])


def attested(lexicon: DataFrame) -> DataFrame:
    """One row (attested): whether any entry has a rate in the recent corpus."""
    return lexicon.agg(F.coalesce(F.max(F.coalesce("corpus_rate", F.lit(0.0)) > 0), F.lit(False)).alias("attested"))


def quality(entries: DataFrame, english: DataFrame, number: Column | None = None) -> DataFrame:
    """Entries fit for human raters. Offensive ones, numbers and, unless curated, common English words (word) go. Of current ones those
    stay that the recent corpus attests; before any is attested, curated ones that aren't initialisms. Others need curation or a median
    score of LEAST_MEDIAN. ``entries`` has term, definition, example, source, status, corpus_rate and median_score. ``number``: which
    entries are numbers, by default terms that have digits only."""
    common = english.select(F.lower("word").alias("_word")).distinct().withColumn("_common", F.lit(True))
    met = entries.withColumn("_word", F.lower("term")).join(common, "_word", "left").join(F.broadcast(attested(entries).withColumnRenamed("attested", "_attested")))
    curated = F.col("source").eqNullSafe("curated")
    current = F.when(F.col("_attested"), F.coalesce("corpus_rate", F.lit(0.0)) > 0).otherwise(curated & ~L.initialism(F.col("term"), F.col("definition")))
    good = F.when(F.col("status").eqNullSafe("current"), current).otherwise(curated | (F.coalesce("median_score", F.lit(0.0)) >= LEAST_MEDIAN))
    number = F.col("term").rlike(r"^\d+$") if number is None else number
    out = met.where(safe(F.col("term"), F.col("definition"), F.col("example")) & (F.col("_common").isNull() | curated) & ~number & good)
    return out.select(*entries.columns)


def stratum(source: Column) -> Column:
    """Stratum of a source by the last part of its path; null for others."""
    tail = F.substring_index(source, "/", -1)
    out = F.lit(None).cast("string")
    for name, members in STRATA.items():
        out = F.when(tail.isin(*members), name).otherwise(out)
    return out


def sheet(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Documents of 40 to 600 characters from a source with a stratum, with the column stratum."""
    return docs.withColumn("stratum", stratum(F.col(source_col))).where(F.length(text_col).between(40, 600) & F.col("stratum").isNotNull())


def _quoted(c: Column) -> Column:
    """A string (null: null) as JSON, all but quotes, backslashes and control characters as they are."""
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for i in range(32):
        out = F.replace(out, F.lit(chr(i)), F.lit(short.get(i, f"\\u{i:04x}")))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def content_hash(task: Column, prompt: Column, context: Column) -> Column:
    """First 16 digits of the SHA-256 of the three as a JSON object with sorted keys."""
    blob = F.concat(F.lit('{"context": '), _quoted(context), F.lit(', "prompt": '), _quoted(prompt), F.lit(', "task": '), _quoted(task), F.lit("}"))
    return F.left(F.sha2(blob, 256), F.lit(16))


def searchable(context: Column, prompt: Column) -> Column:
    """Text that training data may not hold: context and prompt, as far as they aren't empty."""
    return F.concat_ws(" ", F.nullif(context, F.lit("")), F.nullif(prompt, F.lit("")))


def task_manifest(items: DataFrame) -> DataFrame:
    """(task, n, hashes in order) of items (task, prompt, context). A benchmark is small by its nature; its texts aren't gathered."""
    h = items.select("task", content_hash(F.col("task"), F.col("prompt"), F.col("context")).alias("h"))
    return h.groupBy("task").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("h")).alias("hashes"))


def blocked(manifest: DataFrame) -> DataFrame:
    """Distinct (hash) that a loader refuses to serve."""
    return manifest.select(F.explode("hashes").alias("hash")).distinct()


def write_tasks(items: DataFrame, path: str) -> None:
    """Items as JSON lines, a folder a task."""
    items.write.mode("overwrite").partitionBy("task").json(path)


def likeliest(scores: Column, options: Column) -> Column:
    """Place (from 0) of the first option with the highest log-likelihood a word; null without options."""
    words = F.transform(options, lambda o: F.greatest(F.size(F.regexp_extract_all(o, F.lit(r"(\S+)"))), F.lit(1)))
    each = F.zip_with(scores, words, lambda s, n: s / n)
    return F.when(F.size(options) > 0, F.array_position(each, F.array_max(each)).cast("int") - 1)


def accuracy(items: DataFrame, chosen: str, answer: str, status: str) -> DataFrame:
    """(status, n, accuracy) of each status there is and, with status 'all', of all items, those without one included."""
    ok = F.col(chosen).eqNullSafe(F.col(answer)).cast("double")
    each = items.select(F.explode(F.array_distinct(F.array(F.lit("all"), F.col(status)))).alias("status"), ok.alias("_ok")).where("status IS NOT NULL AND status <> ''")
    return each.groupBy("status").agg(F.count("*").alias("n"), F.avg("_ok").alias("accuracy"))
