"""Lexicon: dated definitions to terms, admission rules, and refinement against corpus counts.

Word lists and frequencies that the rules consult are parameters: (word) and (word, zipf) DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import resources as R
from corpusforge.functions import text as T

# fixed values: patterns of entries that aren't vocabulary
TRIVIAL = r"^[a-z0-9]$|^\d+$"
WELL_FORMED = r"^[a-z][a-z0-9'-]*$"
PROPER_NOUN = r"^[A-Z][a-z]+$"
NAME_DEFINITION = r"(?i)\b(the (sweetest|nicest|best|most amazing|kindest) (girl|boy|guy|person|man|woman)|is a (girl|boy|guy) who|my (girlfriend|boyfriend|bestie|bff))\b"
COMMON_ZIPF = 3.6
BASE_WEIGHT = {"current": 1.0, "aging": 0.5, "dead": 0.0}


def years(first_seen: Column, now: Column) -> Column:
    return F.greatest(F.datediff(now, first_seen), F.lit(0)) / 365.25


def recency_weight(first_seen: Column, now: Column) -> Column:
    return F.round(F.pow(F.lit(2.0), -years(first_seen, now) / R.HALF_LIFE_YEARS), 4)


def age_status(first_seen: Column, now: Column) -> Column:
    y = years(first_seen, now)
    return F.when(y <= 4, "current").when(y <= 8, "aging").otherwise("dead")


def effective_weight(status: Column, recency: Column) -> Column:
    base = F.lit(0.3)
    for k, v in BASE_WEIGHT.items():
        base = F.when(status == k, v).otherwise(base)
    return base * (0.5 + 0.5 * recency)


def initialism(term: Column, definition: Column) -> Column:
    """Whether the definition only spells the term's letters out."""
    t = F.regexp_replace(F.lower(term), "[^a-z0-9]", "")
    ws = T.words(F.lower(F.coalesce(definition, F.lit(""))), "[a-z0-9]+")
    initials = F.array_join(F.transform(ws, lambda w: F.left(w, F.lit(1))), "")
    initials = F.substring(initials, F.lit(1), F.length(t) + 1)
    plain, digits = F.left(t, F.lit(4)), F.left(F.translate(t, "248", "tfa"), F.lit(4))
    return (t != "") & (F.length(t) <= 6) & ~F.trim(term).contains(" ") & (F.size(ws) >= 2) & (initials.startswith(plain) | initials.startswith(digits))


def admissible(terms: DataFrame, stop: DataFrame, zipf: DataFrame | None = None, term_col: str = "term", definition_col: str = "definition") -> DataFrame:
    """Rows whose term is vocabulary: not trivial or too long, not all stop words, not a name, not a common word, with a definition."""
    key = F.lower(F.trim(F.col(term_col)))
    df = terms.withColumn("_k", key).withColumn("_w", F.split("_k", r"\s+"))
    d = F.trim(F.coalesce(F.col(definition_col), F.lit("")))
    ok = ~F.col("_k").rlike(TRIVIAL) & (F.length(term_col) >= 2) & (F.size("_w") <= 3) & ~F.trim(F.col(term_col)).rlike(PROPER_NOUN) & ~d.rlike(NAME_DEFINITION) & (d != "")
    df = df.where(ok)
    # a term of one to three words is all stop words if each of them is
    rest = df.select("_k", F.explode("_w").alias("word")).distinct().join(stop.select("word").distinct(), "word", "left_anti").select("_k").distinct()
    df = df.join(rest, "_k", "left_semi")
    if zipf is not None:
        common = zipf.where(F.col("zipf") >= COMMON_ZIPF).select(F.col("word").alias("_k")).distinct()
        df = df.join(common, "_k", "left_anti")
    return df.drop("_k", "_w")


def build(definitions: DataFrame, now: Column, min_score: int = 1) -> DataFrame:
    """(term, first_seen, last_seen, n_defs, median_score, recency_weight, status, definition, example) of word, definition, example,
    time and score. The median is the upper one, a partial aggregate; the definition is that of the highest score, least row first."""
    rows = definitions.select(
        F.lower(F.trim("word")).alias("term"),
        F.trim(F.regexp_replace(F.coalesce("definition", F.lit("")), r"https?://\S+", "")).alias("definition"),
        F.trim(F.coalesce("example", F.lit(""))).alias("example"),
        F.coalesce(F.expr("try_cast(score AS bigint)"), F.lit(0)).alias("score"),
        F.expr("try_to_timestamp(CAST(time AS string))").alias("t"),
    ).where((F.col("term") != "") & (F.col("score") >= min_score) & F.col("t").isNotNull())
    best = F.max_by(F.struct("definition", "example"), F.struct("score", F.negative(F.unix_micros("t").cast("bigint")))).alias("b")
    got = rows.groupBy("term").agg(F.min("t").cast("date").alias("first_seen"), F.max("t").cast("date").alias("last_seen"), F.count("*").alias("n_defs"), F.expr("percentile_disc(0.500000000001) WITHIN GROUP (ORDER BY score)").cast("double").alias("median_score"), best)
    return got.select("term", "first_seen", "last_seen", "n_defs", "median_score", recency_weight(F.col("first_seen"), now).alias("recency_weight"), age_status(F.col("first_seen"), now).alias("status"), F.left("b.definition", F.lit(400)).alias("definition"), F.left("b.example", F.lit(300)).alias("example"))


def refine_status(lexicon: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Status by rate per million in a recent corpus (term, n); a corpus without words changes nothing."""
    if total <= 0:
        return lexicon
    rate = F.round(F.coalesce("n", F.lit(0)) * 1e6 / total, 3)
    got = lexicon.drop("corpus_rate").join(counts, "term", "left").withColumn("corpus_rate", rate).drop("n")
    return got.withColumn("status", F.when(F.col("corpus_rate") >= 1.0, "current").when(F.col("corpus_rate") >= 0.05, "aging").otherwise("dead"))


def merge_curated(lexicon: DataFrame, curated: DataFrame) -> DataFrame:
    """Upsert of curated terms (term, definition, example and, if there is one, the flag drifted: a common word with a new sense). Known ones
    become current with a recency of 0.8 (drifted 0.9) at least; new ones start at 0.85 (0.95) and a score of 50 (60)."""
    drifted = F.coalesce(F.col("drifted"), F.lit(False)) if "drifted" in curated.columns else F.lit(False)
    c = curated.dropDuplicates(["term"]).select("term", F.col("definition").alias("_d"), F.col("example").alias("_e"), drifted.alias("_c"))
    both = lexicon.join(c, "term", "full_outer")
    new, cur = F.col("status").isNull(), F.col("_c").isNotNull()
    by = lambda odd, plain: F.when(F.col("_c"), odd).otherwise(plain)
    return both.select(
        "term",
        F.when(cur, "current").otherwise(F.col("status")).alias("status"),
        F.when(new, by(0.95, 0.85)).when(cur, F.greatest("recency_weight", by(0.9, 0.8))).otherwise(F.col("recency_weight")).alias("recency_weight"),
        F.when(new, by(60.0, 50.0)).otherwise(F.col("median_score")).alias("median_score"),
        F.coalesce("definition", "_d").alias("definition"),
        F.coalesce("example", "_e").alias("example"),
        F.when(new, "curated").otherwise("dated").alias("source"),
    )


def usable(term: Column, definition: Column, example: Column) -> Column:
    """Whether a multiple-choice item can be made of an entry."""
    n = F.size(F.filter(F.split(definition, r"\s+"), lambda w: w != ""))
    return (F.coalesce(definition, F.lit("")) != "") & (F.coalesce(example, F.lit("")) != "") & n.between(3, 40) & F.lower(example).contains(F.lower(F.split(term, r"\s+")[0]))


def term_zipf(terms: DataFrame, zipf: DataFrame, term_col: str = "term") -> DataFrame:
    """terms with zipf: the largest of its words' frequencies (word, zipf), 0 where none is known."""
    each = terms.select(term_col).distinct().select(term_col, F.explode(F.split(term_col, r"\s+")).alias("word"))
    top = each.join(zipf, "word", "left").groupBy(term_col).agg(F.coalesce(F.max("zipf"), F.lit(0.0)).alias("zipf"))
    return terms.join(top, term_col, "left")


def foreign(zipf: DataFrame) -> DataFrame:
    """Distinct words of (word, lang, zipf) that are frequent (3 and more) in some other language and not in English (below 2.5)."""
    top = zipf.groupBy("word").agg(F.max(F.when(F.col("lang") == "en", F.col("zipf"))).alias("_en"), F.max(F.when(F.col("lang") != "en", F.col("zipf"))).alias("_other"))
    return top.where((F.coalesce("_en", F.lit(0.0)) < 2.5) & (F.col("_other") >= 3.0)).select("word")


def emerging(recent: DataFrame, baseline: DataFrame, known: DataFrame, english: DataFrame, foreign_words: DataFrame, min_rate: float = 20.0, min_growth: float = 3.0) -> DataFrame:
    """(term, rate, old_rate) of terms that a recent corpus (term, n) brings up: letters only, 3 to 20 of them, not foreign, at min_rate a
    million and more. An English word counts only if the lexicon (term) has a sense of it and it grew against the baseline (term, n);
    any other only if the lexicon lacks it. Totals are one row; the other sides are joined by term."""
    total = recent.agg(F.sum("n").alias("_r")).join(baseline.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_b")))
    flag = lambda df, name: df.select(F.col(df.columns[0]).alias("term")).distinct().withColumn(name, F.lit(True))
    r = recent.where(F.length("term").between(3, 20) & F.col("term").rlike(r"^\p{L}+$")).join(F.broadcast(total))
    r = r.withColumn("rate", F.col("n") * 1e6 / F.col("_r")).where(F.col("rate") >= min_rate)
    r = r.join(flag(foreign_words, "_f"), "term", "left_anti").join(baseline.withColumnRenamed("n", "_old"), "term", "left")
    r = r.join(flag(known, "_k"), "term", "left").join(flag(english, "_e"), "term", "left")
    old = F.when(F.col("_b") > 0, F.coalesce("_old", F.lit(0)) * 1e6 / F.col("_b"))
    grown = old.isNotNull() & F.col("_k").isNotNull() & ((old == 0) | (F.col("rate") / old >= min_growth))
    r = r.where(F.when(F.col("_e").isNotNull(), F.coalesce(grown, F.lit(False))).otherwise(F.col("_k").isNull()))
    return r.select("term", "rate", F.coalesce(old, F.lit(0.0)).alias("old_rate"))


def well_formed(term: Column) -> Column:
    """Whether every word of a term is one: a letter, then letters, digits, apostrophes and hyphens. False for empty terms."""
    ws = F.filter(F.split(F.coalesce(term, F.lit("")), r"\s+"), lambda w: w != "")
    return (F.size(ws) > 0) & F.forall(ws, lambda w: w.rlike(WELL_FORMED))


def loadable(entries: DataFrame, function_words: DataFrame, jargon: DataFrame, zipf: DataFrame, senses: DataFrame) -> DataFrame:
    """Entries whose term still is vocabulary by the rules in force: well formed, not trivial, no jargon (word), not all function words
    (word), and not a common word (word, zipf) unless it has a new sense (term, definition)."""
    df = entries.where(well_formed(F.col("term")) & ~F.col("term").rlike(TRIVIAL))
    each = df.select("term", F.explode(F.split("term", r"\s+")).alias("word")).distinct()
    each = each.join(function_words.select("word", F.lit(True).alias("_f")).distinct(), "word", "left").join(zipf.select("word", "zipf"), "word", "left")
    met = each.groupBy("term").agg(F.min(F.coalesce("_f", F.lit(False))).alias("_f"), F.coalesce(F.max("zipf"), F.lit(0.0)).alias("_z"))
    met = met.join(senses.select("term", F.lit(True).alias("_s")).distinct(), "term", "left").where(~F.col("_f") & ((F.col("_z") < COMMON_ZIPF) | F.col("_s").isNotNull()))
    met = met.join(jargon.select(F.col("word").alias("term")).distinct(), "term", "left_anti")
    return df.join(met, "term", "left_semi").select(*entries.columns)


def first_of_each(entries: DataFrame, position: str) -> DataFrame:
    """The first entry of each term by position, as a partial aggregate."""
    got = entries.groupBy("term").agg(F.min_by(F.struct(*entries.columns), position).alias("_e"))
    return got.select("_e.*")


def curated_senses(*lists: DataFrame) -> DataFrame:
    """(term, definition) of several lists; a later list wins, and so does the greater definition inside one."""
    all_ = None
    for i, s in enumerate(lists):
        own = s.select("term", "definition", F.lit(i).alias("_i"))
        all_ = own if all_ is None else all_.unionByName(own)
    return all_.groupBy("term").agg(F.max(F.struct("_i", "definition")).alias("_b")).select("term", "_b.definition")


def append_senses(entries: DataFrame, senses: DataFrame) -> DataFrame:
    """Entries and, for senses (term, definition) that they lack, curated ones; columns that these don't have are null."""
    fixed = {"first_seen": "", "last_seen": "", "n_defs": 1, "median_score": 60.0, "recency_weight": 0.95, "status": "current", "example": "", "source": "curated"}
    met = entries.withColumn("_old", F.lit(True)).join(senses.select("term", F.col("definition").alias("_d")), "term", "full_outer")
    new = F.col("_old").isNull()
    value = lambda c, t: F.col("term") if c == "term" else F.when(new, F.col("_d") if c == "definition" else F.lit(fixed.get(c)).cast(t)).otherwise(F.col(c)).alias(c)
    return met.select(*[value(c, t) for c, t in entries.dtypes])


def load(entries: DataFrame, position: str, function_words: DataFrame, jargon: DataFrame, zipf: DataFrame, drifted: DataFrame, slang: DataFrame) -> DataFrame:
    """A lexicon as it is used: the first entry of each term that is loadable, and the curated senses that it lacks."""
    kept = loadable(first_of_each(entries, position), function_words, jargon, zipf, drifted)
    return append_senses(kept, curated_senses(drifted, slang))


def ranked(lexicon: DataFrame) -> DataFrame:
    """The most recent first, then the highest median score, then by term."""
    return lexicon.orderBy(F.desc("recency_weight"), F.desc("median_score"), "term")
