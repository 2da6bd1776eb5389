"""Document cleaning: a chain of predicates whose first failure names the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import resources as R
from corpusforge.functions import text as T


@dataclass(frozen=True)
class CleanConfig:
    strict: bool = False
    min_words: int = 3
    max_words: int = 4096
    min_unique: float = 0.25
    max_symbols: float = 0.70
    max_word: int = 60

    @classmethod
    def strictly(cls) -> CleanConfig:
        return cls(strict=True, min_words=50, min_unique=0.35, max_symbols=0.35)


def clean(df: DataFrame, cfg: CleanConfig | None = None, text_col: str = "text", author_col: str | None = None, pool: str = "internet", exact_entities: bool = False) -> DataFrame:
    """Append clean_text, n_words, lang_route, ok, reason and pool. Nulls are deleted_or_empty. One projection chain, no shuffle.

    Words are extracted once, in a sub-select, and dropped before anything is shuffled.
    """
    cfg = cfg or CleanConfig()
    raw = F.coalesce(F.col(text_col), F.lit(""))
    head = F.substring(raw, 1, 300)
    bot = head.rlike(T.BOT_BODY) | head.rlike(T.CHAT_BOT)
    if author_col:
        bot = bot | F.coalesce(F.col(author_col).rlike(T.BOT_AUTHOR), F.lit(False))
    early = F.when(T.strip(raw).isin(*R.DELETED), "deleted_or_empty").when(bot, "bot").when(raw.rlike(T.PROMO), "promo")
    df = df.withColumn("_early", early)
    df = df.withColumn("clean_text", F.when(F.col("_early").isNull(), T.tidy(T.cap_repeats(T.scrub(T.strip_markup(raw, exact_entities))))).otherwise(F.lit("")))
    df = df.withColumn("_words", T.words(F.col("clean_text"))).withColumn("n_words", F.size("_words")).withColumn("_low", F.array_distinct(T.lowered(F.col("_words"))))
    c, ws, n, low = F.col("clean_text"), F.col("_words"), F.col("n_words"), F.col("_low")
    unique = F.size(low) / n
    symbols = F.length(F.regexp_replace(c, r"(?U)[\p{L}\p{N}\s]+", "")) / F.greatest(F.length(c), F.lit(1))
    links = F.when(F.array_contains(low, "http"), F.size(F.filter(ws, lambda w: F.lower(w) == "http")) / n).otherwise(0.0)
    df = df.withColumn("lang_route", F.when(F.col("_early").isNull(), T.language(ws, c, low)))
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(c == "", "empty_after_clean")
        .when(n < cfg.min_words, F.concat(F.lit("too_short("), n.cast("string"), F.lit(")")))
        .when(n > cfg.max_words, F.concat(F.lit("too_long("), n.cast("string"), F.lit(")")))
        .when(unique < cfg.min_unique, "repetitive")
        .when(symbols > cfg.max_symbols, "mostly_symbols")
        .when(F.exists(ws, lambda w: F.length(w) > cfg.max_word), "hash_or_base64")
        .when(links > 0.25, "link_spam")
        .when(~F.col("lang_route").isin("en", "hinglish"), F.concat(F.lit("lang("), F.col("lang_route"), F.lit(")")))
    )
    if cfg.strict:
        reason = reason.when(~c.rlike("[.!?]"), "no_terminal_punctuation")
    df = df.withColumn("reason", F.coalesce(reason, F.lit("ok")))
    return df.withColumn("ok", F.col("reason") == "ok").withColumn("pool", F.when(F.col("lang_route") == "hinglish", "hinglish").otherwise(F.lit(pool))).drop("_early", "_words", "_low")


def reason_histogram(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy(F.substring_index("reason", "(", 1).alias("reason")).agg(F.count("*").alias("n"))
