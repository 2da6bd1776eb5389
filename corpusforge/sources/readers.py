"""Readers and sinks of corpora: Parquet, CSV, JSON lines (plain or gzip) and JSON arrays; malformed lines are dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

# fixed values: top-level columns that may hold the text, in their order of preference
TEXT_COLUMNS = ("text", "body", "content", "Message", "message", "comment", "Comment", "CommentText", "comment_text", "definition", "hi_ng", "output", "tweet", "post", "selftext", "review")


def read(spark: SparkSession, path: str, kind: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A corpus by its kind (parquet, csv, jsonl, json array), which the name tells if it isn't given. Give JSON a schema at scale:
    without one Spark reads the input twice."""
    name = path.rstrip("/").removesuffix(".gz")
    kind = kind or name.rpartition(".")[2]
    r = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return r.parquet(path)
    if kind == "csv":
        return r.option("header", True).option("mode", "DROPMALFORMED").csv(path)
    if kind in ("jsonl", "ndjson"):
        return r.option("mode", "DROPMALFORMED").json(path)
    if kind == "json":
        return r.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    raise ValueError(f"unknown kind of corpus: {kind}")


def read_capped(frames: Sequence[DataFrame], max_rows: int) -> DataFrame:
    """Union of sources, each cut to its even share of the rows (the cap is the feature: a probe of many sources)."""
    share = max_rows // max(1, len(frames))
    out = frames[0].limit(share)
    for f in frames[1:]:
        out = out.unionByName(f.limit(share), allowMissingColumns=True)
    return out


def fan_out(df: DataFrame, shards: int, index: int, id_col: str = "doc_id") -> DataFrame:
    """One of ``shards`` disjoint parts by id."""
    return df.where(F.pmod(F.col(id_col), F.lit(shards)) == index)


def text_column(df: DataFrame, explicit: str | None = None) -> DataFrame:
    """Append ``text_found``: the first that isn't blank of the explicit (dotted) column, the known columns, the known fields of struct
    columns, other string fields of those with over 20 characters, and other string columns with over 20 characters, a space inside and
    no likeness to an identifier; else empty. Names are told apart by case, as columns may differ in nothing else."""
    # by position: Spark's names ignore case
    place = lambda i: F.col(f"_c{i}")
    named = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    own = {f.name: place(i) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, StringType)}
    known = lambda c: F.when(F.trim(c) != "", c)
    choices = []
    if explicit:
        top, _, below = explicit.partition(".")
        at = next((place(i) for i, c in enumerate(df.columns) if c == top), None)
        choices += [] if at is None else [known(at[below] if below else at)]
    choices += [known(own[c]) for c in TEXT_COLUMNS if c in own]
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, StructType):
            inner = [g.name for g in f.dataType.fields if isinstance(g.dataType, StringType)]
            choices += [known(place(i)[c]) for c in TEXT_COLUMNS if c in inner]
            choices += [F.when(F.length(place(i)[c]) > 20, place(i)[c]) for c in inner]
    choices += [F.when((F.length(c) > 20) & F.trim(c).contains(" ") & ~id_like(c), c) for c in own.values()]
    return named.withColumn("text_found", F.coalesce(*choices, F.lit(""))).toDF(*df.columns, "text_found")


def id_like(c: Column) -> Column:
    """Whether a value looks like an identifier rather than a text."""
    digits = F.length(c) - F.length(F.regexp_replace(c, "[0-9]", ""))
    return c.rlike(r"^[A-Za-z0-9_\-]{16,}$") | (~c.contains(" ") & (digits / F.greatest(F.length(c), F.lit(1)) > 0.15))


def community(column: str) -> Column:
    """Community name: lower case, leading r and / characters and surrounding slashes off."""
    return F.expr(f"trim(BOTH '/' FROM trim(LEADING 'r/' FROM lower(`{column}`)))")


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ("split", "pool")) -> None:
    """Write a corpus partitioned by split and pool, so that later reads prune."""
    df.write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns]).format(fmt).save(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


# fixed values: columns that name people or places of a record, which no corpus keeps
PERSONAL_COLUMNS = (
    "author", "author_fullname", "author_flair_text", "permalink", "id",
    "subreddit_id", "link_id", "parent_id", "name", "CommentID", "VideoID",
    "VideoTitle", "user", "username", "user_id", "channel_id", "server_id",
    "AuthorName", "AuthorChannelID", "author_name", "display_name",
)


def without_personal(df: DataFrame) -> DataFrame:
    """df without columns that name people; column names are told apart by case."""
    kept = [i for i, c in enumerate(df.columns) if c not in PERSONAL_COLUMNS]  # by position: Spark's names ignore case
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*[f"_c{i}" for i in kept]).toDF(*[df.columns[i] for i in kept])


def human_annotated(df: DataFrame) -> Column:
    """Whether a row is a person's work: the first struct column with a field source that isn't null says so with 1; a source that is no
    number, and rows without such a column, count as one."""
    out = F.lit(True)
    for f in reversed(df.schema.fields):
        if isinstance(f.dataType, StructType) and "source" in f.dataType.names:
            s = F.col(f"`{f.name}`")["source"]
            if not isinstance(f.dataType["source"].dataType, NumericType):
                s = s.cast("string")
            out = F.when(F.col(f"`{f.name}`").isNull(), out).otherwise(F.coalesce(s.try_cast("int") == 1, F.lit(True)))
    return out


def only_pools(sources: Sequence[tuple[str, str]], pools: str) -> list[tuple[str, str]]:
    """Those of the (name, pool) sources whose pool is in the comma-separated list; none at all is an error."""
    wanted = {p.strip() for p in pools.split(",") if p.strip()}
    got = [s for s in sources if s[1] in wanted]
    if not got:
        raise ValueError(f"no source has a pool of {sorted(wanted)}")
    return got


def with_position(df: DataFrame) -> DataFrame:
    """Append ``position`` to rows read from files: file, place of the split, place in it. Its order is the order of the rows."""
    meta = F.col("_metadata")
    return df.select("*", F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("row")).alias("position"))
