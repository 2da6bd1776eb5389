"""Shard manifests, listings of files and checkpoints: merging, totals, what is missing, what may go, what a position resumes at.

A manifest is a DataFrame with a row a shard: path, stage, n_tokens and vocab_size. Listings are (path, bytes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators import corpus as C

STAGES = ("S1", "S2", "S3")
# fixed values: suffixes of data files, and characters that some file systems refuse
DATA_SUFFIXES = (".jsonl", ".json", ".csv", ".parquet")
REFUSED = ':*?"<>|'


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def local_name(path: Column) -> Column:
    """The last part of a path with an underscore for each character that a file system may refuse."""
    return F.translate(file_name(path), REFUSED, "_" * len(REFUSED))


def data_files(listing: DataFrame, suffixes: Sequence[str] = DATA_SUFFIXES) -> DataFrame:
    """Rows of a listing that are data files by their suffix, in either case, and aren't hidden."""
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("path").endswith(s)
    return listing.where(wanted & ~F.col("path").startswith("."))


def stage_rank(stage: Column) -> Column:
    """Place of a stage; a missing one is the first, an unknown one goes last."""
    out = F.lit(9)
    for i, s in enumerate(STAGES):
        out = F.when(F.coalesce(stage, F.lit(STAGES[0])) == s, i).otherwise(out)
    return out


def merge(parts: DataFrame) -> DataFrame:
    """The manifest of all partitions (their rows in one DataFrame), in the order of stage and file name. Partitions of tokenizers with
    different vocabularies are an error when the rows are read; the check is two aggregates, joined as one row."""
    sizes = parts.agg(F.min("vocab_size").alias("_least"), F.max("vocab_size").alias("_most"), F.count_if(F.col("vocab_size").isNull()).alias("_none"))
    agree = (F.col("_least") == F.col("_most")) & (F.col("_none") == 0) | F.col("_least").isNull()
    checked = parts.join(F.broadcast(sizes)).withColumn("vocab_size", F.when(agree, F.col("vocab_size")).otherwise(F.raise_error(F.lit("vocab_size differs between partitions")).cast("long")))
    return checked.drop("_least", "_most", "_none").orderBy(stage_rank(F.col("stage")), file_name(F.col("path")), "path")


def of_stages(manifest: DataFrame, stages: Sequence[str]) -> DataFrame:
    return manifest.where(F.col("stage").isin(*stages))


def totals(manifest: DataFrame) -> DataFrame:
    """(stage, shards, tokens) of each stage and, with stage null, of all."""
    staged = manifest.withColumn("stage", F.coalesce("stage", F.lit(STAGES[0])))
    return staged.rollup("stage").agg(F.count("*").alias("shards"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))


def resolved(path: Column, root: str) -> Column:
    """Absolute paths stay; others start at the manifest's folder."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def to_fetch(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Shards whose file isn't in the listing, or is empty there."""
    there = listing.where("bytes > 0").select(file_name(F.col("path")).alias("_name")).distinct()
    return manifest.withColumn("_name", file_name(F.col("path"))).join(there, "_name", "left_anti").drop("_name")


def kept_checkpoints(names: DataFrame, milestones: DataFrame, rolling: int = 2) -> DataFrame:
    """(name) of checkpoints that stay: milestones and the ``rolling`` last by name (a limit that is the feature)."""
    last = names.select("name").distinct().orderBy(F.desc("name")).limit(rolling)
    return milestones.select("name").union(last).distinct()


def to_prune(listing: DataFrame, keep: DataFrame, prefix: str) -> DataFrame:
    """(name) of one run's checkpoints that aren't kept; a prefix that other runs share is refused."""
    if prefix in ("", "ckpt-"):
        raise ValueError("the prefix must name one run")
    return listing.where(F.col("name").startswith(prefix)).select("name").distinct().join(keep.select("name"), "name", "left_anti")


def digests(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of files read with the format binaryFile."""
    return files.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, verdict) of each expected file (path, bytes, sha256): ok, missing, size or content. Files beyond them don't matter."""
    have = found.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    verdict = F.when(F.col("_sha256").isNull(), "missing").when(F.col("bytes") != F.col("_bytes"), "size").when(F.col("sha256") != F.col("_sha256"), "content").otherwise("ok")
    return expected.join(have, "path", "left").select("path", verdict.alias("verdict"))


def cursors(manifest: DataFrame, order: str, positions: DataFrame, length: int) -> DataFrame:
    """positions (windows: how many were served) with epoch, shard and offset to resume at.

    Shards are read in the order of a unique numeric column, each in windows of ``length`` tokens whose last label is in the shard too;
    the tail of a shard is skipped and epochs repeat. Windows before a shard are sums over ranges; each distinct place in an epoch takes
    the last shard that begins up to it, again by ranges, and positions are joined to places. No position meets more than one shard. A
    manifest without a whole window gives no rows.
    """
    served = F.greatest(F.floor((F.col("n_tokens") - 1) / length), F.lit(0))
    own = manifest.select(order, served.alias("_n")).where("_n > 0")
    total = own.agg(F.sum("_n").alias("_all")).where("_all > 0")
    at = positions.join(F.broadcast(total)).withColumn("epoch", F.floor(F.col("windows") / F.col("_all"))).withColumn("_at", (F.col("windows") % F.col("_all")).cast("long"))
    starts = C.prefix_sum(own, (), order, F.col("_n"), "_from").select(F.col("_from").cast("long").alias("_at"), F.struct(F.col(order).alias("shard"), F.col("_from").cast("long").alias("_from")).alias("_shard"))
    places = at.select("_at").where("_at >= 0").distinct().withColumn("_place", F.lit(True))
    found = C.carried(places.unionByName(starts, allowMissingColumns=True), "_at", "_shard", "_in").where("_place").select("_at", "_in.*")
    return at.join(found, "_at").select(*positions.columns, "epoch", "shard", ((F.col("_at") - F.col("_from")) * length).cast("long").alias("offset"))


def batch_plan(rows: DataFrame, seq_len: int) -> DataFrame:
    """rows (global_tokens, devices, hint) with micro and accumulation: the largest micro-batch up to the hint that, on all devices,
    divides the global sequences. Both are null where none does, or where the tokens are no whole sequences."""
    seqs = F.floor(F.col("global_tokens") / seq_len)
    fits = lambda m: (F.col("global_tokens") % seq_len == 0) & (seqs % (m * F.col("devices")) == 0)
    micro = F.array_max(F.filter(F.sequence(F.lit(1), F.greatest("hint", F.lit(1))), fits))
    return rows.withColumn("micro", micro).withColumn("accumulation", F.floor(seqs / (F.col("micro") * F.col("devices"))))
