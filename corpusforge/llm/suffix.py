"""Suffix-array deduplication with a logarithmic index family.

Suffixes are sparse: one in about 50 positions, at minimizers, so that every string of ``length`` bytes has a canonical suffix inside it
that depends on its content alone. A batch's suffix array is the sorted list of fingerprints of its suffixes' first bytes (as many as
every window of the suffix shares). A new batch is merge-scanned against the levels for equal entries, and equal-sized levels merge.
Only windows around matched suffixes are then told apart, first all windows of a suffix at once, and one by one at the ends of matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import discard, flatten, materialise, mix, prefix_hash, release, remove, shared_dir, slices, span_hash

GRAM = 16
WINDOW = 96
BATCHES = 4


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (shorter at the end), by block prefix and suffix minima."""
    n = len(x)
    full = np.full(-(-n // w) * w + w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(buf: np.ndarray, offsets: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each suffix: its document, first window and number of windows, the fingerprint of what all its windows share, and of all of them."""
    n = len(buf)
    z = np.zeros(0, np.int64)
    at = np.arange(n)
    left = np.repeat(offsets[1:], np.diff(offsets)) - at
    valid = np.flatnonzero(left >= length)
    if not len(valid):
        return z, z, z, z, z
    end = np.minimum(at + GRAM, n)
    grams = span_hash(h, at, end) >> np.uint64(32)
    best = (sliding_min(grams << np.uint64(32) | at.astype(np.uint64), WINDOW) & np.uint64(0xFFFFFFFF)).astype(np.int64)[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (best[1:] != best[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    low, count, anchor = valid[first], np.diff(np.append(first, len(valid))), best[first]
    shared = span_hash(h, anchor, anchor + length - WINDOW + 1)
    whole = mix(span_hash(h, low, low + count - 1 + length) ^ mix((count * 1024 + anchor - low).astype(np.uint64)))
    doc = np.searchsorted(offsets, low, "right") - 1
    return doc, low - offsets[doc], count, shared.view(np.int64), whole.view(np.int64)


def third(doc: np.ndarray, f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which entries have two equal ones (f, g) before them in their document."""
    out = np.zeros(len(doc), bool)
    order = np.lexsort((g, f, doc))
    same = (doc[order][2:] == doc[order][:-2]) & (f[order][2:] == f[order][:-2]) & (g[order][2:] == g[order][:-2])
    out[order[2:][same]] = True
    return out


def joined_ranges(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [s, e) in order of document and start, those that touch made one. All are about equally long."""
    top = np.maximum.accumulate(e + doc * (int(e.max()) + 1))
    new = np.ones(len(s), bool)
    new[1:] = s[1:] + doc[1:] * (int(e.max()) + 1) > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return doc[first], s[first], top[last] - doc[first] * (int(e.max()) + 1)


class SuffixFamily:
    """Levels of sorted suffix fingerprints, merged geometrically."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.found: list[str] = []

    def write(self, suffixes: DataFrame) -> tuple[DataFrame, str]:
        folder = shared_dir(self.spark)
        return materialise(suffixes.groupBy("f").agg(F.sum("n").alias("n")).sortWithinPartitions("f"), folder), folder

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch (column f); returns the fingerprints that it has twice or that a level already has."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, fa), (_, b, fb) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, *self.write(a.unionByName(b))))
            remove(self.spark, fa)
            remove(self.spark, fb)
        level, folder = self.write(batch.select("f", F.lit(1).cast("bigint").alias("n")))
        found = level.where(F.col("n") > 1).select("f")
        for _, old, _ in self.levels:
            found = found.unionByName(level.select("f").join(old.select("f"), "f", "left_semi"))
        self.levels.append((1, level, folder))
        self.found.append(shared_dir(self.spark))
        return materialise(found, self.found[-1])

    def drop(self) -> None:
        for _, _, folder in self.levels:
            remove(self.spark, folder)
        self.levels = []


def open_kinds(same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kinds (f, g) of fingerprints whose windows aren't all repeated with the suffix, and a table that the result still reads.

    ``same`` has each kind of each fingerprint that several entries have, with their number c. So a kind of one entry always has others beside
    it, and is taken without a look at them; only kinds of several entries are joined. Else all kinds of a frequent one met in one task.
    """
    once = same.where(F.col("c") == 1)
    open_f = materialise(once.select("f").distinct())
    return once.unionByName(same.where(F.col("c") > 1).join(open_f, "f", "left_semi").select(*same.columns)), open_f


def repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, th, spans): for each text with repeated strings of ``length`` bytes, the byte ranges [s, e) that they cover.

    th is a hash of the text: with it, a row whose id is repeated is still told apart. Matches never cross texts. Fingerprints have 64 bits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") >= length).select("id", F.xxhash64("text").alias("th"), "text")
    id_type = dict(rows.dtypes)["id"]

    def suffixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            buf, off = flatten(b.column(2))
            doc, low, count, f, g = anchors(buf, off, prefix_hash(buf), length)
            twice = third(doc, f, g)
            f, g = pa.array(f, pa.int64()), pa.array(g, pa.int64())
            if twice.any():  # two suffixes show that a text repeats them, of others only the ranges matter
                own, s, e = joined_ranges(doc[twice], low[twice], low[twice] + count[twice] - 1 + length)
                f, g = (pa.concat_arrays([x.filter(pa.array(~twice)), pa.nulls(len(own), pa.int64())]) for x in (f, g))
                doc, low, count = np.concatenate([doc[~twice], own]), np.concatenate([low[~twice], s]), np.concatenate([count[~twice], e - s - length + 1])
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(low, pa.int64()), pa.array(count, pa.int32()), f, g], ["id", "th", "low", "n", "f", "g"])

    entries_at = shared_dir(spark)
    entries = materialise(rows.mapInArrow(suffixes, f"id {id_type}, th bigint, low bigint, n int, f bigint, g bigint"), entries_at)
    family, hits = SuffixFamily(spark), None
    suffixes_of = entries.where(F.col("f").isNotNull())
    for i in range(batches):
        new = family.add(suffixes_of.where(F.pmod(F.xxhash64("th"), F.lit(batches)) == i).select("f"))
        hits = new if hits is None else hits.unionByName(new)
    hits_at, matched_at, same_at, singles_at = (shared_dir(spark) for _ in range(4))
    hits = materialise(hits.distinct(), hits_at)
    family.drop()
    release(spark)
    matched = materialise(suffixes_of.join(hits, "f", "left_semi"), matched_at)
    sure = materialise(entries.where(F.col("f").isNull()))
    del new, hits
    for folder in (entries_at, hits_at, *family.found):
        remove(spark, folder)
    release(spark)
    same = materialise(matched.groupBy("f", "g").agg(F.count("*").alias("c"), F.min(F.struct("th", "id", "low", "n")).alias("one")), same_at)
    release(spark)
    near_kinds, open_f = open_kinds(same)
    edges = near_kinds.select("one.id", "one.th", F.struct(F.col("one.low").alias("low"), F.col("one.n").alias("n"), F.least("c", F.lit(2)).alias("w")).alias("e"))
    edges = edges.groupBy("id", "th").agg(F.collect_list("e").alias("edges"))

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            buf, off = flatten(b.column(2))
            h, e = prefix_hash(buf), b.column(3)
            of = np.repeat(np.arange(b.num_rows), np.diff(e.offsets.to_numpy()))
            low, n, w = (e.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ends = np.cumsum(n, dtype=np.int64)
            at = np.arange(int(ends[-1])) - np.repeat(ends - n - low, n)
            doc = np.repeat(of, n)
            i = at + off[doc]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(at), pa.array(np.repeat(w, n), pa.int64()), pa.array(span_hash(h, i, i + length).view(np.int64))], ["id", "th", "at", "w", "h"])

    near = rows.join(edges.withColumnsRenamed({"id": "id2", "th": "th2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")))
    # rows that are equal in id and text give their windows twice, but those have weight 2 anyway
    singles = materialise(near.select("id", "th", "text", "edges").mapInArrow(windows, f"id {id_type}, th bigint, at bigint, w bigint, h bigint"), singles_at)
    discard(open_f)
    release(spark)
    twice = singles.groupBy("h").agg(F.sum("w").alias("w")).where(F.col("w") > 1).select("h")
    one = materialise(singles.join(twice, "h", "left_semi").groupBy("id", "th").agg(F.collect_list("at").alias("at")))
    remove(spark, singles_at)
    release(spark)
    many = matched.join(same.where(F.col("c") > 1).select("f", "g"), ["f", "g"], "left_semi")
    many = many.select("id", "th", "low", "n").unionByName(sure.select("id", "th", "low", "n"))
    many = materialise(many.groupBy("id", "th").agg(F.collect_list(F.struct(F.col("low").alias("s"), (F.col("low") + F.col("n") - 1 + length).alias("e"))).alias("spans")))
    remove(spark, matched_at)
    remove(spark, same_at)
    discard(sure)
    release(spark)
    one = one.select("id", "th", F.transform("at", lambda x: F.struct(x.alias("s"), (x + length).alias("e"))).alias("spans"))
    return one.unionByName(many).groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(spans: np.ndarray, size: int) -> np.ndarray:
    """Starts and ends of the maximal runs that [s, e) rows cover."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    on = np.cumsum(step)[:size] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def deduplicate(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if asked for); one row per input row.

    Each byte covered by a ``length``-byte string that also starts anywhere else, in the same text included, goes; strings are judged on
    the input. Null and empty texts have no bytes; repeated rows repeat each other's strings; columns other than id and text aren't read.
    """
    spans = repeats(docs, length, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    joined = rows.join(spans.withColumnsRenamed({"id": "id2", "th": "th2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left").select("id", "text", "spans")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            buf, off = flatten(b.column(1))
            removed, count, sha, kept = [], [], [], []
            for i, s in enumerate(b.column(2)):
                text = buf[off[i] : off[i + 1]]
                runs = covered(np.stack([s.values.field(0).to_numpy(), s.values.field(1).to_numpy()], axis=1), len(text)) if s.is_valid else np.zeros((0, 2), np.int64)
                at, parts = 0, []
                for x, y in runs.tolist():
                    parts.append(text[at:x].tobytes())
                    at = y
                rest = b"".join([*parts, text[at:].tobytes()])
                removed.append(len(text) - len(rest)), count.append(len(runs)), sha.append(hashlib.sha256(rest).hexdigest()), kept.append(rest)
            cols = [b.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.binary())] if with_text else [])], names)

    return joined.mapInArrow(cut, f"`{id_col}` {dict(rows.dtypes)['id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
