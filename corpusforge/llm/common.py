"""Shared pieces: checkpoint folder, Arrow text slicing, vectorised words and shingles."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corpusforge.scratch import keep, remove, shared_dir

SLICE_BYTES = 2_000_000
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks write so many narrow rows: one for each 50,000, as many as shuffles have at most."""
    return max(1, min(-(-rows // 50_000), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def materialise(df: DataFrame, folder: str | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``rows``: about how many narrow rows that takes at most, where it is known; few rows make few files then.
    The folder goes with :func:`discard`, or else, as a lazy result may still read it, when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = folder or shared_dir(spark)
    keep(spark, folder)
    if rows is not None:
        df = df.coalesce(tasks(spark, rows))
    df.write.mode("overwrite").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of frames that :func:`materialise` gave, once nothing reads them any more."""
    for df in frames:
        remove(df.sparkSession, df._folder)


def repeatable(df: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``df``, or where its plan has a shuffle, and so may deal rows otherwise when run again, a written copy; and what to discard."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = materialise(df)
        return df, [df]
    return df, []


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def flatten(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column one after another, and int64 offsets; null counts as empty."""
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text; a longer text comes alone and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, n in enumerate(size):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += n
        yield batch.slice(start)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64, and their inverses, of at least n entries."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 1024)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in (("p", _BASE), ("i", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS["p"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i], times the inverse power of i, a polynomial hash of buf[i:j] modulo 2**64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    p, _ = _powers(len(buf) + 1)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(h))
    return mix((h[end] - h[start]) * inv[start])


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the words ``[^\\x20\\x09-\\x0D]+``; words don't cross documents."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each lower-cased word (A-Z only), and its document index."""
    starts, ends, doc = word_spans(buf, offsets)
    return span_hash(prefix_hash(LOWER[buf]), starts, ends), doc


def shingle_hashes(words: np.ndarray, doc: np.ndarray, docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles with their document index; shorter documents have one of all their words."""
    count = np.bincount(doc, minlength=docs)
    first = np.concatenate([[0], np.cumsum(count)])
    out_doc, out = [], []
    m = len(words) - k + 1
    if m > 0:
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(0x100000001B3) + words[j : j + m])
        whole = doc[:m] == doc[k - 1 :]
        out.append(h[whole])
        out_doc.append(doc[:m][whole])
    for d in np.flatnonzero((count > 0) & (count < k)):
        h = np.full(1, count[d], np.uint64)
        for w in words[first[d] : first[d + 1]]:
            h = mix(h * np.uint64(0x100000001B3) + w)
        out.append(h)
        out_doc.append(np.array([d]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(out_doc)


def unique_by_doc(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs, sorted by document, then value."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], d[keep]


def tidy() -> None:
    """Give memory that a worker has freed back to the machine; workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than GNU's have no such call
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames nobody refers to any more, instead of when the driver happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()
