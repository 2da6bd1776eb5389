"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from corpusforge.llm.common import LOWER, flatten, fresh, slices, tidy

GRAMS = (3, 4)
_FOLD = LOWER.copy()
_FOLD[9:14] = 32


@dataclass
class LanguageModel:
    """Languages in code-point order, per-bucket logits (embedding times softmax weights), bias, temperature and threshold."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    meta: dict = field(default_factory=dict)

    def probabilities(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax((average(buf, offsets, self.table) + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and Latin-1 letters, all ASCII white space as a space."""
    out = _FOLD[buf]
    if len(out) > 1:
        up = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E)) + 1
        out[up] += 0x20
    return out


def subwords(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: the bucket at each byte, and whether the gram lies inside its document."""
    b = fold(buf).astype(np.uint32)
    n = len(b)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    for k in GRAMS:
        h = np.zeros(n, np.uint32)
        for j in range(min(k, n)):
            h[: n - j] = (h[: n - j] ^ b[j:]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - buckets.bit_length() + 1), left >= k


def average(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over each document's subwords; zero without any."""
    docs = len(offsets) - 1
    total, count = np.zeros((docs, table.shape[1])), np.zeros(docs)
    if len(buf):
        full = np.flatnonzero(np.diff(offsets))
        at = offsets[full]
        for bucket, ok in subwords(buf, offsets, len(table) - 1):
            bucket[~ok] = len(table) - 1
            for c in range(table.shape[1]):
                total[full, c] += np.add.reduceat(table[:, c][bucket], at, dtype=np.float64)
            count[full] += np.add.reduceat(ok, at, dtype=np.int64)
    return total / np.maximum(count, 1)[:, None]


def bags(texts: list[bytes], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        buf, off = np.frombuffer(t, np.uint8), np.array([0, len(t)])
        ids = np.concatenate([b[ok] for b, ok in subwords(buf, off, buckets)]) if t else np.zeros(0, np.int64)
        u, n = np.unique(ids, return_counts=True)
        out.append((u.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(texts: list[str], langs: list[str], buckets: int = 1 << 14, dim: int = 16, epochs: int = 4, rate: float = 0.1, seed: int = 7, keep: float = 0.999) -> LanguageModel:
    """Mini-batch SGD on whole texts and, for short input, one seeded excerpt of each.

    A fifth of the texts, by seed, calibrates: the temperature (1 or more) has least log loss there, on whole texts and excerpts, and the rejection threshold is the score
    that the share ``keep`` of correctly predicted whole calibration texts reaches, 0.5 at most.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    if len(names) < 2:
        return LanguageModel(names, np.zeros((buckets + 1, max(1, len(names))), np.float32), np.zeros(max(1, len(names))))
    raw = [t.encode() for t in texts]
    short = []
    for t in raw:
        i = int(rng.integers(0, max(1, len(t) - 40)))
        short.append(t[i : i + int(rng.integers(12, 120))])
    held = rng.random(len(raw)) < 0.2
    whole, part = bags(raw, buckets), bags(short, buckets)
    fit = [(whole[i], y[i]) for i in np.flatnonzero(~held)] + [(part[i], y[i]) for i in np.flatnonzero(~held)]
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    size = 64

    def dense(some: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(some), buckets), np.float32)
        for r, (u, v) in enumerate(some):
            x[r, u] = v
        return x

    # AdaGrad steps: the mean over thousands of subwords makes each embedding's own gradient tiny
    g_emb, g_w, g_b = np.full(emb.shape, 1e-12, np.float32), np.full(w.shape, 1e-12, np.float32), np.full(bias.shape, 1e-12, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for i in range(0, len(order), size):
            some = [fit[j] for j in order[i : i + size]]
            x, t = dense([s[0] for s in some]), np.array([s[1] for s in some])
            h = x @ emb
            d = softmax(h @ w + bias)
            d[np.arange(len(t)), t] -= 1
            d = (d / len(t)).astype(np.float32)
            for param, total, grad in ((emb, g_emb, x.T @ (d @ w.T)), (w, g_w, h.T @ d), (bias, g_b, d.sum(axis=0))):
                total += grad * grad
                param -= rate * grad / np.sqrt(total)
    table = np.vstack([emb @ w, np.zeros((1, len(names)), np.float32)])
    out = LanguageModel(names, table, bias.astype(np.float64))
    cal = np.flatnonzero(held)
    if len(cal):
        truth = y[cal]
        full, brief = (np.vstack([dense([bag[i] for i in cal[j : j + 256]]) @ table[:-1] + bias for j in range(0, len(cal), 256)]) for bag in (whole, part))
        grid = np.geomspace(1, 8, 40)
        loss = [sum(-np.log(softmax(logit / t)[np.arange(len(truth)), truth] + 1e-12).mean() for logit in (full, brief)) for t in grid]
        out.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(full / out.temperature)
        right = p.argmax(axis=1) == truth
        if right.any():
            out.threshold = float(min(0.5, np.quantile(p.max(axis=1)[right], 1 - keep)))
        out.meta = {"accuracy": float(right.mean()), "n": len(cal)}
    return out


def sample(docs: DataFrame, where: Column, per_language: int) -> pd.DataFrame:
    """About ``per_language`` rows of each language, by a hash of doc_id and text: a bounded, documented training sample.

    First a count of each language's distinct rows (estimated, it sets the share that is drawn), then a hash threshold for each, so that no
    language meets in one task. Every language counts, however many there are. Repeated rows count once; the sample holds 1.2 * per_language + 50 rows a language at most.
    """
    known = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("own_rows"))
    languages = counts.count()
    if not languages:
        return pd.DataFrame({"text": [], "lang": []})
    u = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    met = known.join(F.broadcast(counts) if languages <= 100_000 else counts, "lang")
    rows = met.where(u < F.lit(per_language) / F.col("own_rows")).select("doc_id", "text", "lang").distinct().limit(int((1.2 * per_language + 50) * languages)).toPandas()
    return rows.sort_values(["doc_id", "lang", "text"], kind="stable").reset_index(drop=True)


def fit(docs: DataFrame, where: Column, per_language: int = 800, **options) -> LanguageModel:
    """Train on the rows of ``docs`` (doc_id, text, lang) for which ``where`` holds, from a bounded sample of each language."""
    rows = sample(docs, where, per_language)
    return train(rows["text"].tolist(), rows["lang"].tolist(), **options)


def predict(docs: DataFrame, m: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", reject_col: str = "rejected") -> DataFrame:
    """Append the predicted language, its calibrated probability, and whether calibrated rejection refuses the document.

    Null texts and texts without a letter get ``und``, score 0 and are rejected; so does everything if no language was learned.
    Whole texts count. All columns of ``docs`` stay; the three new names must not clash (``fresh`` finds free ones). No shuffle.
    The model is part of the task closure: buckets x languages floats, 0.3 MB for four languages.
    """
    letter = fresh(docs, "has_letter")
    df = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    kept = list(docs.columns)
    at, last = kept.index(text_col), len(kept)
    schema = StructType([*docs.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType()), StructField(reject_col, BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            ok = b.column(last).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            p = m.probabilities(*flatten(b.column(at)))
            best = p.argmax(axis=1)
            score = np.where(ok, p[np.arange(len(best)), best], 0.0)
            names = [m.languages[i] if k else "und" for i, k in zip(best.tolist(), ok.tolist(), strict=True)]
            cols = [b.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(score), pa.array(~ok | (score < m.threshold))], [*kept, pred_col, score_col, reject_col])
        tidy()

    return df.mapInArrow(run, schema)
