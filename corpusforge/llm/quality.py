"""Quality classifier: naive Bayes support vectors over n-gram indicators, fitted by dual coordinate descent on the hinge loss."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import LOWER, flatten, mix, prefix_hash, slices, span_hash, unique_by_doc, word_spans

WORD_BITS = 18
SHAPES = 8**4
EXTRA = 64
DIM = (1 << WORD_BITS) + SHAPES + EXTRA

# character classes of the shape n-grams: 0 white space, 1 lower, 2 upper, 3 digit, 4 sentence punctuation, 5 other symbol, 6 beyond ASCII, 7 line break
_CLASS = np.full(256, 5, np.int16)
_CLASS[[32, 9, 11, 12, 13]] = 0
_CLASS[10] = 7
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[33, 34, 39, 44, 46, 58, 59, 63]] = 4
_CLASS[128:] = 6


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram indicators of each document: (feature, document), sorted by document.

    Word uni- and bigrams hashed, 4-grams of character classes, a word's equality with one of the last eight (repetition), and the
    share of distinct words in sixteenths.
    """
    docs = len(offsets) - 1
    starts, ends, doc = word_spans(buf, offsets)
    out, of = [], []
    if len(starts):
        h = span_hash(prefix_hash(LOWER[buf]), starts, ends)
        top = np.uint64(64 - WORD_BITS)
        two = doc[1:] == doc[:-1]
        out += [(h >> top).astype(np.int64), (mix(h[:-1] * np.uint64(31) + h[1:]) >> top).astype(np.int64)[two]]
        of += [doc, doc[1:][two]]
        base = (1 << WORD_BITS) + SHAPES
        for lag in range(1, 9):
            if len(h) > lag:
                d = doc[lag:][(h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])]
                many = np.bincount(d, minlength=docs)
                share = many / np.maximum(np.bincount(doc, minlength=docs), 1)
                hit = np.flatnonzero(share > 0.1)
                out.append(np.full(len(hit), base + lag, np.int64))
                of.append(hit)
        u, ud = unique_by_doc(h, doc)
        n, distinct = np.bincount(doc, minlength=docs), np.bincount(ud, minlength=docs)
        full = np.flatnonzero(n)
        out.append(base + 16 + (distinct[full] * 15 // n[full]))
        of.append(full)
    c = _CLASS[buf]
    if len(c) >= 4:
        g = ((c[:-3] * 8 + c[1:-2]) * 8 + c[2:-1]) * 8 + c[3:]
        left = np.repeat(offsets[1:], np.diff(offsets))[:-3] - np.arange(len(g))
        at = np.repeat(np.arange(docs), np.diff(offsets))[:-3]
        seen = np.zeros((docs, SHAPES), bool)
        ok = left >= 4
        seen[at[ok], g[ok]] = True
        d, s = np.nonzero(seen)
        out.append(s + (1 << WORD_BITS))
        of.append(d)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return unique_by_doc(np.concatenate(out), np.concatenate(of))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        f, d = features(buf, offsets)
        margin = np.bincount(d, self.weights[f], minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Linear hinge loss with an L2 penalty; rows are the indices of set features, ``scale`` their values."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    vals = [scale[r] for r in rows]
    q = np.array([float(v @ v) + 1.0 for v in vals])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], vals[i]
            g = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def train(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, smooth: float = 1.0, seed: int = 11) -> QualityModel:
    """Class log-count ratios scale the indicators; the hinge model is fitted on them and calibrated on a held-back fifth.

    With a single class or none, every score is the smoothed share of label 1.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    prior = (float((y > 0).sum()) + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(DIM), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)

    def fit(use: np.ndarray) -> tuple[np.ndarray, float]:
        count = {s: smooth + np.bincount(np.concatenate([rows[i] for i in use if y[i] == s]), minlength=DIM) for s in (1.0, -1.0)}
        ratio = np.log(count[1.0] / (np.sum(y[use] > 0) + 2 * smooth)) - np.log(count[-1.0] / (np.sum(y[use] < 0) + 2 * smooth))
        mine = [rows[i] for i in use]
        norm = np.mean([np.sqrt((ratio[r] ** 2).sum()) for r in mine]) or 1.0
        scale = ratio / norm
        w, b = dual_coordinate_descent(mine, y[use], scale, cost, epochs, seed)
        return w * scale, b

    w, b = fit(np.flatnonzero(~held))
    cal = np.flatnonzero(held) if held.any() else np.arange(len(y))
    margin, t = np.array([w[rows[i]].sum() + b for i in cal]), (y[cal] > 0).astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(300):  # Platt scaling by Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * margin).sum() + 1e-3 * slope, (p - t).sum()])
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - float(np.clip(step[0], -1, 1)), shift - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(w, b, max(slope, 1e-6), shift)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, **options) -> QualityModel:
    """Learn from labelled rows (labels: doc_id, quality), a sample of ``sample`` distinct doc_ids at most (least hash first).

    Rows of ``labels`` whose doc_id or quality is null, or whose quality isn't 0 or 1, don't count; of a repeated doc_id the least
    quality counts. The sample is the bound on what the driver holds: its indicators, about 1,000 integers a document.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # both ids and labels are narrow: the bound applies before any text is read
    chosen = known.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            buf, off = flatten(b.column(1))
            f, d = features(buf, off)
            at = np.searchsorted(d, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(f, pa.int32()))], ["doc_id", "quality", "f"])

    got = rows.mapInArrow(run, "doc_id bigint, quality int, f array<int>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    f = got["f"].combine_chunks() if got.num_rows else None
    feats = [f[int(i)].values.to_numpy().astype(np.int64) for i in order]
    return train(feats, got["quality"].to_numpy()[order], **options)


def score(docs: DataFrame, m: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold); one row per input row, no shuffle.

    Null and empty texts have no indicators and get the model's score for none. Other columns are neither read nor returned.
    The weights (2 MB) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = shared.value.scores(*flatten(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, predicted int")
