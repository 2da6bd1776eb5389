"""Language-model scoring with a hidden Markov model over word classes.

Frequent words are classes of their own, all others share hashed classes, and the probability of a word inside its class is its smoothed
count there; so the model covers every word of the corpus with a bounded number of parameters. Baum-Welch counts are summed over all
training rows on the executors; the scaled forward recursion gives each text's exact likelihood.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import LOWER, flatten, materialise, slices

LISTED = 200_000
CLASSES = 16_384
HASHED = 512
STATES = 8
ROUNDS = 6
TOLERANCE = 0.002
SAMPLE = 2_000
SEGMENT = 96
BATCH_TOKENS = 1_500_000


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of lower-cased texts as indices into an array of distinct words, and each text's number of words."""
    buf, offsets = flatten(texts)
    lower = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(LOWER[buf].tobytes()))
    lists = pc.ascii_split_whitespace(lower)
    coded = lists.values.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    empty = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py() if len(coded.dictionary) else -1
    if empty >= 0:
        real = index != empty
        index, text = index[real], text[real]
    return index, coded.dictionary, np.bincount(text, minlength=len(lists))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the column text, pre-aggregated in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            return t.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()

        for b in slices(batches):
            index, names, _ = words(b.column(0))
            n = np.bincount(index, minlength=len(names))
            use = np.flatnonzero(n)
            held.append(pa.table({"word": names.take(pa.array(use)), "n": n[use]}))
            rows += len(use)
            if rows > 1_500_000:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The LISTED most frequent words with their counts (the first CLASSES are classes), totals, and the hashed classes' totals."""

    names: pa.Array
    counts: np.ndarray
    classes: int
    total: int
    distinct: int
    ends: int
    hashed_n: np.ndarray
    hashed_v: np.ndarray

    @property
    def size(self) -> int:
        return self.classes + 1 + HASHED

    @property
    def base_denominator(self) -> float:
        return np.log10(self.total + 0.1 * (self.distinct + 1))

    def shares(self) -> np.ndarray:
        n = np.concatenate([self.counts[: self.classes], [self.ends], self.hashed_n]) + 0.1
        return n / n.sum()

    def encode(self, texts: pa.Array) -> dict[str, object]:
        """Class of each token (an end after each text) and the sums that need no corpus counts beyond the list."""
        index, names, n = words(texts)
        docs = len(n)
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        other = (at < 0) | (at >= self.classes)
        hashed = np.zeros(len(at), np.int64)
        hashed[other] = [zlib.crc32(w.encode()) % HASHED for w in names.filter(pa.array(other)).to_pylist()]
        cls = np.where(other, self.classes + 1 + hashed, at)
        known = np.where(at >= 0, self.counts[np.maximum(at, 0)] if len(self.counts) else 0, 0)
        log = np.where(at >= 0, np.log10(known + 0.1), 0.0)
        inside = np.where(other, log - np.log10(self.hashed_n + 0.1 * (self.hashed_v + 1))[hashed], 0.0)
        text = np.repeat(np.arange(docs), n)
        first = np.concatenate([[0], np.cumsum(n + 1)])
        codes = np.full(int(first[-1]), self.classes, np.uint16 if self.size < 1 << 16 else np.int32)
        codes[np.arange(len(index)) + text] = cls[index]
        end = np.log10(self.ends + 0.1)
        rare = at[index] < 0
        rare_at = np.concatenate([[0], np.cumsum(np.bincount(text[rare], minlength=docs))])
        return {
            "n_tokens": n + 1,
            "n_known": np.bincount(text, (at >= 0)[index], minlength=docs).astype(np.int64) + (self.ends > 0),
            "base": np.bincount(text, log[index], minlength=docs) + end,
            "inside": np.bincount(text, inside[index], minlength=docs),
            "codes": [codes[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)],
            "rare": pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), names.take(pa.array(index[rare])).cast(pa.string())),
        }


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes


def unpack(codes: list[bytes], dtype: np.dtype) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Groups of sequences of about BATCH_TOKENS tokens, longest first, as (order, arrays)."""
    seqs = [np.frombuffer(c, dtype) for c in codes]
    group, total = [], 0
    for i, s in enumerate(seqs):
        group.append(i)
        total += len(s)
        if total > BATCH_TOKENS or i == len(seqs) - 1:
            order = np.array(sorted(group, key=lambda j: -len(seqs[j])))
            yield order, [seqs[j] for j in order]
            group, total = [], 0


def by_time(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of sequences sorted by falling length, time by time; where each time starts."""
    size = np.array([len(s) for s in seqs])
    alive = np.bincount(size, minlength=size[0] + 1)[::-1].cumsum()[::-1][1:]
    at = np.concatenate([[0], np.cumsum(alive)])
    out = np.empty(at[-1], np.int64)
    for i, s in enumerate(seqs):
        out[at[: len(s)] + i] = s
    return out, at


def forward(m: Model, seqs: list[np.ndarray], keep: bool = False) -> tuple[np.ndarray, tuple]:
    """log10 likelihood of each sequence by the scaled forward recursion (and, to keep, all scaled probabilities and scales)."""
    tokens, at = by_time(seqs)
    dtype = m.emit.dtype
    alphas = np.empty((m.emit.shape[0], len(tokens)), dtype) if keep else None
    scales = np.empty(len(tokens), dtype) if keep else None
    move, alpha, log = np.ascontiguousarray(m.move.T), m.start[:, None], np.zeros(len(seqs))
    for t in range(len(at) - 1):
        i, j = at[t], at[t + 1]
        a = (move @ alpha[:, : j - i] if t else alpha) * m.emit.take(tokens[i:j], axis=1)
        c = a.sum(axis=0)
        alpha = a / c
        log[: j - i] += np.log10(c)
        if keep:
            alphas[:, i:j], scales[i:j] = alpha, c
    return log, (tokens, at, alphas, scales)


def expectations(m: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions (states x classes) of the sequences, and their log10 likelihood."""
    log, (tokens, at, gamma, scales) = forward(m, seqs, keep=True)
    k = m.emit.shape[0]
    moves, beta, ahead = np.zeros((k, k)), None, 0
    for t in range(len(at) - 2, -1, -1):
        i, j = at[t], at[t + 1]
        now = np.ones((k, j - i), gamma.dtype)
        if beta is not None:
            i2, j2 = at[t + 1], at[t + 2]
            ahead = j2 - i2
            e = m.emit.take(tokens[i2:j2], axis=1) * beta / scales[i2:j2]
            moves += gamma[:, i : i + ahead] @ e.T
            now[:, :ahead] = m.move @ e
        beta = now
        if t + 1 < len(at) - 1:  # alpha of the next time isn't needed any more
            gamma[:, at[t + 1] : at[t + 2]] *= later
        later = beta
    gamma[:, at[0] : at[1]] *= later
    emits = np.stack([np.bincount(tokens, gamma[s], minlength=m.emit.shape[1]) for s in range(k)])
    return gamma[:, : at[1]].sum(axis=1).astype(float), moves * m.move, emits, float(log.sum())


def maximise(start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
    """Smoothed re-estimation; every class keeps a little of its corpus share in every state."""
    emit = emit + 5.0 * shares
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return Model(norm(start + 1.0).astype(np.float32), norm(move + 1.0).astype(np.float32), norm(emit).astype(np.float32))


def initial(shares: np.ndarray, codes: list[bytes], dtype: np.dtype, states: int, seed: int = 3, rounds: int = 15) -> Model:
    """Start for the full rounds: Baum-Welch in memory on a bounded sample of segments, from seeded perturbed shares."""
    rng = np.random.default_rng(seed)
    m = maximise(np.zeros(states), 5 * np.eye(states), len(shares) * rng.gamma(0.5, 2.0, (states, len(shares))) * shares, shares)
    for _ in range(rounds if codes else 0):
        parts = [expectations(m, s) for _, s in unpack(codes, dtype)]
        m = maximise(*(sum(p[i] for p in parts) for i in range(3)), shares)
    return m


def segments(coded: DataFrame, dtype: np.dtype, sample: int) -> list[bytes]:
    """At most ``sample`` segments of SEGMENT tokens (least hash of row and place) of all texts' codes: what the driver gets is bounded in
    bytes, however long a text is."""
    step = SEGMENT * dtype.itemsize
    places = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("codes") - 1) / step).cast("int"))).alias("place")
    each = coded.where(F.octet_length("codes") > 0).select("id", "row", "codes", places)
    part = F.substring(F.col("codes"), F.col("place") * step + 1, F.lit(step)).alias("part")
    return [bytes(r["part"]) for r in each.orderBy(F.xxhash64(F.lit("hmm"), "id", "place"), "row", "place").limit(sample).select(part).collect()]


def train_round(coded: DataFrame, m: Model, shares: np.ndarray, dtype: np.dtype) -> tuple[Model, float]:
    """One Baum-Welch round over all rows of ``coded`` (column codes), and their log10 likelihood before it; each task sends a row a class
    it saw, summed by class."""
    states, shared = len(m.start), coded.sparkSession.sparkContext.broadcast(m)
    names = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shared.value, None
        for b in batches:
            for _, seqs in unpack(b.column(0).to_pylist(), dtype):
                got = expectations(m, seqs)
                total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
        if total is not None:
            start, move, emit, log = total
            seen = np.flatnonzero(emit.any(axis=0))
            key = np.concatenate([[-1], -2 - np.arange(states + 1), seen])
            vals = np.vstack([start, move, np.full(states, log), emit[:, seen].T])
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(vals[:, i]) for i in range(states))], ["key", *names])

    got = coded.select("codes").mapInArrow(run, "key bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toPandas().set_index("key")
    emit = np.zeros((states, len(shares)))
    seen = got.index[got.index >= 0].to_numpy()
    emit[:, seen] = got.loc[seen, names].to_numpy().T
    row = lambda i: got.loc[i, names].to_numpy() if i in got.index else np.zeros(states)
    return maximise(row(-1), np.stack([row(-2 - i) for i in range(states)]), emit, shares), float(row(-2 - states)[0])


def train(coded: DataFrame, shares: np.ndarray, dtype: np.dtype, states: int = STATES, rounds: int = ROUNDS, sample: int = SAMPLE, tolerance: float = TOLERANCE) -> tuple[Model, list[float]]:
    """The model, and the log10 likelihood of all rows before each full round. Rounds end when one gains no more than ``tolerance`` of the
    likelihood, and after ``rounds`` at most."""
    m, logs = initial(shares, segments(coded, dtype, sample), dtype, states), []
    for _ in range(rounds):
        m, log = train_round(coded, m, shares, dtype)
        logs.append(log)
        if len(logs) > 1 and log - logs[-2] <= tolerance * abs(log):
            break
    return m, logs


def lexicon(counts: DataFrame, ends: int, listed: int = LISTED, classes: int = CLASSES) -> Lexicon:
    """What tasks need of the corpus counts; bounded by ``listed`` words and HASHED classes whatever the corpus."""
    top = counts.orderBy(F.desc("n"), "word").limit(listed).toArrow()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    classes = min(classes, top.num_rows)
    hashed_n, hashed_v = np.zeros(HASHED), np.zeros(HASHED)
    if top.num_rows > classes or distinct > top.num_rows:
        last = (top["n"][classes - 1].as_py(), top["word"][classes - 1].as_py())
        rest = counts.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1])))
        for r in rest.groupBy((F.crc32(F.col("word")) % HASHED).alias("h")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            hashed_n[r["h"]], hashed_v[r["h"]] = r["n"], r["v"]
    return Lexicon(top["word"].combine_chunks().cast(pa.large_string()), top["n"].to_numpy(), classes, int(total) + ends, int(distinct) + (ends > 0), ends, hashed_n, hashed_v)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, sample: int = SAMPLE) -> DataFrame:
    """Train on the rows where ``held_out`` is false and score all whole texts.

    Returns id_col, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (smoothed unigram) and score, both log10
    probabilities. Null texts are empty: one end. Repeated rows count and score each; a null ``held_out`` is true; without training rows every word is
    unknown and the model is the perturbed start. Columns other than id and text aren't read.

    Word counts, class totals and Baum-Welch counts cover all training rows; only the start of Baum-Welch comes from ``sample`` segments
    of their texts. Full rounds are run until the likelihood settles, ``rounds`` at most. Texts are read twice; the class sequences are written once, in two bytes a token, for the later passes.
    Counts of words beyond the broadcast list are joined, not broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    counts = materialise(count_words(rows.where(~F.col("held_out"))))
    lex = lexicon(counts, rows.where(~F.col("held_out")).count())
    dtype = np.dtype(np.uint16 if lex.size < 1 << 16 else np.int32)
    shared = spark.sparkContext.broadcast(lex)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = shared.value.encode(b.column(3))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(x["n_tokens"], pa.int64()), pa.array(x["n_known"], pa.int64()), pa.array(x["base"]), pa.array(x["inside"]), pa.array(x["codes"], pa.binary()), x["rare"]],
                ["row", "id", "held_out", "n_tokens", "n_known", "base", "inside", "codes", "rare"],
            )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    coded = materialise(numbered.mapInArrow(run, f"row bigint, id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, inside double, codes binary, rare array<string>"))
    m, _ = train(coded.where(~F.col("held_out")), lex.shares(), dtype, states, rounds, sample)
    final = spark.sparkContext.broadcast(Model(*(x.astype(np.float64) for x in (m.start, m.move, m.emit))))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for order, seqs in unpack(b.column(b.num_columns - 1).to_pylist(), dtype):
                out[order] = forward(final.value, seqs)[0]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*b.schema.names[:-1], "chain"])

    scored = coded.select("row", "id", "held_out", "n_tokens", "n_known", "base", "inside", "codes").mapInArrow(likelihood, f"row bigint, id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, inside double, chain double")
    rare = coded.where(F.size("rare") > 0).select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_log"), F.count("n").alias("rare_known"))
    log = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(float(lex.base_denominator))).alias("base_score"),
        (F.col("chain") + F.col("inside") + log).alias("score"),
    )
