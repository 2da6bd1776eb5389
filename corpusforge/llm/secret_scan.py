"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials they label (state merging, ALERGIA)."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusforge.llm.common import materialise, slices, tidy

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs of 16 and more
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[tuple[Span, str]]:
    """((start, kind index, end), credential) of the fixed patterns, by start, then kind; offsets in code points."""
    out = [((m.start(), 0, m.end()), m[2]) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    out += [((m.start(), 1, m.end()), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [((m.start(), 2, m.end()), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[Span, str]]) -> list[tuple[int, int, str]]:
    """Runs of 12 and more credential characters that no base span touches."""
    starts = [s for (s, _, _), _ in base]
    ends = list(accumulate((e for (_, _, e), _ in base), max, initial=-1))  # the last end of the spans before each
    return [(m.start(), m.end(), m[0]) for m in RUN.finditer(text) if ends[bisect_left(starts, m.end())] <= m.start()]


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- probabilistic automata -------------------------------------------------------------------------------------------

_SIZES = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}


def symbol(c: str) -> str:
    """Character class (digit, a-f, g-z, A-F, G-Z) or the character itself."""
    if "0" <= c <= "9":
        return "d"
    if "a" <= c <= "z":
        return "h" if c <= "f" else "l"
    if "A" <= c <= "Z":
        return "H" if c <= "F" else "U"
    return c


@dataclass(eq=False)
class State:
    count: int = 0
    final: int = 0
    edges: dict[str, int] = field(default_factory=dict)
    next: dict[str, State] = field(default_factory=dict)


def prefix_tree(words: list[str]) -> State:
    root = State()
    for w in words:
        node = root
        node.count += 1
        for c in map(symbol, w):
            node.edges[c] = node.edges.get(c, 0) + 1
            node = node.next.setdefault(c, State())
            node.count += 1
        node.final += 1
    return root


def compatible(a: State, b: State, alpha: float, least: int) -> bool:
    """Hoeffding test of the end and symbol frequencies of two states and of all they reach together."""
    todo, bound, seen = [(a, b)], math.sqrt(0.5 * math.log(2 / alpha)), set()
    while todo:
        p, q = todo.pop()
        if p is q or min(p.count, q.count) < least or (id(p), id(q)) in seen:
            continue
        seen.add((id(p), id(q)))
        room = bound * (1 / math.sqrt(p.count) + 1 / math.sqrt(q.count))
        if abs(p.final / p.count - q.final / q.count) > room:
            return False
        for s in p.next.keys() | q.next.keys():
            x, y = p.next.get(s), q.next.get(s)
            if abs(p.edges.get(s, 0) / p.count - q.edges.get(s, 0) / q.count) > room:
                return False
            if x and y:
                todo.append((x, y))
    return True


def infer(words: list[str], alpha: float = 0.05, least: int = 10) -> Automaton:
    """Merge compatible states of the prefix tree in red-blue order, most frequent first."""
    root = prefix_tree(words)
    red, known = [root], {id(root)}
    while True:
        blue = [(r, s, c) for r in red for s, c in r.next.items() if id(c) not in known]
        if not blue:
            break
        parent, s, node = max(blue, key=lambda x: x[2].count)
        into = next((r for r in red if compatible(r, node, alpha, least)), None)
        if into is None:
            red.append(node)
            known.add(id(node))
            continue
        parent.next[s] = into
        fold = [(into, node)]
        while fold:
            a, b = fold.pop()
            a.count += b.count
            a.final += b.final
            for t, n in b.edges.items():
                a.edges[t] = a.edges.get(t, 0) + n
            for t, c in b.next.items():
                if t in a.next:
                    fold.append((a.next[t], c))
                else:
                    a.next[t] = c
    number = {id(r): i for i, r in enumerate(red)}
    states = []
    for r in red:
        total = sum(r.edges.values()) + r.final + 1.0
        floor = math.log2(0.001 / total)
        states.append(({t: (number[id(c)], math.log2((r.edges[t] + 1e-3) / total) - math.log2(_SIZES.get(t, 1))) for t, c in r.next.items()}, math.log2((r.final + 1e-3) / total), floor))
    return Automaton(states)


@dataclass
class Automaton:
    """Per state: transitions (state, log2 probability of a character), log2 probability of the end, floor for what wasn't seen."""

    states: list[tuple[dict[str, tuple[int, float]], float, float]]

    def log2p(self, word: str) -> float:
        at, total = 0, 0.0
        for c in word:
            moves, _, floor = self.states[at]
            step = moves.get(symbol(c))
            if step is None:
                total += floor - 6  # not in the format: stays, at the floor shared by 64 characters
            else:
                at, total = step[0], total + step[1]
        return total + self.states[at][1]


@dataclass
class SecretModel:
    """One automaton for each labelled kind, the background's with a digit and without one (None if there are too few), and the least
    score (bits a character over the background)."""

    formats: dict[str, Automaton]
    background: list[Automaton | None]
    threshold: float

    def score(self, word: str) -> float:
        """Bits a character by which the likeliest format explains the word better than the background does."""
        if not self.formats:
            return -math.inf
        rest = max(a.log2p(word) if a else -6.5 * len(word) for a in self.background)
        return (max(a.log2p(word) for a in self.formats.values()) - rest) / len(word)


def train(labelled: dict[str, list[str]], other: list[str], keep: float = 0.98) -> SecretModel:
    """Automata of the labelled kinds against two of other candidates, with a digit and without one; the threshold lets the share ``keep`` of labelled ones pass,
    and is 0 (no likelier than background) at least. Other candidates that reach it are as likely credentials as labelled ones are: they
    are kept out of the background, which is inferred anew until that changes no more (five times at most). So how many unlabelled
    credentials there are doesn't move the threshold."""
    formats = {k: infer(sorted(v)) for k, v in labelled.items() if len(v) >= 20}
    m = SecretModel(formats, [None, None], 0.0)
    own = [w for k, v in labelled.items() if k in formats for w in v]
    rest = sorted(other)
    for _ in range(5):
        parts = [[w for w in rest if bool(DIGIT.search(w)) == d] for d in (True, False)]
        m.background = [infer(p) if len(p) >= 20 else None for p in parts]
        if own:
            m.threshold = max(0.0, sorted(map(m.score, own))[int((1 - keep) * (len(own) - 1))])
        before, rest = rest, [w for w in sorted(other) if m.score(w) < m.threshold]
        if rest == before:
            break
    return m


# --- Spark ------------------------------------------------------------------------------------------------------------


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans with their credentials, and candidates, of whole texts; one row per input row, no shuffle."""
    one = "array<struct<s:int,k:int,e:int,v:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("v", pa.string())]))
        for b in slices(batches):
            base, cand = [], []
            for t in b.column(1).to_pylist():
                found = base_spans(t) if t else []
                base.append([{"s": s, "k": k, "e": e, "v": v} for (s, k, e), v in found])
                cand.append([{"s": s, "k": 3, "e": e, "v": v} for s, e, v in candidates(t, found)] if t else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(cand, kind)], [id_col, "base", "cand"])
        tidy()

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, base {one}, cand {one}")


def fit(scanned: DataFrame, sample: int = 400) -> SecretModel:
    """Automata from at most ``sample`` distinct credentials of each kind (least hash first), labelled by the base patterns, and as many
    other candidates with a digit and without one: those of prose are far more."""
    pick = lambda df: [r["v"] for r in df.select("v").distinct().orderBy(F.xxhash64(F.lit("secret"), "v"), "v").limit(sample).collect()]
    base = scanned.where(F.size("base") > 0).select(F.inline("base")).where(F.length("v") <= 4096)
    digit = F.col("v").rlike("[0-9]")
    other = scanned.where(F.size("cand") > 0).select(F.inline("cand")).where(F.length("v") <= 4096)
    return train({KINDS[k]: pick(base.where(F.col("k") == k)) for k in range(3)}, pick(other.where(digit)) + pick(other.where(~digit)))


def report(scanned: DataFrame, m: SecretModel, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, n_format, base_sha256, spans (base ones and candidates that the model accepts)."""
    schema = f"`{id_col}` {dict(scanned.dtypes)[id_col]}, n_assign bigint, n_access bigint, n_hex bigint, n_format bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for base, cand in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                fixed = [(x["s"], x["k"], x["e"]) for x in base]
                more = [(x["s"], x["k"], x["e"]) for x in cand if m.score(x["v"]) >= m.threshold]
                for k in range(3):
                    cols[k].append(sum(x[1] == k for x in fixed))
                cols[3].append(len(more))
                cols[4].append(hashlib.sha256(spell(fixed).encode()).hexdigest())
                cols[5].append(spell(sorted(fixed + more)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], [id_col, "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])

    return scanned.select(id_col, "base", "cand").mapInArrow(run, schema)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 400) -> DataFrame:
    """Scan whole texts, infer the formats from the credentials found, and report all spans.

    Null and empty texts have no spans; repeated rows give repeated results; an empty table gives none. What the scan finds (not the
    texts) is written to the shared folder, so texts are read once. With fewer than 20 distinct credentials of a kind, that kind has
    no automaton. Candidates without a digit are scored too; most are words of prose.
    """
    found = materialise(scan(docs, id_col, text_col))
    return report(found, fit(found, sample), id_col)


def redact(docs: DataFrame, m: SecretModel, text_col: str = "text", mark: str = "<|secret|>", length_col: str = "n_chars") -> DataFrame:
    """Replace each secret span of whole texts (overlapping ones together) by ``mark``; all columns stay, ``length_col`` is kept true
    if there is one. Null texts stay null. No shuffle."""
    names, at = list(docs.columns), list(docs.columns).index(text_col)
    schema = StructType([StructField(f.name, LongType()) if f.name == length_col else f for f in docs.schema.fields])

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        spans = sorted([(s, e) for (s, _, e), _ in base] + [(s, e) for s, e, v in candidates(t, base) if m.score(v) >= m.threshold])
        out, end = [], 0
        for s, e in spans:
            if s >= end:
                out += [t[end:s], mark]
            end = max(end, e)
        return "".join([*out, t[end:]]) if spans else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            text = [clean(t) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(text, pa.string())
            if length_col in names:
                cols[names.index(length_col)] = pa.array([None if t is None else len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names)
        tidy()

    return docs.mapInArrow(run, schema)
