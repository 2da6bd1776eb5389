"""Embedding near-duplicates by NN-descent.

A neighbour graph starts from sorted random projections and is refined by joining each node's neighbours with one another, until few
lists change. Its edges at the threshold give components. A full list whose last edge still reaches the threshold may hide links to
another component, so the vectors with such lists are compared exactly across components. Links inside a component are then counted
exactly, block against block, so that a list of k neighbours never caps a vector's links. An audit against all rows decides whether
lists must grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import discard, materialise
from corpusforge.llm.graph import components

BLOCK = 512
WIDE = 2048
LARGE = 1 << 20


def unit(rows: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision; a power of two keeps squares of any double within range."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of one key (the first ``keys`` columns) together, from batches sorted by key; a key's rows are assumed to be few."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*rest, b]).combine_chunks().to_batches()[0]
        cols = [t.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(t.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = np.concatenate([[0], np.flatnonzero(new)])
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield t.slice(i, j - i)
        rest = [t.slice(int(cut[-1]))]
    if rest:
        yield rest[0]


def by_key(df: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


EDGES = "u bigint, v bigint, sim double"


def seeds(vectors: DataFrame, tables: int, window: int, bits: int, seed: int) -> DataFrame:
    """First edges: in each table, vectors in the order of their random hyperplane signs, then of a random projection, meet the next few."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = unit(part.column(3))
                for t in range(tables):
                    p = x @ np.random.default_rng([seed, t, int(dim)]).normal(size=(int(dim), bits + 1))
                    code = (p[:, :bits] > 0) @ (1 << np.arange(bits))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), part.column(1), part.column(2), pa.array(code, pa.int64()), pa.array(p[:, bits]), part.column(0), part.column(3)], ["t", "label", "dim", "code", "p", "id", "vec"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, ids = [b.column(i).to_numpy() for i in range(4)], b.column(5).to_numpy()
            out = []
            for dim in np.unique(keys[2]):
                at = np.flatnonzero(keys[2] == dim)
                x = unit(b.column(6).take(pa.array(at)))
                for w in range(1, window + 1):
                    i, j = at[:-w], at[w:]
                    same = np.all([k[i] == k[j] for k in keys], axis=0)
                    s = (x[:-w][same] * x[w:][same]).sum(axis=1)
                    out += [(ids[i[same]], ids[j[same]], s), (ids[j[same]], ids[i[same]], s)]
            u, v, s = (np.concatenate([o[c] for o in out]) for c in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["u", "v", "sim"])

    rows = vectors.select("id", "label", "dim", "vec").mapInArrow(sign, f"t int, label int, dim int, code bigint, p double, id bigint, vec {dict(vectors.dtypes)['vec']}")
    order = ["t", "label", "dim", "code", "p", "id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(meet, EDGES)


def nearest(edges: DataFrame, k: int, by: str = "u", other: str = "v") -> DataFrame:
    """The k best distinct edges of each node; Spark limits each group before and after the shuffle."""
    return edges.distinct().withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sim"), other))).where(F.col("r") <= k).drop("r")


def refine(vectors: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Neighbours of neighbours: at each node its neighbours, forward and reverse, meet; edges that beat a list's last one are kept."""
    last = graph.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("c")).select(F.col("u").alias("m"), F.when(F.col("c") < k, F.lit(-2.0)).otherwise(F.col("low")).alias("low"))
    back = nearest(graph, k, "v", "u").select(F.col("v").alias("c"), F.col("u").alias("m"))
    members = graph.select(F.col("u").alias("c"), F.col("v").alias("m")).unionByName(back).distinct()
    rows = members.join(last, "m", "left").join(vectors.select(F.col("id").alias("m"), "vec"), "m").select("c", "m", F.coalesce("low", F.lit(-2.0)).alias("low"), "vec")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            u, v, s = (np.concatenate([o[i] for o in out]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s)], ["u", "v", "sim"])

        for g in groups(batches, 1):
            ids, low, x = g.column(1).to_numpy(), g.column(2).to_numpy(), unit(g.column(3))
            s = x @ x.T
            i, j = np.nonzero((s > low[:, None]) & ~np.eye(len(ids), dtype=bool))
            out.append((ids[i], ids[j], s[i, j]))
            if len(out) >= 2000:
                yield flush()
                out = []
        if out:
            yield flush()

    return by_key(rows, ["c"], meet, EDGES)


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, n): weighted links of each member (root, id, weight, vec) inside its component, by pairs of blocks.

    A component of up to 16 * BLOCK vectors has blocks of BLOCK; of a larger one they grow to LARGE numbers, so its vectors are sent as
    often as it has blocks (a million of 64 numbers: 62 times). Every pair of blocks is a group of its own; only counts leave it.
    """
    most = F.greatest(F.lit(BLOCK), F.floor(F.lit(LARGE) / F.max(F.size("vec"))))
    size = members.groupBy("root").agg(F.greatest(F.least(F.ceil(F.count("*") / BLOCK), F.lit(16)), F.ceil(F.count("*") / most)).cast("int").alias("blocks"))
    dealt = members.join(size, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = dealt.select("root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "id", "weight", "vec")
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "weight", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, rows = [], [], 0
        for g in groups(batches, 3):
            i, j = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            own, name, weight, x = g.column(3).to_numpy(), g.column(4).to_numpy(), g.column(5).to_numpy(), unit(g.column(6))
            n = np.zeros(len(x), np.int64)
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            y = x[b]
            for at in range(0, len(a) if len(b) else 0, step := max(1, 4_000_000 // max(1, len(b)))):
                some = a[at : at + step]
                near = x[some] @ y.T >= threshold
                n[some] += near @ weight[b]
                if i != j:
                    n[b] += weight[some] @ near
            if i == j:
                n -= weight  # a class's own copies are added by the caller
            ids.append(name), counts.append(n)
            rows += len(name)
            if rows > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts).astype(np.int64))], ["id", "n"])
                ids, counts, rows = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts).astype(np.int64))], ["id", "n"])

    return by_key(rows, ["root", "i", "j"], run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def bridges(members: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links between the roots of members (label, dim, root, id, vec), each pair of them compared, by blocks of about WIDE vectors.

    Every pair of a label's blocks is a group of its own; fewer links leave it than it has vectors, since roots that met are one from then on.
    """
    size = members.groupBy("label", "dim").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") < F.col("high"))
    dealt = members.join(size.select("label", "dim", "blocks"), ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = dealt.select("label", "dim", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "root", "vec")
    rows = rows.select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "root", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 4):
            root, x, out = g.column(4).to_numpy().copy(), unit(g.column(5)), []
            for at in range(0, len(x), BLOCK):
                near = x[at : at + BLOCK] @ x.T >= threshold
                for i in np.flatnonzero((near & (root[at : at + BLOCK, None] != root[None, :])).any(axis=1)):
                    own = root[at + i]
                    other = np.unique(root[near[i] & (root != own)])
                    if len(other):
                        out += [(own, o) for o in other]
                        root[np.isin(root, other)] = own
            if out:
                u, v = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return by_key(rows, ["label", "dim", "i", "j"], run, "u bigint, v bigint")


def join_roots(vectors: DataFrame, roots: DataFrame, some: DataFrame, threshold: float) -> DataFrame:
    """``roots`` (node, root) after all vectors whose id is in ``some`` are compared exactly with those of other components."""
    named = vectors.join(roots.withColumnRenamed("node", "id"), "id", "left")
    members = named.join(some, "id", "left_semi").select("label", "dim", F.coalesce("root", "id").alias("root"), "id", "vec")
    found = materialise(bridges(members, threshold))
    if found.isEmpty():
        return roots
    top = components(found).select(F.col("node").alias("was"), F.col("root").alias("top"))
    joined = named.select("id", "root", F.coalesce("root", "id").alias("was")).join(top, "was", "left").where(F.col("root").isNotNull() | F.col("top").isNotNull())
    return materialise(joined.select(F.col("id").alias("node"), F.coalesce("top", "was").alias("root")))


def audit(vectors: DataFrame, found: DataFrame, threshold: float, queries: int, seed: int) -> float:
    """Least recall of a bounded, seeded set of queries, half of them from all vectors and half from those with links, which all rows are
    compared with: the mean share of a query's true links that
    were found, by number of true links (1, 2 to 3, 4 to 7 and so on), so that a large group can't hide what small ones lost."""
    pick = lambda df: df.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(queries // 2).select("id", "label", "dim", "vec")
    some = pick(vectors).union(pick(vectors.join(found.where(F.col("n") > 0).select("id"), "id", "left_semi"))).distinct().toArrow()
    if not some.num_rows:
        return 1.0
    shared = vectors.sparkSession.sparkContext.broadcast((some["id"].to_numpy(), some["label"].to_numpy(), some["dim"].to_numpy(), some["vec"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, dims, vecs = shared.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            for dim in np.unique(dims):
                q, rows = np.flatnonzero(dims == dim), b.filter(pa.array(b.column(2).to_numpy() == dim))
                if not rows.num_rows:
                    continue
                y = np.array([vecs[i] for i in q], np.float64)
                y /= np.linalg.norm(y, axis=1, keepdims=True)
                near = (y @ unit(rows.column(3)).T >= threshold) & (labels[q][:, None] == rows.column(1).to_numpy()[None, :]) & (ids[q][:, None] != rows.column(0).to_numpy()[None, :])
                total[q] += near @ rows.column(4).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "truth"])

    truth = vectors.select("id", "label", "dim", "vec", "weight").mapInArrow(run, "id bigint, truth bigint").groupBy("id").agg(F.sum("truth").alias("truth"))
    share = truth.join(found, "id", "left").where(F.col("truth") > 0).select(F.floor(F.log2("truth")).alias("size"), (F.least("truth", F.coalesce("n", F.lit(0))) / F.col("truth")).alias("share"))
    r = share.groupBy("size").agg(F.avg("share").alias("share")).agg(F.min("share")).first()
    return 1.0 if r[0] is None else r[0]


def near_duplicates(table: DataFrame, threshold: float = 0.98, k: int = 10, tables: int = 10, rounds: int = 5, recall: float = 0.995, queries: int = 512, seed: int = 23) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row (columns vec_id, embedding, label; others aren't read).

    Vectors compare within equal, non-null labels and equal lengths. Null, empty or zero vectors, ones with null or non-finite
    components, and rows with a null vec_id or label have no links and are their own component. Equal vectors of a label are one node
    with a weight (repeated rows too). Vectors whose lists are full at the threshold are compared with all such of other components,
    whatever the audit says: in arithmetic, quadratic in their number within a label. If the audit finds less than ``recall``, k and the tables double, twice at most;
    if the last graph fails too, all vectors of a label are compared exactly across components (quadratic in arithmetic).
    """
    kind = "double" if "double" in dict(table.dtypes)["embedding"] or "decimal" in dict(table.dtypes)["embedding"] else "float"
    vec = F.transform("embedding", lambda x: x.cast(kind))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(F.coalesce(ok, F.lit(False)), vec).alias("vec"), F.col("label").cast("int").alias("label"))
    good = rows.where(F.col("vec").isNotNull())
    vectors = materialise(good.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).withColumn("dim", F.size("vec")))
    # an id may have several rows with other vectors; nodes are then told apart by their number
    vectors = materialise(vectors.withColumn("first", F.col("id")).withColumn("id", F.monotonically_increasing_id()))
    members = lambda: vectors.join(roots.withColumnRenamed("node", "id"), "id").select("root", "id", "weight", "vec")
    for attempt in range(3):
        graph = materialise(nearest(seeds(vectors, tables, 3, 10, seed + attempt), k))
        for _ in range(rounds):
            better = materialise(nearest(graph.unionByName(refine(vectors, graph, k)), k))
            changed = better.join(graph, ["u", "v"], "left_anti").count()
            discard(graph)
            graph = better
            if changed <= 0.001 * k * max(1, vectors.count()):
                break
        near = graph.where(F.col("sim") >= threshold)
        roots = components(near.select("u", "v"))
        # a link that neither end's list holds has two full lists of better ones
        full = graph.groupBy("u").agg(F.count("*").alias("c"), F.min("sim").alias("low")).where((F.col("c") >= k) & (F.col("low") >= threshold))
        roots = join_roots(vectors, roots, full.select(F.col("u").alias("id")), threshold)
        counts = materialise(count_links(members(), threshold))
        if audit(vectors, counts, threshold, queries, seed) >= recall:
            break
        k, tables = 2 * k, 2 * tables
    else:
        roots = join_roots(vectors, roots, vectors.select("id"), threshold)
        counts = materialise(count_links(members(), threshold))
    named = vectors.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    known = named.join(least, "root").join(counts, "id", "left").select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    out = rows.join(known, ["label", "vec"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
