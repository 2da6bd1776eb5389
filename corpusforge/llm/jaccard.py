"""N-gram Jaccard join by vertical partitioning.

The space of shingle hashes is cut into fragments. Fragment by fragment, the documents of each shingle are counted, which gives the global
order of shingles: frequency, then hash. A pair at the threshold shares a shingle among the first ones of both in that order, and its place
there bounds the overlap; that gives the candidates. Their partial overlaps are counted separately in each fragment and summed by pair.
Equal shingle sets are one class from the start, and pairs that already are in one component needn't be verified, so groups of near copies
cost a few pairs a document instead of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from corpusforge.llm.common import discard, flatten, materialise, mix, release, repeatable, shingle_hashes, slices, tidy, unique_by_doc, word_hashes
from corpusforge.llm.graph import components

FRAGMENTS = 8  # of the sets, in verification
BLOCK = 1_000_000  # shingles that a task sorts at once
LOW_BITS = 40  # of a shingle's name within its fragment, in counting
OFTEN = 8  # a shingle that more documents of a block have goes to its fragment once, with their number
STAR_ROUNDS = 3
FEW = 500_000  # rows that may be broadcast


def sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, by document and then hash, with their documents."""
    w, wd = word_hashes(buf, offsets)
    return unique_by_doc(*shingle_hashes(w, wd, len(offsets) - 1, k))


def set_keys(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each document's set: equal for equal sets."""
    out = []
    for salt in (0x51_7CC1_B727_2202, 0x2545_F491_4F6C_DD1D):
        c = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(salt)))])
        out.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _packed(x: np.ndarray) -> bytes:
    """56-bit values in 7 bytes each."""
    return x.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


def _blocks(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """(at, block, kind, data, counts): what each block of documents (columns row, id, text) sends by way of fragment ``at``.

    kind 0: its rows (Arrow: row, id, n, k1, k2, own); of rows with equal sets the first alone has its shingles sent. kind 1: shingles with
    more than OFTEN documents (names, numbers, documents). kind 2: 40 bits of each shingle and 16 of its document, in order; a shingle of
    kind 1 comes once, as of document 65,535, and ``counts`` has its number.
    """
    low = np.uint64(LOW_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = [0, 0]

        def flush() -> pa.RecordBatch:
            n, k1, k2 = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
            first = np.cumsum([0, *(x[0].num_rows for x in held)])
            name = np.concatenate([x[1] for x in held]) >> np.uint64(64 - bits - LOW_BITS)
            doc = np.repeat(np.arange(len(n)), n)
            _, one = np.unique(np.stack([k1, k2], 1), axis=0, return_index=True)
            own = np.zeros(len(n), bool)
            own[one] = True
            name, doc = name[own[doc]], doc[own[doc]]
            order = np.argsort(name, kind="stable")
            name, doc = name[order], doc[order]
            start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
            count = np.diff(start, append=len(name))
            many = np.repeat(count > OFTEN, count)
            keep = ~many
            keep[start] = True
            rows = pa.concat_tables([pa.Table.from_batches([x[0].select(["row", "id"])]) for x in held]).combine_chunks()
            for c, values in (("n", n), ("k1", k1), ("k2", k2), ("own", own)):
                rows = rows.append_column(c, pa.array(values))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_table(rows)
            block = held[0][0].column(0)[0].as_py()
            hot = count > OFTEN
            names, numbers, docs = name[start[hot]], count[hot].astype(np.uint32), doc[many].astype(np.uint16)
            mark = np.where(many, np.uint64(0xFFFF), doc.astype(np.uint64))[keep]
            own_count = np.repeat(count, count)[keep].astype(np.uint32)
            kept, often = name[keep], many[keep]
            cut = np.searchsorted(kept >> low, np.arange((1 << bits) + 1, dtype=np.uint64))
            packed = ((kept & np.uint64((1 << LOW_BITS) - 1)) << np.uint64(16)) | mark
            via = block % 1_000_003 % (1 << bits)
            out: list[tuple[int, int, bytes, bytes]] = [(via, 0, sink.getvalue().to_pybytes(), b"")]
            if len(names):
                out.append((via, 1, names.tobytes() + docs.tobytes(), numbers.tobytes()))
            for f in np.flatnonzero(np.diff(cut)):
                a, b = cut[f], cut[f + 1]
                out.append((int(f), 2, _packed(packed[a:b]), own_count[a:b][often[a:b]].tobytes()))
            held.clear()
            size[:] = [0, 0]
            at, kind, data, counts = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([block] * len(at), pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()), pa.array(counts, pa.binary())], ["at", "block", "kind", "data", "counts"])

        for b in slices(batches):
            for part in (b.slice(i, 30_000) for i in range(0, b.num_rows, 30_000)):
                s, sd = sets(*flatten(part.column(2)), k)
                at = np.searchsorted(sd, np.arange(part.num_rows + 1))
                held.append((part, s, np.diff(at), *set_keys(s, at)))
                size[0] += len(s)
                size[1] += part.num_rows
                if size[0] > BLOCK or size[1] > 30_000:
                    yield flush()
        if held:
            yield flush()
        tidy()

    return docs.mapInArrow(run, "at bigint, block bigint, kind int, data binary, counts binary")


def _counted(blocks: DataFrame) -> DataFrame:
    """(block, at, kind, data): shingles that more than one document has go back to the blocks, 8 bits of log frequency with each."""

    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        passed = t.filter(pa.array(kind < 2))
        out = [passed.select(["block", "at", "kind", "data", "counts"])]
        t = t.filter(pa.array(kind == 2))
        if t.num_rows:
            raw = t.column("data").to_pylist()
            x = _unpacked(b"".join(raw))
            numbers = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint32)
            owner = np.repeat(np.arange(t.num_rows), [len(r) // 7 for r in raw])
            del raw
            weight = np.ones(len(x), np.int64)
            weight[(x & np.uint64(0xFFFF)) == 0xFFFF] = numbers
            names, at = np.unique(x >> np.uint64(16), return_inverse=True)
            f = np.bincount(at, weight, len(names))
            code = np.where(f > 1, np.clip(np.round(4 * np.log2(f)), 1, 255), 0).astype(np.uint64)[at]
            keep = code > 0
            x, owner = (x | (code << np.uint64(56)))[keep], owner[keep]
            cut = np.searchsorted(owner, np.arange(t.num_rows + 1))
            full = np.flatnonzero(np.diff(cut))
            out.append(pa.table([t.column("block").take(pa.array(full)), t.column("at").take(pa.array(full)), pa.array(np.full(len(full), 2, np.int32)), pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()), pa.array([b""] * len(full), pa.binary())], names=["block", "at", "kind", "data", "counts"]))
        tidy()
        return pa.concat_tables([x.cast(schema) for x in out])

    schema = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()), ("counts", pa.binary())])
    return blocks.groupBy("at").applyInArrow(run, "block bigint, at bigint, kind int, data binary, counts binary")


def _signed(counted: DataFrame, percent: int, id_type: DataType) -> DataFrame:
    """row, id, n (set size), k1, k2 (set keys), tokens: names of those of the first n - ceil(percent * n / 100) + 1 shingles in global
    order that other documents have too, and first: the place of the first of them. Only one of equal sets in a block has tokens."""

    schema = StructType([StructField("row", LongType()), StructField("id", id_type), *(StructField(c, LongType()) for c in ("n", "k1", "k2", "first")), StructField("tokens", ArrayType(LongType()))])

    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        rows = pa.ipc.open_stream(t.filter(pa.array(kind == 0)).column("data")[0].as_buffer()).read_all()
        n, own = rows.column("n").to_numpy(), rows.column("own").to_numpy()
        mine = t.filter(pa.array(kind == 2))
        raw = mine.column("data").to_pylist()
        x = np.frombuffer(b"".join(raw), np.uint64)
        code = (x >> np.uint64(56)).astype(np.int64)
        doc = (x & np.uint64(0xFFFF)).astype(np.int64)
        name = (np.repeat(mine.column("at").to_numpy(), [len(r) // 8 for r in raw]) << LOW_BITS) | ((x >> np.uint64(16)) & np.uint64((1 << LOW_BITS) - 1)).astype(np.int64)
        for data, counts in zip(*(t.filter(pa.array(kind == 1)).column(c).to_pylist() for c in ("data", "counts")), strict=True):
            numbers = np.frombuffer(counts, np.uint32).astype(np.int64)
            names = np.frombuffer(data[: 8 * len(numbers)], np.uint64).astype(np.int64)
            docs = np.frombuffer(data[8 * len(numbers) :], np.uint16).astype(np.int64)
            often = doc == 0xFFFF
            order = np.argsort(name[often])
            codes = code[often][order][np.searchsorted(name[often][order], names)]
            code = np.concatenate([code[~often], np.repeat(codes, numbers)])
            name = np.concatenate([name[~often], np.repeat(names, numbers)])
            doc = np.concatenate([doc[~often], docs])
        order = np.lexsort((name, code, doc))
        doc, name = doc[order], name[order]
        at = np.searchsorted(doc, np.arange(len(n) + 1))
        first = np.where(own, n - np.diff(at), n)
        prefix = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
        size = np.clip(prefix - first, 0, np.diff(at))
        ends = np.concatenate([[0], np.cumsum(size)])
        pick = np.arange(ends[-1]) + np.repeat(at[:-1] - ends[:-1], size)
        return pa.table([*(rows.column(c) for c in ("row", "id", "n", "k1", "k2")), pa.array(first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(name[pick]))], names=["row", "id", "n", "k1", "k2", "first", "tokens"])

    return counted.groupBy("block").applyInArrow(run, schema)


def signatures(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """One row a document (columns row, id, text), as :func:`_signed` gives them. Every shingle of every document is counted; 7 bytes of
    each are shuffled. There are four fragments a partition of the input or of a shuffle, so a fragment has the shingles of some 50 MB."""
    spark = rows.sparkSession
    parts = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = min(max((4 * parts - 1).bit_length(), 6), 22)
    return _signed(_counted(_blocks(rows, k, bits)), percent, rows.schema["id"].dataType)


def fragments(texts: DataFrame, k: int) -> DataFrame:
    """(cls, frag, part): the fragments of each set (columns cls, k1, k2, text), cut at fixed places of the hash order, as sorted bytes."""
    top = np.uint64(64 - FRAGMENTS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s, sd = sets(*flatten(b.column(3)), k)
            at = np.searchsorted(sd, np.arange(b.num_rows + 1))
            k1, k2 = set_keys(s, at)
            if (k1 != b.column(1).to_numpy()).any() or (k2 != b.column(2).to_numpy()).any():
                raise ValueError("the input gives other rows when it is read again")
            part = []
            for i in range(b.num_rows):
                own = s[at[i] : at[i + 1]]
                cut = np.searchsorted(own >> top, np.arange(FRAGMENTS + 1))
                part += [own[cut[f] : cut[f + 1]].tobytes() for f in range(FRAGMENTS)]
            cls = np.repeat(b.column(0).to_numpy(), FRAGMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), b.num_rows)), pa.array(part, pa.binary())], ["cls", "frag", "part"])

    return texts.select("cls", "k1", "k2", "text").mapInArrow(run, "cls bigint, frag int, part binary")


def verify(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (u, v, n_u, n_v) with 100 * intersection >= percent * union: overlaps by fragment, summed by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.zeros(b.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(b.column(4), b.column(5), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                if len(p):
                    both[i] = (q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(both)], ["u", "v", "n_u", "n_v", "both"])

    left = parts.select(F.col("cls").alias("u"), "frag", F.col("part").alias("p_u"))
    right = parts.select(F.col("cls").alias("v"), "frag", F.col("part").alias("p_v"))
    met = pairs.join(left, "u").join(right, ["v", "frag"]).select("u", "v", "n_u", "n_v", "p_u", "p_v")
    summed = met.mapInArrow(run, "u bigint, v bigint, n_u bigint, n_v bigint, both bigint").groupBy("u", "v", "n_u", "n_v").agg(F.sum("both").alias("both"))
    return summed.where((100 + percent) * F.col("both") >= percent * (F.col("n_u") + F.col("n_v"))).select("u", "v")


def _may_link(percent: int, n: Column, pos: Column, n2: Column, pos2: Column) -> Column:
    """Whether two sets whose first common shingle has these places may reach the threshold. What precedes it in either isn't common; pairs
    that share an earlier one meet there too, so no link is lost."""
    need = percent * (n + n2)
    return ((100 + percent) * (n - pos) >= need) & ((100 + percent) * (n2 - pos2) >= need) & (100 * F.least(n, n2) >= percent * F.greatest(n, n2))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles and component_id (least id reachable by links, itself included): one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased; a set has the distinct k-word shingles, of shorter texts the one
    of all their words. Null texts and texts without words have an empty set and link with nothing. Repeated rows and equal sets link;
    a null id stays null and counts last among its component's ids. Columns other than id and text aren't read. An empty table gives none.

    Shingles are 64-bit hashes, sets are told apart by 128 bits. Candidates are pairs that meet at a shingle whose places in both allow the
    threshold: first, at most STAR_ROUNDS times, in each bucket a member of each component with one of the component that has most members
    there, while the buckets have more pairs of different components than members; and then all pairs of a bucket that still lie in
    different components.
    """
    spark = docs.sparkSession
    rows, own = repeatable(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    sig = materialise(signatures(rows, k, percent))
    release(spark)
    full = sig.where(F.col("n") > 0)
    total, size = sig.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    classes = materialise(full.groupBy("k1", "k2").agg(F.min("row").alias("cls"), F.min(F.struct(F.col("id").isNull(), "id")).getField("id").alias("id")), rows=total)
    # a class's least row is the first of its sets in its block, and so has tokens
    tokens = full.where(F.size("tokens") > 0).join(classes.select(F.col("cls").alias("row")), "row", "left_semi")
    tokens = tokens.select(F.col("row").alias("cls"), "n", "first", F.posexplode("tokens").alias("i", "h")).select("h", "cls", "n", (F.col("first") + F.col("i")).alias("pos"))
    # in the smaller set of a pair, the shingle is among the first n - ceil(2 * percent * n / (100 + percent)) + 1
    early = (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")
    tokens = materialise(tokens.withColumn("early", early), rows=size)
    useful = tokens.groupBy("h").agg(F.count("*").alias("c"), F.max("early").alias("early")).where((F.col("c") > 1) & F.col("early")).select("h")
    buckets = materialise(tokens.join(useful, "h", "left_semi"), rows=size)
    discard(tokens)
    wanted = materialise(buckets.select("cls").distinct().join(classes.select("cls", "k1", "k2"), "cls"), rows=min(total, size))
    few = wanted.count() <= FEW
    parts = materialise(fragments(rows.join(F.broadcast(wanted) if few else wanted, F.col("row") == F.col("cls")), k))
    release(spark)
    discard(wanted, *own)

    roots, tried, size = None, None, buckets.count()  # the tokens that count
    for i in range(STAR_ROUNDS + 1):
        if roots is None:
            rooted = buckets.withColumn("root", F.col("cls"))
        else:
            rooted = buckets.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        rooted = materialise(rooted, rows=size)
        # of each component in a bucket, the member with the fewest shingles before this one links with most of the others; or any one
        order = F.col("pos") / F.col("n") if i % 2 == 0 else F.lit(0.0)
        member = F.min(F.struct(order.alias("o"), F.xxhash64(F.lit(i), "h", "cls").alias("x"), "cls", "n", "pos")).alias("m")
        members = rooted.groupBy("h", "root").agg(F.count("*").alias("c"), F.max("early").alias("early"), member)
        members = materialise(members.select("h", "root", "c", "early", "m.*"), rows=size)
        centre = F.min(F.struct((-F.col("c")).alias("c"), "o", "x", "cls", "n", "pos", "root")).alias("m")
        apart = F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))
        open_ = members.groupBy("h").agg(centre, F.count("*").alias("roots"), F.max("early").alias("early"), apart.cast("double").alias("apart")).where((F.col("roots") > 1) & F.col("early"))
        open_ = materialise(open_.select("h", "m.cls", "m.n", "m.pos", "m.root", "apart"), rows=size)
        left = open_.agg(F.sum("apart")).first()[0] or 0
        last = i == STAR_ROUNDS or left <= size
        other = F.col("cls").alias("v"), F.col("n").alias("n_v"), F.col("pos").alias("pos_v"), F.col("root").alias("root_v")
        if last:
            rest = rooted.join(open_.select("h"), "h", "left_semi")
            found = rest.join(rest.where("early").select("h", *other), "h")
        else:
            found = members.join(open_.select("h", *other), "h")
        ok = (F.col("root") != F.col("root_v")) & _may_link(percent, F.col("n"), F.col("pos"), F.col("n_v"), F.col("pos_v"))
        swap = F.col("cls") > F.col("v")
        one = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
        found = found.where(ok).select(one("cls", "v").alias("u"), one("v", "cls").alias("v"), one("n", "n_v").alias("n_u"), one("n_v", "n").alias("n_v"), F.lit(False).alias("old"))
        if tried is not None:
            found = found.unionByName(tried.withColumn("old", F.lit(True)))
        found = materialise(found.groupBy("u", "v", "n_u", "n_v").agg(F.max("old").alias("old")).where(~F.col("old")).drop("old"), rows=int(left if last else size))
        if not found.isEmpty():
            tried = found if tried is None else tried.unionByName(found)
            new = materialise(verify(found, parts, percent), rows=FRAGMENTS * found.count())
            if not new.isEmpty():
                links = new if roots is None else new.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
                before, roots = roots, components(links)
                if before is not None:
                    discard(before)
            discard(new)
        discard(rooted, members, open_)
        release(spark)
        if last:
            break
    discard(buckets, parts)
    if roots is None:
        named = classes.withColumn("root", F.col("cls"))
    else:
        named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id")).getField("id").alias("component"))
    named = named.join(least, "root").select("k1", "k2", "component")
    return sig.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
