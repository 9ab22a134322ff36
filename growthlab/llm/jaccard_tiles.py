"""Exact n-gram Jaccard join with size-banded tiles and bitmap signatures (operator 7).

Two documents link when the Jaccard similarity of their sets of distinct 5-word shingles
is at least 0.8; the result gives each document its component of links.

1. *Sets.*  A map over the texts gives each document's set size and a 128-bit digest of its
   set.  Equal sets form a class, represented by the smallest id; copies go no further.
   The same map counts shingles in a fixed-size table of hashed counters.
2. *Prefixes.*  Shingles are ordered by counter, then hash.  Any total order is exact for
   prefix filtering (two sets of this similarity share a shingle within their first
   n - ceil(0.8 n) + 1); this one puts passages that many documents share last.
3. *Shared shingles.*  Prefix shingles are sorted by hash, within partitions; those of one
   document only, nearly all, are dropped in passing.
4. *Stars.*  In two rounds, each representative is checked against at most two partners of
   other components: those with which it shares most prefix shingles among the hub and the
   preceding document of each shingle, where the hub is the document that shares most of
   its own.  This links large groups of near copies in linear work.
5. *Tiles.*  What can still link different components is finished exactly: rows of a shingle
   go to tiles of neighbouring size bands (a set only links within a factor of 1.25), large
   tiles are split into blocks.  A tile takes a pair only if its shingle can be the first
   that the two share (by its place in both prefixes and the shingles just before it);
   then the bit count of the exclusive-or of two
   signatures bounds the symmetric difference from below, hence the overlap from above,
   before the exact intersection of the sorted arrays.
6. *Components* of the links between representatives, then membership.

No step gathers a group: runs are streamed, tiles have a bounded number of rows, hot
shingles are last in the order, hot classes are one representative.

Defined cases: a null, empty or blank text has the empty set, size 0, and links with
nothing; fewer than five words make one shingle; rows that share an id are one document
whose links are those of all its rows; a row without an id links with nothing and has no
component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlab.functions.ordered import materialize
from growthlab.llm.common import batch_shingles, mix, release, shuffle_width, small_batches, text_of
from growthlab.llm.components import components
from growthlab.session import drop_path, scratch_path

#: Hashed counters, and the slices in which they travel.
COUNTERS, SLICES = 1 << 20, 64
#: Bits of the filter that tells a scan which documents it need not send on.
WANTED = 1 << 23
#: Rows of a shingle and size band that are compared in one block.
BLOCK = 512
#: Signature bits per shingle: in the filter of pairs, and folded to fewer inside tiles.
TIGHT, LOOSE = 8, 1
#: Preceding shared shingles of a prefix by which a tile knows that a pair is another's.
EARLIER = 4
#: Rounds of stars before the tiles.
ROUNDS = 2
#: Width of a size band: sets link only within the same or the next band.
BAND = np.log(1.25)


def _encoded(column) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in column]


def _digest(s: np.ndarray) -> list[int]:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end of the task its counters in slices."""
    total = np.zeros(COUNTERS, np.uint32)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            size, d1, d2 = [], [], []
            for s in batch_shingles(_encoded(batch["text"])):
                np.add.at(total, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                a, b = _digest(s)
                size.append(len(s))
                d1.append(a)
                d2.append(b)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["id", "n", "d1", "d2", "part", "slice", "counts"])
    if total.any():
        parts = total.reshape(SLICES, -1)
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array([TaskContext.get().partitionId() % 256] * SLICES, pa.int32()),
             pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["id", "n", "d1", "d2", "part", "slice", "counts"])


def _counter_sum(rows: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // SLICES, np.uint64)
    for c in rows["counts"]:
        total += np.frombuffer(c.as_py(), np.uint32)
    summed = pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())
    return rows.slice(0, 1).set_column(rows.column_names.index("counts"), "counts", summed)


def signature_bits(n: int, density: int) -> int:
    """Bits of the signature of a set of n shingles: a power of two of at least density * n."""
    return max(64, 1 << int(density * n - 1).bit_length())


def signature(s: np.ndarray, density: int = TIGHT) -> np.ndarray:
    bits = np.zeros(signature_bits(len(s), density), bool)
    bits[(mix(s) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def folded(sig: np.ndarray, size: int) -> np.ndarray:
    """The signature of the same set with fewer bytes."""
    while len(sig) > size:
        sig = sig[: len(sig) // 2] | sig[len(sig) // 2:]
    return sig


def _prefixes(counters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                size, sig, loose, prefix, d1 = [], [], [], [], []
                for s in batch_shingles(_encoded(batch["text"])):
                    n = len(s)
                    size.append(n)
                    d1.append(_digest(s)[0])
                    tight = signature(s) if n else np.zeros(0, np.uint8)
                    sig.append(tight.tobytes())
                    loose.append(folded(tight, signature_bits(n, LOOSE) // 8).tobytes() if n else b"")
                    if n:
                        length = n - (4 * n + 4) // 5 + 1
                        rank = counters[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                        s = s[np.argsort(rank, kind="stable")[:length]].astype(np.int64)
                    prefix.append(s.astype(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(size, pa.int64()), pa.array(d1, pa.int64()),
                                                  pa.array(sig, pa.binary()), pa.array(loose, pa.binary()), lists],
                                                 names=["id", "n", "d1", "sig", "loose", "prefix"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shingle: those whose shingle another row has.  Only the last row
    of a batch is held."""
    names = ("shingle", "id", "n", "d1", "pos")
    held = None  # (the row, whether the row before has the same shingle)
    for batch in batches:
        cols = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([[h], x]) for h, x in zip(held[0], cols)]
        same = cols[0][1:] == cols[0][:-1]
        shared = np.concatenate([[held is not None and held[1]], same])
        shared[:-1] |= same
        held = [int(x[-1]) for x in cols], bool(shared[-1])
        if shared[:-1].any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][shared[:-1]], pa.int64()) for x in cols], names=list(names))
    if held is not None and held[1]:
        yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()) for h in held[0]], names=list(names))


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shingle and falling hub degree: each row with the first row of its
    shingle (kind 0) and with the preceding one (kind 1), where the component differs and
    the sizes allow a link.  Two rows of a shingle are held."""
    names = ("shingle", "id", "n", "comp")
    hub = last = None
    for batch in batches:
        cols = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        m = len(cols[0])
        if not m:
            continue
        if last is not None:
            cols = [np.concatenate([[h, p], x]) for h, p, x in zip(hub, last, cols)]
        shingle, ids, n, comp = cols
        new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(shingle)), 0))
        at = np.arange(len(shingle) - m, len(shingle))
        for kind, other in ((0, first), (1, np.arange(len(shingle)) - 1)):
            o = other[at]
            ok = ~new[at] & (comp[at] != comp[o]) & (5 * np.minimum(n[at], n[o]) >= 4 * np.maximum(n[at], n[o]))
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), kind, np.int32)), pa.array(ids[at][ok]), pa.array(ids[o][ok])],
                                                 names=["kind", "id", "v"])
        hub = [int(x[first[-1]]) for x in cols]
        last = [int(x[-1]) for x in cols]


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by tile: pairs of different components whose signatures allow the
    similarity.  Holds one tile, which has a bounded number of rows."""
    key, tile = None, []

    def pairs():
        ids, n, comp, block, band, pos = (np.array([r[i] for r in tile]) for i in range(6))
        earlier, sig = [[x for x in r[6] if x is not None] for r in tile], [r[7] for r in tile]
        before = np.array([x + [0] * (EARLIER - len(x)) for x in earlier])
        known = np.array([[True] * len(x) + [False] * (EARLIER - len(x)) for x in earlier])
        b1, b2, low = key[2], key[3], key[1]
        width = min(len(s) for s in sig)
        bits = np.stack([folded(np.frombuffer(s, np.uint8), width) for s in sig])
        out = []
        for i in range(len(ids)):
            if band[i] != low or block[i] not in (b1, b2):
                continue
            other = (comp != comp[i]) & ((band > low) | (n > n[i]) | ((n == n[i]) & (ids > ids[i])))
            other &= 5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i])
            if b1 != b2:
                other &= block != block[i]
            # if this is the first shingle of both prefixes that they share, so much can follow
            other &= 9 * np.minimum(n - pos, n[i] - pos[i]) >= 4 * (n + n[i])
            at = np.flatnonzero(other)
            if len(at):  # and it is not, if they share one of the last before it: their pair is another tile's
                again = (before[at][:, :, None] == before[i][None, None, :]) & known[at][:, :, None] & known[i][None, None, :]
                at = at[~again.any((1, 2))]
            if len(at):
                apart = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
                at = at[9 * apart <= n[at] + n[i]]
                out += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in at]
        return out

    def batch_of(found):
        return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    for batch in batches:
        cols = [batch[c].to_pylist() for c in ("shingle", "low", "b1", "b2", "id", "n", "comp", "block", "band", "pos", "earlier", "sig")]
        for r in zip(*cols):
            if r[:4] != key:
                if key is not None and (found := pairs()):
                    yield batch_of(found)
                key, tile = r[:4], []
            tile.append(r[4:])
    if key is not None and (found := pairs()):
        yield batch_of(found)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures allow the similarity."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch[c].to_pylist() for c in ("nu", "nv", "su", "sv"))):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            width = min(len(x), len(y))
            keep.append(9 * int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(dtype=np.int64)) <= n + m)
        yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def plausible(sigs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) that the signatures (id, n, sig) do not rule out."""
    side = lambda a: sigs.select(F.col("id").alias(a), F.col("n").alias("n" + a), F.col("sig").alias("s" + a))
    return (pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "su", "sv")
            .mapInArrow(_bounded, "u long, v long"))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact Jaccard of the pairs' sorted arrays."""
    for batch in batches:
        keep = []
        for x, y in zip(batch["sa"], batch["sb"]):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both) and both > 0)
        yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) & np.uint64(WANTED - 1)).astype(np.int64)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(WANTED, bool)
    for batch in batches:
        bits[_slots(batch["id"].to_numpy(zero_copy_only=False))] = True
    if bits.any():
        rows = np.packbits(bits).reshape(SLICES, -1)
        some = [i for i in range(SLICES) if rows[i].any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(some, pa.int32()), "bits": pa.array([rows[i].tobytes() for i in some], pa.binary())})


def _either(rows: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in rows["bits"]])
    return pa.table({"slice": rows["slice"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def sets_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, s): the sorted set of the documents in the pairs, and of a few others: a filter
    of fixed size decides inside the scan, before anything is shuffled; the join that
    follows is exact."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    found = (ids.mapInArrow(_wanted, "slice int, bits binary").groupBy("slice").applyInArrow(_either, "slice int, bits binary").collect())
    table = np.zeros((SLICES, WANTED // SLICES // 8), np.uint8)
    for r in found:
        table[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    packed = table.reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            slot = _slots(whole["id"].to_numpy(zero_copy_only=False))
            whole = whole.filter(pa.array((packed[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool)))
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [s.tobytes() for s in batch_shingles(_encoded(batch["text"]))]
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], names=["id", "s"])

    return texts.where(F.col("id").isNotNull()).mapInArrow(run, "id long, s binary")


def linked(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of representatives that link, by exact intersection.  A hot partner
    is split by adaptive execution."""
    sets = sets_of(texts, pairs)
    left = pairs.join(sets.withColumnRenamed("id", "u").withColumnRenamed("s", "sa"), "u")
    both = left.join(sets.withColumnRenamed("id", "v").withColumnRenamed("s", "sb"), "v")
    return both.select("u", "v", "sa", "sb").mapInArrow(_verify, "u long, v long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row."""
    spark = docs.sparkSession
    small_batches(spark)
    width = shuffle_width(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of(F.col("text")).alias("text"))
    # 1. sets and counters
    path = scratch_path(spark, "sets")
    texts.mapInArrow(_sets, "id long, n long, d1 long, d2 long, part int, slice int, counts binary").write.parquet(path)
    rows = spark.read.parquet(path)
    kind = "part int, slice int, counts binary"  # summed in two levels, at most 256 rows each in the second
    sums = (rows.where(F.col("slice").isNotNull()).select("part", "slice", "counts")
            .groupBy("part", "slice").applyInArrow(_counter_sum, kind).groupBy("slice").applyInArrow(_counter_sum, kind).collect())
    counters = np.zeros((SLICES, COUNTERS // SLICES), np.uint32)
    for r in sums:
        counters[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    sets = rows.where(F.col("slice").isNull()).select("id", "n", "d1", "d2")
    known = sets.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = known.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    # 2. prefixes of the representatives, 3. the shared ones
    prefix = texts.where(F.col("id").isNotNull()).mapInArrow(
        _prefixes(counters.reshape(-1)), "id long, n long, d1 long, sig binary, loose binary, prefix array<long>")
    own = prefix.join(classes.select(F.col("rep").alias("id"), "n", "d1"), ["id", "n", "d1"], "left_semi")
    own_path = scratch_path(spark, "prefixes")
    own.write.parquet(own_path)
    release(spark)
    own = spark.read.parquet(own_path)
    shared_path = scratch_path(spark, "shared")
    (own.select("id", "n", "d1", F.posexplode("prefix").alias("pos", "shingle")).repartition(width, "shingle")
     .sortWithinPartitions("shingle").select("shingle", "id", "n", "d1", F.col("pos").cast("long").alias("pos"))
     .mapInArrow(_shared, "shingle long, id long, n long, d1 long, pos long")
     .write.parquet(shared_path))
    release(spark)
    shared = spark.read.parquet(shared_path)
    # 4. stars; a hub is a document that shares many shingles, as the source of copies does
    sigs = own.select("id", "n", "sig")
    degree = shared.groupBy("id").agg(F.count("*").alias("degree"))
    comp = spark.createDataFrame([], "node long, component long")
    for _ in range(ROUNDS):
        rows = (shared.join(degree, "id").join(comp.withColumnRenamed("node", "id"), "id", "left")
                .select("shingle", "id", "n", F.coalesce("component", "id").alias("comp"), "degree"))
        near = (rows.repartition(width, "shingle").sortWithinPartitions("shingle", F.desc("degree"), "id").select("shingle", "id", "n", "comp")
                .mapInArrow(_partners, "kind int, id long, v long"))
        best = (near.groupBy("kind", "id", "v").agg(F.count("*").alias("hits"))
                .groupBy("kind", "id").agg(F.max(F.struct("hits", "v"))["v"].alias("v")))
        stars = best.select(F.col("id").alias("u"), "v").distinct()
        stars = materialize(plausible(sigs, stars))
        release(spark)
        # the components so far stand for their links
        links = materialize(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(linked(texts, stars)))
        release(spark)
        comp = components(links)
    # 5. tiles between the components found so far
    order = Window.partitionBy("id", "n", "d1").orderBy("pos")  # one text's prefix; an id may have several
    rows = (shared.join(comp.withColumnRenamed("node", "id"), "id", "left")
            .select("shingle", "id", "n", "d1", "pos", F.coalesce("component", "id").alias("comp"),
                    F.floor(F.log(F.col("n")) / F.lit(float(BAND))).cast("int").alias("band"),
                    F.array(*[F.lag("shingle", k).over(order) for k in range(1, EARLIER + 1)]).alias("earlier")))
    # dealt by shingle once; a shingle's bands are told apart there
    tile = Window.partitionBy("shingle", "low")
    rows = (rows.repartition(width, "shingle").withColumn("low", F.explode(F.array(F.col("band"), F.col("band") - 1)))
            .withColumns({"c1": F.min("comp").over(tile), "c2": F.max("comp").over(tile),
                          "n_blocks": F.ceil(F.count("*").over(tile) / F.lit(BLOCK)).cast("int")})
            .where(F.col("c1") != F.col("c2"))
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
            .select("shingle", "low", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"),
                    "id", "n", "d1", "comp", "block", "band", "pos", "earlier"))
    tiles = (rows.join(own.select("id", "n", "d1", "loose").withColumnRenamed("loose", "sig"), ["id", "n", "d1"]).repartition(width, "shingle", "low", "b1", "b2")
             .sortWithinPartitions("shingle", "low", "b1", "b2")
             .select("shingle", "low", "b1", "b2", "id", "n", "comp", "block", "band", "pos", "earlier", "sig"))
    pairs = tiles.mapInArrow(_tile_pairs, "a long, b long").distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = materialize(plausible(sigs, pairs))
    release(spark)
    links = materialize(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(linked(texts, pairs)))
    release(spark)
    # 6. components of the representatives; an id with rows in several classes joins them
    member = known.join(classes, ["d1", "d2", "n"]).select("id", "rep")
    split = (member.groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where(F.col("v") != F.col("w")))
    same = member.join(split, "id").where(F.col("rep") != F.col("v")).select(F.col("rep").alias("u"), "v")
    comp = components(links.unionByName(same))
    found = (member.groupBy("id").agg(F.min("rep").alias("rep"))
             .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
             .select("id", F.coalesce("component", "rep").alias("component_id")))
    result = materialize(sets.join(found, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")))
    for p in (path, own_path, shared_path):
        drop_path(spark, p)
    return result
