"""Benchmark decontamination by latent semantic retrieval (operator 2).

1. *Words.*  A map over the texts writes each document's words as 16-bit slots, and counts
   in how many documents each slot is.
2. *TF-IDF and SVD.*  Passages are half-overlapping runs of ``PASSAGE`` words of all
   documents, over the vocabulary of the benchmark items (other words cannot match),
   weighted by inverse document frequency; slots found in more than ``MAX_SHARE`` of the
   documents weigh nothing.  The leading right singular vectors of the passage matrix A
   come from one randomised pass over all passages: Y = A'(A G) for a random G, an
   orthonormal basis Q of Y, and the eigenvectors of the small Q'A'AQ recovered from the
   same Y.  All sums are slots x rank, a bounded size.
3. *Search.*  Every passage is projected and compared with the passages of the benchmark
   items by cosine; items are taken in blocks, over one vocabulary and basis.  Whatever
   reaches ``MIN_COSINE`` is a candidate; passages too short to reach it are skipped
   beforehand.  Beside that, the rarest word of each item of ``LEAST_EXACT`` words or more
   is looked up in all texts; where a neighbour in the item stands beside it too, the place
   is a candidate, so no exact copy depends on the rank of the projection.
4. *Checks.*  For a candidate, the longest common subsequence of the item and the words
   around the passage must hold ``MIN_COMMON`` of the item's words, and ``MIN_ANSWER`` of
   its most informative words (the answer) must be among them.

Every document and passage takes part; there is no shuffle of texts or passages, only of
the fixed-size sums, and no join on a key that could be hot.

Defined cases: null and empty texts match nothing; items without a word match nothing;
null ids are reported as null; repeated rows are reported alike; an empty benchmark or
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.functions.ordered import materialize
from growthlab.llm.common import ALNUM, batch_words, small_batches, text_of
from growthlab.session import drop_path, scratch_path

SLOTS, SLICES = 1 << 16, 64
#: Rank of the projection: a word of the vocabulary in RANK_SHARE, within these bounds.
LEAST_RANK, MOST_RANK, RANK_SHARE = 96, 512, 64
#: Items of fewer words have no exact lookup: they say too little to tell a leak from chance.
LEAST_EXACT = 4
PASSAGE = 32
STEP = PASSAGE // 2
#: Words found in a larger share of the documents weigh nothing, but an item keeps its
#: LEAST_WORDS rarest ones.
MAX_SHARE, LEAST_WORDS = 0.03, 6
#: A candidate's cosine; a passage shorter than FLOOR times the query counts as that long.
MIN_COSINE, FLOOR = 0.45, 0.6
MIN_COMMON, MIN_ANSWER = 0.6, 0.5
#: Benchmark items searched for in one pass over the passages, and words handled at a time.
ITEMS_PER_BLOCK = 20_000
GROUP = 200_000


def _encoded(column) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in column]


def words_of(texts: list[bytes]) -> list[np.ndarray]:
    """16-bit word features of each text (A-Z lower-cased, letters and digits only)."""
    words, bounds = batch_words(texts, ALNUM)
    words = (words >> np.uint64(48)).astype(np.uint16)
    return [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, words) rows, and at the end the document counts of the slots in slices."""
    total, n_docs, kind = np.zeros(SLOTS, np.int64), 0, None
    for whole in batches:
        kind = whole["doc_id"].type
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            found = words_of(_encoded(batch["text"]))
            for w in found:
                total[np.unique(w)] += 1
            n_docs += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([w.tobytes() for w in found], pa.binary()), pa.nulls(batch.num_rows, pa.int32()),
                 pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())],
                names=["doc_id", "words", "part", "slice", "sums"])
    if n_docs:
        rows = [*np.split(total.astype(np.float64), SLICES), np.array([n_docs], np.float64)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(rows), kind), pa.nulls(len(rows), pa.binary()), pa.array([TaskContext.get().partitionId() % 256] * len(rows), pa.int32()),
             pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
            names=["doc_id", "words", "part", "slice", "sums"])


def _summed(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(r.as_py(), np.float64) for r in rows["sums"])
    return rows.slice(0, 1).set_column(rows.column_names.index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))


def _collected(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the slices over all tasks, in two levels of at most 256 parts in the second."""
    kind = "part int, slice int, sums binary"
    found = (rows.select("part", "slice", "sums").groupBy("part", "slice").applyInArrow(_summed, kind)
             .groupBy("slice").applyInArrow(_summed, kind).collect())
    return {r["slice"]: np.frombuffer(r["sums"], np.float64) for r in found}


def _gaussian(n: int) -> np.ndarray:
    rank = max(LEAST_RANK, min(MOST_RANK, n // RANK_SHARE))
    return np.random.RandomState(7).standard_normal((n, rank)).astype(np.float32)


def _telling(w: np.ndarray, found: np.ndarray, n_docs: float) -> np.ndarray:
    """The slots of an item that weigh something: not too common, or its rarest ones."""
    own = np.unique(w)
    return np.union1d(own[found[own] <= MAX_SHARE * n_docs], own[np.argsort(found[own], kind="stable")[:LEAST_WORDS]])


def _used_slots(found: np.ndarray, n_docs: float):
    """The slots that a task's share of the items uses, as counts in slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS)
        for batch in batches:
            for w in words_of(_encoded(batch["text"])):
                if len(w):
                    total[_telling(w, found, n_docs)] += 1
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId() % 256] * SLICES, pa.int32()), "slice": pa.array(range(SLICES), pa.int32()),
            "sums": pa.array([r.tobytes() for r in np.split(total, SLICES)], pa.binary())})
    return run


class Vocabulary:
    """The slots that weigh something: those of benchmark words that are not too common."""

    def __init__(self, use: np.ndarray, found: np.ndarray, n_docs: float):
        idf = np.log1p(n_docs / np.maximum(found, 1))
        self.found = found
        self.index = np.full(SLOTS, -1, np.int32)
        self.index[use] = np.arange(use.sum())
        self.weights = idf[use].astype(np.float32)
        self.idf = idf


class Passages:
    """The passages of a group of documents: runs of two half-passages, or the only one.  A
    passage is known by its first half."""

    def __init__(self, group: list[np.ndarray], vocabulary: Vocabulary):
        sizes = np.array([len(w) for w in group])
        halves = -(-sizes // STEP)
        self.first_half = np.cumsum(halves) - halves
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        half = place // STEP + np.repeat(self.first_half, sizes)
        slot = vocabulary.index[np.concatenate(group)]
        self.slot, self.half = slot[slot >= 0], half[slot >= 0]
        self.doc = np.repeat(np.arange(len(group)), halves)
        self.n = len(self.doc)
        self.pair = np.append(self.doc[1:] == self.doc[:-1], False)  # a second half follows
        self.there = self.pair | (halves[self.doc] == 1)
        # squared lengths: occurrences of a slot add up within a passage before they are squared
        size = len(vocabulary.weights)
        keys, times = np.unique(self.half.astype(np.int64) * size + self.slot, return_counts=True)
        half, weight = keys // size, times * vocabulary.weights[keys % size].astype(np.float64)
        both = self._with_next(np.bincount(half, weight ** 2, self.n))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, keys + size), len(keys) - 1)  # the same slot in the next half
            shared = (keys[at] == keys + size) & self.pair[half]
            both += np.bincount(half[shared], 2 * weight[shared] * weight[at[shared]], self.n)
        self.squares = np.where(self.there, both, 0)

    def _with_next(self, per_half: np.ndarray) -> np.ndarray:
        after = np.concatenate([per_half[1:], np.zeros_like(per_half[:1])])
        return per_half + after * (self.pair if per_half.ndim == 1 else self.pair[:, None])

    def project(self, weighted: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """Rows of A times a matrix whose rows are already weighted, for every half; only
        those of ``wanted`` passages need be right."""
        slot, half = self.slot, self.half
        if wanted is not None:
            near = wanted.copy()
            near[1:] |= wanted[:-1]
            use = near[half]
            slot, half = slot[use], half[use]
        out = np.zeros((self.n, weighted.shape[1]), np.float32)
        if len(slot):
            new = np.flatnonzero(np.diff(half, prepend=-1))
            out[half[new]] = np.add.reduceat(weighted[slot], new, axis=0)
        return self._with_next(out)


def _groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list]:
    """Documents with words in groups of bounded size: (words, value of each column...)."""
    group, held = [], 0
    for batch in batches:
        for row in zip(batch["words"], *(batch[c] for c in columns)):
            w = np.frombuffer(row[0].as_py(), np.uint16)
            if len(w):
                group.append((w, *(x.as_py() for x in row[1:])))
                held += len(w)
                if held > GROUP:
                    yield group
                    group, held = [], 0
    if group:
        yield group


def _range_pass(vocabulary: Vocabulary):
    """Y = A'(A G) over the passages of a task, in slices; rows of A have unit length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(vocabulary.weights)
        weighted = _gaussian(k) * vocabulary.weights[:, None]
        total, any_row = np.zeros(weighted.shape, np.float64), False
        for group in _groups(batches):
            any_row = True
            p = Passages([w for w, in group], vocabulary)
            x = p.project(weighted) * np.where(p.squares > 0, 1 / np.maximum(p.squares, 1e-9), 0)[:, None].astype(np.float32)
            own = x.copy()  # what a word of a half adds: the passage it begins and the one it ends
            own[1:] += x[:-1] * p.pair[:-1, None]
            order = np.argsort(p.slot, kind="stable")
            slot = p.slot[order]
            if len(slot):
                new = np.flatnonzero(np.diff(slot, prepend=-1))
                total[slot[new]] += np.add.reduceat(own[p.half[order]], new, axis=0)
        if any_row:
            total *= vocabulary.weights[:, None]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId() % 256] * SLICES, pa.int32()), "slice": pa.array(range(SLICES), pa.int32()),
                "sums": pa.array([s.tobytes() for s in np.array_split(total, SLICES)], pa.binary())})
    return run


def singular_vectors(y: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of A from Y = A'A G (slots x rank, float32)."""
    g = _gaussian(len(y)).astype(np.float64)
    q, _ = np.linalg.qr(y)
    small = np.linalg.lstsq((q.T @ g).T, (q.T @ y).T, rcond=None)[0]
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(-values)]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_words(item: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence: one integer operation a word (bit-parallel
    method of Hyyro, 2004).  ``item`` has the places of each word as bits."""
    row = full = (1 << size) - 1
    for w in words:
        hit = row & item.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


class Items:
    """The benchmark items of a block, with their projected passages."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], vocabulary: Vocabulary, weighted: np.ndarray):
        self.ids, self.words = [i for i, _ in rows], [w for _, w in rows]
        queries, owner = [], []
        for k, w in enumerate(self.words):
            # passages at several offsets, so that one lies close to any in a document
            for start in sorted({*range(0, max(len(w) - PASSAGE, 0) + 1, STEP // 2), max(len(w) - PASSAGE, 0)}):
                slot = vocabulary.index[w[start: start + PASSAGE]]
                queries.append(weighted[slot[slot >= 0]].sum(0))
                owner.append(k)
        queries = np.array(queries, np.float32).reshape(-1, weighted.shape[1])
        length = np.linalg.norm(queries, axis=1)
        self.queries, self.length = _unit(queries)[length > 0], length[length > 0]
        self.owner = np.array(owner, np.int64)[length > 0]
        # rarest word -> (item, place of a neighbour beside it, the neighbour)
        self.anchors: dict[int, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.words):
            if len(w) >= LEAST_EXACT:
                i = int(np.argmin(vocabulary.found[w]))
                step = 1 if i + 1 < len(w) else -1
                self.anchors.setdefault(int(w[i]), []).append((k, step, int(w[i + step])))
        self.is_anchor = np.zeros(SLOTS, bool)
        self.is_anchor[list(self.anchors)] = True
        self.bits, self.answers = [], []
        for w in self.words:
            bits: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                bits[x] = bits.get(x, 0) | 1 << i
            self.bits.append(bits)
            self.answers.append(set(w[np.argsort(-vocabulary.idf[w], kind="stable")[: max(1, len(w) // 3)]].tolist()))


def _search(items: Items, vocabulary: Vocabulary, weighted: np.ndarray):
    def near(group: list) -> Iterator[tuple[int, int, int]]:
        """(document, item, place): passages of a document close to an item."""
        p = Passages([w for w, _ in group], vocabulary)
        # a projection is no longer than what it projects, so shorter passages cannot pass
        wanted = p.squares >= 0.999 * (MIN_COSINE * FLOOR * items.length.min(initial=np.inf)) ** 2
        at = np.flatnonzero(wanted & p.there)
        x = p.project(weighted, wanted)[at]
        length = np.linalg.norm(x, axis=1)
        for lo in range(0, len(at), 4096):
            part = slice(lo, lo + 4096)
            dots = x[part] @ items.queries.T
            row, query = np.nonzero(dots >= MIN_COSINE * np.maximum(length[part, None], FLOOR * items.length[None, :]))
            for r, k in set(zip((row + lo).tolist(), items.owner[query].tolist())):
                d = int(p.doc[at[r]])
                yield d, k, int(at[r] - p.first_half[d]) * STEP

    def exact(group: list) -> Iterator[tuple[int, int, int]]:
        """(document, item, place) where an item's rarest word stands beside its neighbour."""
        for d, (words, _) in enumerate(group):
            for i in np.flatnonzero(items.is_anchor[words]).tolist():
                for k, step, neighbour in items.anchors[int(words[i])]:
                    if 0 <= i + step < len(words) and words[i + step] == neighbour:
                        yield d, k, i

    def hits(group: list) -> list[tuple]:
        best: dict[tuple, tuple] = {}
        for d, k, middle in sorted({*near(group), *exact(group)}):
            if best.get((d, k), (0, 0)) == (1, 1):
                continue
            words, size = group[d][0], len(items.words[k])
            around = words[max(0, middle - size): middle + PASSAGE + size].tolist()
            answer = len(items.answers[k].intersection(around)) / len(items.answers[k])
            if answer >= MIN_ANSWER:
                share = common_words(items.bits[k], size, around) / size
                if share >= MIN_COMMON and (share, answer) > best.get((d, k), (0, 0)):
                    best[d, k] = (share, answer)
        return [(group[d][1], items.ids[k], share, answer) for (d, k), (share, answer) in best.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "doc_id"):
            if found := hits(group):
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.int64()),
                                                  pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64())],
                                                 names=["doc_id", "item_id", "common", "answer"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, common, answer): documents that hold a benchmark item, the share of
    its words in the longest common subsequence and the share of its answer words."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = scratch_path(spark, "words")
    (docs.select("doc_id", text_of(F.col("text")).alias("text"))
     .mapInArrow(_count_words, f"doc_id {kind}, words binary, part int, slice int, sums binary").write.parquet(path))
    rows = spark.read.parquet(path)
    words = rows.where(F.col("words").isNotNull()).select("doc_id", "words")
    out = f"doc_id {kind}, item_id long, common double, answer double"
    sums = _collected(rows.where(F.col("slice").isNotNull()))
    if not sums:
        return spark.createDataFrame([], out)
    found = np.concatenate([sums[i] for i in range(SLICES)])
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of(F.col("text")).alias("text"))
    sizes = "part int, slice int, sums binary"
    used = _collected(items.select("text").mapInArrow(_used_slots(found, sums[SLICES][0]), sizes))
    used = np.concatenate([used[i] for i in range(SLICES)]) > 0 if used else np.zeros(SLOTS, bool)
    leaks = None
    if used.any():
        vocabulary = Vocabulary(used, found, sums[SLICES][0])
        y = _collected(words.select("words").mapInArrow(_range_pass(vocabulary), sizes))
        blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK)) if y else 0
        if blocks:
            rank = _gaussian(len(vocabulary.weights)).shape[1]
            basis = singular_vectors(np.concatenate([y[i].reshape(-1, rank) for i in range(SLICES)]))
            weighted = basis * vocabulary.weights[:, None]
        for b in range(blocks):  # a block is a bounded query set
            block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
            own = [(r["item_id"], w) for r in block for w in words_of([r["text"].encode()]) if len(w)]
            if own:
                part = words.mapInArrow(_search(Items(own, vocabulary, weighted), vocabulary, weighted), out)
                leaks = part if leaks is None else leaks.unionByName(part)
    leaks = materialize(spark.createDataFrame([], out) if leaks is None else leaks)
    drop_path(spark, path)
    return leaks
