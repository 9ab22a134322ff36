"""Phrase collocations by weighted acyclic automata (operator 11).

A phrase is a path of word symbols (64-bit hashes) below a language symbol.  Counts live
in transducers: deterministic acyclic automata whose arcs carry a label and, where a
phrase ends, its count; phrases with a common beginning share the arcs of it.

1. Shards of about ``SHARD`` bytes of text sort their phrases and build a transducer from
   the sorted list.  It is cut at splitters, whole paths taken from a hash sample of the
   documents, so a frequent word or pair is cut deeper in the tree instead of making one
   slice large; the splitters affect the balance only.
2. Each slice of the prefix order takes the union of its shards' transducers and sums the
   weights.  A shard sends a phrase once, so no phrase is a hot key.
3. Lengths are counted in the order 1, 2, then 3 and 4 together.  No phrase is more
   frequent than its parts, so a longer one is only counted where its words, or its pairs,
   may reach ``min_count``: a bitmap of fixed size tells which, and those that it lets
   through by chance fall to the exact count.  At any size of the corpus the result is
   exact; only the saving depends on the bitmap.
4. The parts of the candidates are looked up by composing an acceptor of the asked parts
   with the count transducer of their slice, in salted copies where many parts are asked.
5. Scores are exact decimal arithmetic; ``rank`` windows keep each task's best rows before
   the shuffle, and words get their spelling back only for the rows that remain.

Words that share a hash within a language are found in the word counts and take another
hash, so no count mixes two words.

Defined cases: a null text is empty, a null lang is ``und``; empty texts add nothing; long
texts are cut between pieces, and inside a piece with three words of context, so every
phrase is counted once; a language without candidates gives no row (so does an empty
table); repeated rows count each time, ids are not read; ties go to the larger count, then
the phrase in byte order; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlab.functions.ordered import materialize
from growthlab.llm.common import hash_words, shuffle_width, small_batches, text_of, word_spans

#: Bytes of text that a task counts at a time.
SHARD = 12 << 20
#: Bits of the bitmap of parts that may be frequent.
FILTER_BITS = 25
#: Documents (in expectation) whose paths balance the slices.
SAMPLE_DOCS = 1000
LONGEST = 4
PATH = [f"h{i}" for i in range(LONGEST + 1)]  # h0 is the language
_U = np.uint64
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
_NO_WORD = _ENDS_PIECE.copy()
_NO_WORD[[0x20, 0x09]] = True
_PIECE_END, _WORD_END = re.compile(rb"[.,;:!?\x0a-\x0d]"), re.compile(rb"[.,;:!?\x0a-\x0d \t]")


# ---------------------------------------------------------------- transducers

class Transducer:
    """Levels of arcs: ``labels[d]``, ``weights[d]`` (0 where no phrase ends) and
    ``first[d]``, the bounds of each arc's children on level d + 1."""

    def __init__(self, labels: list[np.ndarray], weights: list[np.ndarray], first: list[np.ndarray]):
        self.labels, self.weights, self.first = labels, weights, first

    @classmethod
    def of_sorted(cls, paths: list[np.ndarray], counts: np.ndarray) -> Transducer:
        """From distinct paths in ascending order, a column a level, 0 after the end."""
        n = len(counts)
        labels, weights, first, new = [], [], [], np.zeros(n, bool)
        new[:1] = True
        before: np.ndarray | None = None  # arc of the level above, for each path
        for d, column in enumerate(paths):
            new[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(new & (column != 0))
            own = np.cumsum(new & (column != 0)) - 1
            labels.append(column[at])
            ends = (column != 0) & ((paths[d + 1] == 0) if d + 1 < len(paths) else True)
            weight = np.zeros(len(at), np.int64)
            weight[own[ends]] = counts[ends]
            weights.append(weight)
            if before is not None:
                first.append(np.searchsorted(before[at], np.arange(len(labels[-2]) + 1)))
            before = own
        return cls(labels, weights, first)

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The paths that carry a weight, level by level, and their weights."""
        columns: list[list[np.ndarray]] = [[] for _ in self.labels]
        counts, chain = [], []
        for d, (label, weight) in enumerate(zip(self.labels, self.weights)):
            if d:
                parent = np.repeat(np.arange(len(self.labels[d - 1])), np.diff(self.first[d - 1]))
                chain = [c[parent] for c in chain]
            chain = [*chain, label]
            ends = weight > 0
            for e, column in enumerate(columns):
                column.append(chain[e][ends] if e <= d else np.zeros(int(ends.sum()), _U))
            counts.append(weight[ends])
        return [np.concatenate(c) for c in columns], np.concatenate(counts)

    def compose(self, asked: Transducer) -> np.ndarray:
        """Both automata walked side by side: the weight here of each path that ``asked``
        accepts, in the order of its ``paths()``; 0 where this one has no such path."""
        found = []
        state = np.zeros(0, np.int64)
        for d, label in enumerate(asked.labels):
            if d >= len(self.labels):
                state = np.full(len(label), -1)
            else:
                if d:
                    parent = np.repeat(state, np.diff(asked.first[d - 1]))
                    lo, hi = self.first[d - 1][parent], self.first[d - 1][parent + 1]
                    lo, hi = np.where(parent < 0, 0, lo), np.where(parent < 0, 0, hi)
                else:
                    lo, hi = np.zeros(len(label), np.int64), np.full(len(label), len(self.labels[0]))
                own, end = self.labels[d], hi
                while len(own) and (lo < hi).any():  # binary search in each arc's children at once
                    mid = (lo + hi) >> 1
                    less = (lo < hi) & (own[np.minimum(mid, len(own) - 1)] < label)
                    lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
                hit = (lo < end) & (own[np.minimum(lo, len(own) - 1)] == label) if len(own) else np.zeros(len(label), bool)
                state = np.where(hit, lo, -1)
            weight = np.where(state >= 0, self.weights[d][state], 0) if d < len(self.labels) and len(self.weights[d]) else np.zeros(len(label), np.int64)
            found.append(weight[asked.weights[d] > 0])
        return np.concatenate(found)

    def to_bytes(self) -> bytes:
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        return pickle.dumps((self.labels, [small(w) for w in self.weights], [small(np.diff(f)) for f in self.first]), protocol=5)

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        labels, weights, sizes = pickle.loads(data)
        return cls(labels, [w.astype(np.int64) for w in weights], [np.concatenate([[0], np.cumsum(s, dtype=np.int64)]) for s in sizes])


def sum_sorted(paths: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct paths in ascending order and the sums of their counts."""
    if not len(counts):
        return paths, counts
    order = np.lexsort(paths[::-1])
    paths = [c[order] for c in paths]
    new = reduce(np.logical_or, (c[1:] != c[:-1] for c in paths))
    at = np.concatenate([[0], np.flatnonzero(new) + 1])
    return [c[at] for c in paths], np.add.reduceat(counts[order], at)


def union(parts: list[Transducer]) -> Transducer:
    """The union of transducers, weights of equal paths summed."""
    opened = [p.paths() for p in parts]
    depth = max(len(p) for p, _ in opened)
    columns = [np.concatenate([p[d] if d < len(p) else np.zeros(len(c), _U) for p, c in opened]) for d in range(depth)]
    return Transducer.of_sorted(*sum_sorted(columns, np.concatenate([c for _, c in opened])))


def slice_bounds(paths: list[np.ndarray], splitters: list[list[int]]) -> np.ndarray:
    """Where each splitter cuts the sorted paths: index of the first path not below it."""
    cuts = []
    for split in splitters:
        lo, hi = 0, len(paths[0])
        for column, label in zip(paths, split):
            label = _U(label)
            lo, hi = lo + int(np.searchsorted(column[lo:hi], label, "left")), lo + int(np.searchsorted(column[lo:hi], label, "right"))
            if lo == hi:
                break
        cuts.append(lo)
    return np.array([0, *cuts, len(paths[0])], np.int64)


def slices_of(paths: list[np.ndarray], splitters: list[list[int]]) -> np.ndarray:
    """The slice of each path, in any order of the paths."""
    order = np.lexsort(paths[::-1])
    bounds = slice_bounds([c[order] for c in paths], splitters)
    out = np.empty(len(order), np.int32)
    out[order] = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    return out


# ---------------------------------------------------------------- words of texts

def chunks(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """(chunk, words of context at its start): cuts a long text after a piece, or, in an
    endless piece, between words with the last words repeated as context."""
    at, context = 0, []
    while len(text) - at > size:
        cut = max(text.rfind(bytes([c]), at, at + size) for c in b".,;:!?\x0a\x0b\x0c\x0d") + 1
        ends = cut > at
        if not ends:
            cut = max(text.rfind(b" ", at, at + size), text.rfind(b"\t", at, at + size)) + 1
        if cut <= at:  # one word longer than a chunk
            found = _WORD_END.search(text, at + size)
            if found is None:
                break
            cut = found.start()
            cut += (ends := bool(_ENDS_PIECE[text[cut]]))
        chunk = b" ".join([*context, text[at:cut]])
        yield chunk, len(context)
        # what follows the last piece end of a chunk that goes on is the context of the next
        context = [] if ends else [w for w in re.split(rb"[ \t]+", _PIECE_END.split(chunk)[-1]) if w][-(LONGEST - 1):]
        at = cut
    yield b" ".join([*context, text[at:]]), len(context)


class Words:
    """The words of one language's share of a shard: symbols, pieces, and which are no
    context; ``clashes`` are the symbols that two words of a language share."""

    def __init__(self, parts: list[tuple[bytes, int]], clashes: np.ndarray, mask: int):
        joined = b"\n".join(c for c, _ in parts)
        self.data = _LOWERED[np.frombuffer(joined, np.uint8)]
        self.start, self.stop = word_spans(self.data, _NO_WORD)
        self.symbols = hash_words(self.data, self.start, self.stop) & _U(mask)
        self.symbols[self.symbols == 0] = 1
        if len(clashes):
            for i in np.flatnonzero(np.isin(self.symbols, clashes)):
                self.symbols[i] = _U(xxhash.xxh64_intdigest(self.spelling(i), seed=42) or 1)
        self.piece = np.searchsorted(np.flatnonzero(_ENDS_PIECE[self.data]), self.start)
        self.fresh = np.ones(len(self.start), bool)
        if any(n for _, n in parts):
            begins = np.concatenate([[0], np.cumsum([len(c) + 1 for c, _ in parts])])[:-1]
            for (_, n), i in zip(parts, np.searchsorted(self.start, begins)):
                self.fresh[i: i + n] = False

    def spelling(self, i: int) -> bytes:
        return self.data[self.start[i]: self.stop[i]].tobytes()


def shards(batches: Iterator[pa.RecordBatch], clashes: np.ndarray, mask: int) -> Iterator[tuple[str, Words]]:
    """(lang, Words) of about SHARD bytes of text each, languages apart."""
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            text = text.as_py().encode()
            for chunk in chunks(text, SHARD) if len(text) > SHARD else [(text, 0)]:
                held.setdefault(lang, []).append(chunk)
                size += len(chunk[0]) + 1
                if size >= SHARD:
                    yield from ((k, Words(v, clashes, mask)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, Words(v, clashes, mask)) for k, v in held.items())


def lang_symbol(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") or 1


# ---------------------------------------------------------------- the bitmap of parts

class PartFilter:
    """Which parts may be frequent: two bits a part in a bitmap of fixed size."""

    def __init__(self, bits: np.ndarray | None, width: int):
        self.bits, self.width = bits, width

    def may(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(keys), bool)
        place = _U((1 << self.width) - 1)
        hit = lambda p: (self.bits[p >> _U(6)] >> (p & _U(63))) & _U(1) == 1
        return hit(keys & place) & hit((keys >> _U(self.width)) & place)


def part_filter(parts: DataFrame, key, width: int) -> PartFilter:
    """The bitmap of the parts' keys; at most 2**width / 64 rows reach the driver."""
    place = (1 << width) - 1
    bits = parts.select(F.explode(F.array(key.bitwiseAND(F.lit(place)), F.shiftrightunsigned(key, width).bitwiseAND(F.lit(place)))).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).collect()
    out = np.zeros(1 << (width - 6), np.int64)
    for r in words:
        out[r["w"]] = r["b"]
    return PartFilter(out.view(_U), width)


# ---------------------------------------------------------------- the operator

class Miner:
    """The passes over the texts; what they share travels with their functions."""

    def __init__(self, docs: DataFrame, min_count: int, mask: int, filter_bits: int):
        self.docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"), "doc_id")
        self.min_count, self.mask, self.filter_bits = min_count, mask, filter_bits
        self.clashes, self.splitters = np.zeros(0, _U), []
        self.n_slices = 4 * shuffle_width(docs)

    def words(self) -> DataFrame:
        """(lang, h0, h1, word, f) of every word; clashing symbols are dealt anew."""
        clashes, mask = self.clashes, self.mask

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lang, w in shards(batches, clashes, mask):
                own = np.flatnonzero(w.fresh)
                # a second hash keeps words apart that share a symbol
                other = hash_words(w.data ^ np.uint8(0x5A), w.start, w.stop)[own]
                _, at, counts = np.unique(other, return_index=True, return_counts=True)
                keys, spelled = w.symbols[own[at]], [w.spelling(i) for i in own[at]]
                for i in range(0, len(keys), 50_000):
                    part = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(keys[part]), pa.string()), "h0": pa.array([_signed(lang_symbol(lang))] * len(keys[part]), pa.int64()),
                        "h1": pa.array(keys[part].view(np.int64)), "word": pa.array([s.decode() for s in spelled[part]], pa.string()),
                        "f": pa.array(counts[part].astype(np.int64))})

        found = self.docs.select("lang", "text").mapInArrow(run, "lang string, h0 long, h1 long, word string, f long")
        words = materialize(found.groupBy("lang", "h0", "h1", "word").agg(F.sum("f").alias("f")))
        shared = words.groupBy("h0", "h1").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b")
        # expected number: words squared / 2**65, a handful at most
        again = [r["h1"] for r in shared.select("h1").distinct().collect()]
        if again:
            self.clashes = np.array(again, np.int64).view(_U)
            renamed = F.when(F.xxhash64("word") == 0, F.lit(1).cast("long")).otherwise(F.xxhash64("word"))
            listed = F.broadcast(words.sparkSession.createDataFrame([(h,) for h in again], "h1 long").withColumn("again", F.lit(True)))
            words = words.join(listed, "h1", "left").withColumn("h1", F.when(F.col("again"), renamed).otherwise(F.col("h1"))).drop("again")
        return words

    def find_splitters(self) -> None:
        """Whole paths that cut the prefix order into slices of about equal size."""
        clashes, mask = self.clashes, self.mask
        share = min(1.0, SAMPLE_DOCS / max(self.docs.count(), 1))
        spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lang, w in shards(batches, clashes, mask):
                n = max(len(w.symbols) - LONGEST + 1, 0)
                chosen = np.flatnonzero((w.symbols[:n] ^ w.symbols[LONGEST - 1:]) % _U(16) == 0)
                yield _path_batch([np.full(len(chosen), lang_symbol(lang), _U), *(w.symbols[chosen + d] for d in range(LONGEST))])

        sample = self.docs.where(spread < share).select("lang", "text").mapInArrow(run, ", ".join(f"{c} long" for c in PATH)).distinct()
        found = sorted([x % 2**64 for x in r] for r in sample.collect())
        self.splitters = [found[i * len(found) // self.n_slices] for i in range(1, self.n_slices)] if found else []

    def longer(self, lengths: tuple[int, ...], parts: PartFilter) -> DataFrame:
        """(h0 ... h4, f) of the phrases of some lengths with ``min_count`` occurrences, whose
        words (for pairs) or pairs (for longer ones) the filter lets through."""
        clashes, mask, splitters, min_count = self.clashes, self.mask, self.splitters, self.min_count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lang, w in shards(batches, clashes, mask):
                paths, counts = phrases(w, lang_symbol(lang), lengths, parts)
                bounds = slice_bounds(paths, splitters)
                full = np.flatnonzero(np.diff(bounds))
                blobs = [Transducer.of_sorted([c[bounds[i]: bounds[i + 1]] for c in paths], counts[bounds[i]: bounds[i + 1]]).to_bytes() for i in full]
                yield pa.RecordBatch.from_pydict({"slice": pa.array(full, pa.int32()), "part": pa.array(blobs, pa.binary())})

        def summed(table: pa.Table) -> pa.Table:
            paths, counts = union([Transducer.from_bytes(b) for b in table["part"].to_pylist()]).paths()
            often = counts >= min_count
            return pa.Table.from_batches([_path_batch([c[often] for c in _padded(paths)], f=counts[often])])

        dealt = self.docs.select("lang", "text").mapInArrow(run, "slice int, part binary")
        return materialize(dealt.groupBy("slice").applyInArrow(summed, ", ".join(f"{c} long" for c in [*PATH, "f"])))

    def lookup(self, counted: DataFrame, asked: DataFrame) -> DataFrame:
        """``asked`` (a part's path as h0 ... h4, further columns) with ``f``, the part's count
        among ``counted`` (paths with f): composition slice by slice."""
        splitters = self.splitters
        more = [f for f in asked.schema.fields if f.name not in PATH]

        def place(df: DataFrame) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    own = slices_of([batch[c].to_numpy(zero_copy_only=False).view(_U) for c in PATH], splitters)
                    yield batch.append_column("slice", pa.array(own, pa.int32()))
            return df.mapInArrow(run, f"{_ddl(df)}, slice int")

        asked = materialize(place(asked))
        sizes = {r["slice"]: r["count"] for r in asked.groupBy("slice").count().collect()}  # a row for each slice
        usual = max(1, 2 * sum(sizes.values()) // max(1, self.n_slices))
        salts = [(s, -(-n // usual)) for s, n in sizes.items()]
        if not salts:
            return asked.select(*[f.name for f in more], F.lit(0).cast("long").alias("f"))
        copies = F.broadcast(asked.sparkSession.createDataFrame(salts, "slice int, copies int"))
        asked = asked.join(copies, "slice").withColumn("salt", F.pmod(F.xxhash64(*[f.name for f in more]), F.col("copies")).cast("int")).drop("copies")
        counted = place(counted).join(copies, "slice").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        names = [f.name for f in more]

        def run(have: pa.Table, want: pa.Table) -> pa.Table:
            column = lambda t, c: t[c].to_numpy().view(_U)
            if not want.num_rows:
                return want.select(names).append_column("f", pa.array([], pa.int64()))
            counts = Transducer.of_sorted(*sum_sorted([column(have, c) for c in PATH], have["f"].to_numpy()))
            each = [column(want, c) for c in PATH]
            distinct, _ = sum_sorted(each, np.ones(want.num_rows, np.int64))
            found = counts.compose(acceptor := Transducer.of_sorted(distinct, np.ones(len(distinct[0]), np.int64)))
            listed, _ = acceptor.paths()
            # back from the acceptor's paths to the rows that asked
            order = np.lexsort([*(np.concatenate([a, b]) for a, b in zip(listed, each))][::-1])
            is_path = order < len(found)
            value = np.zeros(len(order), np.int64)
            value[order] = found[order[is_path]][np.cumsum(is_path) - 1]
            return want.select(names).append_column("f", pa.array(value[len(found):]))

        fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in more), "f long"])
        return counted.groupBy("slice", "salt").cogroup(asked.groupBy("slice", "salt")).applyInArrow(run, fields)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _padded(paths: list[np.ndarray]) -> list[np.ndarray]:
    return [*paths, *(np.zeros(len(paths[0]), _U) for _ in range(len(PATH) - len(paths)))]


def _path_batch(paths: list[np.ndarray], **more: np.ndarray) -> pa.RecordBatch:
    columns = {c: pa.array(np.ascontiguousarray(p).view(np.int64)) for c, p in zip(PATH, paths)}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(v.astype(np.int64)) for k, v in more.items()})


def phrases(w: Words, lang: int, lengths: tuple[int, ...], parts: PartFilter) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases of one shard in path order, and their counts."""
    symbols, rank = np.unique(w.symbols, return_inverse=True)
    rank, key, n = rank.astype(_U), _U(lang), len(w.symbols)
    together = w.piece[1:] == w.piece[:-1]  # a word and the next one
    found: list[tuple[list[np.ndarray], np.ndarray]] = []
    if 2 in lengths:
        may = parts.may(symbols ^ key)[rank.astype(np.int64)]
        at = np.flatnonzero(together & may[1:] & may[:-1] & w.fresh[1:])
        pairs, counts = np.unique(rank[at] << _U(32) | rank[at + 1], return_counts=True)
        found.append(([pairs >> _U(32), pairs & _U(0xFFFFFFFF)], counts))
    if {3, 4} & set(lengths):
        ok = together & parts.may(pair_key(key, w.symbols[:-1], w.symbols[1:]))
        at = np.flatnonzero(ok)
        pairs, place = np.unique(rank[at] << _U(32) | rank[at + 1], return_inverse=True)
        pair = np.zeros(max(n - 1, 0), _U)
        pair[at] = place.astype(_U)
        for size in sorted({3, 4} & set(lengths)):
            last = size - 1
            every = reduce(np.logical_and, (ok[i: len(ok) - (last - 1) + i] for i in range(last)))
            i = np.flatnonzero(every & w.fresh[last:][: len(every)])
            tail = rank[i + 2] if size == 3 else pair[i + 2]
            packed, counts = np.unique(pair[i] << _U(32) | tail, return_counts=True)
            head, tail = pairs[(packed >> _U(32)).astype(np.int64)], packed & _U(0xFFFFFFFF)
            ends = [tail] if size == 3 else [(t := pairs[tail.astype(np.int64)]) >> _U(32), t & _U(0xFFFFFFFF)]
            found.append(([head >> _U(32), head & _U(0xFFFFFFFF), *ends], counts))
    # ranks to one path list; a phrase stands before those that go on from it
    depth = max(len(p) for p, _ in found)
    ranks = [np.concatenate([p[d] + _U(1) if d < len(p) else np.zeros(len(c), _U) for p, c in found]) for d in range(depth)]
    ranks, counts = sum_sorted(ranks, np.concatenate([c for _, c in found]).astype(np.int64))
    label = np.concatenate([np.zeros(1, _U), symbols])
    return [np.full(len(counts), key, _U), *(label[r.astype(np.int64)] for r in ranks)], counts


def pair_key(lang, a, b):
    return lang ^ a ^ (b << _U(1))


def score(a, left, right):
    """floor(2000000 a / (l + r)), in exact decimals."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(8,0)"), wide(left) + wide(right))


def mine(docs: DataFrame, min_count: int = 30, cover: int = 80, top: int = 2000,
         mask: int = 2**64 - 1, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): each language's ``top`` collocations of 2
    to 4 words with at least ``min_count`` occurrences that no longer candidate covers to
    ``cover`` percent.  ``mask`` narrows the word symbols (for tests of clashing words)."""
    small_batches(docs.sparkSession)
    miner = Miner(docs, min_count, mask, filter_bits)
    words = miner.words()
    totals = words.groupBy("lang", "h0").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= min_count)
    miner.find_splitters()
    single = part_filter(often, F.col("h0").bitwiseXOR(F.col("h1")), filter_bits)
    pairs = miner.longer((2,), single)
    key = F.col("h0").bitwiseXOR(F.col("h1")).bitwiseXOR(F.shiftleft("h2", 1))
    rest = miner.longer((3, 4), part_filter(pairs, key, filter_bits))
    zero = F.lit(0).cast("long")
    counted = often.select("h0", "h1", *[zero.alias(c) for c in PATH[2:]], "f").unionByName(pairs).unionByName(rest)

    # candidates that a longer candidate covers: one shuffle of candidates and their inner phrases
    wide = F.when(F.col("h4") != 0, 4).when(F.col("h3") != 0, 3).otherwise(2)
    candidates = pairs.unionByName(rest).withColumn("size", wide)
    inner = [F.struct(F.col("h0"), *[F.col(f"h{i + d}").alias(f"h{d + 1}") if d < k else zero.alias(f"h{d + 1}") for d in range(LONGEST)],
                      F.lit(None).cast("long").alias("a"), F.col("f").alias("around"), (F.col("size") >= i + k - 1).alias("real"))
             for k in (2, 3) for i in range(1, LONGEST - k + 2)]
    own = candidates.select(*PATH, F.col("f").alias("a"), F.lit(None).cast("long").alias("around"))
    covers = candidates.where("size > 2").select("*", F.explode(F.array(*inner)).alias("inner")).where(
        F.col("inner.real") & (F.when(F.col("inner.h3") != 0, 3).otherwise(2) < F.col("size"))).select(*[F.col(f"inner.{c}") for c in [*PATH, "a", "around"]])
    judged = own.unionByName(covers).groupBy(*PATH).agg(F.max("a").alias("a"), F.max("around").alias("around"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kept = judged.where(F.col("a").isNotNull() & (F.col("around").isNull() | (exact("around") * 100 < exact("a") * cover))).drop("around")
    kept = materialize(kept.withColumn("size", wide))

    # a row for each cut and side: the part's path beside the candidate's own
    sides = []
    for k in range(1, LONGEST):
        left = [F.col(f"h{d}") if d <= k else zero for d in range(1, LONGEST + 1)]
        right = [F.col(f"h{d + k}") if d + k <= LONGEST else zero for d in range(1, LONGEST + 1)]
        for side, part in (("l", left), ("r", right)):
            sides.append(F.struct(F.lit(k).alias("cut"), F.lit(side).alias("side"), (F.col("size") > k).alias("real"), *[c.alias(f"p{d}") for d, c in enumerate(part, 1)]))
    asked = kept.select(*[F.col(c).alias(f"c_{c}") for c in PATH], "a", "h0", F.explode(F.array(*sides)).alias("s")).where("s.real")
    asked = asked.select("h0", *[F.col(f"s.p{d}").alias(f"h{d}") for d in range(1, LONGEST + 1)], *[f"c_{c}" for c in PATH], "a", "s.cut", "s.side")
    parts = miner.lookup(counted, asked)
    sides_of = parts.groupBy(*[f"c_{c}" for c in PATH], "a").agg(
        *[F.max(F.when((F.col("cut") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}") for k in range(1, LONGEST) for s in "lr"])
    cuts = F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("cut"),
                                                                F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)])
    scored = sides_of.withColumn("best", F.array_min(cuts)).select(*[F.col(f"c_{c}").alias(c) for c in PATH], "a", "best.*")

    # the first rows of each language: ties at the end stay until the spelling decides
    best = Window.partitionBy("h0").orderBy(F.desc("score"), F.desc("a"))
    first = materialize(scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"))
    spelled = (first.select(*PATH, F.posexplode(F.array(*PATH[1:])).alias("at", "symbol")).where("symbol <> 0")
               .join(often.select("h0", F.col("h1").alias("symbol"), "word"), ["h0", "symbol"])
               .groupBy(*PATH).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    rows = first.join(spelled, PATH).join(totals, "h0")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut"))
