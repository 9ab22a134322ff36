"""Removal of repeated 50-byte strings by prefix-free parsing (operator 1).

A byte is removed when a window of ``WINDOW`` bytes covers it that also starts in a
document with a smaller id.

*Parse.*  A rolling hash marks triggers: in each window, the ``GRAM``-byte string of least
hash.  Neighbouring windows with the same trigger form one phrase, the text from the
first window's start to the last one's end.  Phrases depend on content only, overlap so
that each window lies in exactly one phrase, and equal windows have equal triggers.  So
the suffix order of the corpus, to the depth of a window, follows from the suffix order
of the dictionary of distinct phrases alone; the parse only says where phrases occur.

*Dictionary.*  Documents are dealt to blocks by a hash of id and text.  Each block sends its
distinct phrases as (trigger hash, phrase hash, least id), dealt by phrase.  There each
phrase gets its first document, and each trigger's distinct phrases are counted per bucket;
the counts are dealt by trigger and summed, so a trigger costs a row per bucket.  Most occurrences are settled by that: a phrase whose
first document has a smaller id is removed whole.

*Suffix order.*  Where a trigger has several distinct phrases (at the ends of repeats),
their windows may agree in part.  The block of each such phrase's first occurrence sends
the bytes, and the windows of all phrases of a bucket of triggers are sorted as strings;
runs of equal windows get the least first document.  A trigger with more than
``HOT_PHRASES`` distinct phrases (a common string between ever different neighbours) is
not held in one place: each block sends the distinct windows of its phrases with their
least first document, dealt by a hash of the window's own bytes, and the same sort answers.

Blocks hold a set number of documents and bytes (rows that share an id are dealt by their
texts), and phrases are distinct within a block, so a text
that a third of the corpus shares costs a row per block, not per copy.  All shuffles are
by block, by phrase hash, by window hash, or by trigger hash with a bounded number of
phrases a trigger.

Defined cases: null and empty texts are empty; texts shorter than a window lose nothing;
rows that share an id do not affect one another; a row without an id counts as before
every other (its texts stay, and later copies of them go); very long texts are parsed in
overlapping pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.llm.common import mix, order_id, prefix_hash, shuffle_width, span_hash, text_of

WINDOW, GRAM = 50, 24
#: Bytes parsed at a time; positions within must fit in PLACE_BITS.
PIECE, PLACE_BITS = 1 << 19, 20
DOCS_PER_BLOCK = 1500
#: Bytes of text of a block, when its documents are long.
BYTES_PER_BLOCK = 8 << 20
#: Most distinct phrases of a trigger whose windows are sorted in one place.
HOT_PHRASES = 1000
_FACTORS = mix(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)


def _windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the trigger in each window, hash of the GRAM bytes at each place)."""
    with np.errstate(over="ignore"):
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        n = len(data) - GRAM + 1
        value = words[:n] * _FACTORS[0]
        for i in range(1, GRAM // 8):
            value = value + words[8 * i: 8 * i + n] * _FACTORS[i]
        value = mix(value)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (value & ~low) | np.arange(n, dtype=np.uint64)
    width, span = 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width:])
    return (least & low).astype(np.int64), value


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Texts joined up to PIECE bytes, with (document, place in the joined bytes, place in
    the document) of each part; parts of one long text overlap by a window less one."""
    joined, parts, size = [], [], 0
    for d, text in enumerate(texts):
        at = 0
        while len(text) - at >= WINDOW:
            part = text[at: at + PIECE]
            if size + len(part) > PIECE and parts:
                yield b"".join(joined), parts
                joined, parts, size = [], [], 0
            joined.append(part)
            parts.append((d, size, at))
            size += len(part)
            at += PIECE - WINDOW + 1
    if parts:
        yield b"".join(joined), parts


def parse(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The phrases of the texts in order: document, start, number of windows, 48 bits each
    of the trigger's and the phrase's hash."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "start", "n", "trigger", "phrase")}
    for joined, parts in _pieces(texts):
        data = np.frombuffer(joined, np.uint8)
        place, value = _windows(data)
        inside = np.zeros(len(place) + 1, bool)
        begins = np.array([b for _, b, _ in parts])
        ends = np.append(begins[1:], len(data))
        for b, e in zip(begins.tolist(), ends.tolist()):
            inside[b: e - WINDOW + 1] = True
        inside = inside[: len(place)]
        turn = np.append(True, place[1:] != place[:-1])
        before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
        first = np.flatnonzero(inside & (turn | ~before))
        last = np.flatnonzero(inside & (np.append(turn[1:], True) | ~after))
        part = np.searchsorted(begins, first, "right") - 1
        running = prefix_hash(data)
        out["doc"].append(np.array([d for d, _, _ in parts])[part])
        out["start"].append(first - begins[part] + np.array([a for _, _, a in parts])[part])
        out["n"].append(last - first + 1)
        out["trigger"].append(mix(value[place[first]]) >> np.uint64(16))
        out["phrase"].append(span_hash(running, first, last + WINDOW) >> np.uint64(16))
    kinds = {"trigger": np.uint64, "phrase": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds.get(k, np.int64)) for k, v in out.items()}


class Block:
    """The documents of a block in order of id, and their distinct phrases."""

    def __init__(self, rows: pa.Table, buckets: int):
        ids = rows["id"].to_numpy()
        texts = [t.as_py().encode() for t in rows["text"]]
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.rows, self.ids, self.texts = order, ids[order], [texts[i] for i in order]
        self.parsed = p = parse(self.texts)
        bucket = (p["phrase"] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((p["phrase"], p["trigger"], bucket))  # stable: least document first
        trigger, phrase = p["trigger"][order], p["phrase"][order]
        new = np.ones(len(order), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
        self.entry = np.zeros(len(order), np.int64)  # of each occurrence
        self.entry[order] = np.cumsum(new) - 1
        self.at = order[new]  # the first occurrence of each entry
        self.trigger, self.phrase, self.bucket = trigger[new], phrase[new], bucket[order][new]
        self.least = self.ids[p["doc"][self.at]] if len(self.at) else np.zeros(0, np.int64)

    def texts_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(number of windows, least id, the bytes one after another) of some phrases."""
        doc, start, n = (self.parsed[c][self.at[entries]] for c in ("doc", "start", "n"))
        return n, self.ids[doc], b"".join(self.texts[d][s: s + k + WINDOW - 1] for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist()))

    def bucket_starts(self, buckets: int) -> np.ndarray:
        return np.searchsorted(self.bucket, np.arange(buckets + 1))


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of 64-bit values, byte by byte of all values: equal high bytes
    then stand together and compress."""
    return np.ascontiguousarray(values.astype("<i8" if values.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(data: bytes, size: int, kind=np.uint64) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view("<u8" if kind is np.uint64 else "<i8").astype(kind)


def _dictionary(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        own = Block(rows, buckets)
        cut = own.bucket_starts(buckets)
        full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        spans = [slice(cut[b], cut[b + 1]) for b in full]
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "block": pa.array([rows["block"][0].as_py()] * len(full), pa.int32()),
            "trigger": pa.array([_planes(own.trigger[s], 6) for s in spans], pa.binary()),
            "phrase": pa.array([_planes(own.phrase[s], 6) for s in spans], pa.binary()),
            "least": pa.array([_planes(own.least[s], 8) for s in spans], pa.binary())})
    return run


def _sorted_entries(rows: pa.Table):
    """The entries of a bucket by trigger, phrase and least id: (order, trigger, begins a
    trigger, begins a phrase, least)."""
    trigger = np.concatenate([_from_planes(x.as_py(), 6) for x in rows["trigger"]])
    phrase = np.concatenate([_from_planes(x.as_py(), 6) for x in rows["phrase"]])
    least = np.concatenate([_from_planes(x.as_py(), 8, np.int64) for x in rows["least"]])
    order = np.lexsort((least, phrase, trigger))
    t, p = trigger[order], phrase[order]
    new_t = np.ones(len(order), bool)
    new_t[1:] = t[1:] != t[:-1]
    new_p = new_t.copy()
    new_p[1:] |= p[1:] != p[:-1]
    return order, t, new_t, new_p, least


def _phrase_counts(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        """The number of distinct phrases of each trigger in this bucket."""
        _, t, new_t, new_p, _ = _sorted_entries(rows)
        starts = np.flatnonzero(new_t)
        trigger, n = t[starts], np.add.reduceat(new_p.astype(np.int64), starts)
        to = (trigger % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        parts = [(b, order[cut[b]: cut[b + 1]]) for b in range(buckets) if cut[b + 1] > cut[b]]
        return pa.table({"to": pa.array([b for b, _ in parts], pa.int32()),
                         "bucket": pa.array([rows["bucket"][0].as_py()] * len(parts), pa.int32()),
                         "trigger": pa.array([_planes(trigger[o], 6) for _, o in parts], pa.binary()),
                         "n": pa.array([_planes(n[o], 4) for _, o in parts], pa.binary())})
    return run


def _several(hot_phrases: int):
    def run(rows: pa.Table) -> pa.Table:
        """Tells each bucket which of its triggers have several phrases in all, and which
        of these have more than ``hot_phrases``."""
        parts = [_from_planes(x.as_py(), 6) for x in rows["trigger"]]
        found, group = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.concatenate([_from_planes(x.as_py(), 4, np.int64) for x in rows["n"]])
        n = np.bincount(group, n, len(found)).astype(np.int64)[group]
        cut = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        out = [(bucket, trigger[(k > 1) & (k <= hot_phrases)], trigger[(k > 1) & (k > hot_phrases)])
               for i, (bucket, trigger) in enumerate(zip(rows["bucket"].to_pylist(), parts)) for k in (n[cut[i]: cut[i + 1]],)]
        out = [x for x in out if len(x[1]) or len(x[2])]
        return pa.table({"bucket": pa.array([b for b, _, _ in out], pa.int32()), "few": pa.array([_planes(f, 6) for _, f, _ in out], pa.binary()),
                         "many": pa.array([_planes(m, 6) for _, _, m in out], pa.binary())})
    return run


def _first_documents(rows: pa.Table, several: pa.Table) -> pa.Table:
    """For each block, of its entries in this bucket: those with an earlier first document
    elsewhere, and those whose windows must be compared with other phrases' windows."""
    blocks = rows["block"].to_pylist()
    sizes = [len(x.as_py()) // 6 for x in rows["trigger"]]
    order, t, _, new_p, least = _sorted_entries(rows)
    first = least[order][np.maximum.accumulate(np.where(new_p, np.arange(len(order)), 0))]
    early, firsts = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    early[order] = first < least[order]
    firsts[order] = first
    mixed, hot = np.zeros(len(order), bool), np.zeros(len(order), bool)
    for kind, column in ((mixed, "few"), (hot, "many")):
        named = [_from_planes(x.as_py(), 6) for x in several[column]]
        if named:
            kind[order] = np.isin(t, np.concatenate(named)) & (first == least[order])
    out = {"block": [], "bucket": [], "kind": [], "entry": [], "value": []}
    cut = np.concatenate([[0], np.cumsum(sizes)])
    for i, block in enumerate(blocks):
        s = slice(cut[i], cut[i + 1])
        for kind, chosen in (("first", early[s]), ("mixed", mixed[s]), ("hot", hot[s])):
            at = np.flatnonzero(chosen)
            if len(at):
                out["block"].append(block)
                out["bucket"].append(rows["bucket"][0].as_py())
                out["kind"].append(kind)
                out["entry"].append(_planes(at, 4))
                out["value"].append(_planes(firsts[s][at], 8) if kind == "first" else b"")
    return pa.table({"block": pa.array(out["block"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()),
                     "kind": pa.array(out["kind"], pa.string()), "entry": pa.array(out["entry"], pa.binary()),
                     "value": pa.array(out["value"], pa.binary())})


REPLY = "block int, bucket int, kind string, entry binary, value binary"


def _entries(replies: list[dict], kind: str, cut: np.ndarray) -> np.ndarray:
    """The entries of a block that the answers of one kind name, in order."""
    found = [_from_planes(r["entry"], 4, np.int64) + cut[r["bucket"]] for r in replies if r["kind"] == kind]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class HotWindows:
    """The distinct windows of a block's phrases with hot triggers, dealt by their bytes."""

    def __init__(self, own: Block, entries: np.ndarray, buckets: int):
        n, least, text = own.texts_of(entries)
        data = np.frombuffer(text, np.uint8)
        size = n + WINDOW - 1
        phrase = np.repeat(np.arange(len(n)), n)
        self.offset = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
        place = (np.cumsum(size) - size)[phrase] + self.offset
        self.entry, self.own_least = entries[phrase], least[phrase]
        to = (span_hash(prefix_hash(data), place, place + WINDOW) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        bytes_at = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        self.parts = []  # (bucket, distinct windows, least id of each, their windows, which of the distinct ones each is)
        for b in range(buckets):
            at = order[cut[b]: cut[b + 1]]
            if len(at):
                keys, which = np.unique(np.ascontiguousarray(bytes_at[place[at]]).view(f"S{WINDOW}").reshape(-1), return_inverse=True)
                lowest = np.full(len(keys), np.iinfo(np.int64).max)
                np.minimum.at(lowest, which, self.own_least[at])
                self.parts.append((b, keys, lowest, at, which))

    def gone(self, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(entry, offset) of the windows that start in a document before the phrase's first."""
        answers = {r["bucket"]: r for r in replies if r["kind"] == "least"}
        found = [np.zeros(0, np.int64)]
        for b, _, lowest, at, which in self.parts:
            if b in answers:
                lowest = lowest.copy()
                lowest[_from_planes(answers[b]["entry"], 4, np.int64)] = _from_planes(answers[b]["value"], 8, np.int64)
            found.append(at[lowest[which] < self.own_least[at]])
        at = np.concatenate(found)
        return self.entry[at], self.offset[at]


def _phrase_bytes(buckets: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"kind": [], "bucket": [], "block": [], "entry": [], "least": [], "size": [], "data": []}
        asked = [r for r in replies.to_pylist() if r["kind"] != "first"]
        if rows.num_rows and asked:
            own = Block(rows, buckets)
            cut, block = own.bucket_starts(buckets), rows["block"][0].as_py()

            def send(kind, bucket, entry, least, size, data):
                for k, v in zip(out, (kind, bucket, block, entry, _planes(least, 8), size, data)):
                    out[k].append(v)

            mixed = _entries(asked, "mixed", cut)
            to = (own.trigger[mixed] % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(to).tolist():
                entry = mixed[to == b]
                n, least, data = own.texts_of(entry)
                send("phrase", b, _planes(entry, 4), least, (n + WINDOW - 1).astype(np.uint32).tobytes(), data)
            hot = _entries(asked, "hot", cut)
            if len(hot):
                for b, keys, lowest, _, _ in HotWindows(own, hot, buckets).parts:
                    send("window", b, b"", lowest, b"", keys.tobytes())
        return pa.table({k: pa.array(v, pa.string() if k == "kind" else pa.int32() if k in ("bucket", "block") else pa.binary()) for k, v in out.items()})
    return run


def _compared(rows: pa.Table) -> pa.Table:
    return _sorted_windows(rows) if rows["kind"][0].as_py() == "phrase" else _least_windows(rows)


def _least_windows(rows: pa.Table) -> pa.Table:
    """Answers, for each block, which of the windows it sent start in an earlier document."""
    least = [_from_planes(x.as_py(), 8, np.int64) for x in rows["least"]]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in least])])
    least = np.concatenate(least)
    _, which = np.unique(np.frombuffer(b"".join(x.as_py() for x in rows["data"]), f"S{WINDOW}"), return_inverse=True)
    lowest = np.full(len(least), np.iinfo(np.int64).max)
    np.minimum.at(lowest, which, least)
    first = lowest[which]
    parts = [(block, np.flatnonzero(first[a:b] < least[a:b]), first[a:b]) for block, a, b in zip(rows["block"].to_pylist(), cut, cut[1:])]
    parts = [x for x in parts if len(x[1])]
    return pa.table({"block": pa.array([x for x, _, _ in parts], pa.int32()), "bucket": pa.array([rows["bucket"][0].as_py()] * len(parts), pa.int32()),
                     "kind": pa.array(["least"] * len(parts), pa.string()), "entry": pa.array([_planes(at, 4) for _, at, _ in parts], pa.binary()),
                     "value": pa.array([_planes(f[at], 8) for _, at, f in parts], pa.binary())})


def _sorted_windows(rows: pa.Table) -> pa.Table:
    """Sorts all windows of the bucket's mixed phrases as strings; answers, for each phrase,
    which of its windows start in a document before the phrase's first."""
    blocks, entries = rows["block"].to_pylist(), [_from_planes(e.as_py(), 4, np.int64) for e in rows["entry"]]
    least = np.concatenate([_from_planes(x.as_py(), 8, np.int64) for x in rows["least"]])
    size = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows["size"]]).astype(np.int64)
    data = np.frombuffer(b"".join(x.as_py() for x in rows["data"]) + bytes(8), np.uint8)
    n = size - WINDOW + 1
    phrase = np.repeat(np.arange(len(size)), n)
    offset = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
    place = (np.cumsum(size) - size)[phrase] + offset
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    tail = words[place + WINDOW // 8 * 8] >> np.uint64(8 * (8 - WINDOW % 8))
    keys = [tail.astype(np.uint64)] + [words[place + 8 * i].astype(np.uint64) for i in reversed(range(WINDOW // 8))]
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(new)
    first = np.zeros(len(order), np.int64)
    if len(order):
        first[order] = np.repeat(np.minimum.reduceat(least[phrase][order], starts), np.diff(np.append(starts, len(order))))
    gone = first < least[phrase]
    out = {"block": [], "bucket": [], "kind": [], "entry": [], "value": []}
    cut = np.concatenate([[0], np.cumsum([len(e) for e in entries])])
    bounds = np.concatenate([[0], np.cumsum(n)])
    for i, block in enumerate(blocks):
        lo, hi = bounds[cut[i]], bounds[cut[i + 1]]
        at = np.flatnonzero(gone[lo:hi]) + lo
        if len(at):
            out["block"].append(block)
            out["bucket"].append(0)  # entries are counted from the block's first
            out["kind"].append("window")
            out["entry"].append(_planes(entries[i][phrase[at] - cut[i]], 4))
            out["value"].append(_planes(offset[at], 4))
    return pa.table({"block": pa.array(out["block"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()),
                     "kind": pa.array(out["kind"], pa.string()), "entry": pa.array(out["entry"], pa.binary()),
                     "value": pa.array(out["value"], pa.binary())})


def _cut_out(buckets: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        own = Block(rows, buckets) if rows.num_rows else None
        if own is None:
            raise RuntimeError("answers for a block without documents: the input changed between two reads")
        p, cut = own.parsed, own.bucket_starts(buckets)
        first = own.least.copy()
        windows = [[], []]
        replies = replies.to_pylist()
        hot = _entries(replies, "hot", cut)
        if len(hot):
            for found, own_windows in zip(windows, HotWindows(own, hot, buckets).gone(replies)):
                found.append(own_windows)
        for r in replies:
            if r["kind"] == "first":
                first[_from_planes(r["entry"], 4, np.int64) + cut[r["bucket"]]] = _from_planes(r["value"], 8, np.int64)
            elif r["kind"] == "window":
                windows[0].append(_from_planes(r["entry"], 4, np.int64))
                windows[1].append(_from_planes(r["value"], 4, np.int64))
        base = np.concatenate([[0], np.cumsum([len(t) for t in own.texts])])
        delta = np.zeros(base[-1] + 1, np.int32)
        ids = own.ids[p["doc"]] if len(p["doc"]) else np.zeros(0, np.int64)
        start = base[p["doc"]] + p["start"]
        whole = ids > first[own.entry] if len(ids) else np.zeros(0, bool)
        np.add.at(delta, start[whole], 1)
        np.add.at(delta, start[whole] + p["n"][whole] + WINDOW - 1, -1)
        if windows[0]:
            # occurrences in the entry's first document, entry by entry
            rest = np.flatnonzero(~whole)
            rest = rest[np.argsort(own.entry[rest], kind="stable")]
            entry, offset = np.concatenate(windows[0]), np.concatenate(windows[1])
            lo, hi = np.searchsorted(own.entry[rest], entry), np.searchsorted(own.entry[rest], entry, "right")
            times = hi - lo
            occurrence = rest[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            at = start[occurrence] + np.repeat(offset, times)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + WINDOW, -1)
        gone = np.cumsum(delta)[:-1] > 0
        spans, kept = [None] * len(own.texts), [None] * len(own.texts)
        for i, row in enumerate(own.rows):
            mask = gone[base[i]: base[i + 1]]
            if mask.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans[row] = [{"start": a, "end": b} for a, b in zip(turn[0::2].tolist(), turn[1::2].tolist())]
                kept[row] = np.frombuffer(own.texts[i], np.uint8)[~mask].tobytes()
            else:
                spans[row], kept[row] = [], own.texts[i]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": rows["doc_id"], "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})
    return run


def remove_repeats(docs: DataFrame, docs_per_block: int = DOCS_PER_BLOCK, hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """(doc_id, n_bytes, spans: removed byte ranges, kept: remaining bytes), a row per input row."""
    width = shuffle_width(docs)
    n_docs, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_of(F.col("text"))).cast("long"))).first()
    n_blocks = max(width, -(-n_docs // docs_per_block), -(-(size or 0) // BYTES_PER_BLOCK))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_id().alias("id"), text_of(F.col("text")).alias("text"))
    # one shuffle of the texts; the three uses below share it
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int")).repartition(width, "block")
    by_block = rows.groupBy("block")
    dictionary = by_block.applyInArrow(_dictionary(width), "bucket int, block int, trigger binary, phrase binary, least binary")
    # one shuffle of the dictionary; both uses below share it
    by_bucket = dictionary.repartition(width, "bucket").groupBy("bucket")
    counts = by_bucket.applyInArrow(_phrase_counts(width), "to int, bucket int, trigger binary, n binary")
    several = counts.groupBy("to").applyInArrow(_several(hot_phrases), "bucket int, few binary, many binary")
    firsts = by_bucket.cogroup(several.groupBy("bucket")).applyInArrow(_first_documents, REPLY).repartition(width, "block")
    phrases = by_block.cogroup(firsts.groupBy("block")).applyInArrow(
        _phrase_bytes(width), "kind string, bucket int, block int, entry binary, least binary, size binary, data binary")
    windows = phrases.groupBy("kind", "bucket").applyInArrow(_compared, REPLY)
    span = "array<struct<start:long,end:long>>"
    found = by_block.cogroup(firsts.unionByName(windows).groupBy("block")).applyInArrow(
        _cut_out(width), f"doc_id long, spans {span}, kept binary")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", (F.octet_length("kept").cast("long") + removed).alias("n_bytes"), "spans", "kept",
                        removed.alias("n_removed"))
