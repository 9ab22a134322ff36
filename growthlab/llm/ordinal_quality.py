"""Quality classifier: ordinal cumulative-link regression (operator 9).

A document has a grade: 0 for low quality, 1 for acceptable but toxic, 2 for good.  The
model is one weight vector shared by all grades and ordered thresholds:

    P(grade <= j) = sigmoid(threshold_j - weights . features)

so it yields the expected grade and the tail probabilities P(grade >= j); documents with
P(grade >= 2) below ``LEVEL`` are rejected.  The level is fixed: one taken from the least
likely of the good sampled documents would follow those labelled good by mistake.

Features are the distinct words of the whole text (A-Z lower-cased, split at everything
that is neither letter nor digit) and their beginnings, hashed into ``n_slots``, and a
few shape shares (capitals, symbols, repeated neighbours and words, line breaks) as
ladders: a share sets the rung of its logarithmic bin and every rung below, so rungs that
hold few sampled documents borrow from those beneath.  All features can only lower the
grade (their weights are at most zero), and only slots whose share of lower grades in the
sample exceeds the average by ``SCREEN`` standard errors get a weight (rungs, of which
there are few, by ``RUNG_SCREEN``): a long text must not outvote one clear word by its
mere length.  Sampled documents weigh alike, so the probabilities are those of the sample.

The model is fitted on a bounded, documented sample of the labelled rows
(``max_train``, chosen by a hash of the id, copies once); only the sample's hashed
features reach the driver.  Scoring is a map over every row, whole texts, without a shuffle.

Defined cases: a null or empty text has no words and is scored by its shape; labels with
a null are ignored, of several labels for an id the lowest grade counts; without any
labelled row, or with one grade only, the weights are zero and the grade shares decide
(no label at all: nothing is rejected); null ids are scored but never learned from;
repeated rows are scored alike; extra columns are carried in the ``doc`` struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.llm.common import PIECE, mix, packed, prefix_hash, shingle_hashes, small_batches, span_hash, word_hashes

N_GRADES = 3
N_BINS = 12
#: Word beginnings, in bytes, that are features beside the whole words.
STEMS = (5, 6, 7, 8)
#: Standard errors by which a slot's (a rung's) share of lower grades must exceed the average.
SCREEN, RUNG_SCREEN = 4.0, 2.0
#: Sampled documents on a rung that has a weight.
RUNG_DOCS = 3
#: P(grade >= 2) below which a document is rejected.
LEVEL = 0.5
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def _bin(part: float, whole: float) -> int:
    """Logarithmic bin of a share: 0 for none, then one bin per factor of two."""
    return 0 if part <= 0 else int(max(1, min(N_BINS - 1, N_BINS - 1 + np.floor(np.log2(part / max(whole, 1))))))


def features(text: bytes, n_slots: int) -> np.ndarray:
    """Sorted distinct slots of a text: hashed words, then the rungs of its shape shares."""
    slots, n_words, n_distinct, n_upper, n_letters, n_symbols, n_same, n_lines = [], 0, 0, 0, 0, 0, 0, 1
    last, at = None, 0
    while at < len(text):
        raw = np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at)
        if at + len(raw) < len(text) and len(cut := np.flatnonzero(~_ALNUM[raw[-4096:]])):
            raw = raw[: len(raw) - min(4096, len(raw)) + int(cut[-1]) + 1]  # not inside a word
        at += len(raw)
        data = _LOWERED[raw]
        inside = np.concatenate(([False], _ALNUM[data], [False]))
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop, running = turn[0::2], turn[1::2], prefix_hash(data)
        words = span_hash(running, start, stop)
        if last is not None and len(words):
            n_same += int(words[0] == last)
        n_same += int(np.count_nonzero(words[1:] == words[:-1]))
        last = words[-1] if len(words) else last
        n_words += len(words)
        words, first = np.unique(words, return_index=True)
        n_distinct += len(words)
        start, size = start[first], (stop - start)[first]
        slots.append(words % np.uint64(n_slots))
        for stem in STEMS:
            begin = start[size > stem]
            slots.append(mix(span_hash(running, begin, begin + stem) + np.uint64(stem)) % np.uint64(n_slots))
        n_upper += int(np.count_nonzero((raw >= 65) & (raw <= 90)))
        n_letters += int(np.count_nonzero(_ALNUM[raw]))
        n_symbols += int(np.count_nonzero((raw > 32) & (raw < 127) & ~_ALNUM[raw] & (raw != 44) & (raw != 46)))
        n_lines += int(np.count_nonzero(raw == 10))
    own = np.unique(np.concatenate(slots)).astype(np.int64) if slots else np.zeros(0, np.int64)
    shape = [_bin(n_upper, n_letters), _bin(n_symbols, n_words), _bin(n_same, n_words), _bin(max(n_words - n_distinct, 0), n_words), _bin(n_lines, n_words)]
    rungs = [n_slots + i * N_BINS + np.arange(b + 1) for i, b in enumerate(shape)]
    return np.concatenate([own, *rungs])


N_SHAPES = 5


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic flags; the lowest grade of an id counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") != 0, 1).otherwise(2)
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def training_sample(docs: DataFrame, labels: DataFrame, max_train: int, n_slots: int) -> list:
    """[(slots, grade)] of about ``max_train`` labelled documents.  The chosen labels are at
    most that many small rows (the hash share is set from their count), so they are
    broadcast and the documents are not shuffled."""
    rows = graded(labels)
    n = rows.count()
    share = min(1.0, max_train / max(n, 1))
    spread = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(rows.where(spread < share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch["text"]]
            found = [features(t, n_slots).astype(np.int32).tobytes() for t in texts]
            runs = [shingle_hashes(word_hashes(t)) for t in texts]
            copy = [int(r[0].astype(np.int64)) if len(r) else 0 for r in runs]
            yield pa.RecordBatch.from_pydict({"slots": pa.array(found, pa.binary()), "grade": batch["grade"],
                                              "copy": pa.array(copy, pa.int64())})

    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("text", "grade")
    found = sample.mapInArrow(run, "slots binary, grade int, copy long").collect()
    # copies share the least of their hashed word runs; one of them teaches
    once = {r["copy"]: r for r in sorted(found, key=lambda r: (r["copy"], r["slots"], -r["grade"]))}
    return [(np.frombuffer(r["slots"], np.int32), r["grade"]) for r in once.values()]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights shared by all grades, of the ``slots`` that have one, and the ordered thresholds."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.slots, self.weights, self.thresholds = slots, weights, thresholds

    def score(self, found: np.ndarray) -> float:
        place = np.searchsorted(self.slots, found)
        hit = place < len(self.slots)
        hit[hit] = self.slots[place[hit]] == found[hit]
        return float(self.weights[place[hit]].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 ... N_GRADES - 1, a column each."""
        return 1 - _sigmoid(self.thresholds[None, :] - scores[:, None])


def telling(sample: list, shares: np.ndarray, n_slots: int, min_docs: int) -> np.ndarray:
    """The slots, ascending, that lower grades hold more often than chance explains; ``shares``
    are the shares of sampled documents below grade 1, 2.  Counts stand in narrow arrays by
    slot, filled document by document, so the sample is never copied."""
    size = n_slots + N_SHAPES * N_BINS
    counts = np.zeros((N_GRADES, size), np.uint16 if len(sample) < 1 << 16 else np.uint32)
    for slots, grade in sample:
        counts[grade, slots] += 1  # a document's slots are distinct
    out = []
    for lo in range(0, size, 1 << 20):
        part = counts[:, lo: lo + (1 << 20)].astype(np.int64)
        found, at = part.sum(0), lo + np.arange(part.shape[1])
        used, screen = np.zeros(len(at), bool), np.where(at < n_slots, SCREEN, RUNG_SCREEN)
        for j, share in enumerate(shares, 1):
            used |= part[:j].sum(0) - found * share > screen * np.sqrt(np.maximum(found * share * (1 - share), 0.25))
        out.append(at[used & (found >= np.where(at < n_slots, min_docs, RUNG_DOCS))])
    return np.concatenate(out)


def fit(sample: list, n_slots: int, min_docs: int = 8, penalty: float = 0.01, steps: int = 3000) -> Ordinal:
    """Maximum penalised likelihood by Adam on the whole sample.  Slots found in fewer than
    ``min_docs`` sampled documents have no weight."""
    nothing = np.zeros(0, np.int64), np.zeros(0)
    if not sample:
        return Ordinal(*nothing, np.full(N_GRADES - 1, -20.0))
    n = len(sample)
    grade = np.array([g for _, g in sample])
    shares = np.clip(np.cumsum(np.bincount(grade, minlength=N_GRADES) / n)[:-1], 1e-3, 1 - 1e-3)
    even = np.log(shares / (1 - shares))
    base, gap = even[0], np.log(np.maximum(np.diff(even), 0.05))
    cuts_of = lambda own: own[0] + np.concatenate([[0], np.cumsum(np.exp(own[1:]))])
    if len(set(grade.tolist())) == 1:
        return Ordinal(*nothing, cuts_of(np.concatenate([[base], gap])))
    slots = telling(sample, shares, n_slots, min_docs)
    size = len(slots)
    own = [np.searchsorted(slots, s[np.isin(s, slots)]) for s, _ in sample]
    row, flat = np.repeat(np.arange(n), [len(s) for s in own]), np.concatenate(own)
    param = np.concatenate([np.zeros(size), [base], gap])
    m, v = np.zeros_like(param), np.zeros_like(param)
    for t in range(1, steps + 1):
        w, cuts = param[:size], cuts_of(param[size:])
        score = np.bincount(row, w[flat], n)
        edges = np.concatenate([np.zeros((n, 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((n, 1))], 1)
        low, high = edges[np.arange(n), grade], edges[np.arange(n), grade + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p / n, low * (1 - low) / p / n
        g_cut = np.zeros(N_GRADES + 1)
        np.add.at(g_cut, grade + 1, -d_high)
        np.add.at(g_cut, grade, d_low)
        g_cut = g_cut[1:-1]
        g = np.concatenate([np.bincount(flat, (d_high - d_low)[row], size) + penalty / n * w, [g_cut.sum()],
                            np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(param[size + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        param = param - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        param[:size] = np.minimum(param[:size], 0)
    return Ordinal(slots, param[:size], cuts_of(param[size:]))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 10_000, n_slots: int = 1 << 22) -> tuple[Ordinal, int]:
    small_batches(docs.sparkSession)
    return fit(training_sample(docs, labels, max_train, n_slots), n_slots), n_slots


def score(docs: DataFrame, model: Ordinal, n_slots: int) -> DataFrame:
    """(doc, expected_grade, p_ok, p_good, kept) of every row: P(grade >= 1), P(grade >= 2)."""
    small_batches(docs.sparkSession)
    rows = packed(docs)
    kind = rows.schema["doc"].dataType.simpleString()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["doc"].field(place)
            scores = np.array([model.score(features((t.as_py() or "").encode(), n_slots)) for t in texts])
            tails = model.tails(scores.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(tails[:, 1] >= LEVEL)],
                names=["doc", "expected_grade", "p_ok", "p_good", "kept"])

    return rows.mapInArrow(
        run, f"doc {kind}, expected_grade double, p_ok double, p_good double, kept boolean")
