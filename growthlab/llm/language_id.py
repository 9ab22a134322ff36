"""Language identification by rank-order profiles (operator 5).

A language's profile is the list of its most frequent letter n-grams (one to three
letters, ``_`` at word ends) in rank order.  A document is compared with each profile by
the out-of-place distance: for every n-gram of the document's own list, how far its rank
is from the rank in the profile, or the full list length when the profile lacks it.  The
nearest profile gives the language; the score is one minus the distance over its largest
possible value.

Profiles are learned from a bounded sample of the labelled rows (``per_lang`` documents
a language, in whole, chosen by a hash of the id); every document is then scored in
whole, in a map without a shuffle.  The n-grams of the document's list are those that
at least one profile ranks: any other n-gram costs every language the same.

Defined cases: a null text, or one without a letter, gives ``und`` with score 0; so does
a table without labelled rows; ties between languages go to the first by name, ties
between n-grams to the smaller one; a null id counts as the empty string for the
hold-out rule; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlab.llm.common import small_batches

UNKNOWN = "und"
#: Languages up to which their sizes are broadcast.
MANY_LANGS = 10_000
CHUNK = 400_000  # code points handled at a time
_LETTER: list[np.ndarray] = []


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4 == 2


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def pieces(text: str) -> Iterator[str]:
    """The text in parts of bounded length, cut at blanks where there are any."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for whatever is no letter, 0 at both ends."""
    raw = np.frombuffer(("\x00" + text.lower() + "\x00").encode("utf-32-le", "replace"), np.uint32)
    return np.where(_letters()[raw], raw, 0)


def grams(codes: np.ndarray, bits: int = 21) -> list[np.ndarray]:
    """Packed n-grams for n = 1, 2, 3.  Bigrams hold a letter, trigrams one in the middle."""
    c = codes.astype(np.int64)
    one = c[c > 0]
    two = ((c[:-1] << bits) | c[1:])[(c[:-1] > 0) | (c[1:] > 0)]
    three = ((c[:-2] << 2 * bits) | (c[1:-1] << bits) | c[2:])[c[1:-1] > 0]
    return [one, two, three]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, n_found) of each task's share of the sample."""
    total: dict[str, list[dict[int, int]]] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            own = total.setdefault(lang, [{}, {}, {}])
            for piece in pieces(text.as_py()):
                for found, keys in zip(own, grams(_codes(piece))):
                    for k, v in zip(*(x.tolist() for x in np.unique(keys, return_counts=True))):
                        found[k] = found.get(k, 0) + v
    for lang, own in total.items():
        for n, found in enumerate(own, 1):
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(found), pa.string()), "n": pa.array([n] * len(found), pa.int32()),
                "gram": pa.array(list(found), pa.int64()), "n_found": pa.array(list(found.values()), pa.int64())})


def learn_profiles(docs: DataFrame, length: int = 400, per_lang: int = 1500) -> list[tuple[str, list[tuple[int, int]]]]:
    """[(lang, [(n, gram), ...] in rank order)] from rows with a text and a lang.  The sample
    holds about ``per_lang`` documents of each language, all of them where there are
    fewer; the result has at most ``length`` n-grams a language."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("size"))
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("profile")), F.lit(1 << 30)) / float(1 << 30)
    shares = sizes.select("lang", share.alias("share"))
    # a row per language: broadcast after a look at their number, so that texts stay where they are
    if shares.limit(MANY_LANGS + 1).count() <= MANY_LANGS:
        shares = F.broadcast(shares)
    sample = (rows.select("lang", "text", spread.alias("spread")).join(shares, "lang")
              .where(F.col("spread") < F.col("share")).select("lang", "text"))
    counts = (sample.mapInArrow(_counted, "lang string, n int, gram long, n_found long")
              .groupBy("lang", "n", "gram").agg(F.sum("n_found").alias("n_found")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_found"), "n", "gram"))
    top = counts.withColumn("place", rank).where(F.col("place") <= length).orderBy("lang", "place").collect()
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        found.setdefault(r["lang"], []).append((r["n"], r["gram"]))
    return sorted(found.items())


class Profiles:
    """The profiles as lookup tables; small, and sent with the scoring function."""

    def __init__(self, profiles: list[tuple[str, list[tuple[int, int]]]], length: int):
        self.langs, self.length = [lang for lang, _ in profiles], length
        known = sorted({g for _, own in profiles for g in own})
        self.ranks = np.full((len(profiles), len(known)), -1, np.int32)
        place = {g: i for i, g in enumerate(known)}
        for row, (_, own) in zip(self.ranks, profiles):
            row[[place[g] for g in own]] = np.arange(len(own))
        used = sorted({(g >> s) & 0x1FFFFF for _, g in known for s in (0, 21, 42)} - {0})
        self.alphabet = np.array(used, np.int64)
        self.bits = max(2, int(len(used) + 1).bit_length())
        self.n_known = len(known)
        code = {c: i + 2 for i, c in enumerate(used)} | {0: 0}
        self.keys = []
        for n in (1, 2, 3):
            packed = [(sum(code[(g >> 21 * s) & 0x1FFFFF] << self.bits * s for s in range(3)), place[m, g]) for m, g in known if m == n]
            self.keys.append(np.array(sorted(packed), np.int64).reshape(-1, 2))
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def tables(self):
        """Code point -> small code, and packed n-gram -> place among the known ones (the
        last place stands for the unknown); dense where the alphabet allows it."""
        if self._tables is None:
            small = _letters().astype(np.int32)  # 1: a letter that no profile has
            small[self.alphabet] = np.arange(len(self.alphabet)) + 2
            dense = []
            for n, pairs in enumerate(self.keys, 1):
                if n * self.bits > 24:
                    dense.append(None)
                    continue
                t = np.full(1 << n * self.bits, self.n_known, np.int32)
                t[pairs[:, 0]] = pairs[:, 1]
                dense.append(t)
            self._tables = small, dense
        return self._tables

    def places(self, codes: np.ndarray, n: int) -> np.ndarray:
        _, dense = self.tables()
        b, c = self.bits, codes
        keys = c if n == 1 else (c[:-1] << b) | c[1:] if n == 2 else (c[:-2] << 2 * b) | (c[1:-1] << b) | c[2:]
        table, pairs = dense[n - 1], self.keys[n - 1]
        if table is not None:
            return table[keys]
        if not len(pairs):
            return np.full(len(keys), self.n_known)
        at = np.minimum(np.searchsorted(pairs[:, 0], keys), len(pairs) - 1)
        return np.where(pairs[at, 0] == keys, pairs[at, 1], self.n_known)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-gram counts (texts x known n-grams), and whether each text has a letter."""
        small, _ = self.tables()
        joined = "\x00".join(["", *(t.lower().replace("\x00", " ") for t in texts), ""])
        raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        codes = small[raw].astype(np.int64)
        owner = np.cumsum(raw == 0) - 1
        width = self.n_known + 1
        total = np.zeros(len(texts) * width, np.int64)
        letter = np.zeros(len(texts), bool)
        letter[owner[codes > 0]] = True
        for n in (1, 2, 3):
            # a separator belongs to the text behind it; a trigram to the text of its middle
            at = owner[: len(codes) - n + 1] if n < 3 else owner[1: len(codes) - 1]
            places = self.places(codes, n)
            keep = (places < self.n_known) & (at < len(texts))
            total += np.bincount(at[keep] * width + places[keep], minlength=len(total))
        return total.reshape(len(texts), width)[:, : self.n_known], letter

    def nearest(self, counts: np.ndarray, letter: np.ndarray) -> tuple[list[str], list[float]]:
        if not self.langs or not len(counts):
            return [UNKNOWN] * len(counts), [0.0] * len(counts)
        k = min(self.length, self.n_known)
        order = np.argsort(-counts, axis=1, kind="stable")[:, :k]
        there = np.take_along_axis(counts, order, 1) > 0
        n = np.maximum(there.sum(1), 1)
        away = np.empty((len(self.langs), len(counts)))
        for i, ranks in enumerate(self.ranks):
            r = ranks[order]
            d = np.where(r < 0, self.length, np.minimum(np.abs(r - np.arange(k)), self.length))
            away[i] = (d * there).sum(1) / (n * self.length)
        away[:, ~there.any(1)] = 1.0
        best = away.argmin(0)
        return ([self.langs[b] if has else UNKNOWN for b, has in zip(best, letter)],
                [float(1 - away[b, j]) if letter[j] else 0.0 for j, b in enumerate(best)])


def _groups(texts: list[str | None], most: int = 256) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) pairs in groups of bounded size."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text or ""):
            group.append((i, piece))
            size += len(piece)
            if size >= CHUNK or len(group) >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def predict(docs: DataFrame, profiles: list, length: int = 400) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    model = Profiles(profiles, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts = np.zeros((batch.num_rows, model.n_known), np.int64)
                letter = np.zeros(batch.num_rows, bool)
                for group in _groups(batch["text"].to_pylist()):
                    found, has = model.counts([p for _, p in group])
                    rows = np.array([i for i, _ in group])
                    np.add.at(counts, rows, found)
                    np.logical_or.at(letter, rows, has)
                langs, scores = model.nearest(counts, letter)
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "lang_pred": pa.array(langs, pa.string()),
                                                  "score": pa.array(scores, pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, length: int = 400, per_lang: int = 1500) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row."""
    small_batches(docs.sparkSession)
    profiles = learn_profiles(docs.where(~held_out()).select("doc_id", "lang", "text"), length, per_lang)
    return predict(docs, profiles, length)
