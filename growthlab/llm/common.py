"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of the word and line rules: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents without an id count as one whose id is below every other.
NO_ID = -(2**63)


def order_id(column: str | Column = "doc_id") -> Column:
    """The id as a long that sorts nulls below every id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def text_of(column: str | Column = "text") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def packed(df: DataFrame, name: str = "doc") -> DataFrame:
    """Every input column inside one struct, so that no operator column can clash with it."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def shuffle_width(df: DataFrame) -> int:
    """The session's shuffle partition count, the one knob a cluster sets for data size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark) -> None:
    """Fewer rows per Arrow batch than Spark's default of 10,000, which with whole texts makes
    batches of tens of megabytes in the executor and again in its Python workers.  A session
    that has a value of its own keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def release(spark) -> None:
    """Lets Spark delete the shuffle files of finished work now: it does so when the driver's
    garbage is collected, which a mostly idle driver may put off for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the published splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least n + 1 places."""
    size = 1 << max(12, int(n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of a byte array: entry i covers the first i bytes."""
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal spans have equal hashes."""
    _, down = _powers(len(prefix) - 1)
    with np.errstate(over="ignore"):
        own = (prefix[end] - prefix[start]) * down[start]
        return mix(own + mix((end - start).astype(np.uint64) + np.uint64(1)))


#: Words of more bytes are hashed by a cryptographic function: long words can be built so
#: that they agree under every polynomial hash modulo 2**64.
LONG_WORD = 256
#: Bytes of text whose running hashes are held at a time.
SPAN_PIECE = 1 << 19


def hash_words(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [start, stop) of a byte array, which stand in order."""
    out = np.zeros(len(start), np.uint64)
    long = stop - start > LONG_WORD
    for i in np.flatnonzero(long).tolist():
        digest = hashlib.blake2b(data[start[i]: stop[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    short = np.flatnonzero(~long)
    if len(short):
        piece = start[short] // SPAN_PIECE
        for part in np.split(short, np.flatnonzero(np.diff(piece)) + 1):
            at = start[part[0]]
            out[part] = span_hash(prefix_hash(data[at: stop[part[-1]]]), start[part] - at, stop[part] - at)
    return out


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are no letter, digit or part of a longer character.
ALNUM = np.ones(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
#: Bytes that are hashed at a time; longer texts are cut at white space.
PIECE = 1 << 21


def word_spans(data: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of non-blank bytes."""
    inside = np.concatenate(([False], ~blank[data], [False]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return turn[0::2], turn[1::2]


def word_hashes(text: bytes, blank: np.ndarray = _BLANK) -> np.ndarray:
    """One 64-bit hash for each word of a UTF-8 text, A-Z lower-cased; ``blank`` tells the
    bytes that part words."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = max(text.rfind(b, at, end) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut > at:
                end = cut + 1
            else:  # one word longer than a piece: go on to its end
                ends = [p for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(b, end)) >= 0]
                end = min(ends, default=len(text) - 1) + 1
        data = _LOWERED[np.frombuffer(text, np.uint8, end - at, at)]
        start, stop = word_spans(data, blank)
        if len(start):
            parts.append(hash_words(data, start, stop))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words make one run."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        width = min(size, n)
        acc = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            acc = mix(acc * _BASE + words[i: n - width + 1 + i])
    return np.unique(acc)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def batch_words(texts: list[bytes], blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts, one after another, and the bounds of each text.
    Short texts are hashed together, which spares numpy calls; long ones by themselves."""
    parts, sizes, group, held = [], [], [], 0

    def flush():
        nonlocal group, held
        if group:
            joined = b" ".join(group)
            data = _LOWERED[np.frombuffer(joined, np.uint8)]
            start, stop = word_spans(data, blank)
            ends = np.cumsum([len(t) + 1 for t in group])
            parts.append(hash_words(data, start, stop))
            sizes.extend(np.diff(np.searchsorted(start, ends), prepend=0).tolist())
        group, held = [], 0

    for t in texts:
        if len(t) >= PIECE:
            flush()
            parts.append(word_hashes(t, blank))
            sizes.append(len(parts[-1]))
            continue
        group.append(t)
        held += len(t)
        if held >= PIECE // 4:
            flush()
    flush()
    bounds = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds


def batch_shingles(texts: list[bytes], size: int = 5):
    """Yields the sorted distinct shingle hashes of each text, as shingle_hashes would."""
    words, bounds = batch_words(texts)
    runs = np.full(max(len(words) - size + 1, 0), size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            runs = mix(runs * _BASE + words[i: len(words) - size + 1 + i])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(runs[a: b - size + 1]) if b - a >= size else shingle_hashes(words[a:b], size)
