"""Byte-level BPE encoding and decoding by a global distinct-word shuffle (operator 6).

1. Texts are split into pre-tokens.  A block, a bounded number of bytes of documents, keeps
   its pre-tokens as positions into the list of its distinct words.
2. The distinct words of all blocks are dealt by their hash, so that each distinct word of
   the corpus is encoded once, however many documents hold it.
3. The ids come back to the blocks and are put in place by position.
4. Decoding joins ids with the token-byte table, whose size is the vocabulary's.

A block sends a word once, so a word that every text holds costs a row per block.  Words
are grouped by hash bucket, which spreads evenly; texts are read once and not shuffled,
only positions are.

Defined cases: null and empty texts have no tokens; null ids and repeated rows are encoded
like any other; long texts are handled whole (a block holds at least one document); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.llm.common import shuffle_width, small_batches, text_of

BLOCK_BYTES = 8 << 20
_TOOLS: dict[str, tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _encoder(path: str) -> tiktoken.Encoding:
    """Merges one pre-token; the pattern takes the whole string, which is not split again."""
    if path not in _TOOLS:
        ranks = read_ranks(path)
        _TOOLS[path] = (tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}),
                        {rank: token for token, rank in ranks.items()})
    return _TOOLS[path][0]


def _token_bytes(path: str) -> dict[int, bytes]:
    _encoder(path)
    return _TOOLS[path][1]


def _planes(values: np.ndarray) -> bytes:
    """The low bytes of unsigned 32-bit values, plane by plane, compressed: three planes, four
    where a value needs them."""
    size = 3 if values.max(initial=0) < 1 << 24 else 4
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size]
    return bytes([size]) + zlib.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def _from_planes(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view("<u4")


def _packed(words: list[str]) -> bytes:
    """The lengths in bytes, then the bytes of the words, compressed."""
    coded = [w.encode() for w in words]
    sizes = np.array([len(w) for w in coded], "<u4")
    return zlib.compress(len(coded).to_bytes(8, "little") + sizes.tobytes() + b"".join(coded), 1)


def _unpacked(data: bytes) -> list[str]:
    data = zlib.decompress(data)
    n = int.from_bytes(data[:8], "little")
    ends = (8 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 8), dtype=np.int64)).tolist()
    return [data[a:b].decode() for a, b in zip([8 + 4 * n, *ends], ends)]


def _parse(pattern: str):
    """Documents to blocks: ids, pre-tokens per document, positions, distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        task, number = TaskContext.get().partitionId(), 0
        ids, sizes, places, words, held = [], [], [], {}, 0

        def block():
            flat = np.concatenate(places) if places else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{number}"], pa.string()), pa.array([ids], pa.list_(id_type)),
                 pa.array([np.array(sizes, np.uint32).tobytes()], pa.binary()), pa.array([_planes(flat)], pa.binary()),
                 pa.array([_packed(list(words))], pa.binary())], names=["block", "ids", "sizes", "places", "words"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch["doc_id"].type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py() or ""
                found = split(text)
                ids.append(doc_id)
                sizes.append(len(found))
                places.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32, len(found)))
                held += len(text)
                if held >= BLOCK_BYTES or len(words) >= 1 << 23:
                    yield block()
                    number += 1
                    ids, sizes, places, words, held = [], [], [], {}, 0
        if ids:
            yield block()
    return run


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


def _deal(buckets: int):
    """The distinct words of a block, in order, by hash bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch["block"].to_pylist(), batch["words"]):
                dealt: list[list[str]] = [[] for _ in range(buckets)]
                for w in _unpacked(words.as_py()):
                    dealt[_bucket(w, buckets)].append(w)
                full = [b for b in range(buckets) if dealt[b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.string()),
                     pa.array([_packed(dealt[b]) for b in full], pa.binary())], names=["bucket", "block", "words"])
    return run


def _encode(path: str):
    """Every distinct word of a bucket once; the answers go back by block, in its order."""
    def run(rows: pa.Table) -> pa.Table:
        encode, known = _encoder(path).encode_ordinary, {}
        counts, ids = [], []
        for words in rows["words"]:
            n, flat = [], []
            for w in _unpacked(words.as_py()):
                found = known.get(w)
                if found is None:
                    found = known[w] = encode(w)
                n.append(len(found))
                flat += found
            counts.append(np.array(n, np.uint32).tobytes())
            ids.append(_planes(np.array(flat, np.uint32)))
        return pa.table({"bucket": rows["bucket"], "block": rows["block"], "counts": pa.array([zlib.compress(c, 1) for c in counts], pa.binary()),
                         "ids": pa.array(ids, pa.binary())})
    return run


def _assemble(buckets: int, path: str):
    """Positions to ids, and ids to the bytes that the token table gives them."""
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        table = _token_bytes(path)
        out_ids, out_sizes, out_bytes, doc_ids = [], [], [], []
        own = {r["bucket"]: r for r in answers.to_pylist()}
        for row in blocks.to_pylist():
            at, words = [[] for _ in range(buckets)], _unpacked(row["words"])
            for i, w in enumerate(words):
                at[_bucket(w, buckets)].append(i)
            n = np.zeros(len(words), np.int64)
            parts = []
            for b, places in enumerate(at):
                if places:
                    counts = np.frombuffer(zlib.decompress(own[b]["counts"]), np.uint32)
                    n[places] = counts
                    parts.append((np.array(places), counts.astype(np.int64), _from_planes(own[b]["ids"])))
            start = np.cumsum(n) - n
            flat = np.zeros(int(n.sum()), np.int64)
            for places, counts, ids in parts:
                flat[np.repeat(start[places] - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
            spelled = [b"".join(map(table.__getitem__, flat[s: s + k].tolist())) for s, k in zip(start.tolist(), n.tolist())]
            places, sizes = _from_planes(row["places"]).astype(np.int64), np.frombuffer(row["sizes"], np.uint32)
            end = 0
            for size in sizes.tolist():
                own_places = places[end: end + size]
                end += size
                k = n[own_places]
                out_ids.append(flat[np.repeat(start[own_places] - (np.cumsum(k) - k), k) + np.arange(k.sum())].astype(np.int32))
                out_sizes.append(int(k.sum()))
                out_bytes.append(b"".join(map(spelled.__getitem__, own_places.tolist())))
            doc_ids += row["ids"]
        ends = np.concatenate([[0], np.cumsum(out_sizes)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out_ids) if out_ids else np.zeros(0, np.int32)))
        kind = blocks.schema.field("ids").type.value_type
        return pa.table({"doc_id": pa.array(doc_ids, kind), "ids": ids, "decoded": pa.array(out_bytes, pa.binary())})
    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids: array of int, decoded: bytes of the ids), a row per input row.

    The rank file must be readable at ``ranks_path`` on the executors; the input must be
    deterministic (a table, or checkpointed), as a lost block is parsed again."""
    small_batches(docs.sparkSession)
    width = shuffle_width(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # one shuffle of the blocks, which both uses below share
    blocks = (docs.select("doc_id", text_of(F.col("text")).alias("text"))
              .mapInArrow(_parse(pattern), f"block string, ids array<{kind}>, sizes binary, places binary, words binary")
              .repartition(width, "block"))
    answers = (blocks.mapInArrow(_deal(width), "bucket int, block string, words binary").groupBy("bucket")
               .applyInArrow(_encode(ranks_path), "bucket int, block string, counts binary, ids binary"))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _assemble(width, ranks_path), f"doc_id {kind}, ids array<int>, decoded binary")
