"""Token counts by batch encoding (operator 12).

The installed tokenizer library encodes whole texts inside an Arrow function, and only
the lengths come back: no ids, offsets or token strings leave the worker.  The rows of
an Arrow batch are dealt into encoding batches of about ``batch_bytes`` UTF-8 bytes, so
that a batch of many short texts and one of a few long texts cost the same memory; a
text longer than ``piece_chars`` is cut and its pieces are counted one by one.

A cut is made only where the vocabulary's own splitting rule starts a new pre-token
whatever stands on either side, so the counts of the pieces add up to the count of the
whole text:

* before a space or line break that follows a character that is no white space;
* between an ASCII letter and an ASCII digit;
* between a CJK ideograph and a CJK full stop, comma or bracket.

No rule of byte-level pre-splitting joins these two sides, and the special strings of
such a vocabulary hold none of these places (the constructor checks that).  A piece ends
at the last safe place within ``piece_chars``, or at the next one after it: a single
pre-token longer than that is never cut, because its merges may span any place in it.

It is a map over the rows: no shuffle, and no key can be hot.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a
text count as the library counts them by default, as one token; very long texts are cut
as above; repeated rows and ties are counted alike; a null id stays null; an empty table
gives an empty result; other columns, whatever their names, travel in the ``doc`` struct.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.llm.common import packed, small_batches

#: Places at which every byte-level pre-splitting rule starts anew.
SAFE = re.compile("(?<=[^\\s\x1c-\x1f\x85])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
                  "|(?<=[一-龥])(?=[、。「」，])")


def pieces(text: str, size: int) -> Iterator[str]:
    """Cuts a text at safe places into pieces of about ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut, back = at, 256
        while cut == at and back < 2 * size:  # the last safe place, looked for ever further back
            low = max(at + 1, at + size - back)
            for found in SAFE.finditer(text, low, at + size + 1):
                cut = found.start()
            back *= 8
        if cut == at:
            after = SAFE.search(text, at + size)
            if after is None:
                break
            cut = after.start()
        yield text[at:cut]
        at = cut
    yield text[at:]


class Counter:
    """Counts by a tokenizer file of the ``tokenizers`` library, loaded once per worker."""

    def __init__(self, path: str, batch_bytes: int, piece_chars: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        for added in self.coder.get_added_tokens_decoder().values():
            if added.lstrip or added.rstrip or SAFE.search(added.content):
                raise ValueError(f"a text cannot be cut safely beside the special string {added.content!r}")
        self.batch_bytes, self.piece_chars = batch_bytes, piece_chars

    def counts(self, texts: list[str]) -> list[int]:
        totals, batch, owners, held = [0] * len(texts), [], [], 0
        for i, text in enumerate(texts):
            for piece in pieces(text, self.piece_chars):
                batch.append(piece)
                owners.append(i)
                held += len(piece.encode())
                if held >= self.batch_bytes:
                    self._add(batch, owners, totals)
                    batch, owners, held = [], [], 0
        self._add(batch, owners, totals)
        return totals

    def _add(self, batch: list[str], owners: list[int], totals: list[int]) -> None:
        for i, found in zip(owners, self.coder.encode_batch_fast(batch, add_special_tokens=False)):
            totals[i] += len(found)


def token_counts(docs: DataFrame, path: str, limit: int = 512, batch_bytes: int = 1 << 18, piece_chars: int = 1 << 16) -> DataFrame:
    """(doc, n_bytes, n_tokens, over_limit) of every row; ``path`` is a tokenizer file that
    every worker can open, ``over_limit`` tells more than ``limit`` tokens."""
    small_batches(docs.sparkSession)
    rows = packed(docs)
    kind = rows.schema["doc"].dataType.simpleString()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, batch_bytes, piece_chars)
        for batch in batches:
            texts = [t or "" for t in batch["doc"].field(place).to_pylist()]
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(n_bytes, pa.int64()), pa.array(counter.counts(texts), pa.int64())],
                                             names=["doc", "n_bytes", "n_tokens"])

    found = rows.mapInArrow(run, f"doc {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
