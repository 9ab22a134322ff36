"""op12 against the tokenizer library on whole texts."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from growthlab.llm import queries
from growthlab.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"ab1 2'st\n  .,!é  中文。，\t\x0b\x1c\x85　²½", "<|endoftext|>", "'s", "'ll", " the"]


def whole(texts):
    coder = Tokenizer.from_file(PATH)
    return [len(coder.encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("size", [1, 7, 60])
def test_cut_texts_add_up(size):
    rng = random.Random(size)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 300))) for _ in range(800)]
    assert C.Counter(PATH, 500, size).counts(texts) == whole(texts)


def test_pieces():
    text = "word " * 5000 + "x" * 3000 + " end"
    parts = list(C.pieces(text, 100))
    assert "".join(parts) == text and max(map(len, parts)) < 3200 and len(parts) > 200
    assert list(C.pieces("中文" * 500, 100)) == ["中文" * 500]  # one pre-token


def test_rows(spark, make_docs, messy_rows):
    rows = [*messy_rows, (None, "no id <|endoftext|>"), (80, "many words " * 400), (80, "many words " * 400), (81, "y" * 200_000)]
    got = C.token_counts(make_docs(rows), PATH, piece_chars=64).collect()
    want = whole([t or "" for _, t in rows])
    assert sorted((str(r.doc.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (str(d), len((t or "").encode()), n, n > 512) for (d, t), n in zip(rows, want))
    assert C.token_counts(make_docs([]), PATH).collect() == []


def test_other_columns(make_docs, messy_rows):
    docs = make_docs(messy_rows)
    odd = docs
    for name in ("doc", "n_bytes", "n_tokens", "over_limit"):
        odd = odd.withColumn(name, F.lit(name))
    rows = lambda d: sorted((r.doc.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(d, PATH).collect())
    assert rows(odd) == rows(docs)


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op12_token_counts"](spark, path).collect()}
    assert got == dict(zip([d for d, _ in texts], whole([t or "" for _, t in texts])))
