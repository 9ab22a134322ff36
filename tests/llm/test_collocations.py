"""op11 against a plain count of every phrase, and its automata."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthlab.llm import collocations as C

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_count, cover=80, top=2000):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i: i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= min_count}
        around = Counter()
        for g, c in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    around[g[i: i + k]] = max(around[g[i: i + k]], c)
        found = []
        for g, a in cand.items():
            if 100 * around[g] < cover * a:
                s, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-s, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    words = ["of", "The", "the", "é", "new", "york", "city", "x" * 300, "ß a", "in", "a-b"]
    rows = [(None, None), ("en", ""), ("en", " \t\n.,;"), ("fr", None)]
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return rows + [("en", "New York City " * 2000), ("de", "one two " * 30)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i % 50, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


def result(found):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect())


@pytest.mark.parametrize("options", [{}, {"mask": 7}, {"filter_bits": 7}])
def test_equals_a_plain_count(spark, options):
    """Also with clashing word symbols and with a bitmap that lets nearly all through."""
    rows = rows_of(1)
    assert result(C.mine(docs_of(spark, rows), min_count=30, **options)) == plain(rows, 30)


def test_top_cuts_through_ties(spark):
    rows = rows_of(2)
    assert result(C.mine(docs_of(spark, rows), min_count=2, top=7)) == plain(rows, 2, top=7)


@pytest.mark.parametrize("size", [1, 7, 40, 400])
def test_cut_texts_count_every_phrase_once(size):
    rng = random.Random(size)
    text = "".join(rng.choice(["a", "bb", "ccc", "d" * 50]) + rng.choice([" ", " ", "\t", " \t ", ". ", "\n"]) for _ in range(600)).encode()

    def counted(parts):
        w = C.Words(parts, np.zeros(0, np.uint64), 2**64 - 1)
        everything = C.PartFilter(None, 7)
        two, three = C.phrases(w, 9, (2,), everything), C.phrases(w, 9, (3, 4), everything)
        return Counter({(*map(int, p),): int(c) for paths, counts in (two, three) for *p, c in zip(*C._padded(paths), counts)}), int(w.fresh.sum())

    parts = list(C.chunks(text, size))
    assert len(parts) > 1 and counted(parts) == counted([(text, 0)])


def test_transducers():
    rng = random.Random(5)
    tables = []
    for _ in range(4):
        tables.append({tuple(rng.randint(1, 6) for _ in range(rng.randint(1, 4))): rng.randint(1, 9) for _ in range(60)})

    def build(table):
        rows = sorted(table)
        columns = [np.array([r[d] if d < len(r) else 0 for r in rows], np.uint64) for d in range(4)]
        return C.Transducer.of_sorted(columns, np.array([table[r] for r in rows]))

    def read(t):
        paths, counts = t.paths()
        return {tuple(x for x in map(int, p) if x): int(c) for *p, c in zip(*paths, counts)}

    parts = [C.Transducer.from_bytes(build(t).to_bytes()) for t in tables]
    assert [read(p) for p in parts] == tables
    total = sum((Counter(t) for t in tables), Counter())
    whole = C.union(parts)
    assert read(whole) == dict(total)
    assert len(whole.labels[0]) == len({k[0] for k in total})  # beginnings are shared
    asked = build({tuple(rng.randint(1, 7) for _ in range(rng.randint(1, 4))): 1 for _ in range(300)})
    listed, _ = asked.paths()
    want = [total[tuple(x for x in map(int, p) if x)] for p in zip(*listed)]
    assert whole.compose(asked).tolist() == want and 0 in want and max(want) > 0


def test_empty_table_and_other_columns(spark):
    docs = docs_of(spark, rows_of(3, 60))
    assert C.mine(docs.limit(0)).collect() == []
    odd = docs
    for name in ("h0", "f", "slice", "word", "n", "a", "size", "salt"):
        odd = odd.withColumn(name, F.lit(name))
    assert result(C.mine(odd, min_count=5)) == result(C.mine(docs, min_count=5))
