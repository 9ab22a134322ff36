"""Operators 1, 4 and 7 against plain versions."""

import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from growthlab.llm import common, components, jaccard_tiles, line_runs, phrase_dedup


def test_word_hashes_follow_words():
    texts = ["", "  ", "One two  ONE\ttwo\nthree", "é ü é", "a" * 50 + " b"]
    seen = {}
    for t in texts:
        w = [x.translate(plain._LOWER) for x in plain.words(t)]
        h = common.word_hashes(t.encode()).tolist()
        assert len(w) == len(h)
        for a, b in zip(w, h):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)
    words, bounds = common.batch_words([t.encode() for t in texts])
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert words[a:b].tolist() == common.word_hashes(t.encode()).tolist()


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join("w" * random.Random(i).randint(1, 40) + str(i) for i in range(300)).encode()
    whole = common.word_hashes(text).tolist()
    monkeypatch.setattr(common, "PIECE", 64)
    assert common.word_hashes(text).tolist() == whole
    assert [s.tolist() for s in common.batch_shingles([text, b"a b"])] == [common.shingle_hashes(np.array(whole, np.uint64)).tolist(),
                                                                         common.shingle_hashes(common.word_hashes(b"a b")).tolist()]


def check_repeats(rows, found):
    want = {}
    for (d, t), (n, gone, spans, kept) in zip(rows, plain.repeats(rows)):
        want.setdefault(d, []).append((n, gone, spans, kept))
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_repeats_on_messy_rows(make_docs, messy_rows):
    rows = messy_rows + [(None, messy_rows[10][1]), messy_rows[12], (8, messy_rows[12][1])]
    check_repeats(rows, phrase_dedup.remove_repeats(make_docs(rows)).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats_in_very_repetitive_text(make_docs, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    rows = [(i * 7 % 31, "".join(rng.choice(parts)[rng.randint(0, 9):] for _ in range(rng.randint(1, 8)))) for i in range(31)]
    check_repeats(rows, phrase_dedup.remove_repeats(make_docs(rows), docs_per_block=3).collect())


@pytest.mark.parametrize("hot_phrases", [1, 4])
def test_repeats_with_a_trigger_of_many_phrases(make_docs, messy_rows, hot_phrases):
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    ends = [noise(30) for _ in range(4)]
    rows = messy_rows + [(100 + i * 7 % 41, noise(40) + rng.choice(ends) + "a string of bytes that all of these texts do hold" + rng.choice(ends) + noise(40)) for i in range(41)]
    check_repeats(rows, phrase_dedup.remove_repeats(make_docs(rows), docs_per_block=5, hot_phrases=hot_phrases).collect())


def test_a_trigger_of_many_phrases_is_spread():
    """Phrases around one common string go to all buckets, as do their windows."""
    rng = random.Random(8)
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows = pa.table({"id": list(range(400)), "text": [noise() + "a string of bytes that all of these texts do hold" + noise() for _ in range(400)]})
    own = phrase_dedup.Block(rows, 16)
    trigger, n = np.unique(own.trigger, return_counts=True)
    of_common = np.flatnonzero(own.trigger == trigger[n.argmax()])
    assert len(of_common) >= 400
    assert np.bincount(own.bucket[of_common], minlength=16).max() < 2 * len(of_common) / 16
    sizes = [len(keys) for _, keys, _, _, _ in phrase_dedup.HotWindows(own, of_common, 16).parts]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


def test_repeats_survive_a_cut_text(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000)).encode()
    monkeypatch.setattr(phrase_dedup, "PIECE", 700)
    p = phrase_dedup.parse([text, b"short", text[100:900]])
    windows = sorted((d, s + i) for d, s, n in zip(p["doc"].tolist(), p["start"].tolist(), p["n"].tolist()) for i in range(n))
    assert windows == [(0, i) for i in range(5000 - 49)] + [(2, i) for i in range(751)]  # each window once


def test_lines_on_messy_rows(make_docs, messy_rows):
    rows = messy_rows + [(None, messy_rows[10][1])]
    want = sorted((str(d), n, k, x) for (d, _), (n, k, x) in zip(rows, plain.lines_kept(rows)))
    for batches, fanout in ((1, 2), (5, 2), (4, 3)):
        got = line_runs.repeated_lines(make_docs(rows), batches=batches, fanout=fanout).collect()
        assert sorted((str(r.doc.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == want


def test_runs_answer_what_is_new(spark):
    runs = line_runs.LineRuns(spark, buckets=3, fanout=2)
    batch = lambda *hs: spark.createDataFrame([(h, h, 1, h, 1) for h in hs], "h1 long, h2 long, n_docs long, last_doc long, n_lines long")
    for part in ((1, 2), (2, 3), (3, 4), (4, 5, 1)):
        fresh = {r.h1 for r in runs.unseen(batch(*part)).collect()}
        assert fresh == set(part) - {h for run in runs.runs() for h, in run.select("h1").collect()}
        runs.add(batch(*part))
    assert [len(level) for level in runs.levels] == [0, 0, 1]  # two levels were merged on the way
    assert sorted((r.h1, r.n_docs) for r in runs.lookup().collect()) == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 1)]
    runs.drop()


def check_components(rows, found):
    want = plain.jaccard_components(rows)
    for r in found:
        assert r.component_id == want.get(r.doc_id)
    sizes = sorted((str(d), len(plain.shingles(t))) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles) for r in found) == sizes


def test_components_on_messy_rows(make_docs, messy_rows):
    rows = messy_rows + [(None, messy_rows[10][1]), (None, "x"), messy_rows[12], (12, "another text under the same id")]
    check_components(rows, jaccard_tiles.jaccard_components(make_docs(rows)).collect())


def test_components_of_chains_and_near_copies(make_docs):
    rng = random.Random(11)
    rows, number = [], 0
    for family in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 160))]
        for _ in range(25):  # each copy is an edit of the last: chains that only link step by step
            rows.append((number, " ".join(base)))
            number += 1
            at = rng.randrange(len(base))
            base = base[:at] + [f"n{rng.randint(0, 10**6)}"] + base[at + (rng.random() < 0.5):]
    rng.shuffle(rows)
    check_components(rows, jaccard_tiles.jaccard_components(make_docs(rows)).collect())


def test_large_tiles_are_split_without_loss(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard_tiles, "BLOCK", 3)
    monkeypatch.setattr(jaccard_tiles, "linked", lambda texts, pairs, inner=jaccard_tiles.linked, calls=[]: (
        calls.append(1) or (inner(texts, pairs).limit(0) if len(calls) == 1 else inner(texts, pairs))))  # no stars: tiles do it all
    rng = random.Random(2)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base[:39] + [f"e{rng.randint(0, 3)}"] * (1 + i % 2))) for i in range(25)] + [(90, "q r s t u v")]
    check_components(rows, jaccard_tiles.jaccard_components(make_docs(rows)).collect())


def test_components_operator(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 105), (105, 103), (7, 200), (50, 50)]
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted({(r.node, r.component) for r in found}) == sorted([(i, 0) for i in range(31)] + [(200, 0), (100, 100), (103, 100), (105, 100)])
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_signature_bound_never_rules_out_a_link():
    rng = np.random.RandomState(0)
    for n in (1, 4, 9, 50, 333):
        x = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(np.ceil(len(x) * 0.9))], rng.randint(0, 2**62, max(n // 20, 0)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            a, b = jaccard_tiles.signature(x), jaccard_tiles.signature(y)
            w = min(len(a), len(b))
            apart = int(np.bitwise_count(jaccard_tiles.folded(a, w) ^ jaccard_tiles.folded(b, w)).sum())
            assert 9 * apart <= len(x) + len(y)
