"""Cases that earlier versions got wrong."""

import random

import numpy as np
import plain
import pytest

from growthlab.llm import jaccard_tiles, latent_decontamination, ordinal_quality, phrase_dedup, secret_scan
from growthlab.llm.common import hash_words, word_hashes

SF = "/root/testdata/sf0.01"


def test_long_words_built_to_collide():
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    words = (word_hashes(a.encode()), word_hashes(b.encode()))
    assert len(a) == 1024 and words[0] != words[1]
    data = np.frombuffer((a + " " + a + " x").encode(), np.uint8)
    found = hash_words(data, np.array([0, 1025, 2050]), np.array([1024, 2049, 2051]))
    assert found[0] == found[1] == words[0][0] != found[2]


def test_colliding_words_do_not_link(spark, make_docs):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    got = {r.doc_id: r.component_id for r in jaccard_tiles.jaccard_components(make_docs([(1, a), (2, b), (3, a)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_texts_that_share_an_id_keep_their_links(spark, make_docs):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    one, two = text(300), text(300)
    near = lambda w: " ".join([*w[:150], "changed", *w[151:]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, " ".join(text(300)))]
    rows += [(10 + i, " ".join(text(200) + one[:60])) for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard_tiles.jaccard_components(make_docs(rows)).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4


def test_a_ledger_row_for_each_blob(spark, make_docs, tmp_path):
    docs = make_docs([(None, "token = abcdef123456")] * 6 + [(3, "password: hunter2222")] * 3 + [(4, "password: hunter2222"), (5, "nothing")])
    path = str(tmp_path / "ledger")
    first = secret_scan.scan_secrets(docs, path)
    assert first.count() == 11 and spark.read.parquet(path).count() == 3
    secret_scan.scan_secrets(docs, path).count()
    assert spark.read.parquet(path).count() == 3


def test_rows_without_id_are_dealt_out(spark, make_docs):
    rng = random.Random(5)
    shared = " ".join(f"s{rng.randrange(99)}" for _ in range(40))
    rows = [(i if i % 2 else None, f"{rng.random()} {shared if i % 5 == 0 else ''} {rng.random()}") for i in range(600)]
    got = phrase_dedup.remove_repeats(make_docs(rows), docs_per_block=20).collect()
    want = plain.repeats(rows)
    assert sorted((r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted(want)


def test_exact_copies_of_any_length_are_found(spark):
    """2,700 items of 6 to 60 words cut from documents: the source is always found."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: plain.words(r.text) for r in docs.collect()}
    rng = random.Random(4)
    sources = [d for d, w in words.items() if len(w) >= 80]
    items, source = [], {}
    for n in range(2700):
        size, d = (6, 8, 10, 12, 15, 20, 25, 40, 60)[n % 9], rng.choice(sources)
        at = rng.randrange(len(words[d]) - size + 1)
        items.append((n, " ".join(words[d][at: at + size])))
        source[n] = d
    repeated = [(9000 + k, " ".join(["zebrafish"] * k)) for k in (6, 10, 16, 24)]
    holders = spark.createDataFrame([(100_000 + k, f"some words here {t} and more words there") for (_, t), k in zip(repeated, (6, 10, 16, 24))], docs.schema)
    found = latent_decontamination.find_leaks(docs.unionByName(holders), spark.createDataFrame(items + repeated, "item_id long, text string"))
    pairs = {(r.item_id, r.doc_id) for r in found.collect()}
    assert all((n, d) in pairs for n, d in source.items())
    assert all((9000 + k, 100_000 + k) in pairs for k in (6, 10, 16, 24))


def test_classifier_on_rows_it_was_not_taught():
    """Half the labelled rows of sf0.1 teach, the others are judged."""
    import duckdb
    rows = duckdb.sql("""select l.quality, l.toxic, d.text from '/root/testdata/sf0.1/labels.parquet' l
                         join '/root/testdata/sf0.1/documents.parquet' d using (doc_id) order by doc_id""").fetchall()
    grades = [0 if q == 0 else 1 if t else 2 for q, t, _ in rows]
    found = [ordinal_quality.features((t or "").encode(), 1 << 24) for _, _, t in rows]
    model = ordinal_quality.fit([(f, g) for i, (f, g) in enumerate(zip(found, grades)) if i % 2], 1 << 24)
    kept = model.tails(np.array([model.score(f) for f in found]))[:, 1] >= ordinal_quality.LEVEL
    share = {g: np.mean([kept[i] for i in range(0, len(rows), 2) if grades[i] == g]) for g in range(3)}
    assert share[0] < 0.03 and share[1] < 0.15 and share[2] > 0.99


@pytest.mark.parametrize("seed", [1, 2])
def test_fitted_weights_are_a_least_point(seed):
    """No small step of any one weight or threshold lowers the penalised loss."""
    rng = np.random.default_rng(seed)
    sample = []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        slots = set(rng.integers(0, 40, 6).tolist()) | ({100 + g} if g < 2 and rng.random() < 0.8 else set())
        sample.append((np.array(sorted(slots)), g))
    m = ordinal_quality.fit(sample, 1 << 10)
    assert len(m.slots) and (m.weights <= 0).all() and m.thresholds[0] < m.thresholds[1]

    def loss(weights, cuts):
        model = ordinal_quality.Ordinal(m.slots, weights, cuts)
        tails = np.concatenate([np.ones((len(sample), 1)), model.tails(np.array([model.score(s) for s, _ in sample])), np.zeros((len(sample), 1))], 1)
        p = [tails[i, g] - tails[i, g + 1] for i, (_, g) in enumerate(sample)]
        return -np.mean(np.log(p)) + 0.01 / len(sample) / 2 * (weights ** 2).sum()

    base = loss(m.weights, m.thresholds)
    for k in range(len(m.weights)):
        for step in (-0.05, 0.05):
            w = m.weights.copy()
            w[k] = min(0.0, w[k] + step)
            assert loss(w, m.thresholds) >= base - 1e-5
    for k in range(2):
        for step in (-0.05, 0.05):
            c = m.thresholds.copy()
            c[k] += step
            assert loss(m.weights, c) >= base - 1e-5


def test_runs_hold_each_line_as_a_key_once(spark):
    """The anti-join decides: a hash is a key in one run, and increments elsewhere."""
    from growthlab.llm.line_runs import LineRuns
    from growthlab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    runs = LineRuns(spark, 4, fanout=3)
    kind = "h1 long, h2 long, n_docs long, last_doc long, n_lines long"
    for b in range(5):
        runs.add(spark.createDataFrame([(h, h, 1, 10 * b + h % 3, 2) for h in range(b, 20 + 3 * b)], kind))
    held = [{r.h1 for r in run.where("is_key").collect()} for run in runs.runs()]
    assert len(held) > 1 and sum(map(len, held)) == len(set.union(*held)) == 32
    found = {r.h1: (r.n_docs, r.n_lines) for r in runs.lookup().collect()}
    assert found == {h: (n, 2 * n) for h in range(32) if (n := sum(b <= h < 20 + 3 * b for b in range(5)))}
    runs.drop()
