"""The registered queries, the pipeline, and inputs that are empty or oddly shaped."""

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import plain
import pytest
import tiktoken
from pyspark.sql import functions as F

from growthlab.llm import bpe, jaccard_tiles, language_id, latent_decontamination, line_runs, ordinal_quality, phrase_dedup, quality_rules, queries, secret_scan
from growthlab.llm.oracles import ORACLES

SMALL = "/root/testdata/sf0.001"
OPS = {
    "op1": phrase_dedup.remove_repeats, "op2": lambda d: latent_decontamination.find_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "op3": secret_scan.scan_secrets, "op4": line_runs.repeated_lines, "op5": language_id.identify,
    "op6": lambda d: bpe.encode_decode(d, bpe_ranks(), pattern()), "op7": jaccard_tiles.jaccard_components, "op8": quality_rules.ledger,
    "op9": lambda d: ordinal_quality.score(d, *ordinal_quality.train(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))),
}


def bpe_ranks():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern():
    import public_tokenizers
    return public_tokenizers.PATTERN


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("op", OPS)
def test_empty_table(make_docs, op):
    assert OPS[op](make_docs([])).collect() == []


@pytest.mark.parametrize("op", [o for o in OPS if o != "op2"])
def test_clashing_columns_change_nothing(make_docs, messy_rows, op):
    docs = make_docs(messy_rows)
    odd = docs
    for name in ("id", "block", "row", "h1", "n", "place", "slice", "words", "kept", "blob", "doc", "gone", "fail_bits", "component_id", "grade"):
        odd = odd.withColumn(name, F.lit(name))
    rows = lambda d: sorted(str([v for k, v in r.asDict(True).items() if k != "doc"]) for r in OPS[op](d).collect())
    assert rows(odd) == rows(docs)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    found = queries.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        before = docs
        stage(spark, before, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
        rows = [(r.doc_id, r.text) for r in before.collect()]
        now = [r.asDict() for r in docs.collect()]
        if name != "tokenize":
            assert docs.columns == before.columns
        ids = {r["doc_id"] for r in now}
        if name == "quality":
            rated = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            good = [d for d, _ in rows if rated.get(d) == (1, 0)]
            bad = [d for d, _ in rows if d in rated and rated[d] != (1, 0)]
            assert sum(d in ids for d in good) >= 0.95 * len(good) and sum(d in ids for d in bad) <= 0.6 * len(bad)  # a table this small teaches little
        elif name == "line_dedup":
            want = {d: x for (d, _), (_, _, x) in zip(rows, plain.lines_kept(rows))}
            assert {r["doc_id"]: r["text"] for r in now} == want
            assert all(r["n_chars"] == len(r["text"]) for r in now)
        elif name == "near_copies":
            assert ids == set(plain.jaccard_components(rows).values())
        elif name == "decontaminate":
            items = [plain.words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            whole = {d: " ".join(plain.words(t)) for d, t in rows}
            assert ids == {d for d, t in whole.items() if not any(" ".join(i) in t for i in items)}
        else:
            coder = tiktoken.Encoding("whole", pat_str=pattern(), mergeable_ranks=bpe.read_ranks(bpe_ranks()), special_tokens={})
            assert {r["doc_id"]: list(r["ids"]) for r in now} == {d: coder.encode_ordinary(t or "") for d, t in rows}
            assert {r["doc_id"]: r["decoded_sha256"] for r in now} == {d: plain.sha(t or "") for d, t in rows}


def test_pipeline_keeps_rows_without_id_or_text(spark):
    rows = [(None, "a b c d e f", "en", None, 11), (None, "a b c d e f", None, "s", 11), (1, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SMALL).count() == 4, name
