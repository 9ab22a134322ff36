"""Operators 2, 3, 5, 6, 8, 9 and 10."""

import random

import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken

from growthlab.llm import bpe, html_layout, language_id, latent_decontamination, ordinal_quality, quality_rules, secret_scan

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_secrets_on_messy_rows(make_docs, messy_rows):
    rows = messy_rows + [(None, "secret=abcdefgh"), (60, "token=token:abcdefgh api-key apikey : 'zzzzzz' ſecret=abcdefgh"),
                         (61, "é token = \"é\" " + "a1" * 12 + "g" + "b" * 23), (62, "AKIA" + "1" * 15 + " AKIAAKIA" + "2" * 12)]
    got = secret_scan.scan_secrets(make_docs(rows)).collect()
    want = sorted((str(d), ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in plain.secrets(t))) for d, t in rows)
    assert sorted((str(r.doc_id), r.base) for r in got) == want
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in r.base.split(",")) for k in secret_scan.BASE_KINDS)
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_added_kinds():
    text = "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY----- https://u:pa55word@host ghp_" + "a" * 36
    kinds = [secret_scan.KINDS[k] for _, k, _ in secret_scan.find_spans(text)]
    assert {"private_key", "url_password", "hosted_token"} <= set(kinds)


def test_ledger_scans_only_unseen_blobs(spark, make_docs, tmp_path):
    path = str(tmp_path / "ledger")
    first = [(1, "token = abcdefgh"), (2, "token = abcdefgh"), (3, "plain")]
    secret_scan.scan_secrets(make_docs(first), path)
    ledger = lambda: spark.read.parquet(path)
    assert ledger().count() == 2  # one row per blob, also without a finding
    found = secret_scan.scan_secrets(make_docs(first + [(1, "plain"), (4, "secret: zyxwvu")]), path).collect()
    assert ledger().count() == 3
    assert sorted((r.doc_id, r.n_assign) for r in found) == [(1, 0), (1, 1), (2, 1), (3, 0), (4, 1)]


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.identify(docs).join(docs.select("doc_id", language_id.held_out().alias("out")), "doc_id").where("out").collect()
    assert len(rows) > 150 and np.mean([lang[r.doc_id] == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de")] * 8)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "de"), (103, "the dog", None), (104, "Жук", None), (None, "und der", None),
             (105, "the cat and " * 60000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == got[105][0] == "en" and got[None][0] == "de" and got[104][0] in ("de", "en")
    nothing = language_id.identify(docs.where("doc_id > 101")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_cut_text_counts_alike():
    model = language_id.Profiles([("a", [(1, ord("a")), (2, ord("a") << 21 | ord("b")), (3, ord("a") << 21)])], 10)
    text = "ab a abc " * 200
    whole, _ = model.counts([text])
    parts = [text[i: i + 9] for i in range(0, len(text), 9)]
    assert whole.tolist() == [model.counts(parts)[0].sum(0).tolist()]


def test_bpe_equals_the_library(make_docs, messy_rows):
    rows = messy_rows + [(None, "it's 12's  \n\n x y \U0001f600\U0001f600 <|endoftext|>"), messy_rows[12], (70, "\x00 \x00a" + "ab" * 3000)]
    got = bpe.encode_decode(make_docs(rows), RANKS, public_tokenizers.PATTERN).collect()
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = sorted((str(d), whole.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows)
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == want


def test_measures_on_messy_rows(make_docs, messy_rows):
    rows = messy_rows + [(None, "a # b"), (80, "x y z x y z\n x y z\nx y z\nx y z")]
    got = quality_rules.ledger(make_docs(rows)).collect()
    want = sorted((str(d), *plain.measures(t)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_policies_and_ablation(make_docs, messy_rows):
    rows = quality_rules.ledger(make_docs(messy_rows)).cache()
    kept = {p: quality_rules.apply_policy(rows, p).where("kept").count() for p in quality_rules.POLICIES}
    assert kept["full/1"] <= kept["full/2"] <= kept["base/1"]
    bits = [r.fail_bits for r in rows.collect()]
    own = quality_rules.mask(quality_rules.POLICIES["full/1"])
    for r in quality_rules.ablation(rows, "full/1").collect():
        bit = quality_rules.mask([r.rule])
        assert r.n_failed == sum(b & bit != 0 for b in bits)
        assert r.n_failed_alone == sum(b & own == bit for b in bits)
        assert r.n_kept_without == sum(b & own & ~bit == 0 for b in bits)
    rows.unpersist()


def test_no_python_in_the_rule_plan(make_docs, messy_rows):
    plan = quality_rules.ledger(make_docs(messy_rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_classifier_learns_graded_ratings(spark):
    rng = random.Random(4)
    plain_words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text, grade = [rng.choice(plain_words) for _ in range(rng.randint(30, 300))], i % 3
        if grade == 1:
            text[rng.randrange(len(text))] = rng.choice(["vilefool", "vileoaf", "grimcad"]) + str(rng.randint(0, 40))
        if grade == 0:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, n = ordinal_quality.train(docs, spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int"))
    assert model.thresholds[0] < model.thresholds[1] and model.weights[:n].max() <= 0
    got = {r.doc.doc_id: r for r in ordinal_quality.score(docs, model, n).collect()}
    for grade, want in ((0, False), (1, False), (2, True)):
        assert np.mean([got[i].kept == want for i in range(600, 900) if i % 3 == grade]) > 0.9
    assert all(abs(r.expected_grade - r.p_ok - r.p_good) < 1e-9 and r.p_ok >= r.p_good for r in got.values())


def test_bad_documents_labelled_good_do_not_lower_the_level(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        text = [f"word{rng.randrange(300)}" for _ in range(rng.randint(30, 300))]
        if i % 3 == 0:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 > 0 or i % 60 == 0), 0))  # one in twenty bad documents is labelled good
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, n = ordinal_quality.train(docs, spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int"))
    got = {r.doc.doc_id: r.kept for r in ordinal_quality.score(docs, model, n).collect()}
    assert not any(got[i] for i in range(600, 900, 3))
    assert np.mean([got[i] for i in range(600, 900) if i % 3]) > 0.9


def test_classifier_edges(spark, make_docs, messy_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs(messy_rows + [(None, None)])
    model, n = ordinal_quality.train(docs, none)
    assert ordinal_quality.score(docs, model, n).where("kept").count() == len(messy_rows) + 1
    odd = spark.createDataFrame([(10, 1, 0), (10, 0, 0), (11, None, 1), (None, 1, 1), (12, 1, 0)], none.schema)
    assert sorted(map(tuple, ordinal_quality.graded(odd).collect())) == [(10, 0), (12, 2)]


def test_leaks_and_paraphrases(spark, make_docs):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(15, 59)) for _ in range(12)]
    rows, planted = [], set()
    for i in range(300):
        own = text(rng.randint(40, 600))
        if i % 10 == 0:
            k, at = i // 10 % 12, rng.randrange(len(own))
            leak = list(items[k])
            if i % 20:  # a paraphrase: some words changed
                for j in range(4, len(leak), 9):
                    leak[j] = rng.choice(vocabulary)
            own[at:at] = leak
            planted.add((i, k))
        rows.append((i, " ".join(own)))
    rows += [(900, None), (901, ""), (902, "one"), (None, " ".join(items[0]))]
    planted.add((None, 0))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(50, None), (51, ""), (52, "?!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent_decontamination.find_leaks(make_docs(rows), bench).collect()}
    assert got == planted


def test_common_words_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 20))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = {}
        for i, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << i
        assert latent_decontamination.common_words(places, len(a), b) == best[-1][-1]


def test_singular_vectors_span_the_leading_directions():
    rng = np.random.RandomState(3)
    n, r = 4000, 5
    true = np.linalg.qr(rng.standard_normal((n, r)))[0]
    a = rng.standard_normal((80, r)) * 50 @ true.T + 0.01 * rng.standard_normal((80, n))
    v = latent_decontamination.singular_vectors(a.T @ (a @ latent_decontamination._gaussian(n).astype(float)))
    assert np.linalg.norm(true.T @ v[:, :r], 2) > 0.99


@pytest.mark.parametrize("html, text", [
    ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"), ("<div>a</div>b<div>c</div>", "a\nb\nc"), ("x<script>no</script>y<!-- no -->z", "xyz"),
    ("<p hidden>no</p><p style='display : none'>no</p>yes", "yes"), ("a &lt;b&gt; &amp;amp;", "a <b> &amp;"), ("", ""), ("no markup  at\nall", "no markup at all"),
    ("<table><tr><td>a<td>b<tr><td>long cell<td>c</table>", "a          b\nlong cell  c"), ("<pre>\n a  b\n  c</pre>d", " a  b\n  c\n\nd".strip("\n")),
    ("<table><tr><th colspan=2>wide head<tr><td>x<td>y</table>", "wide head\nx  y"), ("<select><option>a<option selected>b</select>", "b"),
    ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"), ("a</p>b", "a\n\nb"), ("<b>x<p>y</b>z", "x\n\nyz"),
    ("<a title='1 > 0'>t</a>", "t"), ("1 < 2 <3", "1 < 2 <3"), ("<title>t</title><textarea><b>raw</b></textarea>", "<b>raw</b>"),
])
def test_rendering(html, text):
    assert html_layout.render(html)[1] == text


@pytest.mark.parametrize("html, text", [
    ("<p>so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> holds", "so x= 1 2 holds"),
    ("<math><semantics><mrow><mi>a</mi><mspace/><msup><mi>b</mi><mn>2</mn></msup></mrow><annotation>no</annotation></semantics></math>!", "ab 2 !"),
    ("a <svg><title>no</title><desc>no</desc><defs><text>no</text></defs>no<g><text>North</text><text x=1>South <tspan>pole</tspan></text></g></svg> b",
     "a North South pole b"),
    ("<svg><style>no</style><text display=none>no</text><text visibility=hidden>no</text><foreignObject><p>yes</p></foreignObject></svg>", "yes"),
    ("<svg/>yes", "yes"), ("<svg><defs><path d='M0'><p>yes", "yes"), ("<text>yes</text><desc>too</desc>", "yestoo"),
    ("<div style='visibility:hidden'>no<br><b style='visibility: visible'>yes<i style='visibility:hidden'>no</i></b></div>", "yes"),
    ("<div style='visibility:hidden'><table><tr><td>no<td style='visibility:visible'>yes</table></div>", "yes"),
    ("<div style='visibility:hidden'><p hidden style='visibility:visible'>no</p></div><b style='backface-visibility:hidden'>yes</b>", "yes"),
])
def test_formulas_drawings_and_visible_children(html, text):
    assert html_layout.render(html)[1].strip() == text
    assert html_layout.render(html)[0] == ""


@pytest.mark.parametrize("html, text", [
    ("<img alt=Bob's photo><p>It's here</p>", "It's here"), ("<a title=5\" href=x>inch</a> 6\" long", "inch 6\" long"), ("<a 'x>y</a>'z", "y'z"),
    ("<b title = '>' hidden>no</b><i title= \">\">yes</i>", "yes"), ("<p title=it's hidden>no</p><p title='hidden'>yes</p>", "yes"),
    ("<p title='hidden>one</p><p>two</p>", "one\n\ntwo"), ("<b x=>yes</b><br/>", "yes"),
])
def test_quotes_inside_tags(html, text):
    assert html_layout.render(html)[1].strip() == text


def test_broken_tags_take_linear_time():
    assert html_layout.render("<a " + "x=\"a\" " * 50000)[1]
    assert html_layout.render("<a" + "=\"a\"" * 50000)[1]


def test_deep_and_broken_pages():
    assert html_layout.render("<div>" * 50000 + "x")[1] == "x"
    assert html_layout.render("<td>x</table></tr><li>y</ul>")[1]
    assert html_layout.render("<head><title> A &amp;\n b </title></head><body>c")[0] == "A & b"


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (None, None, None, "y"), (1, "u", "<p>a</p>", "x")]
    got = html_layout.render_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.title, r.text) for r in got) == [("1", "", "a"), ("1", "", "a"), ("None", "", "")]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole = html_layout.render_pages(pages).collect()
    assert len(whole) == pages.count() and all("<" not in r.title and "track(" not in r.text for r in whole)
