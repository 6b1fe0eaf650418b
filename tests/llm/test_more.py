import numpy as np
import pytest
from edge import SF, prose
from pyspark.sql import functions as F

import corpus_pipeline
from changeflow.llm import chat, html_text, knn, queries

# Pages


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style></head><body>
<header class="site-header"><p>Site name, with words.</p></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div id="cookie-notice">We use cookies, and more cookies.</div><main><article class="post"><h1>Head&shy;line &eacute;</h1>
<p>First para, with <b>bold</b>text.<p>Second<br>line &lt;tag&gt;, a sentence; and one more.<script>var a = "<p>no</p>";</script>
<ul><li>Item one, here.<li>Item two</ul><aside>Read this, too.</aside><table><tr><td>Cell<td>Other</table><div class="ad-box ad">Buy now, cheap.</div>
<form><label>Mail</label><input></form></article><section id="comments"><article class="comment"><p>I disagree, strongly, with this, all of it.</p></article></section></main>
<footer>&copy; all, rights. reserved</footer></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE) == "Head\u00adline é First para, with boldtext. Second line <tag>, a sentence; and one more. Item one, here. Item two Cell Other"


def test_main_text_without_article():
    body = "".join(f"<p>{prose(k, 60)}, {prose(k + 9, 30)}.</p>" for k in range(4))
    page = f'<body><div class="top"><a href=a>One</a> <a href=b>Two</a></div><div class="wrap"><div class="text"><h2>Title here</h2>{body}<p>Short.</p></div><div class="sidebar"><p>Other, text.</p></div></div></body>'
    got = html_text.extract(page)
    assert got.startswith("Title here ") and got.endswith(" Short.") and "Other" not in got and "One" not in got


def test_pages_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "just text, no tags"), (4, "u", "just text, no tags"), (5, "u", "<div " * 3000), (6, "u", "<div><p>a, b." * 3000), (7, "u", '<p title="a>b">x</p><!-- <p>no'), (8, "u", "<script>unclosed"), (9, "u", "a < b & c &nbsp;&bogus; d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n": F.lit(1)})
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got[1] == got[2] == got[3] == got[8] == "" and got[4] == "just text, no tags" and got[6].startswith("a, b. a, b.") and got[7] == "x"
    assert html_text.main_text(df.limit(0)).count() == 0
    pages = queries.page_text(spark, SF).toPandas()
    assert len(pages) == 50 and (pages.n_chars == pages.text.str.len()).all() and (pages.n_chars > 0).all()


# Conversations


@pytest.mark.parametrize("text", ["", "plain", queries.CONTROL, "</turn>", "\\</turn>", "\\\\</turn>\\", "### User:\nx", "\\### ", "#### ### </turn></turn>", "\n</turn>\n", "a\\", "\n\n", '"', "é\U0001f600 </turn"])
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text
    turns = [("user", text), ("assistant", text), ('odd "role":\n', text), ("User", text), ("assistant", "")]
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [text, ""]


def test_alignment():
    ends = [3, 5, 9, 12]
    tokens, covered = chat.align([(0, 3), (4, 9), (5, 6), (12, 12), (7, 7)], ends)
    assert tokens[:3] == [(0, 1), (1, 3), (2, 3)] and covered[:3] == [(0, 3), (4, 9), (5, 6)] and covered[4] == (7, 7)
    rng = np.random.default_rng(0)
    for _ in range(200):
        ends = sorted(set(rng.integers(1, 60, 12).tolist()) | {60})
        a, b = sorted(rng.integers(0, 61, 2).tolist())
        (first, last), (s, e) = (x[0] for x in chat.align([(a, b)], ends))
        assert (s, e) == (a, b)
        starts = [0, *ends]
        assert list(range(first, last)) == [k for k in range(len(ends)) if max(starts[k], a) < min(ends[k], b)]


def test_conversations_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "y </turn>"), (2, None, "assistant", "z"), (2, 5, "assistant", "é\U0001f600" * 500), (2, 5, "assistant", "é\U0001f600" * 500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "ids": F.lit("x")})
    got = {r.conv_id: r for r in chat.format_conversations(df, queries.tokenizer("byte_bpe_50k.json")).collect()}
    assert chat.parse(got[1].formatted) == [("user", ""), ("", "x")] and got[2].n_turns == 3 and got[None].n_turns == 1
    assert "".join(got[2].formatted[s.a : s.b] for s in got[2].loss_spans) == "z" + "é\U0001f600" * 1000
    assert chat.format_conversations(df.limit(0), queries.tokenizer("byte_bpe_50k.json")).count() == 0


# Vectors


def exact(rows, k=20):
    """rows: (id, vector); plain sorting."""
    width = max((len(v) for _, v in rows), default=1)
    x = np.zeros((len(rows), width), np.int64)
    for j, (_, v) in enumerate(rows):
        x[j, : len(v)] = v
    out = []
    for j, (key, _) in enumerate(rows):
        if key is not None and key % 20 == 0:
            s = x @ x[j]
            order = sorted((-int(s[i]), rows[i][0]) for i in range(len(rows)) if i != j)[:k]
            out += [(key, r, i, -s) for r, (s, i) in enumerate(order, 1)]
    return sorted(out)


def search(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>").withColumns({"row": F.lit("x"), "cell": F.lit(1), "score": F.lit(2)})
    return sorted(tuple(r) for r in knn.top_k(df, F.col("v"), F.col("vec_id") % 20 == 0).collect())


def test_top_k_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-3, 4, 4).tolist()) for k in range(120)] + [(40, [1, 1]), (40, [1, 1]), (200, [0, 0, 0, 0])]
    assert search(spark, rows) == exact(rows)
    assert search(spark, [*rows, (20, None), (60, []), (80, [1, None])]) == exact(rows)
    assert search(spark, rows[:1]) == [] and search(spark, rows[:3]) == exact(rows[:3])


def test_top_k_over_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 64)
    monkeypatch.setattr(knn, "QUERIES", 8)
    monkeypatch.setattr(knn, "LEAF", 8)
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (6, 8))
    rows = [(k, (centres[k % 6] + rng.integers(-9, 10, 8)).tolist()) for k in range(700)]
    assert search(spark, rows) == exact(rows)


def test_top_k_query_skips_bad_vectors(spark, tmp_path):
    good = [(k, [0.5, -0.25 * k, 1.0]) for k in range(45)]
    bad = [(20 * k, v) for k, v in enumerate([None, [None, 1.0], [float("nan")], [float("inf"), 0.0]], 10)]
    spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.nearest(spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and all(r.vec_id < 45 for r in got)
    assert len(got) == 60


# The pipeline


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert len(got) and set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert got.groupby("sequence_id").length.sum().max() <= 4096


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, edge, empty, edge_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, edge_dir).count() == 0
    out = stage(spark, edge, edge_dir)
    if name != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    assert out.count() > 0


def test_stages_take_effect(spark, edge_dir):
    stages = dict(corpus_pipeline.STAGES)
    text = prose(70) + " password=hunter2hunter2"
    docs = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, text, "en", "a", len(text)), (3, prose(71), "en", "b", 5), (4, "short", "en", "b", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages["quality rules"](spark, docs, edge_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    one = stages["n-gram Jaccard join"](spark, kept, edge_dir)
    assert sorted(r.doc_id for r in one.collect()) == [1, 3]
    clean = {r.doc_id: r for r in stages["secret scans"](spark, one, edge_dir).collect()}
    assert clean[1].text.endswith("[SECRET]") and clean[1].n_chars == len(clean[1].text) and clean[3].n_chars == 5
