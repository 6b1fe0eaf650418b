"""Near copies so long that their component has more blocks than rows."""

from brute import near
from edge import prose

from changeflow.llm import ngram_join


def test_near_copies_in_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CHARS", 64)
    base = prose(9, 300)
    texts = [base, base + " end", prose(10), "of other " + base, prose(11)]
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = near(texts)
    assert got == {i: (n, min(c)) for i, (n, c) in enumerate(want)} and want[0][0] == 2
