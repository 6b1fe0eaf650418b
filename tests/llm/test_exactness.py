"""Results that are exact beyond floating point, alphabets beyond 127 bytes, ties, and clean-up."""

import math
from collections import defaultdict

import numpy as np
import pytest
from edge import prose
from pyspark.sql import functions as F
from test_more import exact, search

from changeflow.llm import common, knn, lang_id, mixing, ngram_join


def test_scores_beyond_floats(spark):
    big = 2**30
    rows = [(k, [big + k % 7, -big + k % 5, k]) for k in range(60)]
    got = search(spark, rows)
    x = [v for _, v in rows]
    assert len(got) == 60 and all(s == sum(a * b for a, b in zip(x[q], x[i])) for q, _, i, s in got)
    assert [(q, r, i) for q, r, i, _ in got] == [t[:3] for t in exact(rows)]


def test_scores_beyond_63_bits_fail():
    v = np.full((4, 2), 2**32, np.int64)
    with pytest.raises(ValueError, match="63 bits"):
        knn.dual_search(v, np.arange(4), v, np.arange(4), np.arange(4), 2, np.full(4, knn.NONE))


def dist(seen, context, alphabet):
    """The whole distribution after a context, by its recursive definition."""
    if context is None:
        return np.full(alphabet, 1 / alphabet)
    own, below = seen.get(context), dist(seen, context[1:] if context else None, alphabet)
    if not own:
        return below
    n = np.zeros(alphabet)
    for b, c in own.items():
        n[b] = c
    total, distinct = n.sum(), (n > 0).sum()
    rest = np.where(n > 0, 0, below)
    if not rest.sum():
        return n / total
    return n / (total + distinct) + distinct / (total + distinct) * rest / rest.sum()


@pytest.mark.parametrize("bytes_there", [20, 200])
def test_language_code_lengths_equal_a_plain_coder(spark, bytes_there):
    """Fitted tables against the recursive definition, byte by byte; 200 different bytes each keep a symbol."""
    r = np.random.default_rng(1)
    letters = [chr(0x100 + k) for k in range(64)] + [chr(0x400 + 64 * k) for k in range(30)] + [chr(0x4E00 + 0x300 * k) for k in range(20)] + [chr(c) for c in range(33, 127)]
    letters = letters if bytes_there == 200 else list("abcdefgh ")
    texts = ["".join(r.choice(letters, 60)) for _ in range(30)]
    rows = [(k, t, "x" if k % 2 else "y") for k, t in enumerate(texts)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    raw = [t.encode() for t in texts]
    there = sorted(set(b"".join(raw)) | {10})
    assert model.width == (8 if len(there) > 127 else 7)
    code = {b: k for k, b in enumerate(there)}
    for j, lang in enumerate(["x", "y"]):
        seen = defaultdict(lambda: defaultdict(int))
        for k, t in enumerate(raw):
            if (k % 2 == 1) == (lang == "x"):
                s = tuple(code[b] for b in b"\n\n\n" + t)
                for i in range(3, len(s)):
                    for order in range(4):
                        seen[s[i - order : i]][s[i]] += 1
        s = tuple(code[b] for b in b"\n\n\n" + raw[0][:20])
        want = -sum(math.log2(dist(seen, s[i - 3 : i], 1 << model.width)[s[i]]) for i in range(3, len(s)))
        assert np.isclose(model.lengths([raw[0][:20]])[0, j], want, rtol=1e-4)


def test_language_tables_have_a_bound(monkeypatch):
    monkeypatch.setattr(lang_id, "MODEL_BYTES", 1000)
    with pytest.raises(ValueError, match="fewer texts"):
        lang_id.train({"a": (np.arange(10), np.ones(10))}, np.zeros(256, np.uint8))


def test_the_sample_is_no_larger_than_its_bound(spark):
    docs = spark.createDataFrame([(k, "a" if k % 5 else "bb", "x" if k % 5 else "y") for k in range(3000)], "doc_id long, text string, lang string")
    small = lang_id.fit(docs, most=3)
    assert small.langs == ["x", "y"] and small.lengths([b"a"]).argmin() == 0 and small.lengths([b"bb"]).argmin() == 1


def test_repeated_keys_and_texts_stay_the_same_on_reruns(spark):
    rows = [(1, prose(1), "en", f"s{k}", k) for k in range(6)] + [(None, prose(2), lang, None, None) for lang in ("de", None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(map(str, ngram_join.deduplicate(docs.repartition(n, F.rand(n))).collect())) for n in (1, 4)]
    assert len(kept[0]) == 2 and kept[0] == kept[1]


def test_unlike_documents_of_one_bucket_chain_do_not_meet():
    """Groups hold who shares a bucket with their head, not what chains to it."""
    met = ngram_join._others([[1, 5], [1], [5], [2, 5]], 5)
    assert [bool((met[i] & met[j]).any()) for i, j in ((0, 1), (0, 2), (0, 3), (2, 3))] == [True, False, False, False]
    assert ngram_join._others([[5], [5]], 5) is None


def test_loops_that_dont_converge_fail(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long")
    assert {r.comp for r in ngram_join.components(chain, "t").collect()} == {0}
    with pytest.raises(RuntimeError, match="converge"):
        ngram_join.components(chain, "t", rounds=1)
    sums = spark.createDataFrame([("a", 100, 250.0)], "source string, words long, target double")
    with pytest.raises(RuntimeError, match="Newton"):
        mixing.balance(sums, tolerance=-1.0, most=10)


def test_scratch_goes(spark):
    with common.scratch(spark):
        path = common.scratch_path(spark, "x")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
