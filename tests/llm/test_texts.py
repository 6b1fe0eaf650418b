import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import counts, digest, near, personal, secret, shares
from edge import SF, edge_rows, prose
from oracle import connection, same
from pyspark.sql import functions as F

from changeflow.llm import lang_id, mixing, ngram_join, oracles, packing, pii, quality, queries, secrets
from changeflow.llm.common import listed

TEXTS = [t for _, t, *_ in edge_rows()]


def tables(sf):
    import pyarrow.dataset as ds

    return lambda name: ds.dataset(f"{sf}/{name}.parquet").to_table().to_pandas()


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, SF), connection(SF), oracles.oracle_sql()[name])


# Language


def test_language_held_out_accuracy(spark):
    got = queries.language(spark, SF).toPandas().merge(tables(SF)("documents"), on="doc_id")
    assert all((zlib.crc32(str(k).encode()) % 5 == 0) == h for k, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_codes_are_probabilities():
    r = np.random.default_rng(0)
    symbol = np.full(256, 127, np.uint8)
    symbol[:40] = np.arange(40)
    grams = np.unique(r.integers(0, 40, (500, 4)) @ np.array([1 << 21, 1 << 14, 1 << 7, 1]))
    model = lang_id.train({"a": (grams, r.integers(1, 9, len(grams))), "b": (grams[:300], np.ones(300))}, symbol)
    bits = model.bits.reshape(2, -1, 128).astype(float)
    bits[:, :, 127] -= 8
    assert np.allclose(np.exp2(-bits).sum(2), 1, atol=1e-4)
    # A text's length is the sum of its bytes', each by its own context.
    text = bytes(r.integers(0, 40, 50).tolist())
    s = symbol[np.frombuffer(b"\n\n\n" + text, np.uint8)].astype(int)
    want = sum(model.bits.reshape(2, -1, 128)[0, model.row[s[i - 3] << 14 | s[i - 2] << 7 | s[i - 1]], s[i]] for i in range(3, len(s)))
    got = model.lengths([b"", text, b"", text])
    assert np.allclose(got[[1, 3], 0], want, rtol=1e-5) and not got[[0, 2]].any()


def test_language_edges(spark, edge, empty):
    got = {r.doc_id: r for r in lang_id.predict(edge, lang_id.fit(edge)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[8].lang_pred == "und" and got[4].lang_pred in ("en", "de", "fr")
    assert lang_id.fit(empty) is None
    assert lang_id.predict(empty, None).count() == 0
    assert {r.lang_pred for r in lang_id.predict(edge, None).collect()} == {"und"}


# Personal data and secrets


def test_personal_data_edges(spark, edge, empty):
    rows = pii.detect(edge).select("doc_id", F.sha2(listed(F.col("base")).cast("binary"), 256).alias("d")).collect()
    assert len(rows) == len(TEXTS)
    assert Counter(r.d for r in rows) == Counter(digest(personal(t or "")) for t in TEXTS)
    assert pii.detect(empty).count() == 0


def test_contexts_discover_identifiers(spark):
    """Card numbers follow `card`; one that fails its check digit is found by its context, others of its shape are not."""
    seeds = [f"my card {4000000000000000 + k} {prose(k, 1)}{'x' * (k % 97)}" for k in range(4000) if personal(f"{4000000000000000 + k}")][:20]
    texts = [*seeds, "my card 4000000000000001 x", "lot 4000000000000001 x", "lot 4000000000000003 x"]
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.more] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[20] == [("ctx_card", 8, 24)] and not got[21] and not got[22] and not got[0]


def test_secrets_edges(spark, edge, empty):
    got = secrets.scan(edge)
    base = F.filter("_spans", lambda x: x["k"] < 3)
    rows = got.select("doc_id", "row", F.sha2(listed(base).cast("binary"), 256).alias("d"), "_spans").collect()
    assert Counter(r.d for r in rows) == Counter(digest(secret(t or "")) for t in TEXTS)
    assert [x.kind for r in rows if r.doc_id == 7 for x in r._spans][-1] == "forge" and rows[0].row == "other"
    assert secrets.scan(empty).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    ledger, key = str(tmp_path / "ledger"), "token = 'abcdefgh12345'"
    kinds = lambda df: {r.doc_id: [x.kind for x in r._spans] for r in df.collect()}
    assert kinds(secrets.scan(frame((1, key), (2, key), (3, "none")), ledger=ledger)) == {1: ["assign"], 2: ["assign"], 3: []}
    assert spark.read.parquet(ledger).count() == 2
    assert kinds(secrets.scan(frame((9, key), (4, "new")), ledger=ledger)) == {9: ["assign"], 4: []}
    assert spark.read.parquet(ledger).count() == 3
    newer = (secrets.Rule("assign", "abc", version=2), *secrets.RULES[1:])
    assert kinds(secrets.scan(frame((1, key)), ledger=ledger, rules=newer)) == {1: ["assign"]}
    assert [r.scanned for r in spark.read.parquet(ledger).collect()].count(["assign@2"]) == 1


def test_redaction(spark):
    text = 'a \U0001f600 password="hunter2hunter2" then deadbeefdeadbeefdeadbeefdeadbeef token=deadbeefdeadbeefdeadbeefdeadbeef.'
    got = secrets.redact(secrets.scan(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")))
    assert {r.doc_id: r.text for r in got.collect()} == {1: 'a \U0001f600 [SECRET]" then [SECRET] [SECRET]', 2: None, 3: "plain"}


# Quality


def test_quality_counts_and_labels(spark, edge, empty):
    got = sorted(quality.judge(edge, None).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert [tuple(r) for r in got] == sorted(counts(t or "") for t in TEXTS)
    assert quality.judge(empty, None).count() == 0 and quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int")) is None
    rows = queries.quality_rules(spark, SF).toPandas().merge(tables(SF)("labels"), on="doc_id")
    judged = rows[~rows.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.98 and judged[judged.quality == 0].kept.mean() < 0.2


def test_crf_against_enumeration():
    import itertools

    r = np.random.default_rng(1)
    score, turns = r.normal(size=(5, 2)), r.normal(size=(2, 2))
    score[:, 0] = 0
    paths = list(itertools.product((0, 1), repeat=5))
    value = np.array([score[range(5), p].sum() + sum(turns[a, b] for a, b in zip(p, p[1:])) for p in paths])
    weight = np.exp(value) / np.exp(value).sum()
    longer = np.stack([np.concatenate([score, r.normal(size=(3, 2))]), np.concatenate([score, score[:3]])])
    p, pairs = (x[0] for x in quality._marginals(longer, turns, np.array([5, 8])))
    assert not p[5:].any()
    p = p[:5]
    assert np.allclose(p, sum(w * np.array(x) for w, x in zip(weight, paths)))
    assert np.isclose(pairs[1, 0], sum(w * sum((a, b) == (1, 0) for a, b in zip(x, x[1:])) for w, x in zip(weight, paths)))
    x = r.normal(size=(5, len(quality.FEATURES)))
    x[:, 0] = score[:, 1]
    w = np.zeros(len(quality.FEATURES))
    w[0] = 1
    assert tuple(quality.Field(w, turns).labels(x).astype(int)) == paths[int(value.argmax())]


# Packing


def test_word_encoder_equals_tokenizer():
    path = queries.tokenizer("word_bpe_49k.json")
    e = packing.encoder_of(path)
    for t in [t or "" for t in TEXTS] + ["It's  DON'T straße İstanbul ΑΣ <|endoftext|> a\x1cb\x85c 日本 ½²'Sx", "naïve ÀÉ'll\u00a0x"]:
        assert e.encode(t) == e.whole(t)


def test_packing_edges(spark, edge, empty):
    path = queries.tokenizer("word_bpe_49k.json")
    rows = packing.pack(edge, path, open_windows=2).collect()
    e = packing.encoder_of(path)
    want = Counter((k, len(e.whole(t or "")) // 4 + 1) for k, t, *_ in edge_rows())
    total = sum(n * c for (_, n), c in want.items())
    assert sum(r.length for r in rows) == total and {(r.doc_id, r.doc_tokens) for r in rows} == set(want)
    whole = {(k, len(e.whole(t or "")) // 4 + 1): e.whole(t or "") + b"\x02\0\0\0" for k, t, *_ in edge_rows()}
    by = defaultdict(list)
    for r in rows:
        assert bytes(r.ids) == whole[r.doc_id, r.doc_tokens][4 * r.start : 4 * (r.start + r.length)]
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    assert packing.pack(empty, path).count() == 0


def test_windows_fill_best_and_emit_fullest():
    w = packing.Windows(0, 10, 2)
    ids = lambda n: b"\0\0\0\0" * n
    out = [list(w.place(k, ids(n))) for k, n in enumerate([6, 7, 3, 5, 23])]
    assert out[0] == out[1] == [] and [r[3] for r in out[2]] == [1, 2]
    assert out[3] == []
    assert [r[5] for r in out[4] if r[3] == 4] == [10, 10, 3] or len(w.held) <= 2
    assert sum(r[5] for o in out for r in o) + sum(r[5] for r in w.close()) == 44


# Near duplicates


def test_near_duplicates_edges(spark, edge, empty):
    got = ngram_join.near_duplicates(edge).collect()
    keys = [k for k, *_ in edge_rows()]
    want = Counter((keys[i], links, min((keys[j] for j in c if keys[j] is not None), default=None), len(c)) for i, (links, c) in enumerate(near(TEXTS)))
    assert Counter((r.doc_id, r.n_links, r.class_id, r.n_class) for r in got) == want
    assert ngram_join.near_duplicates(empty).count() == 0
    left = ngram_join.deduplicate(edge).collect()
    assert len(left) == len({frozenset(c) for _, c in near(TEXTS)}) and ngram_join.deduplicate(empty).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """One large group of near copies, cut into blocks: no link between blocks is lost."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = prose(9, 200).split()
    texts = [" ".join([*base[: 50 + k % 40], f"w{k}", *base[50 + k % 40 :]]) for k in range(60)] + [prose(50 + k) for k in range(10)]
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (n, min(c)) for i, (n, c) in enumerate(near(texts))}


def test_posterior_bounds_keep_true_pairs():
    bounds = ngram_join._least_agreements()
    assert all(m < 0.8 * n for n, m in bounds.items()) and bounds[ngram_join.HASHES] > 0.5 * ngram_join.HASHES


# Mixing


def test_mixing_edges(spark, edge, empty):
    got = mixing.mix(edge).collect()
    sizes = Counter()
    for _, t, _, s, _ in edge_rows():
        sizes[s] += counts(t or "")[0]
    want = shares(dict(sizes))
    assert len(got) == len(TEXTS)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
    assert mixing.mix(empty).count() == 0


def test_mixing_meets_targets_and_repeats(spark):
    import random

    r = random.Random(3)
    docs = [(k, " w" * int(r.paretovariate(1.6) * 20), f"s{min(k % 7, 3)}") for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    one = {x.doc_id: x for x in mixing.mix(df).collect()}
    two = {x.doc_id: x.copies for x in mixing.mix(df.repartition(5)).collect()}
    assert {k: x.copies for k, x in one.items()} == two
    for s in {x.source for x in one.values()}:
        own = [x for x in one.values() if x.source == s]
        assert abs(sum(x.size * x.copies for x in own) - own[0].target) <= 0.01 * own[0].target + 50


def test_mixing_in_buckets(spark, monkeypatch):
    """All documents of one size: ranks come from many buckets and are still whole."""
    monkeypatch.setattr(mixing, "BUCKET", 16)
    df = spark.createDataFrame([(k, "a b c", "x" if k % 3 else "y") for k in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    for s in ("x", "y"):
        own = [x for x in got if x.source == s]
        assert abs(sum(3 * x.copies for x in own) - own[0].target) <= 3
