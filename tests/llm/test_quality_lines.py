import numpy as np
from edge import SF

from changeflow.llm import quality


def test_lines_of_one_document_get_their_own_labels(spark):
    """Good and bad labelled documents, joined: each line is labelled by its own kind, the share lies between."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    field = quality.fit(docs, labels)
    rows = quality.judge(docs, None).join(labels, "doc_id").filter("not base_failed").select("text", "quality").collect()
    good, bad = ([r.text for r in rows if r.quality == q] for q in (1, 0))
    right, wrong = [], []
    for k, b in enumerate(bad):
        a = good[k % len(good)]
        n = len(quality.count(a)[1])
        _, *parts = quality.count(f"{a}\n{b}")
        y = field.labels(quality.features(*parts))
        right.append(y[:n].mean())
        wrong.append(y[n:].mean())
    assert len(bad) >= 3 and np.mean(right) > 0.9 and np.mean(wrong) < 0.15
    mixed = [(f"{a}\n{b}",) for a, b in zip(good, bad)]
    shares = [r.content_share for r in quality.judge(spark.createDataFrame(mixed, "text string"), field).collect() if not r.base_failed]
    assert shares and sum(0 < s < 1 for s in shares) > 0.8 * len(shares)


def test_a_recurring_line_counts_as_boilerplate_evidence():
    own = [(True, np.array([k, k + 100, 7]), np.array([5, 5, 3])) for k in range(20, 26)]
    copies = [(True, np.array([1, 2, 3]), np.array([4, 4, 4]))] * 4
    told = quality._evidence([*own, *copies, (False, np.array([9]), np.array([4]))])
    assert all(t.tolist() == [0.95, 0.95, 0.1] for t in told[:6])
    assert all(t.tolist() == [0.95] * 3 for t in told[6:10]) and told[10].tolist() == [0.3]


def test_training_finds_hidden_labels():
    """One feature tells the lines apart; a run of each document is of the other kind, and evidence is of documents."""
    r = np.random.default_rng(2)
    samples = []
    for k in range(60):
        good = k % 2 == 0
        run, begin = (2, 9)[not good], r.integers(0, 20)
        y = np.where((np.arange(30) >= begin) & (np.arange(30) < begin + run), not good, good)
        x = np.zeros((30, len(quality.FEATURES)))
        x[:, 0], x[:, 3] = 1, y
        samples.append((x, np.full(30, 1 - quality.NOISE["good"] if good else quality.NOISE["bad"]), 1 / 60))
    field = quality.train(samples)
    assert np.mean([(field.labels(x) == x[:, 3].astype(bool)).mean() for x, _, _ in samples]) > 0.85


def test_fit_takes_a_run_of_a_long_document(spark):
    docs = spark.createDataFrame([(k, "\n".join(f"line {j} of this, good." if k % 2 else "BAD!! ### LINE!!" for j in range(400))) for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    for run in (16, 1000):
        field = quality.fit(docs, labels, run=run)
        _, *parts = quality.count("line 5 of this, good.\nBAD!! ### LINE!!\nBAD!! ### LINE!!\nBAD!! ### LINE!!")
        assert field.labels(quality.features(*parts)).tolist() == [True, False, False, False]
