"""The mixing stage on ids that don't tell documents apart."""

from collections import Counter

import corpus_pipeline
from changeflow.llm import mixing


def test_repeated_and_null_ids(spark):
    rows = [(None if k % 3 == 0 else k % 5, f"t{k}" + " w" * (k % 11), "en", f"s{k % 2}" if k % 7 else None, k) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    plan = mixing.mix(docs).collect()
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source, r.size] += r.copies
    assert 0 in {r.copies for r in plan}
    got = corpus_pipeline.source_mix(spark, docs, "").collect()
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in got) == +want
    # Each row's own number: within a source and size, numbers differ by one at most, and none is above three.
    own = Counter(r.n_chars for r in got)
    by = {}
    for _, text, _, source, n in rows:
        by.setdefault((source, len(text.split())), []).append(own[n])
    assert all(max(x) <= 3 and max(x) - min(x) <= 1 for x in by.values())
