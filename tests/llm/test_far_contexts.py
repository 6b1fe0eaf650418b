"""The word before a mention, however far or long it is."""

from brute import personal

from changeflow.llm import pii


def test_word_beyond_blanks_and_long_word(spark):
    cards = [f"{4000000000000000 + k}" for k in range(4000)]
    cards = [c for c in cards if personal(c)][:20]
    bad = "4000000000000001"
    texts = [f"my card {c} {'x' * (k + 2)}" for k, c in enumerate(cards)] + [f"my card{' ' * 200}{bad} x", f"lot{' ' * 9000}{bad} x", f"card{' ' * 9000}{bad} x"]
    texts += [f"pay {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} {'y' * (k + 2)}" for k, c in enumerate(cards)]
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.more] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[20] == [("ctx_card", 207, 223)] and not got[21] and got[22] == [("ctx_card", 9004, 9020)]


def test_whole_word(spark):
    long, n = "x" * 100, "1234567"
    rows = [(f"a {long}y {n}", f"l {long}y"), (f"{'z' * 5000} {n} ", "l " + "z" * 5000), (" " * 500 + n, None), (f"q\f\x0b{chr(10) * 70}{n}", "l q"), (f"{n}{' ' * 70}{long}", f"r {long}"), (f"{n}. {'z' * 5000}! and", None)]
    df = spark.createDataFrame(rows, "text string, want string")
    got = df.select("want", pii._mentions(df["text"], pii.base_spans(df["text"])).alias("m")).collect()
    assert [(r.m[0].patterns or [None])[0] for r in got] == [r.want for r in got]
