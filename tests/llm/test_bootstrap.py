import random
import re
from collections import defaultdict

from brute import personal
from edge import prose
from pyspark.sql import functions as F

from changeflow.llm import pii

MENTION = re.compile(r"""(?<![^\W_0-9])(?<![0-9@_.+(-])[+(]{0,2}[0-9]+(?:\)?[ .-]?\(?[0-9]+)*|(?<![^\s<>()\[\],;:"])[^\s@<>()\[\],;:"]+@[^\s@<>()\[\],;:"]+""")


def fits(m):
    n, dotted = len(re.sub("[^0-9]", "", m)), re.fullmatch(r"[0-9]+(\.[0-9]+){3}", m)
    if "@" in m:
        return {"email"}
    if dotted:
        return {"ip"} if n <= 12 else set()
    return {k for k, ok in (("card", 12 <= n <= 19 and re.fullmatch("[0-9 -]+", m)), ("phone", 7 <= n <= 15)) if ok}


def bootstrap(texts, rounds=3, support=5, confidence=0.8):
    """Spans that contexts discover, by text: plain dictionaries."""
    word = lambda w: re.sub(r"[\W0-9_]", "", w).lower()
    mentions = []
    for t, text in enumerate(texts):
        base = [(s, e, kind) for s, _, kind, e in personal(text)]
        free = [(m.start(), m.end(), None) for m in MENTION.finditer(text) if fits(m[0]) and not any(s < m.end() and e > m.start() for s, e, _ in base) and ("@" in m[0] or not re.match(r"[^\W0-9]|@", text[m.end() : m.end() + 1]))]
        for s, e, kind in base + free:
            a, b = (word(text[:s].split()[-1]) if text[:s].split() else ""), (word(text[e:].split()[0]) if text[e:].split() else "")
            patterns = [p for ok, p in ((a, f"l {a}"), (b, f"r {b}"), (a and b, f"b {a} {b}")) if ok]
            m = text[s:e]
            mentions.append((t, s, e, kind, m.lower() if "@" in m else re.sub(r"[^0-9.]|(?<=[^0-9])\.", "", m), fits(m) | {kind} - {None}, patterns))
    edges = defaultdict(dict)
    for _, _, _, kind, m, fit, patterns in mentions:
        for p in patterns:
            for k in fit:
                old = edges[p, k].get(m)
                seed = None if kind is None else kind == k
                edges[p, k][m] = seed if old is None else old or bool(seed)
    best = {}

    def confident(least):
        out = {}
        for (p, k), own in edges.items():
            conf = sum(best.get((k, m), 0.0) if seed is None else float(seed) for m, seed in own.items()) / len(own)
            if sum(seed is True for seed in own.values()) >= support and conf >= least:
                out[p, k] = conf
        return out

    for _ in range(rounds):
        found, best = confident(0.0), {}
        for pk, conf in found.items():
            for m, seed in edges[pk].items():
                if seed is None:
                    best[pk[1], m] = max(best.get((pk[1], m), 0.0), conf)
    good = confident(confidence)
    out = defaultdict(list)
    for t, s, e, kind, _, fit, patterns in mentions:
        hits = [(good[p, k], k) for p in patterns for k in fit if (p, k) in good]
        if kind is None and hits:
            out[t].append((f"ctx_{max(hits)[1]}", s, e))
    return {t: sorted(v, key=lambda x: x[1]) for t, v in out.items()}


def made(n=150):
    r = random.Random(1)
    texts = []
    for k in range(n):
        w = prose(k, 12).split()
        phone, mail = f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", f"u{r.randint(1, 9999)}@mail.example.org"
        card = f"{4000000000000000 + r.randint(1, 10**9)}"
        texts.append(" ".join([*w[:5], r.choice(["call", "ring", "of"]), phone, "now or write to", mail, "please", *w[5:], f"for {r.randint(1, 50)} items, card", card, "and", f"{r.randint(1, 255)}.2.3.{r.randint(1, 255)}", r.choice(["host", "end"])]))
    return [*texts, "call (826) 555-4081 now", "call 555-123-4567 now", "please call 8725828797960379 now", "write to bob@host please", "lot 5551234567 x", "ring\n\n5551234567\nnow", "", "of 555 123 4567"]


def test_bootstrap_equals_the_plain_version(spark):
    texts = made()
    got = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    want = bootstrap(texts)
    assert {r.doc_id: [(x.kind, x.s, x.e) for x in r.more] for r in got if r.more} == want
    n = len(texts)
    assert want[n - 8] == [("ctx_phone", 5, 19)] and want[n - 5] == [("ctx_email", 9, 17)]
    assert n - 6 not in want and n - 4 not in want and n - 2 not in want  # 16 digits are no phone; contexts that say nothing


def test_hidden_seeds_come_back_where_contexts_tell(spark):
    docs = spark.createDataFrame(list(enumerate(made(300))), "doc_id long, text string")
    got = {r.kind: r for r in pii.held_out(docs).collect()}
    assert got["email"].hidden > 30 and got["email"].back == got["email"].hidden
    assert got["phone"].back >= 0.9 * got["phone"].hidden and not sum(r.as_other for r in got.values())


def test_contexts_reach_over_blanks(spark):
    wide = " " * 9000
    texts = [*[f"mail me: {wide}u{k}@x.example.org{wide} thanks" for k in range(9)], f"me {wide}bob@host{wide} thanks"]
    got = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter(F.col("doc_id") == 9).first()
    assert [x.kind for x in got.more] == ["ctx_email"]
