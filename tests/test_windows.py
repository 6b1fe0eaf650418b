"""Windows over hot groups: many tasks' work, and the same results as over whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from changeflow.model import as_changes
from changeflow.operators import changelog, metrics


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(k, r.choice(["a", "a", "a", "b", None]), r.choice([None, 1.5, r.random() * 1e6, -3.0, float(k)]), 1_700_000_000 + r.randint(0, 50_000)) for k in range(2000)]
    return spark.createDataFrame(data, "k long, g string, v double, s long").withColumn("ts", F.timestamp_seconds("s")).cache()


def plain(df):
    return sorted(map(str, df.collect()))


def test_sliding_equals_one_window(rows):
    last = Window.partitionBy("g").orderBy("s").rangeBetween(-599, 0)
    want = rows.withColumns({"n": F.sum("k").over(last), "max_v": F.max("v").over(last)})
    for span in (1, 3, 1000):
        got = metrics.sliding(rows, "ts", ["g"], 600, span, n="k", max_v="v")
        assert plain(got.select(want.columns)) == plain(want)


def test_averages_and_percentiles_equal_sorted_lists(rows):
    own = {}
    for r in sorted(rows.collect(), key=lambda r: r.k):
        own.setdefault(r.g, []).append(r)
    kept = rows.filter("v is not null")
    got = {r.g: r.ema for r in metrics.ema_by(kept, ["g"], "k", "v").collect()}
    ranks = {r.g: r for r in metrics.nearest_rank(rows, ["g"], "v", {"p50": 0.5, "p99": 0.99, "p0": 0.0}).collect()}
    for g, rs in own.items():
        values = [r.v for r in rs if r.v is not None]
        e = values[0]
        for x in values[1:]:
            e = 0.2 * x + 0.8 * e
        assert abs(got[g] - e) < 1e-6 * max(1, abs(e))
        s = sorted(values)
        assert [ranks[g].p0, ranks[g].p50, ranks[g].p99] == [s[int((len(s) - 1) * p + 0.5)] for p in (0.0, 0.5, 0.99)] and ranks[g].n == len(s)


def test_runs_equal_one_window(spark):
    r = random.Random(6)
    data = [(k, r.choice(["s.a", "s.a", "s.b", None]), r.choice(["INSERT", "DELETE", "UPDATE_AFTER", "UPDATE_BEFORE"])) for k in range(600)]
    df = spark.createDataFrame(data, "_seq long, _origin string, _kind string").withColumn("x", F.col("_seq"))
    want, last, run = {}, {}, {}
    for k, o, kind in data:
        if kind == "UPDATE_BEFORE":
            continue
        op = "delete" if kind == "DELETE" else "upsert"
        run[o] = run.get(o, 0) + (o in last and last[o] != op)
        last[o], want[k] = op, run[o]
    for width in (1, 7, 10_000):
        assert {x._seq: x._run for x in changelog.runs(df, width=width).collect()} == want


def test_no_window_is_keyed_by_group_alone(spark, rows):
    """Every window over rows is partitioned by a part of its group; those by group alone see one row per part."""
    changes = as_changes(rows.select("k", "v"), origin=F.lit("s.t"), seq=F.col("k"))
    for df in (metrics.sliding(rows, "ts", ["g"], 600, n="k"), metrics.ema_by(rows, ["g"], "k", "v"), metrics.nearest_rank(rows, ["g"], "v", {"p50": 0.5}), changelog.runs(changes)):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert windows and any("_part" in w or "_stretch" in w or "_bucket" in w for w in windows)
