"""Physical plans: what reaches the scan, and what is shuffled."""

from changeflow import codecs
from changeflow.model import as_changes
from changeflow.operators import changelog, filters, routing
from changeflow.queries import SPEC

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    events = as_changes(spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "value"))
    got = plan(filters.filter_by_index(events, 2, ">", 100).select("event_id"))
    assert "GreaterThan(value,100.0)" in got
    schema = got[got.index("ReadSchema") :].splitlines()[0]
    assert "event_id" in schema and "value" in schema and "event_type" not in schema and "props" not in schema


def test_codecs_and_routing_do_not_shuffle(spark):
    messages = spark.createDataFrame([('{"op":"u","before":{"user_id":1},"after":{"user_id":2}}', "s.t", 1)], "m string, _origin string, _seq long")
    got = plan(routing.fan_out_topics(codecs.decode(messages, "m", SPEC, "debezium-json"), "x"))
    assert "Exchange" not in got and "Python" not in got


def test_last_change_is_aggregated_before_the_shuffle(spark):
    changes = as_changes(spark.range(100).selectExpr("id % 3 AS k", "id AS v"))
    got = plan(changelog.latest_by_key(changes, ["k"]))
    assert got.count("Exchange hashpartitioning") == 1 and "partial_max_by" in got
