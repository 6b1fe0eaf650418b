import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from changeflow.model import as_changes
from changeflow.plans import cli, config, hocon, job
from changeflow.sinks import external
from changeflow.sinks.tables import TableSink, VersionedTable
from changeflow.sources import cdc, connect, fake, http
from changeflow.streaming import fanout, stateful

JOB = """
env: {job.name: demo, parallelism: 2, checkpoint: {interval: 1000}}
source: {FakeSource: {row.num: 20}}
transform:
  - filter: {field_index: 0, operator: ">=", value: 5}
  - fanout: {mode: n, n: 2}
  - sql: {query: "SELECT f0, f1, f2, _kind, _origin, _seq FROM source WHERE f2"}
sink:
  - table: {path: %s, primary-keys: f0}
"""


def test_job_end_to_end(spark, tmp_path, capsys):
    path = tmp_path / "job.yaml"
    path.write_text(JOB % (tmp_path / "out"))
    spec = config.load(str(path))
    assert spec.name == "demo" and spec.checkpoint_interval_ms == 1000 and spec.pipelines[0].parallelism == 2
    assert job.run(spark, spec) == {"pipeline-0": {}}
    got = VersionedTable(spark, str(tmp_path / "out")).read()
    assert sorted(r.f0 for r in got.collect()) == [6, 8, 10, 12, 14, 16, 18]
    assert "Filter" in job.explain(spark, spec)
    assert cli.main(["validate", "-c", str(path)]) == 0 and cli.main(["validate", "-c", str(tmp_path / "no.yaml")]) == 2


def test_configs():
    h = hocon.loads('env { job.name = "x y" # note\n parallelism = 2 }\nsource { Fake { row.num: 3, list = [1, 2.5, a] } }\nsink { Console {} }')
    assert h["env"] == {"job": {"name": "x y"}, "parallelism": 2} and h["source"]["Fake"]["list"] == [1, 2.5, "a"]
    assert config.job(h).pipelines[0].source.options["row"] == {"num": 3}
    with pytest.raises(hocon.HoconError):
        hocon.loads("a = {")
    toml = config.job(config.parse('[[source]]\nplugin_name = "Fake"\n[sink.B]\n[sink.A]\n', "toml"))
    assert [s.name for s in toml.pipelines[0].sinks] == ["A", "B"]
    many = config.job({"pipelines": [{"name": "p", "source": {"MySQL-CDC": {"format": "x"}}, "sinks": [{"Console": {}}], "on-sink-failure": "isolate"}], "transform": {"filter": {"field_index": 0}}})
    assert many.pipelines[0].on_sink_failure == "isolate" and many.pipelines[0].transforms[0].name == "filter" and len(many.warnings) == 1
    for bad in ({"source": {"A": {}}}, {"sink": {"A": {}}}, {"source": {"A": 1}, "sink": {"B": {}}}):
        with pytest.raises(config.ConfigError):
            config.job(bad)
    rules = config.Rules(("a",), exclusive=(("b", "c"),), bundled=(("d", "e"),), conditional=(("m", "x", ("n",)),))
    assert len(rules.errors({"d": 1, "m": "x"})) == 4 and rules.errors({"a": 1, "b": 1}) == []
    with pytest.raises(config.ConfigError, match="unknown transform"):
        job.transform(config.Plugin("nope"))


def test_stream_restart_is_exactly_once(spark, tmp_path):
    """Two bounded runs over growing input, with a sink that fails once in between: each row arrives once."""
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    table = VersionedTable(spark, str(tmp_path / "t"))
    sink = TableSink(table, ["f0"])
    broken = {"on": False}

    def write(df, batch):
        if broken["on"]:
            raise RuntimeError("down")
        sink.write(df, batch)

    def run():
        stream = spark.readStream.schema("f0 long, f1 string, f2 boolean, _kind string, _origin string, _seq long").parquet(src)
        q = fanout.run(stream, [lambda df: df.filter("f0 >= 0")], {"table": write}, ckpt)
        q.awaitTermination()

    fake.rows(spark, 50).write.mode("append").parquet(src)
    run()
    assert table.read().count() == 50
    fake.rows(spark, 80).write.mode("append").parquet(src)
    broken["on"] = True
    with pytest.raises(Exception, match="down"):
        run()
    broken["on"] = False
    run()
    run()
    got = table.read()
    assert got.count() == 80 and got.select("f0").distinct().count() == 80
    ledger = fanout.Ledger(spark, f"{ckpt}-ledger")
    assert ledger.last("table") >= 1
    with pytest.raises(fanout.SinkFailed):
        fanout.guard_restore(spark, str(tmp_path / "none"), ledger, ["table"])


def test_fan_out_policies(spark):
    seen = []

    def good(df, b):
        seen.append((b, df.count()))

    def bad(df, b):
        raise RuntimeError("x")

    df = spark.range(3)
    mux = fanout.FanOut({"a": good, "b": bad}, on_failure="isolate")
    mux(df, 0)
    mux(df, 0)
    mux(df, 1)
    assert seen == [(0, 3), (1, 3)] and list(mux.dead) == ["b"]
    with pytest.raises(fanout.SinkFailed):
        fanout.FanOut({"b": bad})(df, 0)
    with pytest.raises(fanout.SinkFailed):
        fanout.FanOut({"b": bad}, on_failure="isolate")(df, 0)


def test_fake_stream(spark, tmp_path):
    q = fake.stream(spark, 25, 10).writeStream.format("memory").queryName("fake_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            if spark.sql("select count(*) n from fake_rows").first().n >= 25:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert sorted(r.f0 for r in spark.table("fake_rows").collect()) == list(range(25))


def test_pairing_stream(spark, tmp_path):
    rows = [("s.t", 1, "UPDATE_BEFORE", 1), ("s.t", 2, "UPDATE_AFTER", 2), ("s.t", 3, "UPDATE_BEFORE", 3), ("s.t", 4, "UPDATE_BEFORE", 4), ("s.t", 5, "UPDATE_AFTER", 5), ("s.u", 6, "UPDATE_AFTER", 6), ("s.u", 7, "DELETE", 7), ("s.u", 8, "INSERT", 8)]
    spark.createDataFrame(rows, "_origin string, _seq long, _kind string, v long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("_origin string, _seq long, _kind string, v long").parquet(str(tmp_path / "in"))
    q = stateful.pair_stream(stream).writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            if spark.table("paired").count() >= 6:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    got = {(r._seq, r.event, r.old) for r in spark.table("paired").collect()}
    assert got == {(2, "update", '{"v":1}'), (3, "delete", None), (5, "update", '{"v":4}'), (6, "update", None), (7, "delete", None), (8, "insert", None)}


@pytest.fixture()
def server():
    got = []

    class Handler(BaseHTTPRequestHandler):
        fails = 1

        def do_GET(self):
            if Handler.fails:
                Handler.fails -= 1
                self.send_response(503)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"data":{"rows":[{"b":1,"a":"x"},{"b":{"k":[1]},"a":null}]}}')

        def do_POST(self):
            got.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", got
    s.shutdown()


def test_http(spark, server):
    url, got = server
    spark.dataSource.register(http.HttpSource)
    rows = connect.http({"url": url, "data-path": "data.rows", "retry-backoff-ms": 1}).load(spark).collect()
    assert sorted(map(str, (r.fields for r in rows))) == sorted(map(str, [["x", "1"], [None, '{"k":[1]}']]))
    external.http(fake.rows(spark, 5).coalesce(1), url, batch=2)
    assert len(got) == 3 and got[0].startswith("[[0,")


def test_readers_are_checked():
    assert connect.jdbc({"url": "jdbc:x", "table": "t", "partition.column": "id", "partition.num": 2}, (0, 9)).predicates == ("id >= 0 AND id < 5", "id >= 5 AND id < 10")
    assert connect.kafka({"bootstrap.servers": "b", "topic": "t", "startup.mode": "specific-offsets", "startup.specific-offsets": "0:5,1:7"}).options["startingOffsets"] == '{"t": {"0": 5, "1": 7}}'
    for bad in (lambda: connect.jdbc({"url": "x"}), lambda: connect.kafka({"topic": "t"}), lambda: connect.http({"url": "x", "method": "PUT"}), lambda: connect.clickhouse({"url": "u", "table": "t"}, ["a", "b"])):
        with pytest.raises(ValueError):
            bad()
    assert cdc.retention_gap(5, 3, "warn") and not cdc.retention_gap(1, 3)


def test_save_modes(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    sink = TableSink(table, ["f0"])
    with pytest.raises(ValueError):
        sink.open("ERROR_WHEN_SCHEMA_NOT_EXIST")
    sink.open()
    sink.write(fake.rows(spark, 3), 0)
    with pytest.raises(ValueError):
        sink.open(data_mode="ERROR_WHEN_DATA_EXISTS")
    sink.open(data_mode="CUSTOM_PROCESSING", custom=lambda df: df.filter("f0 < 2"))
    assert table.read().count() == 2
    sink.open("RECREATE_SCHEMA")
    assert table.read() is None


def test_empty_frames(spark):
    empty = as_changes(spark.createDataFrame([], "a long, b string"))
    from changeflow.operators import changelog, routing

    assert changelog.apply_changelog(None, empty, ["a"]).count() == 0
    assert routing.fan_out_topics(empty, "t").count() == 0
    with pytest.raises(Exception, match="needs database and table"):
        routing.fan_out_topics(as_changes(spark.range(1).select(F.col("id").alias("a"))), "${table}").collect()


def test_matching_stream(spark, tmp_path):
    pre = [(k, k * 10, f"2024-01-01 00:00:{k:02d}", f"v{k}") for k in range(10)]
    com = [(k, k * 10, k * 10 + 5, f"2024-01-01 00:00:{k + 20:02d}") for k in range(0, 10, 2)]
    ts = F.col("ts").cast("timestamp")
    spark.createDataFrame(pre, "handle long, start_ts long, ts string, value string").withColumn("ts", ts).write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(com, "handle long, start_ts long, commit_ts long, ts string").withColumn("ts", ts).write.parquet(f"{tmp_path}/c")
    spark.createDataFrame([(4, 40), (77, 770)], "handle long, start_ts long").write.parquet(f"{tmp_path}/r")
    late = spark.createDataFrame([(1, 10, 15, "2024-01-09 00:00:00")], "handle long, start_ts long, commit_ts long, ts string").withColumn("ts", ts)
    p = spark.readStream.schema("handle long, start_ts long, ts timestamp, value string").parquet(f"{tmp_path}/p")
    c = spark.readStream.schema("handle long, start_ts long, commit_ts long, ts timestamp").parquet(f"{tmp_path}/c")
    back = spark.readStream.schema("handle long, start_ts long").parquet(f"{tmp_path}/r")
    q = stateful.match_stream(p, c, back).writeStream.format("memory").queryName("matched").option("checkpointLocation", f"{tmp_path}/k").start()
    try:
        for _ in range(60):
            if spark.table("matched").count() >= 4:
                break
            q.awaitTermination(1)
        late.write.mode("append").parquet(f"{tmp_path}/c")  # days after its prewrite
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.handle, r.commit_ts, r.value) for r in spark.table("matched").collect()) == [(k, k * 10 + 5, f"v{k}") for k in (0, 1, 2, 6, 8)]


def test_foreign_tables_are_rejected(spark):
    from changeflow.operators import canal_client

    rows = as_changes(spark.createDataFrame([(1,)], "id long"), origin=F.lit("s.other"))
    with pytest.raises(Exception, match="not registered"):
        canal_client.encode_tables(rows, {"s.t": canal_client.Fields("id", {"id": "id"})}).collect()
    with pytest.raises(ValueError):
        canal_client.encode_tables(rows, {})


def test_metrics_and_splits(spark):
    from changeflow.operators import metrics, splits

    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "xs array<double>")
    a, b = (r[0] for r in df.select(metrics.ema(F.col("xs"), 0.5)).collect())
    assert a == 2.25 and b is None
    assert splits.ranges(1, 10, 3) == [splits.Range(1, 5, 0), splits.Range(5, 9, 1), splits.Range(9, 11, 2)]
    assert splits.ranges(None, None, 3) == [] and len(splits.snapshot_ranges(1, 20_000, 1)) == 3
