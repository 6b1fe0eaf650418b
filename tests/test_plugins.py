"""One job for each kind of plugin, against local files, servers and databases."""

import json
import socketserver
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from changeflow.model import TableSpec, as_changes
from changeflow.plans import cli, config, job
from changeflow.schema.evolution import Change
from changeflow.sinks import dbapi, external, tables
from changeflow.sinks.tables import TableSink, VersionedTable
from changeflow.sources import fake
from changeflow.sources.catalog import Catalog
from changeflow.streaming import fanout


def spec_of(source, sink, **more):
    return config.job({"source": source, "sink": sink, **more})


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


# Tables


def test_a_job_that_runs_twice_adds_its_second_run(spark, tmp_path):
    out = str(tmp_path / "out")
    first, second = (spec_of({"Fake": {"row.num": n}}, {"table": {"path": out}}) for n in (3, 7))
    job.run(spark, first)
    job.run(spark, second)
    assert VersionedTable(spark, out).read().count() == 10
    job.run(spark, second, name="x")
    job.run(spark, second, name="x")
    assert VersionedTable(spark, out).read().count() == 17


def test_the_batch_after_custom_processing_is_kept(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    sink = TableSink(table, ["f0"], run="r")
    sink.write(fake.rows(spark, 5), 0)
    again = TableSink(table, ["f0"], run="r")
    again.open(data_mode="CUSTOM_PROCESSING", custom=lambda df: df.filter("f0 >= 1"))
    again.write(fake.rows(spark, 9).filter("f0 >= 5"), 1)
    again.write(fake.rows(spark, 9).filter("f0 >= 5"), 1)
    assert sorted(r.f0 for r in table.read().collect()) == list(range(1, 9))


def test_a_small_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    sink = TableSink(table, ["id"], buckets=16)
    frame = lambda rows, kind="INSERT": as_changes(spark.createDataFrame(rows, "id long, v string"), F.lit(kind))
    sink.write(frame([(k, "a") for k in range(500)]), 0)
    before = table.manifest()["folders"]
    assert len(before) == 16
    sink.write(frame([(7, "b")]), 1)
    after = table.manifest()["folders"]
    changed = [k for k in after if after[k] != before[k]]
    assert len(changed) == 1 and dict(rows_of(table))[7] == "b" and table.read().count() == 500
    sink.write(frame([(k, "x") for k in range(500)], "DELETE"), 2)
    assert table.read().count() == 0 and table.manifest()["folders"] == {}
    sink.write(frame([(1, "z")]), 3)
    assert rows_of(table) == [(1, "z")] and len(table.versions()) <= 3


def test_columns_are_added_to_a_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    sink = TableSink(table, ["id"], buckets=4)
    sink.write(as_changes(spark.createDataFrame([(k, "a") for k in range(20)], "id long, v string")), 0)
    sink.write(as_changes(spark.createDataFrame([(3, "b", 1.5)], "id long, v string, w double")), 1)
    sink.write(as_changes(spark.createDataFrame([(4, "c")], "id long, v string")), 2)
    got = {r.id: (r.v, r.w) for r in table.read().collect()}
    assert len(got) == 20 and got[3] == ("b", 1.5) and got[4] == ("c", None) and got[5] == ("a", None)


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    sink = TableSink(table, ["f0"])
    sink.write(fake.rows(spark, 4), 0)

    def die(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", die)
        with pytest.raises(RuntimeError, match="killed"):
            sink.write(fake.rows(spark, 9), 1)
    assert table.read().count() == 4
    sink.write(fake.rows(spark, 9), 1)
    assert table.read().count() == 9


def test_ledgers_keep_the_last_batch_and_who_was_left_out(spark, tmp_path):
    ledger = fanout.Ledger(spark, str(tmp_path / "l"))
    for b in range(6):
        ledger.note("a", b)
        assert ledger.last("a") == b
    assert ledger.last("b") == -1

    def bad(df, b):
        raise RuntimeError("x")

    seen = []
    fanout.FanOut({"a": lambda df, b: seen.append(b), "b": bad}, ledger, "isolate")(spark.range(1), 6)
    again = fanout.FanOut({"a": lambda df, b: seen.append(b), "b": lambda df, b: seen.append("b")}, fanout.Ledger(spark, str(tmp_path / "l")), "isolate")
    again(spark.range(1), 7)
    assert seen == [6, 7] and "isolated since batch 6" in again.dead["b"]
    ledger.readmit("b")
    fanout.FanOut({"b": lambda df, b: seen.append("b")}, ledger)(spark.range(1), 8)
    assert seen[-1] == "b"


# Databases


def test_a_database_sink(spark, tmp_path):
    url = f"jdbc:sqlite:{tmp_path}/db"
    sink = {"JDBC": {"url": url, "table": "users", "columns": {"id": "bigint", "name": "string", "score": "double", "at": "timestamp"}, "primary-keys": "id", "batch-size": 3}}
    spark.createDataFrame([(k, f"n{k}", k / 2, None) for k in range(10)], "id long, name string, score double, at timestamp").write.parquet(f"{tmp_path}/in")
    assert job.run(spark, spec_of({"files": {"path": f"{tmp_path}/in"}}, sink)) == {"pipeline-0": {}}
    spec = job.table_spec(sink["JDBC"], "users")
    changes = as_changes(spark.createDataFrame([(1, "x", 9.0, None), (2, None, None, None), (99, "new", 1.0, None)], "id long, name string, score double, at timestamp"), F.when(F.col("id") == 2, "DELETE").otherwise("UPDATE_AFTER"))
    dbapi.write(changes, spec, url)
    dbapi.write(changes, spec, url)
    con = sqlite3.connect(f"{tmp_path}/db")
    got = dict(con.execute("SELECT id, name FROM users").fetchall())
    assert len(got) == 10 and got[1] == "x" and 2 not in got and got[99] == "new"
    with pytest.raises(ValueError):
        dbapi.open_table(url, spec, data_mode="ERROR_WHEN_DATA_EXISTS")
    with pytest.raises(ValueError):
        dbapi.open_table(url, TableSpec.of("nope", "id", id="bigint"), "ERROR_WHEN_SCHEMA_NOT_EXIST")
    dbapi.apply_schema(url, "users", [Change("rename", name="name", to="full_name"), Change("drop", name="score")])
    assert [c[1] for c in con.execute("PRAGMA table_info(users)").fetchall()] == ["id", "full_name", "at"]
    dbapi.open_table(url, spec, "IGNORE", "DROP_DATA")
    assert con.execute("SELECT count(*) FROM users").fetchone() == (0,)
    dbapi.open_table(url, spec, "RECREATE_SCHEMA")
    assert len(con.execute("PRAGMA table_info(users)").fetchall()) == 4


def test_a_catalog_and_a_sink_without_columns(spark, tmp_path):
    url = f"jdbc:sqlite:{tmp_path}/db"
    known = Catalog(url)
    assert known.tables() == [] and not known.exists("users") and not (tmp_path / "db").exists()
    dbapi.execute(url, ["CREATE TABLE users (f0 BIGINT PRIMARY KEY, f1 VARCHAR(20) NOT NULL, f2 BOOLEAN, price DECIMAL(12,2), at TIMESTAMP, raw BLOB, odd whatever)"])
    spec = known.spec("users")
    assert [(c.name, c.type) for c in spec.columns] == [
        ("f0", "bigint"), ("f1", "string"), ("f2", "boolean"), ("price", "decimal(12,2)"), ("at", "datetime"), ("raw", "bytes"), ("odd", "string"),
    ]
    assert spec.primary_key == ["f0"] and [c.nullable for c in spec.columns[:3]] == [False, False, True]
    assert known.tables() == ["users"] and known.exists("main.users") and not known.exists("nope") and known.count("users") == 0
    job_of = spec_of({"Fake": {"row.num": 6}}, {"JDBC": {"url": url, "table": "users"}})
    assert job.run(spark, job_of) == {"pipeline-0": {}} and job.run(spark, job_of) == {"pipeline-0": {}}
    assert known.count("users") == 6


def test_types_that_a_catalog_reads():
    my, post = Catalog("jdbc:mysql://h/d"), Catalog("jdbc:postgresql://h/d")
    assert [my._type(t) for t in ("bigint unsigned", "tinyint(1)", "tinyint(4)", "varchar(20)", "int(11)", b"datetime(6)")] == ["bigint", "boolean", "tinyint", "string", "int", "datetime"]
    assert my._type("decimal(12,2)") == my._type("decimal(12,2) unsigned") == post._type("numeric", 12, 2) == "decimal(12,2)"
    assert [post._type(t) for t in ("int8", "timestamptz", "_int4", "uuid")] == ["bigint", "timestamp", "array<int>", "string"]
    assert my._where("d.t") == ("table_name = ? AND table_schema = ?", ["t", "d"]) and post._where("t") == ("table_name = ? AND table_schema = current_schema()", ["t"])


def test_statements_in_drivers_own_marks():
    spec = TableSpec.of("s.t", "id", id="bigint", v="double", n="string")
    cols = list(spec.columns)
    assert dbapi.native(dbapi.POSTGRES.upsert("s.t", cols, ["id"]), "postgresql").count("%s") == 3
    assert "::double precision" in dbapi.native(dbapi.POSTGRES.insert("s.t", cols), "postgresql")
    assert dbapi.native(dbapi.POSTGRES.delete("s.t", cols[:2]), "sqlite") == 'DELETE FROM "s"."t" WHERE "id" = ? AND "v" = ?'
    assert dbapi.native(dbapi.MYSQL.insert("s.t", cols), "mysql").count("%s") == 3
    with pytest.raises(ValueError):
        dbapi.kind_of("jdbc:oracle:x")


# HTTP interfaces


@pytest.fixture()
def web():
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            got.append((self.path, body))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", got
    s.shutdown()


def test_a_column_store_sink(spark, web):
    url, got = web
    job.run(spark, spec_of({"Fake": {"row.num": 25}}, {"ClickHouse": {"url": url, "table": "db.t", "batch-size": 10}}))
    lines = [json.loads(x) for _, body in got for x in body.splitlines()]
    assert sorted(x["f0"] for x in lines) == list(range(25))
    assert {parse_qs(urlparse(p).query)["query"][0] for p, _ in got} == {"INSERT INTO db.t FORMAT JSONEachRow"}


def test_a_search_sink_keeps_the_order_of_each_id(spark, web):
    url, got = web
    rows = [(k % 5, k) for k in range(200)]
    changes = as_changes(spark.createDataFrame(rows, "id long, v long").repartition(8), F.when(F.col("v") % 7 == 0, "DELETE").otherwise("UPDATE_AFTER"), seq=F.col("v"))
    external.bulk(external_lines(changes), url, most=10)
    seen = {}
    for _, body in got:
        lines = body.splitlines()
        k = 0
        while k < len(lines):
            act = json.loads(lines[k])
            ident = next(iter(act.values()))["_id"]
            if "delete" in act:
                seen[ident], k = None, k + 1
            else:
                seen[ident], k = json.loads(lines[k + 1])["doc"]["v"], k + 2
    assert seen == {str(i): (None if (195 + i) % 7 == 0 else 195 + i) for i in range(5)}
    assert job.run(spark, spec_of({"Fake": {"row.num": 4}}, {"Elasticsearch": {"hosts": url, "index": "i", "primary-keys": "f0"}})) == {"pipeline-0": {}}


def external_lines(changes):
    from changeflow.operators.changelog import bulk_lines

    return bulk_lines(changes, ["id"], "ix")


# A key-value store


class Store(socketserver.StreamRequestHandler):
    data: dict = {}
    seen: list = []

    def handle(self):
        while line := self.rfile.readline():
            words = []
            for _ in range(int(line[1:])):
                n = int(self.rfile.readline()[1:])
                words.append(self.rfile.read(n + 2)[:-2].decode())
            self.seen.append(words)
            self.wfile.write(self.answer(words))

    def answer(self, w):
        bulk = lambda x: b"$-1\r\n" if x is None else b"$%d\r\n%s\r\n" % (len(str(x).encode()), str(x).encode())
        many = lambda xs: b"*%d\r\n" % len(xs) + b"".join(bulk(x) for x in xs)
        own = self.data.get(w[1]) if len(w) > 1 else None
        if w[0] == "SCAN":
            return b"*2\r\n" + bulk("0") + many(sorted(self.data) * 2)
        if w[0] == "TYPE":
            return {str: b"+string\r\n", dict: b"+hash\r\n", list: b"+list\r\n", set: b"+set\r\n"}.get(type(own), b"+none\r\n")
        if w[0] == "GET":
            return bulk(own)
        if w[0] == "HGETALL":
            return many([x for kv in own.items() for x in kv])
        if w[0] == "LRANGE":
            return many(own)
        if w[0] == "SMEMBERS":
            return many(sorted(own, reverse=True))
        if w[0] == "SET":
            self.data[w[1]] = w[2]
            return b"+OK\r\n"
        if w[0] == "DEL":
            self.data.pop(w[1], None)
            return b":1\r\n"
        return b"-ERR unknown\r\n"


@pytest.fixture()
def store():
    Store.data, Store.seen = {}, []
    s = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Store)
    s.daemon_threads = True
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_address[1]
    s.shutdown()


def test_a_key_value_store_both_ways(spark, store, tmp_path):
    at = {"host": "127.0.0.1", "port": store}
    Store.data.update({"a": "é1", "h": {"y": "2", "x": "1"}, "l": ["p", "q"], "s": {"m", "n"}})
    job.run(spark, spec_of({"Redis": at}, {"table": {"path": f"{tmp_path}/t"}}))
    got = sorted(r.fields for r in VersionedTable(spark, f"{tmp_path}/t").read().collect())
    assert got == [["a", "é1"], ["h", "x", "1"], ["h", "y", "2"], ["l", "p"], ["l", "q"], ["s", "m"], ["s", "n"]]
    Store.data.clear()
    changes = as_changes(spark.createDataFrame([(k % 3, k) for k in range(30)], "f0 long, f1 long").repartition(4), F.when(F.col("f1") == 29, "DELETE").otherwise("INSERT"), seq=F.col("f1"))
    external.redis(changes, {"host": "127.0.0.1", "port": str(store)}, key="k${f0}", value="${f1}")
    assert Store.data == {"k0": "27", "k1": "28"}
    assert job.run(spark, spec_of({"Fake": {"row.num": 3}}, {"Redis": {**at, "key": "f${f0}"}})) == {"pipeline-0": {}} and {"f0", "f1", "f2"} <= set(Store.data)
    dead = job.run(spark, config.job({"source": {"Fake": {"row.num": 3}}, "sink": [{"Redis": {**at, "data-type": "set"}}, {"Console": {}}], "env": {"on-sink-failure": "isolate"}}))
    assert "ERR unknown" in str(dead)


# Change sources


MESSAGES = [
    {"op": "c", "after": {"id": 1, "v": "a"}, "source": {"db": "shop", "table": "users"}, "ts_ms": 100},
    {"op": "c", "after": {"id": 2, "v": "b"}, "source": {"db": "shop", "table": "users"}, "ts_ms": 200},
    {"op": "c", "after": {"id": 9, "v": "z"}, "source": {"db": "shop", "table": "other"}, "ts_ms": 250},
    {"op": "u", "before": {"id": 1, "v": "a"}, "after": {"id": 1, "v": "c"}, "source": {"db": "shop", "table": "users"}, "ts_ms": 300},
    {"op": "d", "before": {"id": 2, "v": "b"}, "source": {"db": "shop", "table": "users"}, "ts_ms": 400},
]


@pytest.fixture()
def messages(spark, tmp_path):
    path = str(tmp_path / "messages")
    rows = [(json.dumps(m), k) for k, m in enumerate(MESSAGES)]
    spark.createDataFrame(rows, "value string, offset long").write.parquet(path)
    return path


def change_source(path, **more):
    return {"messages": path, "messages.format": "parquet", "columns": {"id": "bigint", "v": "string"}, "primary-keys": "id", "table-names": "shop.users", **more}


@pytest.mark.parametrize("more, want", [({}, [(1, "c")]), ({"stop.mode": "timestamp", "stop.timestamp": 250}, [(1, "a"), (2, "b")]), ({"startup.mode": "timestamp", "startup.timestamp": 300}, [(1, "c")]), ({"stop.mode": "specific", "stop.seq": 3}, [(1, "c"), (2, "b")])])
def test_a_change_source_of_messages(spark, messages, tmp_path, more, want):
    job.run(spark, spec_of({"MySQL-CDC": change_source(messages, **more)}, {"table": {"path": f"{tmp_path}/t", "primary-keys": "id"}}))
    assert rows_of(VersionedTable(spark, f"{tmp_path}/t")) == want


def test_a_change_source_begins_with_a_snapshot(spark, messages, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (5, "s")], "id long, v string").write.parquet(f"{tmp_path}/snap")
    job.run(spark, spec_of({"PostgreSQL-CDC": change_source(messages, snapshot=f"{tmp_path}/snap", **{"snapshot.seq": 2})}, {"table": {"path": f"{tmp_path}/t", "primary-keys": "id"}}))
    assert rows_of(VersionedTable(spark, f"{tmp_path}/t")) == [(1, "c"), (5, "s")]


def test_a_change_source_without_images_before(spark, tmp_path):
    rows = [({"_type": t, "_db": "d", "_table": "t", "data": [d], "old": [o]}, k) for k, (t, d, o) in enumerate([("INSERT", {"id": 1, "v": "a"}, None), ("UPDATE", {"id": 1, "v": "b"}, {"v": "a"})])]
    spark.createDataFrame([(json.dumps(m), k) for m, k in rows], "value string, offset long").write.parquet(f"{tmp_path}/m")
    plugin = config.Plugin("TiDB-CDC", {"messages": f"{tmp_path}/m", "messages.format": "parquet", "columns": {"id": "bigint", "v": "string"}, "primary-keys": "id"})
    assert [(r._kind, r._origin, r.v) for r in job.source(spark, plugin).orderBy("_seq").collect()] == [("INSERT", "d.t", "a"), ("UPDATE_AFTER", "d.t", "b")]


def test_messages_of_topics_are_decoded(spark):
    raw = spark.createDataFrame([(bytearray(b'{"b":"x","a":1}'), 5, "t")], "value binary, offset long, topic string")
    with_columns = job.kafka_rows(raw, config.Plugin("Kafka", {"columns": {"a": "bigint", "b": "string"}, "format": "json"}))
    assert [(r.a, r.b, r._seq, r._origin) for r in with_columns.collect()] == [(1, "x", 5, "t")]
    assert job.kafka_rows(raw, config.Plugin("Kafka", {})).first().fields == ["1", "x"]
    assert job.kafka_rows(raw, config.Plugin("Kafka", {"format": "text"})).first().f0 == '{"b":"x","a":1}'


# Streams


def test_a_streaming_job_restarts_where_it_was(spark, messages, tmp_path):
    spec = spec_of({"MySQL-CDC": change_source(messages)}, {"table": {"path": f"{tmp_path}/t", "primary-keys": "id"}}, env={"checkpoint.interval": 50})
    for _ in range(2):
        for q in job.stream(spark, spec, str(tmp_path / "ckpt"), bounded=True).values():
            q.awaitTermination()
    assert rows_of(VersionedTable(spark, f"{tmp_path}/t")) == [(1, "c")]
    spark.createDataFrame([(json.dumps(MESSAGES[1] | {"ts_ms": 500}), 10)], "value string, offset long").write.mode("append").parquet(messages)
    (q,) = job.stream(spark, spec, str(tmp_path / "ckpt")).values()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows_of(VersionedTable(spark, f"{tmp_path}/t")) == [(1, "c"), (2, "b")]


def test_options_are_checked(spark, tmp_path):
    for source in ({"JDBC": {"url": "x"}}, {"JDBC": {"url": "x", "table": "t", "query": "q"}}, {"Kafka": {"topic": "t"}}, {"MySQL-CDC": {"hostname": "h"}}, {"RabbitMQ": {"host": "h"}}):
        with pytest.raises(config.ConfigError):
            job.plan(spark, spec_of(source, {"Console": {}}).pipelines[0])
    for sink in ({"JDBC": {"url": "x"}}, {"Redis": {}}, {"ClickHouse": {"table": "t"}}, {"JDBC": {"url": "jdbc:sqlite:x", "table": "t"}}):
        with pytest.raises(config.ConfigError):
            job.run(spark, spec_of({"Fake": {}}, sink))
    path = tmp_path / "job.yaml"
    path.write_text(f"env: {{checkpoint.interval: 100}}\nsource: {{MySQL-CDC: {{messages: {tmp_path}/none, columns: {{id: bigint}}}}}}\nsink: {{Console: {{}}}}\n")
    assert cli.main(["validate", "-c", str(path)]) == 0
    assert fake.rows(spark, 3).count() == 3 and tables.BUCKETS > 1


def test_a_message_is_parsed_once(spark):
    from changeflow import codecs

    spec = TableSpec.of("t", "id", id="bigint", v="string")
    df = spark.range(3).select(F.lit('{"op":"u","before":{"id":1},"after":{"id":1,"v":"x"}}').alias("m"), "id").withColumn("m", F.concat("m", F.lit("")))
    raw = spark.createDataFrame([("x",)], "m string")
    for fmt in ("json", "debezium_json", "canal_json", "maxwell_json", "ogg_json"):
        plan = codecs.decode(raw, "m", spec, fmt)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1, plan
    assert codecs.decode(df, "m", spec, "debezium_json").count() == 6
