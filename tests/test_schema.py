import pytest

from changeflow.functions.scalars import camel_case, flatten_config
from changeflow.model import ColumnSpec, TableSpec, spark_type, type_name
from changeflow.schema import evolution as ev
from changeflow.schema.dialects import MYSQL, POSTGRES, TIDB, clickhouse_table, search_mapping

USERS = TableSpec("db.users", (ColumnSpec("id", "bigint", False, True), ColumnSpec("name"), ColumnSpec("score", "decimal(10,2)", False), ColumnSpec("tags", "array<string>")))


def test_create_table():
    assert MYSQL.create_table(USERS) == "CREATE TABLE `db`.`users` (`id` BIGINT NOT NULL, `name` TEXT, `score` DECIMAL(10,2) NOT NULL, `tags` JSON, PRIMARY KEY (`id`))"
    assert POSTGRES.create_table(USERS) == 'CREATE TABLE "db"."users" ("id" BIGINT NOT NULL, "name" TEXT, "score" NUMERIC(10,2) NOT NULL, "tags" TEXT[], PRIMARY KEY ("id"))'
    assert TIDB.sql_type(ColumnSpec("k", "string", primary_key=True)) == "VARCHAR(255)"
    assert "ReplacingMergeTree() ORDER BY (`id`)" in clickhouse_table(USERS)
    assert search_mapping(USERS)["mappings"]["properties"]["name"] == {"type": "keyword"}


def test_alter_text():
    col = ColumnSpec("age", "int", False)
    assert MYSQL.change("t", ev.add(col)) == ["ALTER TABLE `t` ADD COLUMN `age` INT NOT NULL"]
    assert POSTGRES.change("s.t", ev.modify(col)) == ['ALTER TABLE "s"."t" ALTER COLUMN "age" TYPE INTEGER', 'ALTER TABLE "s"."t" ALTER COLUMN "age" SET NOT NULL']
    assert MYSQL.change("t", ev.rename("a", "b")) == ["ALTER TABLE `t` RENAME COLUMN `a` TO `b`"]
    assert MYSQL.change("t", ev.drop("a")) == ["ALTER TABLE `t` DROP COLUMN `a`"]


def test_dml_text():
    cols = [ColumnSpec("id", "bigint"), ColumnSpec("name"), ColumnSpec("at", "datetime")]
    assert MYSQL.insert("db.t", cols, 2) == "INSERT INTO `db`.`t` (`id`, `name`, `at`) VALUES (?, ?, ?), (?, ?, ?)"
    assert POSTGRES.upsert("t", cols, ["id"]).endswith('VALUES ($1::bigint, $2, $3::timestamp) ON CONFLICT ("id") DO UPDATE SET "name" = EXCLUDED."name", "at" = EXCLUDED."at"')
    assert POSTGRES.upsert("t", cols[:1], ["id"]).endswith("DO NOTHING")
    assert MYSQL.upsert("t", cols[:2], ["id"]).endswith("ON DUPLICATE KEY UPDATE `name` = VALUES(`name`)")
    assert POSTGRES.delete("t", cols[:1]) == 'DELETE FROM "t" WHERE "id" = $1::bigint'


def test_types_in():
    assert MYSQL.type_of("TINYINT", 1) == "boolean" and MYSQL.type_of("tinyint") == "tinyint"
    assert MYSQL.type_of("bigint unsigned") == "bigint" and MYSQL.type_of("decimal", 80, 40) == "decimal(65,30)"
    assert POSTGRES.type_of("_int4") == "array<int>" and POSTGRES.type_of("money") == "decimal(30,2)" and POSTGRES.type_of("what") == "string"
    assert type_name("Decimal(10, 2)") == "decimal(10,2)" and type_name("odd") == "string" and spark_type("decimal(60,2)") == "string" and spark_type("ubigint") == "decimal(20,0)"


def test_apply_changes():
    t = TableSpec("db.t", (ColumnSpec("id", "bigint", False, True), ColumnSpec("name")))
    t = ev.apply_changes(t, [ev.add(ColumnSpec("score", "float"), 0), ev.rename("name", "full_name"), ev.modify(ColumnSpec("score", "double"))])
    assert t.names == ["id", "full_name", "score"] and t.column("score").type == "double"
    assert ev.apply_change(t, ev.rename("id", "key")).primary_key == ["key"]
    with pytest.raises(ev.CannotDropPrimaryKey):
        ev.apply_change(t, ev.drop("id"))
    with pytest.raises(ev.ColumnMissing):
        ev.apply_change(t, ev.drop("nope"))
    with pytest.raises(ev.ColumnExists):
        ev.apply_change(t, ev.add(ColumnSpec("score")))


def test_diff_and_positions():
    a, b = [ColumnSpec("id", "bigint"), ColumnSpec("x")], [ColumnSpec("id", "bigint"), ColumnSpec("y")]
    assert ev.diff(a, b) == [ev.rename("x", "y")]
    assert ev.diff(a, a) == []
    got = ev.diff(a, [ColumnSpec("id", "int"), ColumnSpec("y")])
    assert [c.action for c in got] == ["add", "drop", "modify"] and got[0].position == 1
    assert ev.positional(got[1]).name == "f1" and ev.positional(ev.rename("a", "b", 2)).to == "f2"
    assert ev.watched(got, exclude=["y"]) == got[1:]
    w = ev.SchemaWatcher()
    assert w.look("t", a) is None and w.look("t", b) == [ev.rename("x", "y")] and w.look("t", b) == []


def test_parse_alter():
    p = ev.parse_alter
    assert p("DROP TABLE x") is None and p("ALTER TABLE t ADD INDEX i (a), ENGINE=InnoDB") == []
    got = p("alter table `db`.`t` ADD COLUMN (a INT, b DECIMAL(10,2) NOT NULL), DROP c")
    assert [(c.action, c.column.name if c.column else c.name) for c in got] == [("add", "a"), ("add", "b"), ("drop", "c")]
    assert got[1].column.type == "decimal(10,2)" and not got[1].column.nullable
    assert [c.action for c in p("ALTER TABLE t CHANGE a a BIGINT")] == ["rename", "modify"]
    assert p("ALTER TABLE t RENAME COLUMN a TO b;") == [ev.rename("a", "b")]
    assert p("ALTER TABLE t MODIFY a VARCHAR(20) DEFAULT 'x,y' COMMENT 'c'")[0].column.default == "x,y"
    assert ev.altered_table("ALTER TABLE `db`.`t` DROP a") == "t" and ev.altered_table("select 1") is None


def test_names_and_flat_configs():
    assert camel_case("l_class_student") == "lClassStudent"
    assert flatten_config({"a": {"b": 1, "c": [1, "x"]}, "d": [{"e": 1}], "f": True, "g": None}) == {"a.b": "1", "a.c": "1,x", "d": '[{"e":1}]', "f": "true", "g": ""}


def test_zones():
    from changeflow.functions.scalars import zone

    assert zone("utc") == "UTC" and zone("+8") == "+08:00" and zone("-0530") == "-05:30" and zone("Asia/Shanghai") == "Asia/Shanghai"
    assert zone("no/where") == zone("") and zone(None)[0] in "+-"
