"""Tables in Parquet that changes are applied to: save modes, versions, last-write-wins. Any Hadoop file system."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.model import TableSpec, align, data_columns
from changeflow.operators.changelog import JDBC, Policy, apply_changelog

#: What to do about a table that is or isn't there, and about rows that are.
SCHEMA_MODES = ("RECREATE_SCHEMA", "CREATE_SCHEMA_WHEN_NOT_EXIST", "ERROR_WHEN_SCHEMA_NOT_EXIST", "IGNORE")
DATA_MODES = ("DROP_DATA", "APPEND_DATA", "CUSTOM_PROCESSING", "ERROR_WHEN_DATA_EXISTS")
#: Buckets of keys that a table is cut into: a batch rewrites those that it touches. For large tables, thousands.
BUCKETS = 64
_BUCKET = "_bucket"


class VersionedTable:
    """Data folders, and manifests `m=<n>.json` that say which of them make up version n: by bucket of keys, or `+<k>` for
    rows that were only added. The greatest manifest is the table. It appears by a rename, so a writer that dies leaves no new
    version; it names the batches that the table has taken (the last ones), so a batch that comes again writes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(n[2:-5]) for n in names if n.startswith("m=") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        got = self.versions()
        if not got:
            return {"folders": {}, "batches": [], "buckets": None}
        stream = self._fs.open(self._at(f"m={got[-1] if version is None else version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self.versions())

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, only: list[str] | None = None) -> DataFrame | None:
        """The table, or its buckets in `only`; null where a folder was written before a column was added."""
        if not self.exists():
            return None
        m = self.manifest()
        return self._read([f for k, f in m["folders"].items() if only is None or k in only], m["schema"])

    def took(self, batch: str) -> bool:
        return batch in self.manifest()["batches"]

    def commit(self, folders: dict[str, str], schema: str, buckets: int | None, batch: str | None, remember: int = 1000) -> int:
        got = self.versions()
        n = got[-1] + 1 if got else 0
        known = self.manifest()["batches"] if got else []
        text = json.dumps({"folders": folders, "schema": schema, "buckets": buckets, "batches": [*known, *([batch] if batch else [])][-remember:]})
        self._fs.mkdirs(self._at(""))
        draft = self._at(f".m={n}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(draft, self._at(f"m={n}.json")):
            raise RuntimeError(f"version {n} of {self.path} was written by another job")
        return n

    def replace(self, df: DataFrame, batch: str | None = None) -> int:
        """df becomes the whole table."""
        got = self.versions()
        folder = f"d={got[-1] + 1 if got else 0}/all"
        df.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return self.commit({"+all": folder}, _ddl(df), None, batch)

    def apply(self, changes: DataFrame, keys: list[str], policy: Policy, batch: str | None = None, buckets: int = BUCKETS) -> int:
        """The table after the changes. With keys, only buckets that changes touch are read and written; without, rows are added."""
        got, m = self.versions(), self.manifest()
        n, folders, own = got[-1] + 1 if got else 0, dict(m["folders"]), data_columns(changes)
        # Columns that the table doesn't have yet are added to it; those that the changes lack are null in them.
        fields = {f.name: f.dataType for f in (self._read([], m["schema"]) if got else changes.select(*own)).schema}
        fields |= {f.name: f.dataType for f in changes.schema if f.name in own and f.name not in fields}
        schema = ", ".join(f"`{k}` {t.simpleString()}" for k, t in fields.items())
        changes = changes.withColumns({c: F.lit(None).cast(t) for c, t in fields.items() if c not in own})
        if not keys:
            apply_changelog(None, changes, keys, policy).select(*fields).write.mode("overwrite").parquet(f"{self.path}/d={n}/+{n}")
            return self.commit(folders | {f"+{n}": f"d={n}/+{n}"}, schema, m["buckets"], batch)
        count = m["buckets"] or buckets
        put = lambda df: df.withColumn(_BUCKET, _bucket(df, keys, count))
        loose = [f for k, f in folders.items() if k.startswith("+")]
        if loose:  # rows that no bucket holds: this once, all of it is dealt
            touched, base = [str(k) for k in range(count)], put(self._read(list(folders.values()), schema))
        else:
            touched = [str(r[0]) for r in changes.select(_bucket(changes, keys, count)).distinct().collect()]  # at most `count`
            base = put(self._read([folders[k] for k in touched if k in folders], schema))
        if not touched:
            return self.commit(folders, schema, count, batch)
        after = apply_changelog(base.drop(_BUCKET) if got else None, changes, keys, policy).select(*fields)
        put(after).repartition(min(len(touched), count), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/d={n}")
        kept = {k: f for k, f in folders.items() if not loose and k not in touched}
        written = {s.getPath().getName() for s in self._fs.listStatus(self._at(f"d={n}"))}
        return self.commit(kept | {k: f"d={n}/{_BUCKET}={k}" for k in touched if f"{_BUCKET}={k}" in written}, schema, count, batch)

    def drop(self) -> None:
        self._fs.delete(self._at(""), True)

    def keep(self, most: int = 3) -> None:
        """Manifests beyond the last `most` go, and the data folders that only they name."""
        got = self.versions()
        used = {f for n in got[-most:] for f in self.manifest(n)["folders"].values()}
        gone = {f for n in got[:-most] for f in self.manifest(n)["folders"].values()} - used
        for n in got[:-most]:
            self._fs.delete(self._at(f"m={n}.json"), False)
        for f in gone:
            self._fs.delete(self._at(f), True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _bucket(df: DataFrame, keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


class TableSink:
    """Applies batches of changes by a policy. run: whose batches these are; a batch of a run is taken once."""

    def __init__(self, table: VersionedTable, keys: list[str], policy: Policy = JDBC, spec: TableSpec | None = None, run: str = "", buckets: int = BUCKETS):
        self.table, self.keys, self.policy, self.spec, self.run, self.buckets = table, keys, policy, spec, run, buckets

    def open(self, schema_mode: str = "CREATE_SCHEMA_WHEN_NOT_EXIST", data_mode: str = "APPEND_DATA", custom=None) -> None:
        if schema_mode not in SCHEMA_MODES or data_mode not in DATA_MODES:
            raise ValueError(f"unknown save mode {schema_mode} / {data_mode}")
        there = self.table.exists()
        if schema_mode == "ERROR_WHEN_SCHEMA_NOT_EXIST" and not there:
            raise ValueError("the table does not exist")
        if schema_mode == "RECREATE_SCHEMA" or data_mode == "DROP_DATA":
            self.table.drop()
        elif data_mode == "ERROR_WHEN_DATA_EXISTS" and there and not self.table.read().isEmpty():
            raise ValueError("the table has rows")
        elif data_mode == "CUSTOM_PROCESSING" and custom and there:
            self.table.replace(custom(self.table.read()))

    def write(self, changes: DataFrame, batch: int) -> None:
        name = f"{self.run}#{batch}"
        if self.table.took(name):
            return
        if self.spec is not None:
            changes = align(changes, self.spec)
        self.table.apply(changes, self.keys, self.policy, name, self.buckets)
        self.table.keep()


def compact(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a replacing merge tree shows: the last row of each key by `_seq`."""
    from changeflow.operators.changelog import latest_by_key

    return latest_by_key(rows, keys).select(*data_columns(rows))
