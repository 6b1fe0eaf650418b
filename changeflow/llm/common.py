"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java's, Python's and DuckDB's syntax alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows handed to Python at a time: texts may be very long.
ARROW_ROWS = "512"

_PREFIX_CHUNK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Keep the batches that Python workers get small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of this process's own if the session is local; a cluster
    must name one that driver and executors share."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = getattr(shared_folder, "own", None)
    if folder is None:
        folder = shared_folder.own = f"file://{tempfile.mkdtemp(prefix='changeflow-')}"
        atexit.register(_forget, folder)
    return folder


def _forget(folder: str) -> None:
    import shutil

    shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


_made: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved within go at its end: what is made of them must have been written elsewhere by then."""
    begin = len(_made)
    try:
        yield
    finally:
        for path in _made[begin:]:
            drop(spark, path)
        del _made[begin:]


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/changeflow/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a lambda's argument is never computed again, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(numbers: Column) -> Column:
    """Exclusive running sums of an array of bigint. Chunks bound the copying that appending to an array costs."""
    none = F.array().cast("array<bigint>")

    def chunk_sums(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(
            chunk,
            F.struct(acc["t"].alias("t"), none.alias("a")),
            lambda x, v: F.struct((x["t"] + v).alias("t"), F.concat(x["a"], F.array(x["t"])).alias("a")),
        )
        return let(inner, lambda r: F.struct(r["t"].alias("t"), F.concat(acc["a"], F.array(r["a"])).alias("a")))

    def sums(ns: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(ns) - 1) / _PREFIX_CHUNK).cast("int"))
        chunks = F.transform(starts, lambda c: F.slice(ns, c * _PREFIX_CHUNK + 1, F.lit(_PREFIX_CHUNK)))
        start = F.struct(F.lit(0).cast("bigint").alias("t"), F.array().cast("array<array<bigint>>").alias("a"))
        return F.flatten(F.aggregate(chunks, start, chunk_sums)["a"])

    return let(numbers, lambda ns: F.when(F.size(ns) == 0, none).otherwise(sums(ns)))


#: What match_spans returns.
SPANS = "array<struct<s:bigint,e:bigint,m:string>>"


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """All leftmost, non-overlapping matches that keep() accepts: code points s to e (exclusive) and the match m."""
    none = F.array().cast(SPANS)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        parts = F.zip_with(gaps, found, lambda p, m: F.struct(F.length(p).alias("g"), F.length(m).alias("l"), m.alias("m")))

        def spans(ps: Column) -> Column:
            before = prefix_sums(F.transform(ps, lambda x: (x["g"] + x["l"]).cast("bigint")))
            return F.zip_with(ps, before, lambda x, o: F.struct((o + x["g"]).alias("s"), (o + x["g"] + x["l"]).alias("e"), x["m"].alias("m")))

        return let(parts, spans)

    return let(hits, lambda found: F.when(F.size(found) == 0, none).otherwise(F.filter(located(found), lambda x: keep(x["m"]))))


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans as structs that sort by start, then by the order of their kinds."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))


def listed(spans: Column) -> Column:
    """kind:start:end of tagged spans, sorted, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")
