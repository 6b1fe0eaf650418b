"""The corpus pipeline: documents go through five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm import mixing, ngram_join, packing, quality, secrets
from changeflow.llm.common import drop, save, scratch, shared_folder, table
from changeflow.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL can't express the stages' models.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the line field reject go."""
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select(*COLUMNS), field).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the least id."""
    return ngram_join.deduplicate(docs.select(*COLUMNS)).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are blotted out, private keys with their bodies; n_chars follows."""
    clean = secrets.redact(secrets.scan(docs.select(*COLUMNS), rules=secrets.WHOLE_RULES))
    n_chars = F.when(F.size("_spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row occurs as often as the mix takes it, whatever its id."""
    # Numbers of rows only hold once they are written: ids may repeat or be null.
    rows = save(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("mix_row")), "mix-rows")
    taken = mixing.mix(rows, carry=("mix_row",)).filter("copies > 0").select("mix_row", "copies").hint("shuffle_hash")
    return rows.join(taken, "mix_row").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    got = packing.pack(docs, tokenizer("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/changeflow/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):  # what a stage keeps for itself, and its input, go as soon as its rows are written
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
