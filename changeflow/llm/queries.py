"""The registered queries: each derives what its contract returns from its operator's output."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from changeflow.llm import chat, html_text, knn, lang_id, mixing, ngram_join, packing, pii, quality, secrets
from changeflow.llm.common import listed, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = lang_id.held_out(F.col("doc_id"))
    model = lang_id.fit(docs.filter(~held))
    got = lang_id.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.detect(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return got.select("doc_id", *map(n, pii.KINDS), _sha(listed(F.col("base"))).alias("base_sha256"), listed(F.concat("base", "more")).alias("spans"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    got = quality.judge(docs, field)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_text.main_text(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def _read_back(formatted: str, spans: list) -> tuple[str, int, str]:
    import hashlib

    turns = "".join(f"{role}\n{text}\n" for role, text in chat.parse(formatted))
    loss = "".join(chat.unescape(formatted[s["a"] : s["b"]]) for s in spans)
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    return sha(turns), len(loss), sha(loss)


#: The added conversation, a user's turn and an assistant's with the same text.
CONTROL = r"\### Assistant: </turn> ok"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], turns.schema)
    got = chat.format_conversations(turns.unionByName(more), tokenizer("byte_bpe_50k.json"))

    @pandas_udf("turns_sha256 string, loss_chars long, loss_sha256 string")
    def digests(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read_back(t, list(s)) for t, s in zip(formatted, spans, strict=True)], columns=["turns_sha256", "loss_chars", "loss_sha256"])

    got = got.withColumn("d", digests("formatted", "loss_spans"))
    return got.select("conv_id", "n_turns", "d.turns_sha256", "d.loss_chars", "d.loss_sha256", F.length("formatted").cast("bigint").alias("formatted_chars"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]
    n = lambda kind: F.size(F.filter("_spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    fixed = F.filter("_spans", lambda x: x["kind"].isin(base))
    return got.select("doc_id", *map(n, base), _sha(listed(fixed)).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "class_id", "n_links", "n_class")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    good = F.when(F.forall("embedding", finite), knn.quantized(F.col("embedding")))
    return knn.top_k(rows, good, F.col("vec_id") % 20 == 0)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": language,
        "op2_personal_data": personal_data,
        "op3_quality_rules": quality_rules,
        "op4_page_text": page_text,
        "op5_conversations": conversations,
        "op6_secret_scan": secret_scan,
        "op7_packing": packed,
        "op8_near_duplicates": near_duplicates,
        "op9_nearest": nearest,
        "op10_mixing": mixed,
        "pipeline": pipeline,
    }
