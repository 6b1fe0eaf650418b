"""Language identification by prediction by partial matching (PPM).

For each language, context trees of bytes up to order 3 are counted over a bounded sample of labelled texts and frozen.
A context's code for a byte: seen symbols get count / (total + distinct), and the escape's share, distinct / (total +
distinct), goes to the symbols not seen there in proportion to their probability one order lower (exclusion); order -1 is
uniform. A text's score is the exact length of its code under each language; the shortest wins.

Because statistics are frozen, the code length of a byte is a function of the three bytes before it. It is tabulated once
for each context of the tree, for all languages side by side, and texts are scored by table look-ups in numpy. Every byte
of the sample is a symbol of its own; bytes that no language has there share one, of which 8 further bits tell them apart, in
all languages alike. The tables take 4 bytes for each context seen in the sample, symbol (128, or 256 if the sample has
more than 127 bytes) and language, in the driver and in each worker: tens of MB for a few languages. More than
MODEL_BYTES is an error that asks for a smaller sample.

Defined results: `und` with score 0 for a null text, one without letters, or if nothing was learned; a tie goes to the
first language by name; repeated rows and an empty table need nothing special; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from changeflow.llm.common import arrow_batches

UNKNOWN = "und"
#: The bound of the fit: so many texts of each language at most, those with the least hash of their id.
FIT_TEXTS = 400
ORDER = 3
MODEL_BYTES = 1 << 30


@dataclass
class Model:
    """langs; symbol of each byte; row of each context of three symbols; code length by (row, symbol), for each language."""

    langs: list[str]
    symbol: np.ndarray
    row: np.ndarray
    bits: np.ndarray
    width: int = 7


    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], np.int64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        # Three line ends before each text are the context of its first bytes.
        raw = np.frombuffer(b"\n\n\n" + b"\n\n\n".join(texts[k] for k in full), np.uint8)
        s = self.symbol[raw].astype(np.int32)
        context = (s[:-3] << 2 * self.width) | (s[1:-2] << self.width) | s[2:-1]
        index = (self.row[context].astype(np.int64) << self.width) + s[3:]
        starts = np.concatenate(([0], np.cumsum(sizes[full] + 3)[:-1]))
        ends = starts + sizes[full]
        edges = np.stack([starts, ends], 1).ravel()
        if edges[-1] == len(index):
            edges = edges[:-1]
        for k in range(len(self.langs)):
            out[full, k] = np.add.reduceat(self.bits[k].take(index), edges, dtype=np.float64)[::2]
        return out


def train(counts: dict[str, tuple[np.ndarray, np.ndarray]], symbol: np.ndarray, width: int = 7) -> Model:
    """counts: by language, (codes of four symbols of `width` bits; their counts). The last symbol is what no language has."""
    langs, symbols = sorted(counts), 1 << width
    grams = np.concatenate([g for g, _ in counts.values()])
    two, three = np.unique((grams >> width) & (symbols**2 - 1)), np.unique(grams >> width)
    size = len(langs) * (symbols + len(two) + len(three)) * symbols * 4
    if size > MODEL_BYTES:
        raise ValueError(f"the tables of {len(langs)} languages would take {size} bytes: fit fewer texts")
    tables = [_codes(*counts[lang], two, three, width) for lang in langs]
    # Rows: contexts of one symbol, then those of two and of three that were seen; others fall back to a shorter one.
    row = np.tile(np.arange(symbols, dtype=np.int32), symbols)
    row[two] = symbols + np.arange(len(two))
    row = np.tile(row, symbols)
    row[three] = symbols + len(two) + np.arange(len(three))
    bits = np.stack([-np.log2(t) for t in tables]).astype(np.float32)
    bits[:, :, symbols - 1] += 8
    return Model(langs, symbol, row, bits.reshape(len(langs), -1), width)


def _codes(grams: np.ndarray, n: np.ndarray, two: np.ndarray, three: np.ndarray, width: int) -> np.ndarray:
    """Probabilities by (context, symbol): all contexts of one symbol, then the given ones of two and of three."""
    symbols = 1 << width

    def counted(order: int) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(grams & ((1 << width * (order + 1)) - 1), return_inverse=True)
        return keys, np.bincount(back, n, len(keys))

    def refine(lower: np.ndarray, keys: np.ndarray, c: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """lower: probabilities one order below, a row for each context; rows: the contexts' codes, sorted."""
        seen = np.zeros(lower.shape)
        at = np.searchsorted(rows, keys >> width)
        ok = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == keys >> width)
        seen[at[ok], keys[ok] & (symbols - 1)] = c[ok]
        total, distinct = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
        rest = np.where(seen > 0, 0, lower)
        mass = rest.sum(1, keepdims=True)
        bottom = np.maximum(total + distinct, 1)
        escape = np.where(total > 0, distinct / bottom, 1.0)
        # With every symbol seen nothing is left to escape to.
        p = np.where(mass > 0, seen / bottom + escape * rest / np.maximum(mass, 1e-300), seen / np.maximum(total, 1))
        return p

    p = np.full((1, symbols), 1 / symbols)
    p = refine(p, *counted(0), np.zeros(1, np.int64))
    p1 = refine(np.repeat(p, symbols, 0), *counted(1), np.arange(symbols))
    p2 = refine(p1[two & (symbols - 1)], *counted(2), two)
    p3 = refine(p2[np.searchsorted(two, three & (symbols**2 - 1))], *counted(3), three)
    return np.concatenate([p1, p2, p3])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = FIT_TEXTS) -> Model | None:
    """A model of the languages in labelled, of `most` texts of each at most (whole texts, chosen by a hash of the key)."""
    arrow_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    # A hash thins each language to about twice as many, of which the least hashes are taken; most are already there if few.
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2 * most / n + 64 / n)))])
    thin = rows.filter(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", F.xxhash64("text"))
    picked = thin.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most).select("lang", "text")
    grams = picked.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = grams.toPandas()
    if not len(got):
        return None
    gram = got["gram"].to_numpy(np.int64)
    n = got["n"].to_numpy(np.int64)
    common = np.bincount(gram & 255, n, 256)
    there = np.flatnonzero(common)
    width = 7 if len(there) < 128 else 8
    symbol = np.full(256, (1 << width) - 1, np.uint8)
    symbol[there] = np.arange(len(there))
    code = np.zeros(len(gram), np.int64)
    for k in (24, 16, 8, 0):
        code = (code << width) | symbol[(gram >> k) & 255]
    counts = {}
    for name in sorted(sizes):
        mine = (got["lang"] == name).to_numpy()
        if mine.any():
            keys, back = np.unique(code[mine], return_inverse=True)
            counts[name] = keys, np.bincount(back, n[mine], len(keys))
    return train(counts, symbol, width)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            by.setdefault(lang, []).append(b"\n\n\n" + text.encode("utf-8", "surrogatepass"))
        for lang, texts in by.items():
            codes = []
            for t in texts:
                b = np.frombuffer(t, np.uint8).astype(np.int64)
                codes.append((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])
            grams, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the winner's posterior probability) and bits_per_byte."""
    spark = docs.sparkSession
    arrow_batches(spark)
    letters = F.rlike(F.col(text), F.lit(r"\p{L}"))
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    shared = spark.sparkContext.broadcast(model)  # its size: languages x contexts of the bounded sample
    scored = _scorer(shared)
    got = F.when(letters, scored(F.col(text)))
    return docs.withColumn("_ppm", got).withColumns(
        {"lang_pred": F.coalesce("_ppm.lang", F.lit(UNKNOWN)), "score": F.coalesce("_ppm.score", F.lit(0.0)), "bits_per_byte": F.col("_ppm.bits")}
    ).drop("_ppm")


def _scorer(shared):
    @pandas_udf("lang string, score double, bits double")
    def score(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        raw = [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in texts]
        bits = np.concatenate([model.lengths(raw[k : k + 32]) for k in range(0, len(raw), 32)]) if raw else np.zeros((0, len(model.langs)))
        best = bits.argmin(1)
        least = bits[np.arange(len(raw)), best]
        odds = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        sizes = np.maximum([len(t) for t in raw], 1)
        return pd.DataFrame({"lang": np.array(model.langs, object)[best], "score": 1 / odds, "bits": least / sizes})

    return score


def held_out(key: Column) -> Column:
    """Whether a document is kept from the fit: crc32 of its id as text, modulo 5, is 0; never for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


