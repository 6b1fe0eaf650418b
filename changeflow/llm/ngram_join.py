r"""N-gram Jaccard self-join with Bayesian pruning: near-duplicate classes of documents.

A document is its set of shingles (hashes of five consecutive words; a text of one to four words is one shingle). Two
documents are linked if their sets' Jaccard similarity is 0.8 or more; classes are the connected components of links.

1. One pass over the texts yields a hash of the set, its size and a MinHash signature. Equal sets are one representative.
2. Signatures are cut into bands; representatives that share a band's values (a bucket) are candidates. 40 bands of 6 miss a
   pair at similarity 0.8 with a probability under 1e-5, the closer ones with less. A bucket is known by its least member,
   its head, and all buckets with one head make up a group: a representative is in a group for each of its distinct heads,
   near copies mostly in the same few. Nothing is closed transitively, so unlike documents don't chain into one group.
3. Groups are dealt to tasks, small ones many at a time, large ones as pairs of blocks of bounded size. A pair is looked at
   in the group with the least head that both have, and nowhere else. A task takes pairs through their MinHash values, 40 at
   a time, and drops a pair as soon as the posterior probability that its similarity reaches the threshold falls below the
   tolerance (1e-8, under a uniform prior). Those that are left are verified exactly on the shingle sets. Only sums per
   document and a spanning forest leave the task, never pairs.
4. The forests' roots, contracted (each document hands its roots to the least of them), are a small graph whose components
   are the classes; no document with very many links is a key of a join.

Work within a group of m distinct near copies is of order m * m (each pair's link is counted), its rows are of order
m * blocks. Defined results: a null or empty text is a class of its own with no links; repeated rows with one text link
to each other; an empty table gives no rows; a class's id is the least id in it; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm.common import arrow_batches, save

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-8
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
#: MinHash values compared between two looks at the posterior.
LOOK = 40
#: Documents and characters of text in a block, about.
BLOCK, BLOCK_CHARS = 2048, 4_000_000
#: Rows of a side that is still broadcast.
FEW = 100_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at white space as words have it
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - WORDS + 1, 1)
    out = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = _mix(out * _BASE + h[k : k + n])
    return np.unique(out)


@cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of the least value under each of HASHES permutations of the shingles' upper halves."""
    a, b = _factors()
    least = np.empty(HASHES, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    step = max(1, 100_000 // max(len(x), 1))
    for k in range(0, HASHES, step):
        least[k : k + step] = (x[None] * a[k : k + step, None] + b[k : k + step, None]).min(1)
    return _mix(least.astype(np.uint64)).astype("<u2")


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        texts = batch.column(4).to_pylist()
        sets, sizes, signs = [], [], []
        for t in texts:
            s = shingles(t or "")
            sizes.append(len(s))
            sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            signs.append(signature(s).tobytes() if len(s) else None)
        made = [pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], ["row", "key", "hash", "chars", "set", "size", "sig"])


@cache
def _least_agreements() -> dict[int, int]:
    """By the number of values compared: how many must agree for the pair to stay."""
    grid = (np.arange(4000) + 0.5) / 4000
    out = {}
    for n in range(LOOK, HASHES + 1, LOOK):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= THRESHOLD].sum() / p.sum() >= TOLERANCE:
                out[n] = m
                break
    return out


def linked_pairs(
    sigs_a: np.ndarray, sets_a: list[np.ndarray], sigs_b: np.ndarray, sets_b: list[np.ndarray], same: bool, met_a: np.ndarray | None = None, met_b: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """For each document of a, the documents of b linked to it (if same, those after it only). met: which other groups, by
    column, each document is in; pairs that share one are left to it."""
    bounds = _least_agreements()
    sizes_a, sizes_b = (np.array([len(s) for s in x], np.float64) for x in (sets_a, sets_b))
    everything = np.concatenate([*sets_a, *([] if same else sets_b)])
    values, seen = np.unique(everything, return_counts=True)
    shared = values[seen > 1]  # what only one document has is in no intersection

    def bits(sets: list[np.ndarray]) -> np.ndarray:
        """Which of the shared values each set has, 64 to a word."""
        out = []
        for k in range(0, len(sets), 128):
            some = np.zeros((len(sets[k : k + 128]), -(-max(len(shared), 1) // 64) * 64), bool)
            for row, s in zip(some, sets[k : k + 128], strict=True):
                at = np.searchsorted(shared, s)
                at = at[at < len(shared)]
                row[at[shared[at] == s[: len(at)]]] = True
            out.append(np.packbits(some, 1))
        return np.concatenate(out).view(np.uint64)

    bits_a = bits(sets_a)
    bits_b = bits_a if same else bits(sets_b)
    for i in range(len(sets_a)):
        left = np.arange(i + 1, len(sets_b)) if same else np.arange(len(sets_b))
        # Sizes alone bound the similarity.
        low, high = np.minimum(sizes_a[i], sizes_b[left]), np.maximum(sizes_a[i], sizes_b[left])
        left = left[low >= THRESHOLD * high - 1e-9]
        if met_a is not None and met_a[i].any():
            left = left[~(met_b[left] & met_a[i]).any(1)]
        agree = np.zeros(len(left), np.int64)
        for n in range(0, HASHES, LOOK):
            if not len(left):
                break
            agree += (sigs_b[left, n : n + LOOK] == sigs_a[i, n : n + LOOK]).sum(1)
            stay = agree >= bounds[n + LOOK]
            left, agree = left[stay], agree[stay]
        if not len(left):
            continue
        common = np.bitwise_count(bits_b[left] & bits_a[i]).sum(1, dtype=np.int64)
        total = sizes_a[i] + sizes_b[left] - common
        ok = common >= THRESHOLD * total - 1e-9
        if ok.any():
            yield i, left[ok]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _others(heads: list, head: int) -> np.ndarray | None:
    """By document, which of the groups with lesser heads it is in."""
    lesser = [[h for h in own if h < head] for own in heads]
    columns = {h: k for k, h in enumerate(sorted({h for own in lesser for h in own}))}
    if not columns:
        return None
    met = np.zeros((len(heads), len(columns)), bool)
    for row, own in zip(met, lesser, strict=True):
        row[[columns[h] for h in own]] = True
    return np.packbits(met, 1)


def _verify(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one task: of many whole groups, or of one pair of blocks (side tells which; pair, that there are two)."""
    out, known = [], {}
    rows = rows.drop_duplicates(["head", "row"]).sort_values(["head", "row"], kind="stable")
    for head, own in rows.groupby("head", sort=False):
        for r, t in zip(own["row"], own["text"], strict=True):
            if r not in known:
                known[r] = shingles(t)
        sets = [known[r] for r in own["row"]]
        sigs = np.frombuffer(b"".join(own["sig"]), "<u2").reshape(len(own), HASHES)
        row, copies, side = own["row"].to_numpy(), own["copies"].to_numpy(), own["side"].to_numpy()
        links, forest, met = np.zeros(len(own), np.int64), Forest(len(own)), _others(list(own["heads"]), head)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if own["pair"].iloc[0] and not (len(a) and len(b)):
            continue  # a block of the pair is empty
        same = not len(b)
        if same:
            b = a
        mets = (None, None) if met is None else (met[a], met[b])
        for i, js in linked_pairs(sigs[a], [sets[k] for k in a], sigs[b], [sets[k] for k in b], same, *mets):
            k, others = a[i], b[js]
            links[k] += copies[others].sum()
            links[others] += copies[k]
            for o in others:
                forest.join(int(k), int(o))
        roots = [forest.root(k) for k in range(len(own))]
        out.append(pd.DataFrame({"row": row, "links": links, "root": row[roots]}))
    return pd.concat(out) if out else pd.DataFrame({"row": [], "links": [], "root": []}).astype("int64")


def components(edges: DataFrame, name: str, rounds: int = 50) -> DataFrame:
    """(node, comp) of edges (a, b); comp is the least node. Alternating large-star and small-star, joins on minima only."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(rounds):
        twice = both(now)
        least = twice.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = twice.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        after = save(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        # Done when every edge leads to a root and each node has one edge: stars.
        state = after.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
        if state[0] is None:
            break
        deep = after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi").limit(1).count()
        now = after
        if state[0] == 1 and not deep:
            break
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    stars = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast if it is small; a join by shuffle otherwise. df is written, so counting it reads no more than that."""
    return F.broadcast(df) if df.count() <= FEW else df


def groups(alone: DataFrame) -> DataFrame:
    """(row, head): the groups of alone (row, sig), all of two rows or more; heads are members too."""
    bands = alone.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring("sig", k * 2 * ROWS + 1, F.lit(2 * ROWS)))).alias("band", "value"))
    banded = bands.select("row", F.xxhash64("band", "value").alias("bucket"))
    heads = banded.groupBy("bucket").agg(F.min("row").alias("head"), F.count("*").alias("n")).filter("n > 1").select("bucket", "head")
    # Written, so that both sides of the join are dealt anew and a very large bucket can be split.
    return save(banded.join(save(heads, "heads"), "bucket").select("row", "head").distinct(), "groups")


def _classes(found: DataFrame) -> DataFrame:
    """(row, class) of the forests (row, root): rows hand their roots to the least, whose graph is small."""
    least = save(found.groupBy("row").agg(F.min("root").alias("least"), F.collect_set("root").alias("roots")), "least-roots")
    edges = least.filter(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    merged = save(components(edges, "classes").filter("node <> comp"), "merged-roots")
    return least.select("row", "least").join(_few(merged), F.col("least") == F.col("node"), "left").select("row", F.coalesce("comp", "least").alias("comp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, class_id (least key of its class), n_links (rows linked to it), n_class."""
    spark = docs.sparkSession
    arrow_batches(spark)
    content = F.col(text)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("key"), F.xxhash64(content).alias("hash"), F.length(content).cast("bigint").alias("chars"), content.alias("text")
    )
    signed = save(rows.mapInArrow(_signer, "row long, key long, hash long, chars long, set binary, size long, sig binary"), "signatures")
    sets = signed.filter("size > 0").groupBy("set").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    reps = save(sets, "sets")
    # Written once: signatures are most of what moves beside the texts.
    alone = save(signed.join(reps.select(F.col("rep").alias("row"), "copies"), "row").select("row", "key", "hash", "chars", "sig", "copies"), "representatives")
    member = groups(alone)
    # What each task gets is settled on numbers alone; texts move afterwards.
    sizes = member.join(alone.select("row", "chars"), "row").groupBy("head").agg(F.count("*").alias("m"), F.sum("chars").alias("all"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all") / BLOCK_CHARS)).cast("int"))
    sizes = save(sizes, "group-sizes")
    total = sizes.filter("blocks <= 1").agg(F.sum("all")).first()[0] or 0
    bins = max(1, -(-total // (BLOCK_CHARS // 4)))
    large = sizes.filter("blocks > 1").select("head", "blocks")
    dealt = member.join(_few(save(large, "large-groups")), "head", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    whole = F.array(F.struct(F.concat(F.lit("w"), F.pmod(F.xxhash64("head"), F.lit(bins)).cast("string")).alias("task"), "head", F.lit(0).alias("side"), F.lit(False).alias("pair")))
    parts = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.concat_ws("/", F.col("head"), F.least("own", other), F.greatest("own", other)).alias("task"), "head", F.when(F.col("own") > other, 1).otherwise(0).alias("side"), (F.col("own") != other).alias("pair")),
    )
    tasks = dealt.withColumn("own", own).select("row", "head", F.when(F.col("blocks") == 1, whole).otherwise(parts).alias("tasks"))
    tasks = tasks.groupBy("row").agg(F.collect_list("head").alias("heads"), F.flatten(F.collect_list("tasks")).alias("tasks"))
    # Texts of candidates only, found by key and hash (twice if a row is repeated: tasks drop one of them).
    wanted = alone.select("row", "key", "hash", "sig", "copies").join(tasks, "row").withColumnsRenamed({"key": "_key", "hash": "_hash"})
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(content).alias("hash"), content.alias("text"))
    texts = texts.join(wanted.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_hash")))
    texts = texts.select("row", "copies", "sig", "text", "heads", F.explode("tasks").alias("t")).select("t.task", "t.head", "t.side", "t.pair", "row", "copies", "sig", "text", "heads")
    found = save(texts.groupBy("task").applyInPandas(_verify, "row long, links long, root long"), "links")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    classes = _classes(found).withColumnRenamed("row", "node")
    kept = reps.join(links.withColumnRenamed("row", "rep"), "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    kept = kept.select("set", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("class"))
    judged = signed.select("row", "key", "hash", "set").join(kept, "set", "left")
    judged = save(judged.select("row", "key", "hash", F.coalesce("class", "row").alias("class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "judged")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    # Written, so that the join deals both sides anew and a class of very many members can be split.
    ids = save(judged.groupBy("class").agg(first.alias("first"), F.count("*").alias("n_class")), "class-ids")
    out = judged.join(ids, "class")
    stays = F.col("row") == F.col("first.row")
    return out.select(F.col("key").alias(key), F.col("first.key").alias("class_id"), "n_links", "n_class", stays.alias("stays"), "hash")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each class, that with the least key. Columns `_key`, `_hash` and `_n` go."""
    docs = docs.drop("_key", "_hash", "_n")
    kept = save(near_duplicates(docs, key, text), "deduplicated")
    same = ["_key", "_hash"]
    times = kept.groupBy(F.col(key).alias("_key"), F.col("hash").alias("_hash")).agg(F.count("*").alias("_n"), F.max("stays").alias("_stays")).filter("_stays").drop("_stays")
    met = docs.join(times.hint("shuffle_hash"), F.col(key).cast("bigint").eqNullSafe(F.col("_key")) & (F.xxhash64(F.col(text)) == F.col("_hash")))
    # Of rows repeated with one key and one text, that with the least hash of all its columns stays.
    again = met.filter("_n > 1").groupBy(*same).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_one")).select("_one.*")
    return met.filter("_n = 1").select(*docs.columns).unionByName(again)
