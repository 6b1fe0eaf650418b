"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to cells by their nearest pivot (a bounded sample) and, within a cell, to blocks of bounded size; a
stated set of query rows is dealt likewise. A pair of blocks is searched in one task: both get a cover tree (a node's
children cover its points within 1/1.3 of its radius), and pairs of nodes are expanded best bound first, where a node
pair's bound is the inner product of the centres plus what the covering radii allow. A pair goes when its bound is below
the worst kth score in the query node.

Two rounds: first each query block meets the blocks of its own cell, which fixes a kth score for each query; then only
block pairs whose bound, by centre and radius of the whole blocks, reaches the block's worst kth score are searched, and
only candidates that reach their query's kth score are returned. Nothing is approximate.

Defined results: vectors that are null or empty or hold null or non-finite components take no part; shorter vectors count
as padded with zeros; a row is not its own neighbour, but repeated rows are neighbours of each other; ties go to the
smaller id; an empty table gives no rows; other columns are not read. Scores are exact 64-bit integers: products are made in
floating point where none can reach 2**53, in integers beyond, and vectors whose scores might not fit 63 bits are an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm.common import arrow_batches, save

PIVOTS = 128
BLOCK = 8192
QUERIES = 2048
LEAF = 128
#: Scores of a leaf pair are made in tiles of this side.
TILE = 1024
SHRINK = 1.3
#: Less than any score.
NONE = np.iinfo(np.int64).min


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as bigint."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


class Node:
    """Points, their centre (one of them), covering radius and children."""

    __slots__ = ("points", "centre", "radius", "norm", "kids")

    def __init__(self, points: np.ndarray, centre: int, away: np.ndarray, x: np.ndarray):
        self.points, self.centre = points, x[centre]
        self.radius = float(away.max())
        self.norm = float(np.sqrt((self.centre**2).sum()))
        self.kids: list[Node] = []


def cover_tree(x: np.ndarray, leaf: int = LEAF, least: int = LEAF // 4) -> Node:
    """A node stays a leaf if its children would hold fewer than `least` points on average: where distances are all alike,
    smaller balls bound nothing, and a leaf's scores are one matrix product."""
    distance = lambda points, c: np.sqrt(((x[points] - x[c]) ** 2).sum(1))
    everyone = np.arange(len(x))
    root = Node(everyone, 0, distance(everyone, 0), x)
    todo = [(root, 0)]
    while todo:
        node, centre = todo.pop()
        if len(node.points) <= leaf or node.radius == 0:
            continue
        reach = node.radius / SHRINK
        left, c, kids = node.points, centre, []
        while len(left) and len(kids) * least <= len(node.points):
            away = distance(left, c)
            near = away <= reach
            kids.append((Node(left[near], c, away[near], x), c))
            left = left[~near]
            if len(left):
                c = left[int(away[~near].argmax())]
        if not len(left):
            node.kids = [k for k, _ in kids]
            todo += kids
    return root


class Best:
    """The k best (score, id) of each query, scores descending, then ids ascending."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.scores = np.full((queries, k), NONE)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def worst(self, points: np.ndarray) -> int:
        return int(np.maximum(self.scores[points, -1], self.least[points]).min())

    def offer(self, points: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """ids ascend. Only what reaches a query's kth score, so far or among these scores, is sorted in."""
        floor = np.maximum(self.scores[points, -1], self.least[points])
        if scores.shape[1] > 2 * self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, 1)[:, -self.k])
        good = (scores >= floor[:, None]) & (scores > NONE)
        count = good.sum(1)
        rows = np.flatnonzero(count)
        if not len(rows):
            return
        r, c = np.nonzero(good[rows])
        at = np.arange(len(r)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
        points, width = points[rows], int(count[rows].max())
        new_scores = np.full((len(rows), width), NONE)
        new_ids = np.full((len(rows), width), np.iinfo(np.int64).max)
        new_scores[r, at], new_ids[r, at] = scores[rows][r, c], ids[c]
        all_scores = np.concatenate([self.scores[points], new_scores], 1)
        all_ids = np.concatenate([self.ids[points], new_ids], 1)
        order = np.argsort(all_ids, 1, kind="stable")
        order = np.take_along_axis(order, np.argsort(~np.take_along_axis(all_scores, order, 1), 1, kind="stable"), 1)[:, : self.k]
        self.scores[points] = np.take_along_axis(all_scores, order, 1)
        self.ids[points] = np.take_along_axis(all_ids, order, 1)


def dual_search(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_rows: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> Best:
    """q, x: integer vectors; rows: identities, so that no row is offered to itself; least: scores that count."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if most >= 2**63:
        raise ValueError("inner products of these vectors may not fit 63 bits")
    exact = most < 2**53
    fq, fx = q.astype(np.float64), x.astype(np.float64)
    best = Best(len(q), k, least)
    a, b = cover_tree(fq), cover_tree(fx)

    def bound(m: Node, n: Node) -> float:
        top = float(m.centre @ n.centre) + m.radius * n.norm + n.radius * m.norm + m.radius * n.radius
        return top + 1e-9 * (1 + abs(top) + (m.norm + m.radius) * (n.norm + n.radius))

    heap, turn = [(-bound(a, b), 0, a, b)], 0
    while heap:
        top, _, m, n = heapq.heappop(heap)
        if -top < best.worst(m.points):
            continue
        if not m.kids and not n.kids:
            for k0 in range(0, len(m.points), TILE):
                some = m.points[k0 : k0 + TILE]
                for k1 in range(0, len(n.points), TILE):
                    them = n.points[k1 : k1 + TILE]
                    scores = (fq[some] @ fx[them].T).astype(np.int64) if exact else q[some] @ x[them].T
                    scores[q_rows[some][:, None] == x_rows[them][None]] = NONE
                    best.offer(some, scores, ids[them])
            continue
        # The wider node is split; both have bounds that only shrink.
        split_m = bool(m.kids) and (not n.kids or m.radius >= n.radius)
        for kid in m.kids if split_m else n.kids:
            pair = (kid, n) if split_m else (m, kid)
            if (up := bound(*pair)) >= best.worst(pair[0].points):
                turn += 1
                heapq.heappush(heap, (-up, turn, *pair))
    return best


def _dealer(pivots: np.ndarray, width: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, vectors, asks = (c.to_pylist() for c in batch.columns)
            if not rows:
                continue
            x = np.zeros((len(rows), width), np.int64)
            for k, v in enumerate(vectors):
                x[k, : len(v)] = v
            f = x.astype(np.float64)
            away = (f**2).sum(1)[:, None] - 2 * f @ pivots.T + (pivots**2).sum(1)[None]
            cell = away.argmin(1)
            far = np.sqrt(((f - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(ids), pa.array(asks), pa.array(cell.astype(np.int64)), pa.array(far), pa.array([v.tobytes() for v in x], pa.binary())],
                ["row", "id", "asks", "cell", "far", "v"],
            )

    return deal


def _searcher(k: int, width: int) -> Callable:
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_row": [], "query_id": [], "id": [], "score": []}
        if len(left) and len(right):
            q, x = (np.frombuffer(b"".join(v), np.int64).reshape(-1, width) for v in (left["q_v"], right["x_v"]))
            rows, ids, least = left["q_row"].to_numpy(), right["x_id"].to_numpy(), left["q_least"].to_numpy(np.int64)
            order = np.argsort(ids, kind="stable")
            got = dual_search(q, rows, x[order], right["x_row"].to_numpy()[order], ids[order], k, least)
            keep = got.scores > NONE
            which = np.nonzero(keep)[0]
            out = {"query_row": rows[which], "query_id": left["q_id"].to_numpy()[which], "id": got.ids[keep], "score": got.scores[keep]}
        return pd.DataFrame(out).astype("int64")

    return search


def top_k(rows: DataFrame, vector: Column, asks: Column, key: str = "vec_id", k: int = 20) -> DataFrame:
    """(query_id, rank, <key>, score) of the rows for which asks holds, against all rows; vector: array<bigint>."""
    spark = rows.sparkSession
    arrow_batches(spark)
    usable = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), vector.alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    usable = save(usable.filter((F.size("v") > 0) & ~F.exists("v", F.isnull)), "vectors")
    about = usable.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    width, n = about["width"] or 1, about["n"]
    sample = usable.orderBy(F.xxhash64("id"), "row").limit(int(max(1, min(PIVOTS, n // BLOCK)))).select("v").collect()
    pivots = np.zeros((max(len(sample), 1), width))
    for j, r in enumerate(sample):
        pivots[j, : len(r["v"])] = r["v"]
    dealt = save(usable.select("row", "id", "v", "asks").mapInArrow(_dealer(pivots, width), "row long, id long, asks boolean, cell long, far double, v binary"), "cells")
    count = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("m"))
    cells = count.select("cell", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("m") / QUERIES).alias("groups"))
    spread = lambda c: F.pmod(F.xxhash64("row"), F.greatest(c, F.lit(1)))
    placed = dealt.join(F.broadcast(cells), "cell")  # at most PIVOTS rows
    data = placed.withColumn("block", spread(F.col("blocks"))).drop("blocks", "groups", "asks")
    queries = placed.filter("asks").withColumn("group", spread(F.col("groups"))).drop("blocks", "groups", "asks")
    blocks = data.groupBy(F.col("cell").alias("dc"), "block").agg(F.max("far").alias("dr"))
    result = "query_row long, query_id long, id long, score long"

    def searched(q: DataFrame, pairs: DataFrame) -> DataFrame:
        """q: cell, group, row, id, v, least; pairs: cell, group, dc, block."""
        pairs = pairs.withColumn("pair", F.concat_ws("/", "cell", "group", "dc", "block"))
        left = q.join(pairs.select("cell", "group", "pair"), ["cell", "group"]).select(*[F.col(c).alias(f"q_{c}") for c in ("pair", "row", "id", "v", "least")])
        right = data.withColumnRenamed("cell", "dc").join(pairs.select("dc", "block", "pair"), ["dc", "block"]).select(*[F.col(c).alias(f"x_{c}") for c in ("pair", "row", "id", "v")])
        return left.groupBy("q_pair").cogroup(right.groupBy("x_pair")).applyInPandas(_searcher(k, width), result)

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    groups = queries.groupBy("cell", "group").agg(F.max("far").alias("qr"))
    own = groups.join(blocks.withColumnRenamed("dc", "cell"), "cell").select("cell", "group", F.col("cell").alias("dc"), "block")
    start = queries.withColumn("least", F.lit(int(NONE)).cast("bigint"))
    first = save(searched(start, own).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "first-round")
    worst = first.filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("least"))
    held = queries.join(worst, "row", "left").withColumn("least", F.coalesce("least", F.lit(int(NONE)).cast("bigint")))
    bars = held.groupBy("cell", "group").agg(F.max("far").alias("qr"), F.min("least").cast("double").alias("bar"))
    centres = spark.createDataFrame([(c, d, float(pivots[c] @ pivots[d]), float(np.linalg.norm(pivots[c])), float(np.linalg.norm(pivots[d]))) for c in range(len(pivots)) for d in range(len(pivots)) if c != d] or [(0, 0, 0.0, 0.0, 0.0)], "cell long, dc long, dot double, qn double, dn double").filter("cell <> dc")
    top = F.col("dot") + F.col("qr") * F.col("dn") + F.col("dr") * F.col("qn") + F.col("qr") * F.col("dr")
    others = bars.join(centres, "cell").join(blocks, "dc").filter(top * (1 + 1e-9) + 1e-6 >= F.col("bar")).select("cell", "group", "dc", "block")
    second = searched(held, others)
    ranked = first.drop("rank").unionByName(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
