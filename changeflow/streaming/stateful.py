"""Stateful operators on streams: pairing of update images, matching of prewrites and commits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from changeflow.model import AFTER, BEFORE, DELETE, data_columns

#: How long a before image waits for its after image.
WINDOW_MS = 100


def pair_stream(changes: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """`_origin`, `_seq`, `event`, `data`, `old` (JSON texts): one slot of state per table, as in the batch encoder.

    A before image that a second one follows, or whose window ends, becomes a delete."""
    image = F.to_json(F.struct(*[F.col(f"`{c}`") for c in data_columns(changes)]), {"ignoreNullFields": "false"})
    rows = changes.select("_origin", "_seq", "_kind", image.alias("image"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((key[0], held[0], "delete", held[1], None))
            state.remove()
        else:
            for row in pd.concat(list(frames)).sort_values("_seq").itertuples(index=False):
                if row[2] == BEFORE:
                    if held:
                        out.append((key[0], held[0], "delete", held[1], None))
                    held = (int(row[1]), row[3])
                elif row[2] == AFTER:
                    out.append((key[0], int(row[1]), "update", row[3], held[1] if held else None))
                    held = None
                else:
                    out.append((key[0], int(row[1]), "delete" if row[2] == DELETE else "insert", row[3], None))
            if held:
                state.update(held)
                state.setTimeoutDuration(window_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["_origin", "_seq", "event", "data", "old"])

    return rows.groupBy("_origin").applyInPandasWithState(
        step, "_origin string, _seq long, event string, data string, old string", "seq long, image string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def match_stream(prewrites: DataFrame, commits: DataFrame, rollbacks: DataFrame | None = None) -> DataFrame:
    """Prewrites with the commit_ts of their commits, by (handle, start_ts), in whatever order and however late they come; a
    rollback undoes its prewrite. What is held is the open transactions; the resolved timestamp is for the reader to apply."""
    body = [c for c in prewrites.columns if c not in ("handle", "start_ts")]
    none = F.lit(None)
    one = lambda df, kind, ts, text: df.select("handle", "start_ts", F.lit(kind).alias("kind"), ts.cast("long").alias("commit_ts"), text.cast("string").alias("body"))
    rows = one(prewrites, "prewrite", none, F.to_json(F.struct(*body))).unionByName(one(commits, "commit", F.col("commit_ts"), none))
    if rollbacks is not None:
        rows = rows.unionByName(one(rollbacks, "rollback", none, none))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, ts, undone = state.get if state.exists else (None, None, False)
        for frame in frames:
            for kind, commit_ts, own in zip(frame["kind"], frame["commit_ts"], frame["body"], strict=True):
                if kind == "prewrite":
                    text = own
                elif kind == "commit":
                    ts = int(commit_ts)
                else:
                    undone = True
        if text is not None and (undone or ts is not None):
            if state.exists:
                state.remove()
            yield pd.DataFrame({"handle": [] if undone else [key[0]], "start_ts": [] if undone else [key[1]], "commit_ts": [] if undone else [ts], "body": [] if undone else [text]})
        else:
            state.update((text, ts, undone))

    done = rows.groupBy("handle", "start_ts").applyInPandasWithState(
        step, "handle long, start_ts long, commit_ts long, body string", "body string, commit_ts long, undone boolean", "append", GroupStateTimeout.NoTimeout
    )
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prewrites.schema if f.name in body)
    return done.withColumn("_body", F.from_json("body", shape)).select("handle", "start_ts", "_body.*", "commit_ts")
