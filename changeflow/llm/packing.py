"""Packing documents into token windows: bounded-space online best fit.

Each partition streams through its documents once. A document is its token ids and an end id. What exceeds whole windows
is a remainder, which goes to the open window that it fills best; if none of the `open_windows` has room and no more may
be opened, the fullest is emitted. The pieces of open windows are all that a task holds. At the end, the windows that are
still open are merged: their pieces are laid end to end, by groups of neighbouring partitions, and cut at window ends.

Ids are those of the tokenizer, but words are encoded once per worker: this tokenizer's words don't depend on what
stands around white space. Texts with characters for which that shortcut isn't plainly right are encoded whole.

Defined results: a null or empty text is just its end id; repeated rows are packed as often as they occur; an empty table
gives no rows; columns other than id and text are left out.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from changeflow.llm.common import arrow_batches, save

WINDOW = 4096
END = 2
OPEN = 64
#: Neighbouring partitions whose open windows are merged together, at most one of them not filled.
MERGED = 16

_SCHEMA = "closed boolean, part long, turn long, key long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Letters that are lower-cased one by one alike everywhere, that NFC leaves alone, and white space that all split at.
_PLAIN = re.compile("[\t\n\v\f\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]*").fullmatch
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What may stand behind a word's letters as one piece.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words and pieces kept in each of two generations.
_KEPT = 400_000
LONG = 64


class Recent(dict):
    """A dict that forgets what wasn't asked for lately: beyond `most` entries, the last generation but one goes. Keys longer
    than LONG aren't kept, so that its bytes are bounded too."""

    def __init__(self, most: int, learn):
        super().__init__()
        self.most, self.learn, self.old = most, learn, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONG:
            return self.learn(key)
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Token ids, as little-endian uint32 bytes, of whole texts."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces_of = regex.compile(_SPLIT).findall
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = {k: as_bytes(chr(k))[0][0] for k in range(0xA1, 0x250) if _PLAIN(chr(k))}
        self.merge = self.tokenizer.model.tokenize
        self.bytes_of = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.words = Recent(_KEPT, self._word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.translate(self.shown)
        return b"".join([self.bytes_of[t.id] for t in self.merge(shown)])

    def _word(self, word: str) -> bytes:
        """A word's pieces are words themselves, so both are kept in one place. Most words are letters, and marks behind them."""
        letters = word.rstrip(_MARKS)
        if letters.isalpha():
            return self._piece(word) if letters == word else self.words[letters] + self.words[word[len(letters) :]]
        pieces = self.pieces_of(word)
        return self._piece(word) if len(pieces) == 1 else b"".join(map(self.words.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        if _PLAIN(text) is None or "<|" in text:
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


@cache
def encoder_of(path: str) -> WordEncoder:
    """One for each Python worker, kept from task to task."""
    return WordEncoder(path)


class Windows:
    """Open windows with best fit; place() and close() yield the pieces of emitted windows."""

    def __init__(self, part: int, size: int, most: int):
        self.part, self.size, self.most, self.made = part, size, most, 0
        self.room: list[tuple[int, int]] = []  # (free, number), sorted
        self.held: dict[int, list[tuple]] = {}

    def _emit(self, number: int) -> Iterator[tuple]:
        at = 0
        for key, start, length, total, ids in self.held.pop(number):
            yield True, self.part, 0, key, start, length, total, (self.part << 32) | number, at, ids
            at += length

    def place(self, key: int | None, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        whole = total - total % self.size
        for start in range(0, whole, self.size):
            self.held[self.made] = [(key, start, self.size, total, ids[4 * start : 4 * (start + self.size)])]
            yield from self._emit(self.made)
            self.made += 1
        if total == whole:
            return
        n = total - whole
        at = bisect.bisect_left(self.room, (n, -1))
        if at < len(self.room):
            free, number = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                yield from self._emit(self.room.pop(0)[1])
            free, number = self.size, self.made
            self.held[number] = []
            self.made += 1
        self.held[number].append((key, whole, n, total, ids[4 * whole :]))
        if free == n:
            yield from self._emit(number)
        else:
            bisect.insort(self.room, (free - n, number))

    def close(self) -> Iterator[tuple]:
        turn = 0
        for number in sorted(self.held):
            for key, start, length, total, ids in self.held[number]:
                yield False, self.part, turn, key, start, length, total, None, None, ids
                turn += 1


def _packer(path: str, window: int, end: int, most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("closed", pa.bool_())] + [(c, pa.int64()) for c in ("part", "turn", "key", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())]
        )
        encode, tail = encoder_of(path).encode, np.array([end], "<u4").tobytes()
        windows = Windows(TaskContext.get().partitionId(), window, most)
        rows: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, text in zip(keys, texts, strict=True):
                rows.extend(windows.place(key, encode(text or "") + tail))
                if len(rows) >= 512:
                    yield flushed()
        rows.extend(windows.close())
        if rows:
            yield flushed()

    return pack


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, open_windows: int = OPEN) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    tokenizer: the path of word_bpe_49k.json on every executor."""
    arrow_batches(docs.sparkSession)
    pieces = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(_packer(tokenizer, window, end, open_windows), _SCHEMA)
    pieces = save(pieces, "pieces", compression="zstd")
    out = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    group = F.floor(F.col("part") / MERGED)
    before = Window.partitionBy(group).orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)
    left = pieces.filter("not closed").withColumn("at", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # A piece is shorter than a window, so at most one window's end cuts it.
    head = F.least(F.col("length"), window - F.col("at") % window)

    def part(begin, n):
        at = F.col("at") + begin
        return F.struct(
            (F.col("start") + begin).alias("start"),
            n.alias("length"),
            F.substring("ids", (begin * 4 + 1).cast("int"), (n * 4).cast("int")).alias("ids"),
            (F.lit(1 << 62) + F.shiftleft(group.cast("bigint"), 32) + F.floor(at / window)).alias("sequence_id"),
            (at % window).alias("offset"),
        )

    cut = left.select("key", "doc_tokens", F.explode(F.filter(F.array(part(F.lit(0).cast("bigint"), head), part(head, F.col("length") - head)), lambda x: x["length"] > 0)).alias("x"))
    merged = cut.select("key", "x.start", "x.length", "x.ids", "doc_tokens", "x.sequence_id", "x.offset")
    return pieces.filter("closed").select(*out).unionByName(merged.select(*out)).withColumnRenamed("key", key)
