r"""Quality rules: counts over whole texts, then line sequence labelling with a linear-chain CRF.

A text's lines with a word are a sequence; a conditional random field with two labels, content and boilerplate, scores
line features and transitions, Viterbi decoding marks the lines, and the share of words in content lines decides.

The field is fitted here, on a bounded sample of labelled documents: at most `most` of either quality, of each a run of at
most `run` neighbouring lines. Nobody labelled lines, so their labels are hidden: a line's evidence is its document's
quality, or, if the line recurs in other documents of the sample that are no copies, that it is boilerplate; evidence is
wrong with a stated probability (NOISE). First the features' weights climb the likelihood of the evidence line by line, so
that a clean line in a bad document, or a license line in a good one, may take its own label (a chain would rather explain
a document's evidence by never changing). The probabilities this gives are the targets of the field: its features and
transitions are trained on them by forward-backward. Runs of good and bad documents are also joined pairwise, which
shows the chain where labels change.

Counting is linear in the text and happens where the row is read: no shuffle. Defined results: a null text has no words
and fails the base rules; repeated rows are judged alike; without labelled rows of both kinds the fixed rules alone
decide; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import countOf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from changeflow.llm.common import WORD, arrow_batches

MIN_WORDS = 50
#: The bound of the fit: so many labelled documents of each quality, those with the least hashes of their ids.
FIT_DOCS = 300
#: And so many neighbouring lines of each, from a place that a hash of the id tells.
FIT_RUN = 256
#: How often evidence is wrong: that a line of a good document is content, that one of a bad document is boilerplate, that one
#: which recurs is boilerplate.
NOISE = {"good": 0.05, "bad": 0.3, "recurs": 0.1}
#: In how many documents of the sample a line must be to recur.
RECURS = 3
SHARE = 0.5
SYMBOLS = "#*$%&|<>"
FEATURES = (
    "bias", "symbols", "symbols_many", "capitals", "capitals_many", "marks", "marks_many", "digits", "short", "long", "mean_word", "long_word",
    "unlike_words", "repeated_windows", "duplicate", "ends", "comma", "lower_start", "few_letters", "title_words", "first", "last", "shorter",
)
_words = re.compile(WORD).findall
_symbol = re.compile("[#*$%&|<>]").findall


@dataclass
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > 50 * self.n_words


def repeat_words(words: list[str]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 3:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    again = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    return int((np.append(again, [False, False]) | np.append(np.append(False, again), False) | np.append([False, False], again)).sum())


def count(text: str) -> tuple[Counts, list[str], list[list[str]], list[bool]]:
    """The counts, the lines with a word, their words, and whether each equals an earlier one."""
    lines, split, again, seen = [], [], [], set()
    for line in text.split("\n"):
        if own := _words(line):
            again.append(line in seen)
            seen.add(line)
            lines.append(line)
            split.append(own)
    words = [w for own in split for w in own]
    return Counts(len(words), sum(map(len, words)), len(_symbol(text)), sum(again), repeat_words(words)), lines, split, again


def features(lines: list[str], split: list[list[str]], again: list[bool]) -> np.ndarray:
    out = np.zeros((len(lines), len(FEATURES)))
    usual = float(np.median([len(w) for w in split])) if split else 0.0
    for k, (line, words) in enumerate(zip(lines, split, strict=True)):
        n, chars = len(words), sum(map(len, words))
        symbols, marks = len(_symbol(line)), line.count("!") + line.count("?")
        letters = sum(map(str.isalpha, line))
        capitals = sum(map(str.isupper, line)) / max(letters, 1)
        digits = sum(map(str.isdigit, line))
        distinct = len(set(words)) / n
        windows = repeat_words(words) / n
        out[k] = (
            1, min(symbols / n, 1), symbols > 0.3 * n, capitals, capitals > 0.5, min(marks / n, 1), marks > 0.3 * n, digits / chars, n < 4, n > 40, min(chars / n / 10, 3),
            max(map(len, words)) > 40, distinct, windows, again[k], line.rstrip()[-1:] in (".", "!", "?", ":", ";"), countOf(line, ",") / n, line.lstrip()[:1].islower(), letters < 0.5 * chars,
            sum(w[0].isupper() for w in words) / n, k == 0, k == len(lines) - 1, 4 * n < usual,
        )
    return out


@dataclass
class Field:
    """weights: scores of content over boilerplate by feature; turns[a, b]: score of label b after a (1: content)."""

    weights: np.ndarray
    turns: np.ndarray

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the most probable labelling, True for content. Ties go to content."""
        score = np.stack([np.zeros(len(x)), x @ self.weights], 1)
        best, back = score[0], np.zeros((len(x), 2), int)
        for k in range(1, len(x)):
            via = best[:, None] + self.turns
            back[k] = np.where(via[1] >= via[0], 1, 0)
            best = via.max(0) + score[k]
        at = int(best[1] >= best[0])
        out = np.zeros(len(x), bool)
        for k in range(len(x) - 1, -1, -1):
            out[k] = at
            at = back[k, at]
        return out


def _marginals(score: np.ndarray, turns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of content by line, and expected numbers of transitions by sequence, by forward-backward.

    score: (sequence, line, label), of which the first `sizes` lines count; all sequences take a step at a time."""
    many, most = score.shape[:2]
    ahead, behind = np.zeros((many, most, 2)), np.zeros((many, most, 2))
    ahead[:, 0] = score[:, 0]
    for k in range(1, most):
        ahead[:, k] = np.logaddexp.reduce(ahead[:, k - 1, :, None] + turns, 1) + score[:, k]
    for k in range(most - 2, -1, -1):
        step = np.logaddexp.reduce(turns + (score[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
        behind[:, k] = np.where((k + 1 < sizes)[:, None], step, 0.0)
    total = np.logaddexp.reduce(ahead[np.arange(many), sizes - 1], 1)
    pairs = ahead[:, :-1, :, None] + turns + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
    pairs = np.where((np.arange(1, most) < sizes[:, None])[:, :, None, None], np.exp(np.minimum(pairs, 0)), 0.0)
    p = np.where(np.arange(most) < sizes[:, None], np.exp(np.minimum(ahead + behind - total[:, None, None], 0))[:, :, 1], 0.0)
    return p, pairs.sum(1)


def train(samples: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """samples: of each sequence its features, its lines' evidence (probability that the evidence is seen if the line is
    content, over that and if it is boilerplate) and its weight. Gradient ascent (Adam), first of features on the evidence's
    likelihood, line by line; then of the whole field on the probabilities of lines that this gives."""
    theta = np.zeros(len(FEATURES) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    # Sequences of like length are stacked, so that padding stays small.
    order = sorted(samples, key=lambda s: len(s[0]))
    stacks = []
    for some in (order[k : k + 64] for k in range(0, len(order), 64)):
        sizes = np.array([len(x) for x, _, _ in some])
        x, e = np.zeros((len(some), sizes[-1], len(FEATURES))), np.zeros((len(some), sizes[-1], 2))
        for row, (features_of, evidence, _) in enumerate(some):
            x[row, : sizes[row]], e[row, : sizes[row], 1], e[row, : sizes[row], 0] = features_of, np.log(evidence), np.log1p(-evidence)
        stacks.append((x, e, sizes, np.array([w for _, _, w in some]) / sizes))
    none = np.zeros((2, 2))
    targets = None
    for t in range(1, 2 * rounds + 1):
        g = -decay * theta
        if t == rounds + 1:
            # What lines are, as far as their own features and the evidence tell.
            targets = [_marginals(np.stack([np.zeros(x.shape[:2]), x @ theta[:-4]], 2) + e, none, sizes)[0] for x, e, sizes, _ in stacks]
            m, v = np.zeros_like(theta), np.zeros_like(theta)
        turns = theta[-4:].reshape(2, 2) if targets else none
        for k, (x, e, sizes, w) in enumerate(stacks):
            score = np.stack([np.zeros(x.shape[:2]), x @ theta[:-4]], 2)
            free, free_pairs = _marginals(score, turns, sizes)
            told = targets[k] if targets else _marginals(score + e, turns, sizes)[0]
            g[:-4] += np.einsum("sl,slf->f", (told - free) * w[:, None], x)
            if targets:
                y = np.stack([1 - told, told], 2) * (np.arange(x.shape[1]) < sizes[:, None])[:, :, None]
                g[-4:] += np.einsum("sab,s->ab", np.einsum("sla,slb->sab", y[:, :-1], y[:, 1:]) - free_pairs, w).ravel()
        u = (t - 1) % rounds + 1
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**u)) / (np.sqrt(v / (1 - 0.99**u)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def _evidence(runs: list[tuple[bool, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each run (quality, hashes of its lines, their words) the evidence of its lines."""
    found = Counter(h for _, hashes, _ in runs for h in set(hashes.tolist()))
    out = []
    for good, hashes, words in runs:
        again = np.array([found[h] >= RECURS for h in hashes.tolist()], bool)
        if words[again].sum() > 0.5 * words.sum():
            again[:] = False  # a copy of a whole document
        out.append(np.where(again, NOISE["recurs"], 1 - NOISE["good"] if good else NOISE["bad"]))
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", most: int = FIT_DOCS, run: int = FIT_RUN) -> Field | None:
    """A field from at most `most` labelled documents of either quality, `run` lines of each; None if one quality has none."""
    arrow_batches(docs.sparkSession)
    labelled = labels.filter(F.col(quality).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(quality).alias("_q"), F.min(quality).alias("_low")).filter("_q = _low")
    # So many ids of either quality, those with the least hashes: small enough to broadcast, whatever the tables' size.
    few = [labelled.filter(F.col("_q") == q).orderBy(F.xxhash64("_key"), "_key").limit(most) for q in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))
    texts = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    picked = texts.join(chosen, F.col("_doc") == F.col("_key")).select(F.col("_doc").cast("string"), F.col("_q").cast("int"), "_text")
    # A key's repeated rows are one labelled row: the one with the least hash of its text.
    once = picked.groupBy("_doc", "_q").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    got = once.mapInArrow(_line_rows(run), "key string, quality int, x binary, lines binary, words binary").collect()
    got = sorted(got, key=lambda r: r["key"])
    runs = [(bool(r["quality"]), np.frombuffer(r["lines"], "<i8"), np.frombuffer(r["words"], "<i8")) for r in got]
    x = [np.frombuffer(r["x"], "<f8").reshape(-1, len(FEATURES)) for r in got]
    told = _evidence(runs)
    good, bad = ([k for k, (q, _, _) in enumerate(runs) if q == y] for y in (True, False))
    if not good or not bad:
        return None
    samples = [(x[k], told[k], 1 / len(own) / 3) for own in (good, bad) for k in own]
    pairs = max(len(good), len(bad))
    for j in range(pairs):
        a, b = good[j % len(good)], bad[j % len(bad)]
        a, b = (a, b) if j % 2 else (b, a)
        samples.append((np.concatenate([x[a], x[b]]), np.concatenate([told[a], told[b]]), 1 / pairs / 3))
    return train(samples)


def _line_rows(run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = {"key": pa.string(), "quality": pa.int32(), "x": pa.binary(), "lines": pa.binary(), "words": pa.binary()}
        for batch in batches:
            out = []
            for key, quality, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                _, lines, split, again = count(text)
                if lines:
                    begin = xxhash.xxh3_64_intdigest(key) % max(len(lines) - run + 1, 1)
                    part = slice(begin, begin + run)
                    hashes = [xxhash.xxh3_64_intdigest(line.strip().encode("utf-8", "surrogatepass")) for line in lines[part]]
                    words = np.array([len(w) for w in split[part]], "<i8")
                    out.append((key, quality, features(lines, split, again)[part].tobytes(), np.array(hashes, "<u8").tobytes(), words.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), names.values(), strict=True)], list(names))

    return rows


def judge(docs: DataFrame, field: Field | None, text: str = "text", share: float = SHARE) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept."""
    arrow_batches(docs.sparkSession)
    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"

    @pandas_udf(kinds)
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            c, lines, split, again = count(t or "")
            content = 1.0
            if field is not None and not c.failed:
                words = np.array([len(x) for x in split])
                content = float(words[field.labels(features(lines, split, again))].sum() / c.n_words)
            rows.append((c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.failed, content, not c.failed and content >= share))
        return pd.DataFrame(rows, columns=[k.split()[0] for k in kinds.split(", ")])

    got = docs.withColumn("_judged", judged(F.col(text)))
    return got.withColumns({k.split()[0]: F.col(f"_judged.{k.split()[0]}") for k in kinds.split(", ")}).drop("_judged")
