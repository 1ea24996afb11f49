"""A quality classifier from weak labels: labeller accuracies by EM, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

GOOD, BAD = 1, 2
LABELLERS = ("symbols", "bangs", "capitals", "stutter", "lines", "variety", "word_length", "plain_words", "marks")
#: A bound on the texts that the scorer is fitted on, about; a seeded hash of the text picks them.
FIT_ROWS = 20_000
#: Buckets of the hashed features, before the bias.
FEATURES = 1 << 12
_SYMBOLS = "#*$%&|<>"
#: Bytes that are no marks: letters, digits, white space, and parts of characters beyond ASCII.
_NO_MARKS = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b).isspace())


def _rates(text: str) -> tuple[list[str], float, float]:
    """The words, the share that repeat the word before, and the share of lines that repeat an earlier one."""
    words = text.split()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return words, sum(map(eq, words, words[1:])) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines))


def pattern(text: str | None) -> int:
    """The labellers' votes on a text as base-3 digits (0 abstains, 1 good, 2 bad); -1 for a text without words."""
    words, stutter, dup_lines = _rates(text or "")
    n = len(words)
    if not n:
        return -1
    capitals = sum(len(w) > 1 for w in filter(str.isupper, words)) / n
    symbols, bangs, variety = sum(map(text.count, _SYMBOLS)) / n, text.count("!") / n, len(set(words)) / n
    chars = sum(map(len, words)) / n
    bare = text.replace(".", "").replace(",", "").split()
    plain = sum(map(str.isalpha, bare)) / max(1, len(bare))
    marks = len(text.encode("utf-8", "replace").translate(None, _NO_MARKS)) / (chars * n)
    votes = (
        BAD if symbols > 0.3 else GOOD if symbols < 0.05 else 0,
        BAD if bangs > 0.5 else GOOD if bangs < 0.1 else 0,
        BAD if capitals > 0.6 else GOOD if capitals < 0.2 else 0,
        BAD if stutter > 0.3 else GOOD if stutter < 0.05 else 0,
        BAD if dup_lines > 0.4 else GOOD if dup_lines == 0 else 0,
        0 if n < 50 else BAD if variety < 0.25 else GOOD if variety > 0.4 else 0,
        BAD if chars < 2 or chars > 20 else GOOD if 3 <= chars <= 12 else 0,
        BAD if plain < 0.6 else GOOD if plain > 0.9 else 0,
        BAD if marks > 0.15 else 0 if n < 50 else BAD if marks > 0.07 else GOOD if marks < 0.05 else 0,
    )
    return sum(v * 3**k for k, v in enumerate(votes))


def estimate(patterns: dict[int, int], rounds: int = 80) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of ``bad`` for each vote pattern, and the labellers' rates ``[class][labeller][vote]``.

    Expectation-maximisation over the pattern counts (3 ** labellers at most,
    whatever the rows). Bad texts are bad in different ways, which different
    labellers see, so the bad class is itself a mixture: a component for each
    labeller, started from the patterns where that labeller and another call the
    text bad. Within a component votes are independent, and an abstention says
    nothing. A labeller that no other bears out gets no component to itself, and
    so counts as mistaken.
    """
    n_lab = len(LABELLERS)
    if not patterns:
        return {}, np.zeros((2, n_lab, 3))
    keys = np.array(sorted(patterns))
    n = np.array([patterns[k] for k in keys], float)
    vote = np.stack([keys // 3**k % 3 for k in range(n_lab)], axis=1)
    called = (vote == BAD).astype(float)
    calls = called.sum(axis=1, keepdims=True)
    bad = np.where(calls >= 2, 0.9, 0.02)
    share = np.concatenate((1 - bad, bad * np.where(calls > 0, called / np.maximum(calls, 1), 1 / n_lab)), axis=1)
    onehot = (vote[:, :, None] == np.arange(3)).astype(float)
    for _ in range(rounds):
        weight = share * n[:, None]
        rates = np.einsum("pc,plv->clv", weight, onehot[:, :, GOOD:]) + 0.05
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=0) + 0.01) / (n.sum() + 0.01 * (n_lab + 1))
        logs = np.einsum("plv,clv->pc", onehot[:, :, GOOD:], np.log(rates)) + np.log(prior)
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
    bad = share[:, 1:].sum(axis=1)
    both = np.einsum("cp,plv->clv", np.stack([(1 - bad) * n, bad * n]), onehot) + 1e-9
    return dict(zip(keys.tolist(), bad.tolist(), strict=True)), both / both.sum(axis=2, keepdims=True)


def _class_table() -> np.ndarray:
    table = np.full(256, 7, np.uint64)
    table[ord("a") : ord("z") + 1] = 1
    table[128:] = 1  # parts of letters beyond ASCII, nearly always
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[[ord(c) for c in ".,;:'\"()-?"]] = 4
    table[ord("!")] = 5
    table[[ord(c) for c in _SYMBOLS]] = 6
    return table


_CLASSES = _class_table()


def _bucket(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(52)).astype(np.int64)  # 12 bits: FEATURES


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's hashed features; the values' squares sum to 1.

    Features are runs of four character classes, and grades of stutter and of
    repeated lines. A value is the root of the feature's share.
    """
    data = text.encode("utf-8", "replace")
    c = _CLASSES[np.frombuffer(data, np.uint8)]
    if len(c) > 1:
        c = c[np.concatenate(([True], (c[1:] != c[:-1]) | (c[1:] > 3)))]  # a run of letters, digits or spaces is one
    c = np.concatenate((np.zeros(2, np.uint64), c, np.zeros(2, np.uint64)))
    grams = c[:-3] + c[1:-2] * np.uint64(8) + c[2:-1] * np.uint64(64) + c[3:] * np.uint64(512)
    some, n = np.unique(_bucket(grams), return_counts=True)
    _, stutter, lines = _rates(text)
    share = np.array([max(1e-6, 1 - stutter), stutter, max(1e-6, 1 - lines), lines])
    flags = _bucket(np.arange(1 << 20, (1 << 20) + 4, dtype=np.uint64))
    return np.concatenate((some, flags)), np.sqrt(np.concatenate((n / (3 * n.sum()), share / 3)))


class Scorer:
    """A linear model over hashed features.

    A short text says little: below ``full_words`` words its log-odds are drawn
    towards ``prior``, those of the rows that the model was trained on.
    """

    def __init__(self, weights: np.ndarray, bias: float, prior: float = 0.0, full_words: int = 20):
        self.weights, self.bias, self.prior, self.full_words = weights, bias, prior, full_words

    def score(self, text: str | None) -> float:
        """The probability of being good; 0 for a text without words."""
        if not text or text.isspace():
            return 0.0
        at, value = features(text)
        odds = self.bias + (self.weights[at] * value).sum()
        trust = min(1.0, len(text.split(None, self.full_words)) / self.full_words)  # splits no further than it needs to
        return float(1 / (1 + np.exp(-np.clip(self.prior + trust * (odds - self.prior), -50, 50))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, steps: int = 600, decay: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient steps."""
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    w, b = np.zeros(FEATURES), 0.0
    pw, pb = w, b
    for k in range(steps):
        m = k / (k + 3)
        yw, yb = w + m * (w - pw), b + m * (b - pb)
        off = 1 / (1 + np.exp(-np.clip(yb + np.bincount(owner, yw[at] * value, len(rows)), -50, 50))) - good
        pw, pb = w, b
        w = yw - 2.0 * (np.bincount(at, off[owner] * value, FEATURES) / len(rows) + decay * yw)
        b = yb - 2.0 * off.mean()
    mean = min(max(float(good.mean()), 0.01), 0.99)
    return Scorer(w, b, float(np.log(mean / (1 - mean))))


def fit_sample(texts: DataFrame, rows: int, fit_rows: int, seed: int) -> DataFrame:
    """About ``fit_rows`` different texts at most, of a column ``text`` with so many different ``rows``; all of them where that is more."""
    limit = int(min(1.0, fit_rows / rows) * (1 << 30))
    some = texts if limit == 1 << 30 else texts.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) < limit)
    return some.distinct()


def fit(docs: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS, seed: int = 5) -> Scorer | None:
    """Estimate the labellers on all rows, then train the scorer on their posteriors.

    All rows are reduced to counts of vote patterns. The scorer's rows are a
    sample of about ``fit_rows`` different texts, picked by a seeded hash of the
    text so that it does not depend on partitions. Copies of a text count once, in
    the sample and in its rate, so they neither swell nor shrink it. No rows with
    words give no scorer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pattern(t) for t in batch.column(0).to_pylist()], pa.int32()), batch.column(1)], names=["pattern", "hash"])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [(pattern(t), *features(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))], names=["pattern", "at", "value"])

    texts = docs.select(F.col(text).alias("text")).where("text is not null")
    each = texts.select("text", F.xxhash64("text")).mapInArrow(run, "pattern int, hash long").where("pattern >= 0")
    each = each.groupBy("pattern", "hash").agg(F.count("*").alias("n"))
    counts = each.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()
    patterns, different = {r["pattern"]: r["n"] for r in counts}, sum(r["different"] for r in counts)
    if not different:
        return None
    posterior, _ = estimate(patterns)
    picked = fit_sample(texts, different, fit_rows, seed)
    got = [r for r in picked.mapInArrow(described, "pattern int, at array<long>, value array<double>").toArrow().to_pylist() if r["pattern"] >= 0]
    if not got:
        return None
    got.sort(key=lambda r: (r["pattern"], r["at"], r["value"]))  # sums of doubles depend on the order
    return train([(np.array(r["at"]), np.array(r["value"])) for r in got], np.array([1 - posterior[r["pattern"]] for r in got]))


def scored(docs: DataFrame, model: Scorer | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, and ``score``, the probability of being good.

    Null, empty and blank texts score 0, as does everything without a model.
    Repeated rows score alike.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    if model is None:
        return rows.withColumn("score", F.lit(0.0))
    held, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(0).flatten()[where]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held.value.score(t) for t in texts.to_pylist()], pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
