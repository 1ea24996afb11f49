"""Language identification: mixtures of n-gram models fitted per document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

UNKNOWN = "und"
#: A model of more languages (128 KB each) is refused.
MOST_LANGUAGES = 2_048


def _letters(low: str) -> np.ndarray:
    """Code points of a lower-cased text, all but letters as spaces."""
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), dtype="<u4")
    if (codes >= 128).any():
        some, at = np.unique(codes, return_inverse=True)
        keep = np.array([chr(c).isalpha() for c in some])[at]
    else:
        keep = (codes >= 97) & (codes <= 122)
    return np.where(keep, codes, 32).astype(np.uint64)


def hashed_ngrams(text: str, bits: int, n: int = 3, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """Buckets of the text's character n-grams, letters lower-cased and each run of others one space.

    They come in blocks, so a very long text needs little more memory than its
    own; each takes over the end of the one before, so the counts of all blocks
    together are those of the whole text. A space is put at both ends.
    """
    low = text.lower()  # of the whole text: some letters depend on those beside them
    held, last = np.array([32], np.uint64), 0
    for at in range(0, max(1, len(low)), block):
        codes = _letters(low[at : at + block])
        if len(codes):
            before = np.concatenate(([last], codes[:-1]))
            last = codes[-1]
            codes = codes[(codes != 32) | (before != 32)]
        end = [32] if at + block >= len(low) else []
        codes = np.concatenate((held, codes, end)).astype(np.uint64)
        h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        yield (h >> np.uint64(64 - bits)).astype(np.int64)
        held = codes[max(0, len(codes) - n + 1) :]


def ngram_counts(docs: DataFrame, bits: int = 15, lang: str = "lang", text: str = "text", block: int = 1 << 20) -> DataFrame:
    """Counts of hashed n-grams by language over all rows: ``(lang, bucket, n)``.

    Each task adds up dense counts of at most 64 languages, ``2 ** bits`` each,
    before it sends one row for each count above zero, so what is shuffled doesn't
    grow with a task's texts, nor its memory with the languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for name, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in slices(batches):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in sums and len(sums) == 64:
                    yield from sent()
                into = sums.setdefault(name, np.zeros(1 << bits, np.int64))
                for part in hashed_ngrams(t, bits, block=block):
                    into += np.bincount(part, minlength=1 << bits)
        yield from sent()

    picked = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t")).where("lang is not null and t is not null")
    return picked.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixtures:
    """n-gram models of some languages, and the inference of a text's mixture."""

    def __init__(self, names: list[str], counts: np.ndarray, bits: int, penalty: float = 0.5, rounds: int = 12, smooth: float = 0.5):
        self.names, self.bits, self.penalty, self.rounds = names, bits, penalty, rounds
        rates = counts + smooth
        self.model = np.log(rates / rates.sum(axis=1, keepdims=True)).T.astype(np.float32)  # bucket x language

    def infer(self, text: str | None, block: int = 1 << 20) -> tuple[str, float, dict[str, float]]:
        """The main language, its share, and the shares of the chosen set.

        Expectation-maximisation finds the shares that maximise the likelihood
        of the text's n-grams. The set then loses its weakest language for as
        long as the likelihood of the rest, less the penalty (``penalty`` times
        the log of the n-gram count for each language), does not fall.
        """
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, {}
        if len(text) <= block:
            some, n = np.unique(next(hashed_ngrams(text, self.bits)), return_counts=True)
        else:
            dense = sum(np.bincount(part, minlength=1 << self.bits) for part in hashed_ngrams(text, self.bits, block=block))
            some = np.flatnonzero(dense)
            n = dense[some]
        logs = self.model[some]
        top = logs.max(axis=1, keepdims=True)
        like, n, base = np.exp(logs - top), n.astype(np.float32), float((n * top[:, 0]).sum())
        total, cost = n.sum(), self.penalty * math.log(max(2.0, float(n.sum())))

        def fit(active: list[int], share: np.ndarray) -> tuple[np.ndarray, float]:
            p = like[:, active]
            if len(active) > 1:
                for _ in range(self.rounds):
                    share = share * (p.T @ (n / np.maximum(p @ share, 1e-30))) / total
            else:
                share = np.ones(1, np.float32)
            return share, base + float((n * np.log(np.maximum(p @ share, 1e-30))).sum())

        active = list(range(len(self.names)))
        share, value = fit(active, np.full(len(active), 1 / len(active), np.float32))
        best = value - cost * len(active)
        while len(active) > 1:
            weak = int(np.argmin(share))
            rest = active[:weak] + active[weak + 1 :]
            start = np.delete(share, weak)
            less, value = fit(rest, start / max(start.sum(), 1e-30))
            if value - cost * len(rest) < best:
                break
            active, share, best = rest, less, value - cost * len(rest)
        k = int(np.argmax(share))
        return self.names[active[k]], float(min(1.0, max(0.0, share[k]))), {self.names[a]: float(s) for a, s in zip(active, share, strict=True)}


def learn(docs: DataFrame, bits: int = 15, lang: str = "lang", text: str = "text") -> Mixtures:
    """Fit on every row with a text and a language.

    The model is ``2 ** bits`` counts for each language, whatever the number of
    the others, so that no prediction depends on it. It comes to the driver a
    language at a time; more than ``MOST_LANGUAGES`` raise an error.
    """
    rows = written(ngram_counts(docs, bits, lang, text), "ngrams")
    names = [r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names.sort()
    at = {name: k for k, name in enumerate(names)}
    counts = np.zeros((len(names), 1 << bits))
    for r in rows.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).toLocalIterator():
        counts[at[r["lang"]], r["b"]] = r["n"]
    return Mixtures(names, counts, bits)


def identify(docs: DataFrame, model: Mixtures, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``mixture`` (language to share) for each row.

    Null texts and texts without a letter give ``und`` with score 0 and an empty
    mixture. The score is the main language's share. Repeated rows get like rows.
    """
    keep = ["doc_id"] if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches):
            got = [m.infer(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([list(g[2].items()) for g in got], pa.map_(pa.string(), pa.float64()))],
                names=[*keep, "lang_pred", "score", "mixture"],
            )

    picked = docs.select(*keep, F.col(text).alias("__text"))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))]
    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:-1], *added]))


def held_out(id: str | Column = "doc_id") -> Column:
    """Rows never learned from: the id's CRC-32, as text, leaves 2 when divided by 4 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
