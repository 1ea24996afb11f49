"""Collocated phrases by merged count-min sketches and an exact count of what survives them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_join, written

#: Cells of one row of the sketch: as many as ``CELL_BYTES`` of text each, at most ``MOST_CELLS`` (32 MB of half bytes).
MOST_CELLS, CELL_BYTES = 1 << 26, 8
#: Rows of the sketch.
DEPTH = 2
#: A cell stops counting here; thresholds above it are refused.
FULL = 15
#: Cells of one piece of a sketch, as tasks hand it on.
BLOCK = 1 << 16
#: Ranks within a language are first taken in so many parts.
PARTS = 32

_BREAK = b"\xff"  # in no UTF-8 text
_ID_BITS = 21
_ID = (1 << _ID_BITS) - 1
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))


class _Counts:
    """N-grams of one to three words, counted over many texts as words' numbers."""

    def __init__(self, most_words: int = 1 << 18, most_held: int = 1_000_000) -> None:
        self.most_words, self.most_held = most_words, most_held
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {_BREAK: 0}
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, texts: list[bytes]) -> Iterator[tuple]:
        """Count these texts; gives out what is held when that grows large."""
        words = _BREAK.join(texts).translate(_TABLE).replace(_BREAK, b" \xff ").split()
        for at in range(0, len(words), self.most_words):
            if len(self.number) > 2 * self.most_words:
                yield from self.flush()
            part, number = words[at : at + self.most_words + 2], self.number
            ids = np.fromiter((number.setdefault(w, len(number)) for w in part), np.int64, len(part))
            own = min(len(ids), self.most_words)
            a = ids[:own]
            b = np.append(ids[1:], 0)[:own]
            c = np.append(ids[2:], (0, 0))[:own]
            two = (a << _ID_BITS | b)[(a > 0) & (b > 0)]
            three = (a << 2 * _ID_BITS | b << _ID_BITS | c)[(a > 0) & (b > 0) & (c > 0)]
            keys, counts = np.unique(np.concatenate((a[a > 0], two, three)), return_counts=True)
            self.held.setdefault(lang, []).append((keys, counts))
            self.size += len(keys)
            if self.size > self.most_held:
                self._merge()
                if self.size > self.most_held // 2:
                    yield from self.flush()

    def _merge(self) -> None:
        self.size = 0
        for lang, got in self.held.items():
            keys, counts = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.held[lang] = [(keys[first], np.add.reduceat(counts, first))]
            self.size += len(first)

    def flush(self) -> Iterator[tuple]:
        """``(lang, keys, counts, words, hashes)`` of all that is held."""
        self.held = {lang: got for lang, got in self.held.items() if any(len(k) for k, _ in got)}
        if self.held:
            self._merge()
            words = list(self.number)
            value = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            value[0] = 0
            for lang, ((keys, counts),) in self.held.items():
                yield lang, keys, counts, words, _hashes(lang, keys, value)
        self.clear()


def _hashes(lang: str, keys: np.ndarray, value: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """One 64-bit hash for each n-gram, which depends on its language and words only."""
    out = np.full(len(keys), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(keys), block):
            h, k = out[at : at + block], keys[at : at + block]
            for shift in (2 * _ID_BITS, _ID_BITS, 0):
                h = (h + value[k >> shift & _ID]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            out[at : at + block] = h
    return out


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """Each hash's cell in a row of the sketch."""
    with np.errstate(over="ignore"):
        x = h * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)[row])
    return (x >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


def _counted(batches: Iterable[pa.RecordBatch], room: int = 1 << 20) -> Iterator[tuple]:
    """Counts over all rows ``(lang, text)`` of a task, in as few pieces as its memory allows."""
    counts = _Counts()
    texts: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = text.as_py()
            texts.setdefault(lang, []).append(t)
            size[lang] = size.get(lang, 0) + len(t)
            if size[lang] > room:
                yield from counts.add(lang, texts.pop(lang))
                del size[lang]
    for lang, held in texts.items():
        yield from counts.add(lang, held)
    yield from counts.flush()


def _packed(cells: np.ndarray) -> bytes:
    """Counters as half bytes."""
    return (cells[0::2] | cells[1::2] << 4).tobytes()


def _raise(held: np.ndarray, h: np.ndarray, counts: np.ndarray, row: int, width: int, block: int = 1 << 17) -> None:
    """Add ``counts`` to the counters of their hashes in a row that is held as half bytes."""
    for start in range(0, len(h), block):
        cells = _cells(h[start : start + block], row, width)
        order = np.argsort(cells)
        cells = cells[order]
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        cells, more = cells[first], np.add.reduceat(np.minimum(counts[start : start + block], FULL)[order], first)
        for shift in (0, 4):  # two counters of one byte are never raised at once
            mine = (cells & 1) << 2 == shift
            at = cells[mine] >> 1
            new = np.minimum((held[at] >> shift & 15) + more[mine], FULL).astype(np.uint8)
            held[at] = held[at] & (0xF0 >> shift) | new << shift


def _unpacked(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    out = np.empty(2 * len(x), np.uint8)
    out[0::2], out[1::2] = x & 15, x >> 4
    return out


def _filled(batches: Iterable[pa.RecordBatch], width: int) -> np.ndarray:
    """A task's own sketch: a row of ``width`` counters, as half bytes, for each of ``DEPTH``."""
    held = np.zeros((DEPTH, width // 2), np.uint8)
    for _, _, counts, _, h in _counted(batches):
        for row in range(DEPTH):
            _raise(held[row], h, counts, row, width)
    return held


def merged_sketch(rows: DataFrame, width: int) -> list[bytes]:
    """The count-min sketch of all n-grams of ``rows`` (``lang, text``), a packed row of ``width`` counters for each of ``DEPTH``.

    Each task fills a sketch of its own and hands it on in blocks; blocks of one
    place are added up as they stream by. Counters stay at ``FULL``, so the sum
    is never below the true count where that is less.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _filled(batches, width)
        block = min(width, BLOCK) // 2
        for row in range(DEPTH):
            for at in range(0, width // 2, block):
                if held[row, at : at + block].any():
                    yield pa.RecordBatch.from_pylist([{"place": row * (width // 2 // block) + at // block, "cells": held[row, at : at + block].tobytes()}])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = _unpacked(data.as_py())
                if p != place:
                    if place is not None:
                        yield pa.RecordBatch.from_pylist([{"place": place, "cells": _packed(total)}])
                    place, total = p, cells
                else:
                    total = np.minimum(total + cells, FULL)
        if place is not None:
            yield pa.RecordBatch.from_pylist([{"place": place, "cells": _packed(total)}])

    kind = "place long, cells binary"
    blocks = rows.mapInArrow(fill, kind).repartition("place").sortWithinPartitions("place").mapInArrow(add, kind)
    block = min(width, BLOCK)
    got = {r["place"]: bytes(r["cells"]) for r in written(blocks, "sketch").toLocalIterator()}  # DEPTH * width / 2 bytes
    return [b"".join(got.get(row * (width // block) + k, bytes(block // 2)) for k in range(width // block)) for row in range(DEPTH)]


def phrase_counts(rows: DataFrame, least: int) -> DataFrame:
    """``(lang, phrase, words, f)`` of all n-grams of one to three words met ``least`` times or more, and of no words: all word occurrences.

    ``rows`` has ``lang`` (string) and ``text`` (binary). Only n-grams that the
    sketch puts at ``least`` or more, as it does their words and word pairs, are
    counted exactly; the sketch never estimates too low, so that none is lost.
    """
    if least > FULL:
        raise ValueError(f"counters end at {FULL}")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST_CELLS, 1 << max(12, math.ceil(math.log2(max(1, size / CELL_BYTES)))))
    sketch = rows.sparkSession.sparkContext.broadcast(merged_sketch(rows, width))

    def often(h: np.ndarray, block: int = 1 << 17) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for row in range(DEPTH):
            held = np.frombuffer(sketch.value[row], np.uint8)
            for at in range(0, len(h), block):
                cells = _cells(h[at : at + block], row, width)
                ok[at : at + block] &= (held[cells >> 1] >> (4 * (cells & 1)).astype(np.uint8) & 15) >= least
        return ok

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, keys, counts, words, h in _counted(batches):
            total = int(counts[keys <= _ID].sum())
            ok = often(h)
            frequent = np.zeros(len(words), bool)
            frequent[0] = True  # where there is no word
            frequent[keys[ok & (keys <= _ID)]] = True
            for shift in (0, _ID_BITS, 2 * _ID_BITS):
                ok &= frequent[keys >> shift & _ID]
            pairs = keys[ok & (keys > _ID) & (keys >> 2 * _ID_BITS == 0)]  # rising, as keys do
            three = np.flatnonzero(ok & (keys >> 2 * _ID_BITS > 0))
            for part in (keys[three] >> _ID_BITS, keys[three] & ((1 << 2 * _ID_BITS) - 1)):
                at = np.minimum(np.searchsorted(pairs, part), max(0, len(pairs) - 1))
                ok[three] &= pairs[at] == part if len(pairs) else False
            keys, counts = keys[ok], counts[ok]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([0], pa.int32()), pa.array([total], pa.int64())], names=names)
            for at in range(0, len(keys), 10_000):
                k = keys[at : at + 10_000]
                a, b, c = (k >> 2 * _ID_BITS).tolist(), (k >> _ID_BITS & _ID).tolist(), (k & _ID).tolist()
                text = [(words[x] + b" " + words[y] + b" " + words[z] if x else words[y] + b" " + words[z] if y else words[z]).decode() for x, y, z in zip(a, b, c, strict=True)]
                n = 1 + (k > _ID).astype(np.int32) + (k >> 2 * _ID_BITS > 0)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(text), pa.array(n, pa.int32()), pa.array(counts[at : at + 10_000], pa.int64())], names=names)

    names = ["lang", "phrase", "words", "f"]
    found = rows.mapInArrow(survivors, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(f"f >= {least} or words = 0")


def scored(counts: DataFrame) -> DataFrame:
    """``(lang, words, phrase, a, l, r, score)``: each phrase of two or three words with its lowest-scoring cut, the first of equals."""
    word = lambda k: F.element_at(F.split("phrase", " "), k)
    cut = lambda k, first, rest: F.struct(F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))
    pair = lambda i, j: F.concat_ws(" ", word(i), word(j))
    cuts = F.when(F.col("words") == 2, F.array(cut(1, word(1), word(2)))).otherwise(F.array(cut(1, word(1), pair(2, 3)), cut(2, pair(1, 2), word(3))))
    rows = counts.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "words", "phrase", "a", "c.*")
    parts = counts.where("words in (1, 2)")
    rows = keyed_join(rows, parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    rows = keyed_join(rows, parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    big = lambda c: F.col(c).cast("decimal(38,0)")
    rows = rows.withColumn("p", F.lit(1_000_000).cast("decimal(38,0)") * big("a") * big("a")).withColumn("q", big("l") * big("r"))
    rows = rows.withColumn("score", F.expr("p div q").cast("long"))
    best = rows.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "words", "phrase", "a", "b.l", "b.r", "b.score")


def not_subsumed(phrases: DataFrame, percent: int = 50) -> DataFrame:
    """Without the pairs that stand in some phrase of three words with ``percent`` or more of their count."""
    three = phrases.where("words = 3").select("lang", F.col("a").alias("longer"), F.split("phrase", " ").alias("w"))
    inside = three.select("lang", "longer", F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2]))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    rows = phrases.join(most, ["lang", "phrase"], "left")
    return rows.where(F.col("longer").isNull() | (F.col("words") == 3) | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * percent)).drop("longer")


def top(rows: DataFrame, by: str, order: list[Column], most: int, salt: Column) -> DataFrame:
    """The first ``most`` rows of each ``by`` with their ``rank``; a large group is first cut down in ``PARTS`` parts."""
    parts = rows.withColumn("__p", F.pmod(salt, F.lit(PARTS)))
    first = Window.partitionBy(by, "__p").orderBy(*order)
    rows = parts.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= most).drop("__r", "__p")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's ``most`` best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z become lower case; a phrase is two or three words that follow each other
    with no mark of ``.,;:!?`` or line end between. Null language is ``und``; null
    and blank texts have no words, and a table without any has no phrases.
    Repeated rows count each time; ties of score and count go by the phrase's
    bytes. Sums and products are exact: counts are longs, products decimals.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where("text is not null")
    counts = written(phrase_counts(rows, least), "phrases")
    kept = not_subsumed(written(scored(counts), "scored"), percent)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = top(kept, "lang", order, most, F.xxhash64("phrase"))
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
