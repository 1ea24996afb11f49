"""Removal of repeated byte strings by a radix sort of suffixes to a limited depth.

A window is a suffix's first ``least`` bytes. Windows are put in buckets by
most-significant-digit passes: each pass splits the buckets of the one before by
the bytes that come next, and drops what is alone in its bucket. The order of
digits is chosen so that few windows need rows of their own:

- The first digit is a window's anchor, the run of ``GRAM`` bytes in it with the
  smallest hash. Equal windows have equal anchors at equal places. Windows that
  follow each other and share an anchor's occurrence are one row, a run.
- Runs of an anchor whose bytes are all equal are copies of each other, and all
  their windows repeat. Others are cut into nodes, by how far the anchor is from
  the window's start: all windows of a node cover the node's core, which is its
  next digit. Nodes with equal cores are in one bucket; where all bytes of two
  nodes are equal their windows repeat, else they are cut into smaller nodes with
  longer cores, until a node is one window and its core the window.

Buckets are named by 128-bit digests of the digits so far and are not put in
order among each other, since only equality is asked for. They are counted by
pre-aggregated group-bys, so that no task gathers one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, keyed_join, slices
from .substrings import _with_spans, merged

#: Bytes of an anchor.
GRAM = 32
#: Windows of a node in each pass.
WIDTHS = (64, 8, 1)
#: Positions hashed at once.
PIECE = 1 << 18
#: Bits of the filter of repeated anchors that tasks get (16 MB).
FILTER_BITS = 1 << 27

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _grams(data: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes."""
    n = len(data) - size + 1
    g = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for at in [*range(0, size - 7, 8), *range(size // 8 * 8, size)]:
            kind = "<u8" if at < size // 8 * 8 else "u1"
            part = np.ndarray((n,), kind, data, at, (1,))
            g ^= part
            g *= _MIX[0]
            g ^= g >> np.uint64(32)
        g *= _MIX[1]
        g ^= g >> np.uint64(29)
    return g


def _least_of(g: np.ndarray, wide: int) -> np.ndarray:
    """Where the smallest of each ``wide`` values that follow each other is, the first of equals (in their upper 44 bits)."""
    low = np.uint64((1 << 20) - 1)
    v = g & ~low | np.arange(len(g), dtype=np.uint64)
    rows = -(-len(v) // wide)
    block = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
    block[: len(v)] = v
    block = block.reshape(rows, wide)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - wide + 1
    return (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & low).astype(np.int64)


def runs(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, place, first, last`` of each run: its windows start at ``first`` to ``last`` and the anchor at ``place``."""
    size = min(GRAM, least)
    wide = least - size + 1
    n = len(data) - least + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 4
    values, places, firsts = [], [], []
    held = -1
    for at in range(0, n, PIECE):
        stop = min(at + PIECE, n)
        g = _grams(data[at : stop - 1 + least], size)
        pick = _least_of(g, wide)
        new = np.flatnonzero(np.concatenate(([pick[0] + at != held], pick[1:] != pick[:-1])))
        values.append(g[pick[new]].view(np.int64)), places.append(pick[new] + at), firsts.append(new + at)
        held = int(pick[-1]) + at
    first = np.concatenate(firsts)
    return np.concatenate(values), np.concatenate(places), first, np.append(first[1:], n) - 1


def repeated_anchors(rows: DataFrame, least: int) -> DataFrame:
    """``anchor`` of more than one run; ``rows`` has ``id, k, text`` (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            values, counts = np.unique(np.concatenate([np.empty(0, np.int64), *(runs(t.as_py(), least)[0] for t in batch.column(0))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["anchor", "m"])

    found = rows.select("text").mapInArrow(run, "anchor long, m long")
    return found.groupBy("anchor").agg(F.sum("m").alias("m")).where("m > 1").select("anchor")


def filter_of(anchors: DataFrame) -> bytes:
    """``FILTER_BITS`` bits, as bytes, with the bit of each anchor set: a filter that lets all of these through, and few others while it is sparse."""
    bit = F.shiftrightunsigned("anchor", 64 - FILTER_BITS.bit_length() + 1)
    block = anchors.groupBy(F.shiftright(bit, 15).alias("block")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in block.toLocalIterator():  # FILTER_BITS / 8 bytes in all
        out[r["block"] << 12 : r["block"] + 1 << 12] = r["bits"]
    return bytes(out)


def run_table(rows: DataFrame, least: int, wanted: bytes) -> DataFrame:
    """``(id, k, anchor, c1, c2, span, at)`` of every run whose anchor passes the filter ``wanted``; a span is ``begin << 32 | end``, c1 and c2 digest its bytes and ``at``.

    ``rows`` has ``id, k, text`` (binary).
    """
    held = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, bits = xxhash.xxh3_128_digest, np.frombuffer(held.value, np.uint8)
        shift = np.uint64(64 - FILTER_BITS.bit_length() + 1)
        for batch in slices(batches, 256):
            owner, got, digests = [], [], []
            for k, t in enumerate(batch.column(2)):
                data = t.as_py()
                found = runs(data, least)
                bit = (found[0].view(np.uint64) >> shift).astype(np.int64)
                value, place, first, last = (x[(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)] for x in found)
                if len(value):
                    owner.append(np.full(len(value), k, np.int32))
                    got.append((value, first << 32 | last + least, (place - first).astype(np.int32)))
                    digests += [digest(data[b:e], s) for b, e, s in zip(first.tolist(), (last + least).tolist(), (place - first).tolist(), strict=True)]
            if got:
                take = pa.array(np.concatenate(owner))
                value, span, at = (np.concatenate(x) for x in zip(*got, strict=True))
                c = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = [batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, (value, c[:, 0].copy(), c[:, 1].copy(), span, at))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "k", "anchor", "c1", "c2", "span", "at"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, k long, anchor long, c1 long, c2 long, span long, at int")


def cut(data: bytes, at: int, lo: int, hi: int, bucket: bytes, wide: int, before: tuple[int, int] | None, least: int) -> Iterator[tuple]:
    """Nodes of ``wide`` windows of the run ``data`` whose anchor is at ``at`` and lies ``lo`` to ``hi`` bytes behind its windows' starts.

    ``before`` is the core (begin, end) that the pass before has read, counted
    from the anchor; a node's digit is what its core has besides. Gives ``(bucket
    digest, digest of all bytes, lo, hi, bytes)`` of each node.
    """
    for node in range(lo // wide, hi // wide + 1):
        low, high = node * wide, node * wide + wide - 1
        begin, end = at - low, at - high + least
        digit = data[begin:end] if before is None else data[begin : at + before[0]] + data[at + before[1] : end]
        a, b = max(lo, low), min(hi, high)
        whole = data[at - b : at - a + least]
        yield xxhash.xxh3_128_digest(bucket + node.to_bytes(4, "little") + digit), xxhash.xxh3_128_digest(whole, a << 32 | b), a, b, whole


_NODE = "place long, n int, lo int, hi int, k1 long, k2 long, h1 long, h2 long, bytes binary"
_NAMES = ["id", "k", "place", "n", "lo", "hi", "k1", "k2", "h1", "h2", "bytes"]


def _batch(batch: pa.RecordBatch, owner: list[int], got: list[tuple]) -> pa.RecordBatch:
    take = pa.array(owner, pa.int32())
    place, n, lo, hi, key, whole, data = zip(*got, strict=True)
    halves = [np.frombuffer(b"".join(x), "<i8").reshape(-1, 2) for x in (key, whole)]
    columns = [pa.array(place, pa.int64()), *(pa.array(c, pa.int32()) for c in (n, lo, hi)), *(pa.array(h[:, i].copy()) for h in halves for i in (0, 1)), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], names=_NAMES)


def _first_nodes(rows: DataFrame, wide: int, least: int) -> DataFrame:
    """The nodes of the first pass; ``rows`` has ``id, k, text, cs`` with the runs asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            owner, got = [], []
            for r, (t, cs) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                text = t.as_py()
                for c in cs:
                    begin, end = c["span"] >> 32, c["span"] & 0xFFFFFFFF
                    last = c["at"] - (end - least - begin)
                    for key, whole, a, b, data in cut(text[begin:end], c["at"], last, c["at"], c["anchor"].to_bytes(8, "little", signed=True), wide, None, least):
                        owner.append(r)
                        got.append((begin + c["at"], c["n"], a, b, key, whole, data))
            for at in range(0, len(got), 20_000):
                yield _batch(batch, owner[at : at + 20_000], got[at : at + 20_000])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, k long, {_NODE}")


def _next_nodes(rows: DataFrame, was: int, wide: int, least: int) -> DataFrame:
    """The nodes of a pass, from those of the one before that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_000):
            owner, got = [], []
            for r, (place, n, lo, hi, k1, k2, _, _, data) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2, 11)), strict=True)):
                bucket = k1.to_bytes(8, "little", signed=True) + k2.to_bytes(8, "little", signed=True)
                low = lo // was * was
                for key, whole, a, b, part in cut(data, hi, lo, hi, bucket, wide, (-low, -(low + was - 1) + least), least):
                    owner.append(r)
                    got.append((place, n, a, b, key, whole, part))
            if got:
                yield _batch(batch, owner, got)

    return rows.select(*_NAMES).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, k long, {_NODE}")


def repeated_spans(rows: DataFrame, least: int) -> DataFrame:
    """``(id, k, spans)``: spans of windows that start anywhere else too, as ``begin << 32 | end``.

    ``rows`` has ``id``, ``k`` (a hash of the text) and ``text`` (binary); equal
    rows share a key and count as different places.
    """
    rows = rows.select("id", "k", "text")
    tables = Tables(rows.sparkSession)
    # A run whose anchor is met once is alone in its bucket; the few that pass the filter by chance are so later.
    wanted = filter_of(tables.put(repeated_anchors(rows, least), "anchors"))
    found = tables.put(run_table(rows, least, wanted), "runs")
    kinds = found.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("m"), F.min(F.struct("id", "k", "span", "at")).alias("one"))
    kinds = tables.put(kinds, "kinds")
    spans = {"copies": tables.put(keyed_join(found, kinds.where("m > 1").select("anchor", "c1", "c2"), ["anchor", "c1", "c2"]).select("id", "k", "span"), "copies")}
    tables.drop("anchors", "runs")
    # An anchor with one kind of run is settled, and so is one whose kinds are all met twice or more.
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("m").alias("fewest")).where("kinds > 1 and fewest = 1").select("anchor")
    asked = keyed_join(kinds, open_, ["anchor"]).select("one.id", "one.k", F.struct("anchor", "one.span", "one.at", F.least("m", F.lit(2)).cast("int").alias("n")).alias("c"))
    asked = tables.put(asked.groupBy("id", "k").agg(F.collect_list("c").alias("cs")), "asked")
    tables.drop("kinds")
    widths = [w for w in WIDTHS if w <= least]
    nodes = tables.put(_first_nodes(_with_spans(rows, asked, "inner"), widths[0], least), f"nodes_{widths[0]}")
    tables.drop("asked")
    for was, wide in zip(widths, [*widths[1:], None], strict=True):
        kind = ["k1", "k2", "h1", "h2"]
        kinds = tables.put(nodes.groupBy(*kind).agg(F.sum("n").alias("m"), F.min(F.struct("id", "k", "place")).alias("one")), f"kinds_{was}")
        settled = keyed_join(nodes.where("n = 1").select("id", "k", "place", "lo", "hi", *kind), kinds.where("m > 1").select(*kind), kind)
        spans[f"settled_{was}"] = tables.put(settled.select("id", "k", F.expr(f"shiftleft(place - hi, 32) | (place - lo + {least})").alias("span")), f"settled_{was}")
        if wide is not None:
            open_ = kinds.groupBy("k1", "k2").agg(F.count("*").alias("kinds"), F.min("m").alias("fewest")).where("kinds > 1 and fewest = 1").select("k1", "k2")
            on = keyed_join(kinds, open_, ["k1", "k2"]).select(*kind, F.col("one.id").alias("__id"), F.col("one.k").alias("__k"), F.col("one.place").alias("__place"), F.least("m", F.lit(2)).cast("int").alias("__n"))
            n = nodes.join(on, kind).where(F.col("id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__k")) & (F.col("place") == F.col("__place"))).withColumn("n", F.col("__n"))
            nodes = tables.put(_next_nodes(n, was, wide, least), f"nodes_{wide}")
        tables.drop(f"nodes_{was}", f"kinds_{was}")
    out = tables.put(reduce(DataFrame.union, spans.values()).groupBy("id", "k").agg(F.collect_set("span").alias("spans")), "spans")
    tables.drop(*spans)
    return out


def without_repeats(docs: DataFrame, least: int = 200, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's ``id``, ``n_bytes``, ``spans`` (maximal removed runs, ``[begin, end]`` in bytes), ``n_removed`` and ``kept`` (binary).

    A byte of the text's UTF-8 goes if a string of ``least`` bytes over it starts
    at another place too, in the same or any other row. A null text is empty.
    Every copy of a repeated row loses its bytes alike, and an empty table gives
    an empty one. A cut may part the bytes of one character, so ``kept`` is no text.
    """
    whole = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(whole).alias("k"), whole.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, gone, cuts, left = [], [], [], []
            for t, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = t.as_py()
                own = merged((s >> 32, s & 0xFFFFFFFF) for s in spans) if spans else []
                keep, last = [], 0
                for a, b in own:
                    keep.append(data[last:a])
                    last = b
                n.append(len(data)), gone.append(sum(b - a for a, b in own)), cuts.append([list(c) for c in own]), left.append(b"".join((*keep, data[last:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cuts, pa.list_(pa.list_(pa.int64()))), pa.array(gone, pa.int64()), pa.array(left, pa.binary())], names=[id, "n_bytes", "spans", "n_removed", "kept"])

    both = _with_spans(rows, repeated_spans(rows, least), "left").select("id", "text", "spans")
    fields = [T.StructField(id, both.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())]
    return both.mapInArrow(run, T.StructType(fields))
