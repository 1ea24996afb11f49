"""SimHash near-duplicates, with ring-chain (pigeonring) candidate pruning."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, keyed_join, slices, written

BITS = 64
#: Larger buckets are split by longer chains. A comparison costs some nanoseconds, a row of a longer slot some
#: microseconds for each of about twenty slots, so that a split pays only for buckets far above a thousand members.
DIRECT = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """The 64-bit SimHash of a text over its word shingles, repeats included.

    Letters A-Z are lower-cased, words are runs of anything but U+0020 and
    U+0009 to U+000D, and a text with fewer words than a shingle is one shingle.
    A bit is set when more than half of the shingles' XXH64 have it; no words
    (or a null text) give zero. Bits are counted in blocks, so a very long text
    needs no more memory than its own size.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        h = np.array(hashes[at : at + block], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, keep: list[str], shingle: int = 4, seed: int = 42) -> DataFrame:
    """``keep`` columns of ``docs`` and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(len(keep)).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps.view(np.int64))], names=[*names, "fp"])

    picked = docs.select(*keep, F.col(text).alias("__text"))
    names = list(keep)
    schema = T.StructType([*(picked.schema[i] for i in range(len(keep))), T.StructField("fp", T.LongType())])
    return picked.mapInArrow(run, schema)


def segments(parts: int) -> list[tuple[int, int]]:
    """``(first bit, width)`` of each of the consecutive segments of a fingerprint."""
    ends = [round(BITS * i / parts) for i in range(parts + 1)]
    return [(ends[i], ends[i + 1] - ends[i]) for i in range(parts)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def ring_slots(distance: int, depth: int = 2) -> list[tuple[int, int, int]]:
    """The slots of chains of ``depth`` segments: ``(start, key mask, slot one segment shorter)`` of each.

    Take ``distance + 1`` segments on a ring. If two fingerprints differ in at
    most ``distance`` bits, some segment starts a chain whose first l segments
    together differ in at most ``l * distance // parts = l - 1`` bits, for every
    l: none in the first, one at most in the first two, and so on. A slot masks
    ``depth - 1`` bits of a chain, no more than l - 1 of them in its first l
    segments; fingerprints whose chain differs in these bits alone agree on the
    other bits of its segments, the slot's key. A longer slot continues one
    shorter slot: that which masks what the longer one masks of its segments and,
    to make up the number, the lowest other bits of its last.
    """
    parts = distance + 1
    seg = [range(first, first + width) for first, width in segments(parts)]
    shorter = ring_slots(distance, depth - 1) if depth > 2 else []
    out, masked = [], _masked_bits(distance, depth)
    of = {(start, bits): k for k, (start, bits) in enumerate(_masked_bits(distance, depth - 1))} if shorter else {}
    for start, bits in masked:
        key = sum(1 << b for k in range(depth) for b in seg[(start + k) % parts] if b not in bits)
        parent = -1
        if shorter:
            rest = tuple(b for b in bits if b not in seg[(start + depth - 1) % parts])
            fill = [b for b in seg[(start + depth - 2) % parts] if b not in rest][: depth - 2 - len(rest)]
            parent = of[start, tuple(sorted((*rest, *fill)))]
        out.append((start, signed(key), parent))
    return out


def _masked_bits(distance: int, depth: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(start, masked bits)`` of every slot of ``depth`` segments, by start."""
    parts = distance + 1
    seg = [range(first, first + width) for first, width in segments(parts)]
    out = []
    for start in range(parts):
        level: set[tuple[int, ...]] = {()}
        for at in range(1, depth):
            here = seg[(start + at) % parts]
            level = {tuple(sorted((*some, *more))) for some in level for n in range(at - len(some) + 1) for more in combinations(here, n)}
        out += [(start, bits) for bits in sorted(level) if len(bits) == depth - 1]
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def chain_holds(a: Column, b: Column, start: Column, distance: int) -> Column:
    """Whether the chain from segment ``start`` stays within the proportional budget at every length."""
    parts = distance + 1
    seg, out = segments(parts), None
    for i in range(parts):
        mask, within = 0, F.lit(True)
        for length in range(1, parts):
            first, width = seg[(i + length - 1) % parts]
            mask |= ((1 << width) - 1) << first
            within &= F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(signed(mask)))) <= length * distance // parts
        out = F.when(start == i, within) if out is None else out.when(start == i, within)
    return out


def near_classes(fps: DataFrame, distance: int = 4, direct: int = DIRECT) -> DataFrame:
    """Classes of fingerprints linked at ``distance`` or fewer differing bits.

    ``fps`` has distinct longs ``fp``. Returns ``(node, component)`` for each
    fingerprint with a link to another; ``component`` is the smallest ``fp`` of
    its class. No link is lost, and no large bucket is expanded into its pairs. All joins
    sort and merge but that to the list of slots: Spark takes an exploded table for as small as its file.

    1. every fingerprint enters the bucket of each slot (``ring_slots``); buckets
       of one are dropped after a pre-aggregation;
    2. members are compared to two pivots of their bucket, and contracted to
       components. In a large group of near copies this joins nearly all;
    3. in a bucket of at most ``direct`` members, those of different components
       are compared within the join, first by the chain's budgets, then in full,
       and only links come out;
    4. a larger bucket that holds more than one component is dealt anew by slots
       of one more segment, and so on to chains of four, whose buckets agree on
       all but some sixteen bits.
    """
    known, links, rows = None, None, fps.select("fp")
    for depth in range(2, min(4, distance + 1) + 1):
        slots = ring_slots(distance, depth)
        if depth == 2:
            each = F.explode(F.array(*(F.struct(F.lit(k).alias("slot"), F.lit(i).alias("start"), F.lit(m).alias("mask")) for k, (i, m, _) in enumerate(slots))))
            member = rows.select("fp", each.alias("s")).select("s.slot", "s.start", F.col("fp").bitwiseAND(F.col("s.mask")).alias("key"), "fp")
        else:  # 1,197 or 26,350 slots at a distance of 4
            longer = fps.sparkSession.createDataFrame([(up, k, i, m) for k, (i, m, up) in enumerate(slots)], "slot int, next int, start int, mask long")
            member = rows.join(F.broadcast(longer), "slot").select(F.col("next").alias("slot"), "start", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        shared = member.groupBy("slot", "key").agg(F.count("*").alias("size"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi")
        near = written(keyed_join(member, shared, ["slot", "key"]), f"members{depth}")
        ends = near.select("fp", F.explode(F.array("lo", "hi")).alias("pivot")).where(F.col("fp") != F.col("pivot"))
        pivots = ends.where(hamming(F.col("fp"), F.col("pivot")) <= distance).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
        if known is not None:
            pivots = pivots.union(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
        known = written(components(pivots), f"known{depth}")
        label = known.withColumnsRenamed({"node": "fp"})
        labelled = near.select("slot", "start", "key", "fp", "size").join(label.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        labelled = written(labelled, f"labelled{depth}")
        last = depth == min(4, distance + 1)
        few = labelled if last else labelled.where(F.col("size") <= direct)
        p, q = few.alias("p"), few.select("slot", "key", "fp", "component").alias("q")
        found = (
            p.join(q.hint("merge"), ["slot", "key"])
            .where("p.component < q.component")
            .where(chain_holds(F.col("p.fp"), F.col("q.fp"), F.col("p.start"), distance))
            .where(hamming(F.col("p.fp"), F.col("q.fp")) <= distance)
            .select(F.col("p.component").alias("a"), F.col("q.component").alias("b"))
            .distinct()
        )
        found = written(found, f"links{depth}")
        links = found if links is None else links.union(found)
        if last:
            break
        many = labelled.where(F.col("size") > direct)
        split = many.groupBy("slot", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("slot", "key")
        rows = written(keyed_join(many.select("slot", "key", "fp"), split, ["slot", "key"]).select("slot", "fp"), f"large{depth}")
        if rows.isEmpty():
            break
    if known is None:
        return fps.select(F.col("fp").alias("node"), F.col("fp").alias("component")).limit(0)
    return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: its id, ``keep`` columns, ``fingerprint``, ``component_id`` and ``component``.

    ``component_id`` is the smallest id in reach over links of ``distance`` or
    fewer bits, ``component`` the smallest fingerprint (as a long). Null, empty
    and blank texts share fingerprint zero and so one class. Repeated rows each
    come back. A null id never names a class unless all ids of the class are
    null. Other columns of ``docs`` are not read.
    """
    keep = keep or []
    picked = docs.select(F.col(id).alias("__id"), F.col(text).alias("__t"), *(F.col(c).alias(f"__keep_{c}") for c in keep))
    rows = written(with_fingerprints(picked, "__t", ["__id", *(f"__keep_{c}" for c in keep)], shingle, seed), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("__id").alias("low")), "distinct")
    near = near_classes(fps.select("fp"), distance).withColumnRenamed("node", "fp")
    named = fps.join(near.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = keyed_join(named.select("fp", "component"), low, ["component"]).select("fp", "component_id", "component")
    return rows.join(named.hint("merge"), "fp").select(
        F.col("__id").alias(id), *(F.col(f"__keep_{c}").alias(c) for c in keep), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component"
    )


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate class: that with the smallest id.

    Ties of the id go to the smaller text hash; null ids come last, and of alike
    rows one stays. All columns stay as they are.
    """
    row = F.struct(*(docs[c] for c in docs.columns))
    rows = docs.select(row.alias("row"), docs[id].alias("__id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("__k"))
    near = near_duplicates(rows.select("__id", "__k", F.col(f"row.{text}").alias("__t")), "__id", "__t", distance, shingle, seed, keep=["__k"])
    first = near.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__k")).alias("first"))
    first = first.select(F.col("first.__id").alias("__i"), F.col("first.__k").alias("__l")).distinct()
    kept = rows.join(first.hint("merge"), rows["__id"].eqNullSafe(first["__i"]) & (rows["__k"] == first["__l"]), "left_semi")
    alike = Window.partitionBy("__id", "__k").orderBy(F.lit(0))
    return kept.withColumn("__n", F.row_number().over(alike)).where("__n = 1").select("row.*")
