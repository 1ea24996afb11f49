"""Near copies by exact likeness of word shingles; SimHash ring chains and MinHash bands are the candidate searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, keyed_join, releasing, slices, written
from .simhash import fingerprint, near_classes

#: Bands of so many MinHashes each. A pair at likeness 0.8 shares no band with probability (1 - 0.8**4)**28 = 4e-7.
BANDS, ROWS = 28, 4
#: Members of larger buckets are not compared one by one.
FEW = 16
_MIX = np.random.default_rng(11).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The different word shingles of a text as sorted 64-bit hashes; none for a text without words.

    Letters A-Z are lower-cased, words are runs of anything but U+0020 and
    U+0009 to U+000D, and a text with fewer words than a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= size:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    return np.unique(np.array([digest(joined[s:e]) for s, e in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64))


def bands(have: np.ndarray, block: int = 512) -> np.ndarray:
    """A hash for each band of a non-empty set of shingles: equal when its ``ROWS`` minima are."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    a, b = _MIX[:, :1], _MIX[:, 1:]
    with np.errstate(over="ignore"):
        have = have ^ (have >> np.uint64(32))
        for at in range(0, len(have), block):
            np.minimum(low, (have[at : at + block] * a + b).min(axis=1), out=low)
        out = np.zeros(BANDS, np.uint64)
        for k in range(ROWS):
            out = (out ^ low[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _node(have: np.ndarray) -> int:
    """The hash that names a set of shingles; 0 is the empty set."""
    return xxhash.xxh3_64_intdigest(have.tobytes()) - (1 << 63) if len(have) else 0


def with_nodes(docs: DataFrame, text: str, keep: list[str], size: int = 5) -> DataFrame:
    """``keep`` columns of ``docs``, ``node`` (a hash of the set of shingles), ``bands`` and ``fp``, the SimHash as a signed long."""
    picked = docs.select(*keep, F.col(text).alias("__text"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(len(names)).to_pylist()
            sets = [shingles(t, size) for t in texts]
            got = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))]
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *got, pa.array(fps)], names=[*names, "node", "bands", "fp"])

    added = [T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]
    return picked.mapInArrow(run, T.StructType([*(picked.schema[i] for i in range(len(names))), *added]))


def with_sets(rows: DataFrame, size: int = 5) -> DataFrame:
    """``node``, ``n`` and ``have``, the sorted shingles, of rows ``(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "have"])

    return rows.select("node", "text").mapInArrow(run, "node long, n long, have array<long>")


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets share ``percent`` or more of their union, in whole numbers."""
    p, q = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("have").alias(f"have_{c}")) for c in ("a", "b"))
    rows = pairs.join(p.hint("merge"), "a").join(q.hint("merge"), "b").withColumn("both", F.size(F.array_intersect("have_a", "have_b")))
    return rows.where(f"both * {100 + percent} >= (n_a + n_b) * {percent}").select("a", "b")


def deltas(families: DataFrame, sets: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """How each node's set differs from its pivot's: ``(pivot, e, node, component, n, d, at)``.

    ``families`` has ``node, component, pivot``; ``d`` is the size of the
    symmetric difference and ``e`` its elements, rarest first, of which only the
    first that ``like_classes`` needs are listed, by place ``at``.
    """
    nodes = families.select("node").union(families.select("pivot")).distinct()
    common = ranked.join(nodes.hint("merge"), "node", "left_semi").groupBy("node").agg(F.collect_list("shingle").alias("met"), F.collect_list("df").alias("df"))
    whole = written(sets.join(nodes.hint("merge"), "node", "left_semi").join(common.hint("merge"), "node", "left"), "whole")  # read by node and by pivot
    x, y = whole, whole.select(*(F.col(c).alias(f"{c}_") for c in whole.columns))
    rows = families.join(x.hint("merge"), "node").join(y.hint("merge"), F.col("pivot") == F.col("node_")).select("pivot", "node", "component", "n", "have", "met", "df", "have_", "met_", "df_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            take, size, e, at = [], [], [], []
            for k, (n, have, met, df, have_, met_, df_) in enumerate(zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)):
                d = np.setxor1d(np.array(have, np.int64), np.array(have_, np.int64), assume_unique=True)
                seen = dict(zip([*(met or ()), *(met_ or ())], [*(df or ()), *(df_ or ())], strict=True))
                count = np.array([seen.get(v, 1) for v in d.tolist()], np.int64)
                first = d[np.lexsort((d, count))][: n * (100 - percent) // percent + 1].tolist()
                take += [k] * len(first)
                size += [len(d)] * len(first)
                e += first
                at += range(1, len(first) + 1)
            own = [c.take(pa.array(take, pa.int32())) for c in batch.columns[:4]]
            yield pa.RecordBatch.from_arrays([own[0], pa.array(e, pa.int64()), *own[1:], pa.array(size, pa.int64()), pa.array(at, pa.int64())], names=["pivot", "e", "node", "component", "n", "d", "at"])

    return rows.mapInArrow(run, "pivot long, e long, node long, component long, n long, d long, at long")


def ring_pairs(texts: DataFrame, distance: int = 4) -> DataFrame:
    """Each set with the first of its SimHash class, as pairs ``(a, b)``, from rows ``(node, fp)``.

    Classes are those of op1: fingerprints linked at ``distance`` or fewer bits by
    ring chains. The pairs are candidates for an exact check.
    """
    near = near_classes(texts.select("fp").distinct(), distance)
    classed = texts.join(near.hint("merge"), F.col("fp") == near["node"], "left").select(texts["node"], F.coalesce("component", "fp").alias("class"))
    classed = written(classed, "classed")
    first = classed.groupBy("class").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size")
    return keyed_join(classed, first, ["class"]).where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))


def like_classes(sets: DataFrame, percent: int = 80, few: int = FEW, *, also: DataFrame | None = None) -> DataFrame:
    """Classes of sets linked at a likeness of ``percent`` or more: ``(node, component)`` of each set with a link.

    Pairs ``(a, b)`` in ``also``, with ``a < b``, are checked first, with those of step 2.

    ``sets`` has different longs ``node``, ``n`` and ``have``. Two sets are linked
    when their difference has at most ``(n + m) * r`` elements, where ``r`` is
    ``(100 - percent) / (100 + percent)``. No link is lost:

    1. shingles are put in one order, rarest first. Two sets alike enough share
       one of their first ``n - ceil(n * percent / 100) + 1`` shingles (the smaller
       one of its first ``n * r + 1``), so each set enters the buckets of these
       (not those that no other set has). A much edited copy has its own shingles
       first, and so enters few;
    2. members are compared to two pivots of their bucket, of which one is the set
       that meets the most others (the original of many copies), and contracted;
    3. in a bucket of at most ``few`` members, those of different components are
       compared;
    4. a larger bucket that holds several components is not expanded. Its members
       are told apart by how they differ from the pivot: the difference of two
       sets is that of their differences, which for two sets of which one is not
       linked to the pivot always meet. So the prefix filter holds for these too:
       the larger one's first ``n * (100 - percent) / percent + 1`` elements and
       the smaller one's first half as many share one. Edits that no other copy
       has come first, so copies that were edited apart never meet.

    Elements before the first common one are not shared, so a meeting counts only
    where those that follow could make up the likeness.
    """
    each = sets.select("node", "n", F.explode("have").alias("shingle"))
    met = written(each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "met")
    # Those met once come first and need no row: their number is n less the count of the others.
    order = Window.partitionBy("node").orderBy("df", "shingle")
    ranked = each.join(met.hint("merge"), "shingle").withColumns({"at": F.row_number().over(order), "others": F.count("*").over(Window.partitionBy("node"))})
    ranked = written(ranked.select("node", "n", "shingle", "df", (F.col("n") - F.col("others") + F.col("at")).alias("at")), "ranked")
    member = ranked.where(f"at <= n - ceil(n * {percent} / 100D) + 1").drop("df")
    shared = member.groupBy("shingle").agg(F.count("*").alias("size")).where("size > 1")
    near = keyed_join(member, shared, ["shingle"]).withColumn("score", F.sum("size").over(Window.partitionBy("node")))
    near = written(near, "members")
    pivots = near.groupBy("shingle").agg(F.max_by("node", "score").alias("centre"), F.max_by("node", F.xxhash64("node")).alias("other"))
    pivots = written(pivots, "pivots")
    both = keyed_join(near.select("shingle", "node"), pivots, ["shingle"])
    pairs = both.select(F.col("node").alias("a"), F.explode(F.array("centre", "other")).alias("b"))
    pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = (pairs if also is None else pairs.union(also.select("a", "b"))).distinct()
    known = written(components(written(alike(pairs, sets, percent), "near")), "known")
    label = known.withColumnRenamed("node", "node_")
    labelled = near.join(label.hint("merge"), F.col("node") == F.col("node_"), "left").select("shingle", "node", "n", "at", "size", F.coalesce("component", "node").alias("component"))
    labelled = written(labelled, "labelled")
    split = labelled.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("shingle")
    mixed = written(keyed_join(labelled, split, ["shingle"]), "mixed")
    small = mixed.where(F.col("size") <= few)
    p, q = small.alias("p"), small.alias("q")
    rest = (
        p.join(q.hint("merge"), "shingle")
        .where("p.component != q.component and (p.n > q.n or p.n = q.n and p.node > q.node)")
        .where(f"(p.n + q.n - 2 * (1 + least(p.n - p.at, q.n - q.at))) * {100 + percent} <= (p.n + q.n) * {100 - percent}")
        .where(f"q.at <= floor(q.n * {100 - percent} / {100 + percent}D) + 1")
        .select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
        .distinct()
    )
    large = mixed.where(F.col("size") > few).select("shingle", "node", "component")
    families = keyed_join(large, pivots.select("shingle", F.col("centre").alias("pivot")), ["shingle"]).where("node != pivot")
    families = written(families.select("node", "component", "pivot").distinct(), "families")
    if not families.isEmpty():
        apart = written(deltas(families, sets, ranked, percent), "deltas")
        p, q = apart.alias("p"), apart.where(f"at <= floor(n * {100 - percent} / {2 * percent}D) + 1").alias("q")
        rest = rest.union(
            p.join(q.hint("merge"), ["pivot", "e"])
            .where("p.component != q.component and (p.d > q.d or p.d = q.d and p.node > q.node)")
            .where(f"(p.d + q.d - 2 * (1 + least(p.d - p.at, q.d - q.at))) * {100 + percent} <= (p.n + q.n) * {100 - percent}")
            .select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
            .distinct()
        ).distinct()
    links = written(alike(rest, sets, percent), "links")
    return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of ``docs``, one of each class of near copies: that with the smallest id.

    Rows are linked when their sets of ``size``-word shingles share ``percent`` or
    more of their union; a class is what links reach. Texts without words are one
    class. Ties of the id go to the smaller text hash; null ids come last, and of
    alike rows one stays. All columns stay as they are.
    """
    row = F.struct(*(docs[c] for c in docs.columns))
    rows = docs.select(row.alias("row"), docs[id].alias("__id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("__k"))
    with releasing(docs.sparkSession):
        first = _first_of_class(rows, text, percent, size)
    kept = rows.join(first.hint("merge"), rows["__id"].eqNullSafe(first["__i"]) & (rows["__k"] == first["__l"]), "left_semi")
    same = Window.partitionBy("__id", "__k").orderBy(F.lit(0))
    return kept.withColumn("__n", F.row_number().over(same)).where("__n = 1").select("row.*")


def _first_of_class(rows: DataFrame, text: str, percent: int, size: int) -> DataFrame:
    """``(__i, __l)``, id and text hash of the first row of each class of ``rows`` (``row, __id, __k``).

    Candidates are the sets that op1's ring chains put into a class with others (SimHash of the
    ``size``-word shingles) and those that share a MinHash band. Links are checked in full.
    """
    named = written(with_nodes(rows.select("__id", "__k", F.col(f"row.{text}").alias("__t")), "__t", ["__id", "__k"], size), "nodes")
    # A set in no band and no SimHash class with another has no near copy; the others are compared in full. One text of each is read.
    texts = named.groupBy("node").agg(F.min(F.struct("__id", "__k")).alias("one"), F.any_value("bands").alias("bands"), F.min("fp").alias("fp"))
    texts = written(texts, "different")
    ring = written(ring_pairs(texts.select("node", "fp")), "ring")
    banded = texts.select("node", F.posexplode("bands").alias("slot", "key"))
    shared = banded.groupBy("slot", "key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("slot", "key")
    chained = ring.select(F.explode(F.array("a", "b")).alias("node"))
    some = written(banded.join(shared.hint("merge"), ["slot", "key"]).select("node").union(chained).distinct(), "candidates")
    some = texts.join(some.hint("merge"), "node").select("node", F.col("one.__id").alias("__i"), F.col("one.__k").alias("__l"))
    found = rows.select("__id", "__k", F.col(f"row.{text}").alias("text"))
    found = found.join(some.hint("merge"), found["__id"].eqNullSafe(some["__i"]) & (found["__k"] == some["__l"])).select("node", "text")
    sets = written(with_sets(found, size).dropDuplicates(["node"]), "sets")
    near = like_classes(sets, percent, also=ring)
    named = named.select("__id", "__k", "node").join(near.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__k")).alias("first"))
    return written(first.select(F.col("first.__id").alias("__i"), F.col("first.__k").alias("__l")).distinct(), "first")
