"""A trie of conversation prefixes, encoded by preorder intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_join, written

#: Turns of a conversation that are summed in one window; longer ones are dealt in several.
TURNS = 512
#: Members whose ids are joined as one piece of text before they are hashed.
IDS = 4_096
#: Siblings that one window should hold, about.
SIBLINGS = 100_000


def running(rows: DataFrame, by: list[str], bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add inclusive prefix sums along ``order`` within ``by``, by parts: no window holds more than a bucket.

    ``bucket`` (a long, not null) must not fall along ``order``. Each bucket's
    sums give the later ones their start. ``by`` must not hold nulls.
    """
    rows = rows.withColumn("__b", bucket).withColumns({f"__v_{k}": c for k, c in sums.items()})
    totals = rows.groupBy(*by, "__b").agg(*(F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "__b", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in sums))
    inner = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, [*by, "__b"]).withColumns({k: F.col(f"__s_{k}") + F.sum(f"__v_{k}").over(inner) for k in sums})
    return rows.drop("__b", *(f"__{x}_{k}" for x in "vs" for k in sums))


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, d, role, text)``: turns counted from 1 in each conversation, null turns first.

    Equal turn numbers go by role, then text. Null role or text is empty; rows
    without a conversation's id belong to none and are left out.
    """
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("__turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    part = F.coalesce(F.floor(F.col("__turn") / TURNS).cast("long"), F.lit(-(1 << 62)))
    rows = running(rows, ["conv_id"], part, [F.col("__turn").asc_nulls_first(), F.col("role"), F.col("text")], {"d": F.lit(1)})
    return rows.select("conv_id", F.col("d").cast("long").alias("d"), "role", "text")


def shared_starts(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuild every conversation ``c``: the first ``h`` turns of ``c - c % family``, then its own after the first ``h``.

    ``h`` is the CRC-32 of c's decimals modulo ``most``; a start that is shorter
    or absent gives the turns that it has. Returns the rebuilt turns
    (``conv_id, d`` and ``turns``' further columns) and ``(conv_id, length)`` of
    every conversation, turnless ones too.
    """
    rest = [c for c in turns.columns if c not in ("conv_id", "d")]
    lengths = turns.groupBy("conv_id").agg(F.max("d").alias("own"))
    convs = lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = written(convs.select("conv_id", "base", "h", "own", F.least("h", F.coalesce("there", F.lit(0))).alias("m")), "conversations")
    own = keyed_join(turns, convs.select("conv_id", "h", "m"), ["conv_id"]).where("d > h").select("conv_id", (F.col("m") + F.col("d") - F.col("h")).alias("d"), *rest)
    heads = turns.where(F.col("d") < most).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("d <= h").select("conv_id", "d", *rest)
    return own.union(heads), convs.select("conv_id", (F.col("m") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length"))


def _paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each conversation and prefix of it, the empty one too: its key, its parent's, and its last turn's.

    A key of 128 bits is made from running sums of the hashes of numbered turns
    (128 bits in four longs, which can't overflow), so that a long conversation
    is dealt to many tasks like any other prefix sum.
    """
    low, high = (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(c, 32))
    x, y = F.xxhash64("d", "k1", "k2"), F.xxhash64(F.lit(2), "k2", "d", "k1")
    lanes = {"s1": low(x), "s2": high(x), "s3": low(y), "s4": high(y)}
    rows = turns.select("conv_id", "d", "k1", "k2", "bytes", *(c.alias(f"v{k}") for k, c in lanes.items()))
    rows = running(rows, ["conv_id"], F.expr(f"(d - 1) div {TURNS}"), [F.col("d")], {k: F.col(f"v{k}") for k in lanes})

    def key(depth: Column, sums: list[Column]) -> list[Column]:
        return [F.when(depth > 0, F.xxhash64(depth, *sums)).otherwise(0), F.when(depth > 0, F.xxhash64(F.lit(3), *reversed(sums), depth)).otherwise(0)]

    a, b = key(F.col("d"), [F.col(k) for k in lanes])
    up, ub = key(F.col("d") - 1, [F.col(k) - F.col(f"v{k}") for k in lanes])
    rows = keyed_join(rows.select("conv_id", "d", a.alias("a"), b.alias("b"), up.alias("pa"), ub.alias("pb"), "k1", "k2", "bytes"), lengths, ["conv_id"])
    null = F.lit(None).cast("long")
    roots = lengths.select("conv_id", F.lit(0).cast("long").alias("d"), *(F.lit(0).cast("long").alias(c) for c in ("a", "b")), *(null.alias(c) for c in ("pa", "pb", "k1", "k2")), F.lit(0).cast("long").alias("bytes"), (F.col("length") == 0).alias("last"))
    return rows.withColumn("last", F.col("d") == F.col("length")).drop("length").union(roots)


def _ends(paths: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)`` of the nodes where conversations end: the hash of their ids, rising, comma-joined.

    Ids are first joined in ranges of ``IDS``. Such pieces then stream through
    one hash a node, in order; a hash is of one sequence, so this can't be split.
    """
    rows = paths.where("last").groupBy("a", "b", F.floor(F.col("conv_id") / IDS).alias("part")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, hashlib.sha256()
        out: list[dict] = []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (a, b) == node:
                    held.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append({"a": node[0], "b": node[1], "ends_sha256": held.hexdigest()})
                node, held = (a, b), hashlib.sha256(ids.encode())
            if len(out) > 5_000:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if node is not None:
            out.append({"a": node[0], "b": node[1], "ends_sha256": held.hexdigest()})
            yield pa.RecordBatch.from_pylist(out)

    rows = rows.repartition("a", "b").sortWithinPartitions("a", "b", "part").select("a", "b", "ids")
    return rows.mapInArrow(run, "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """The trie of all prefixes of conversations: a row for each distinct one (a node), the empty one (the root) included.

    ``turns`` has ``conv_id`` (a long), ``d`` (1, 2, ...), ``role`` and ``text``;
    ``lengths`` lists all conversations with their number of turns, so that
    turnless ones count too. Returns ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256`` and the node's place ``pre`` in the
    lexicographic order of all nodes, with the last place ``end`` of its subtree.
    No conversations give no nodes.

    1. Nodes are grouped by key. A conversation is the smallest member of the
       nodes from some depth of its path to its end: its chain. Smallest member
       and depth so name a node.
    2. A subtree's size is the number of chain nodes at or below it, summed over
       the conversations that pass.
    3. Siblings are ordered by the digest of their last turn. The sizes of those
       before it tell how many places a node lies behind its parent, and the sum
       of these steps along its path is its place in preorder.
    4. Leaves and savings are differences of prefix sums over all places.
    """
    bytes_ = F.octet_length("text").cast("long")
    slim = turns.select("conv_id", "d", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "role").alias("k2"), bytes_.alias("bytes"))
    lengths = turns.groupBy("conv_id").agg(F.max("d").alias("length")) if lengths is None else lengths
    paths = written(_paths(slim, lengths), "paths")
    nodes = paths.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.max("d").alias("depth"), F.count("*").alias("n_convs"), *(F.max(c).alias(c) for c in ("pa", "pb", "k1", "k2", "bytes")))
    nodes = written(nodes, "nodes")
    total = nodes.count()
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("tail"))
    passing = keyed_join(paths, chains, ["conv_id"])
    sizes = passing.groupBy("a", "b").agg(F.sum(F.col("tail") - F.greatest("top", "d") + 1).alias("size"))
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(sizes, ["a", "b"]).join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "sizes")
    bits = max(6, math.ceil(math.log2(max(1, total / SIBLINGS))))
    steps = running(nodes.where("depth > 0"), ["pa", "pb"], F.shiftright("k1", 64 - bits).cast("long"), [F.col("k1"), F.col("k2")], {"upto": F.col("size")})
    steps = steps.select("a", "b", (F.col("upto") - F.col("size") + 1).alias("step"))
    walked = keyed_join(passing.where("d > 0").select("conv_id", "d", "top", "a", "b"), steps, ["a", "b"])
    walked = running(written(walked, "steps"), ["conv_id"], F.expr(f"(d - 1) div {TURNS}"), [F.col("d")], {"pre": F.col("step")})
    root = paths.where("d = 0").agg(F.min("conv_id").alias("conv_id")).where("conv_id is not null").select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("pre"))
    places = walked.where("d >= top").select("conv_id", "d", "pre").union(root)
    nodes = nodes.join(places.withColumnRenamed("d", "depth"), ["conv_id", "depth"])
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("end", F.col("pre") + F.col("size") - 1)
    nodes = written(nodes.select("conv_id", "depth", "a", "b", "pa", "pb", "n_convs", "n_children", "pre", "end", "leaf", "own"), "places")
    wide = max(1_000, math.isqrt(total))
    sums = written(running(nodes, [], F.expr(f"pre div {wide}"), [F.col("pre")], {"leaves": F.col("leaf"), "saved": F.col("own")}), "sums")
    ends = sums.select(F.col("pre").alias("end"), F.col("leaves").alias("__l"), F.col("saved").alias("__s"))
    rows = sums.join(ends, "end").withColumn("n_leaves", F.col("__l") - F.col("leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("__s") - F.col("saved") + F.col("own"))
    up = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    rows = keyed_join(rows, up, ["pa", "pb"], "left").join(_ends(paths), ["a", "b"], "left")
    none = hashlib.sha256().hexdigest()
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "pre", "end")


def labelled(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the ``role`` and ``text`` of their last turn (null for the root)."""
    last = turns.select("conv_id", F.col("d").alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` after each has taken over the start of its family's first (``shared_starts``)."""
    turns = written(ordered_turns(conversations), "turns")
    rebuilt, lengths = shared_starts(turns)
    return prefix_trie(rebuilt, written(lengths, "lengths"))
