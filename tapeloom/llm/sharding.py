"""Proportional stratified interleaving into shards, by DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window group should hold, about.
GROUP_ROWS = 100_000


def _ranked(rows: DataFrame, by: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based rank ``name`` of each row within ``by`` and ``__n``, that group's rows.

    ``bucket`` must not decrease along ``order``. Rows are ranked within
    ``(by, bucket)``, and the buckets' counts give each bucket its offset, so a
    group that holds a third of all rows is still dealt to many tasks.
    """
    rows = rows.withColumn("__b", bucket)
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    along = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = counts.select(
        *(F.col(c).alias(f"__k_{c}") for c in by), F.col("__b").alias("__kb"),
        (F.sum("__c").over(along.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__from"),
        F.sum("__c").over(along).alias("__n"),
    )
    same = F.col("__b") == F.col("__kb")
    for c in by:
        same &= F.col(c) == F.col(f"__k_{c}")
    joined = rows.join(counts, same)
    inner = Window.partitionBy(*by, "__b").orderBy(*order)
    return joined.withColumn(name, F.col("__from") + F.row_number().over(inner) - 1).drop(*(f"__k_{c}" for c in by), "__kb", "__b", "__from")


def interleaved_shards(docs: DataFrame, shards: int = 16, seed: int = 17, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Deal ``docs`` into ``shards`` that each match the mixture of sources.

    Rows of a source are ranked in a seeded random order; rank over the source's
    row count, shifted by a phase drawn from the source's name, is the row's
    place on a line from 0 to 1. All rows sorted by that place are cut into
    shards of equal row counts (law ``rows``: at most one apart), so each shard
    holds each source within about one row of its share.

    Copies of one text are rows like any others: law ``rows`` asks for equal counts,
    which it could not keep if a group of copies had to stay together, and a group
    that holds a third of all rows is dealt over all shards in its share.

    Returns ``id``, ``source``, ``size`` (UTF-8 bytes plus one), ``text_crc32``,
    ``law``, ``shard``, ``slot`` and ``grown_shard`` (null). Null text counts as
    empty, a null source is a stratum of its own, repeated rows each get a slot
    (alike rows are interchangeable), and no rows give no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).alias("__id"), F.col(source).alias("__source"), F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("__s"),
        (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
    )
    total = docs.count()
    bits = max(6, math.ceil(math.log2(max(1, total / GROUP_ROWS))))
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col("__id"), F.col("size"), F.col("text_crc32")))
    first = F.shiftright("__h", 64 - bits)  # signed: grows with the hash, as the order does
    rows = _ranked(rows, ["__s"], first, [F.col("__h"), F.col("__id"), F.col("text_crc32")], "__r")
    phase = (F.pmod(F.xxhash64(F.lit(seed), F.col("__s")), F.lit(1 << 20)) + 0.5) / (1 << 20)
    rows = rows.withColumn("__at", (F.col("__r") + phase) / F.col("__n")).drop("__n", "__r")
    cuts = 1 << bits
    order = [F.col("__at"), F.col("__s"), F.col("__h"), F.col("__id")]
    rows = _ranked(rows, [], F.floor(F.col("__at") * cuts), order, "__p")
    rows = rows.withColumn("__shard", F.expr(f"(__p * {shards}L) div {max(1, total)}L"))
    start = F.expr(f"(__shard * {max(1, total)}L + {shards - 1}L) div {shards}L")
    return rows.select(
        F.col("__id").alias(id), F.col("__source").alias(source), "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"), (F.col("__p") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
