"""Shared helpers: the word definition, scratch tables and graph components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: U+0020 and U+0009 to U+000D, nothing else.
WORD_BREAK = r"[\x20\x09-\x0D]+"
_BREAKS = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text: str | Column) -> Column:
    """The words of a text as an array; none for a null or blank text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def without_breaks(text: Column) -> Column:
    """The text less its white space, by byte-level replacement (no regular expression)."""
    for ch in _BREAKS:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode one of our own where that is unset.

    Executors on other machines could not see a folder of our own, so that this
    raises on a cluster without the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tapeloom-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{scratch_root(spark).rstrip('/')}/tapeloom-{uuid.uuid4().hex}/{label}"

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            top = jvm.org.apache.hadoop.fs.Path(path).getParent()
            top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(top, True)
        except Exception:  # the JVM is gone; whoever owns the folder clears it
            pass

    atexit.register(remove)
    return path


#: Spark removes an execution's shuffle files when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read of the file and
    not the work before it, and each reader prunes the columns that it needs.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Within it an execution's shuffle files go when it ends; every DataFrame is executed once only."""
    was = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, was)


class Tables:
    """Tables that are ``written`` under a label and dropped when nothing unwritten needs them any more.

    The shuffle files behind a table go as soon as it is written, not when the
    driver happens to collect its garbage; a DataFrame is written once only.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, label: str) -> DataFrame:
        path = self.paths[label] = scratch_path(self.spark, label)
        with releasing(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(label)).getParent()
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keyed_join(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` to a table with a row for each key, so that adaptive execution can split a hot key.

    ``few`` comes from an aggregate by the keys, whose partitioning a join would
    share; a shared one can't be split. One more key, a hash of the others, makes
    both sides be dealt anew for the join alone. Neither side is broadcast: what
    Spark knows of them before it runs is the size of a compressed file, without
    the rows that an explode adds.
    """
    h = F.xxhash64(*keys)
    return rows.withColumn("__h", h).join(few.withColumn("__h", h).hint("merge"), [*keys, "__h"], how).drop("__h")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph by alternating star contraction.

    ``edges`` holds two long columns; loops and repeated edges do no harm.
    Returns ``(node, component)`` for every node of an edge, where ``component``
    is the smallest node in reach. Each round hangs nodes on their smallest
    neighbour (first the larger, then the smaller neighbours), which keeps the
    edge count and needs a logarithmic number of rounds. Rounds are cut with
    ``checkpoint()``. A very popular node is only a hot join key (``keyed_join``).
    """
    scratch_root(edges.sparkSession)

    def large(e: DataFrame) -> DataFrame:
        s = e.union(e.select("v", "u"))
        low = s.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return keyed_join(s, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        hung = keyed_join(e, low, ["u"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.union(low.select("u", F.col("m").alias("v"))).distinct()

    def seen(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct().checkpoint()
    before = seen(e)
    while before[0]:
        e = small(large(e)).checkpoint()
        now = seen(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
