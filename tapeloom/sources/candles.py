"""Daily candles from raw tables and from text dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import folds


def parsed_date(text: Column) -> Column:
    """A stored date: RFC 3339 first, then ``YYYY-MM-DD``; null if neither."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def scan(raw: DataFrame, bad_dates: str = "skip") -> DataFrame:
    """Candles from rows whose ``date`` is text.

    A date that can't be read drops its row (``skip``), stays null (``keep``), or
    drops its whole token (``fail_token``).
    """
    rows = raw.withColumn("date", parsed_date(F.col("date")))
    if bad_dates == "keep":
        return rows
    if bad_dates == "skip":
        return rows.where("date is not null")
    if bad_dates == "fail_token":
        bad = rows.where("date is null").select("token").distinct()
        return rows.join(bad, "token", "left_anti")
    raise ValueError(f"bad_dates: {bad_dates}")


def history(candles: DataFrame, token: int, since: str | Column) -> DataFrame:
    """One token's bars from a date on, oldest first; both filters reach the scan."""
    return candles.where(F.col("token") == token).where(F.col("date") >= since).orderBy("date")


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily bars by supplier: an integer walk over its lines by ship date.

    Each line moves the price by five less than its discount in hundredths.
    Lines of a day follow order key, line number and part key. One shuffle by
    token serves the running sum and the daily aggregation.
    """
    cents = F.round(F.col("l_discount") * 100).cast("long") - 5
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    walk = Window.partitionBy("token").orderBy("date", "place").rowsBetween(Window.unboundedPreceding, 0)
    rows = lineitem.select(
        F.col("l_suppkey").alias("token"), F.col("l_shipdate").cast("timestamp").alias("date"), place.alias("place"), cents.alias("dx"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tx"), F.col("l_linenumber").cast("long").alias("ln"), F.col("l_quantity").cast("long").alias("q"),
    ).withColumn("px", F.lit(500).cast("long") + F.sum("dx").over(walk))
    days = rows.groupBy("token", "date").agg(
        F.min_by(F.col("px") - F.col("dx") + F.col("ln") - 4, "place").alias("o"), F.max_by("px", "place").alias("c"),
        F.max("px").alias("h"), F.min("px").alias("l"), F.max("tx").alias("tx"), F.sum("q").alias("v"),
    )
    return days.select(
        "token", "date", F.col("o").cast("double").alias("open"), (F.greatest("h", "o") + F.col("tx")).cast("double").alias("high"),
        (F.least("l", "o") - F.col("v") % 5).cast("double").alias("low"), F.col("c").cast("double").alias("close"), F.col("v").cast("long").alias("volume"),
    )


def gathered_lineitem(lineitem: DataFrame) -> DataFrame:
    """The bars of ``from_lineitem``, gathered: ``token`` and its ``bars`` in order of date (``indicators.gathered``).

    A token's lines meet in one shuffle; an Arrow function sorts, sums and
    aggregates those of a batch's tokens.
    """
    parts = {
        "date": F.col("l_shipdate").cast("timestamp"), "a": F.col("l_orderkey").cast("long"), "b": F.col("l_linenumber").cast("long"), "c": F.col("l_partkey").cast("long"),
        "dx": F.round(F.col("l_discount") * 100).cast("long") - 5, "tx": F.round(F.col("l_tax") * 100).cast("long"), "ln": F.col("l_linenumber").cast("long"), "q": F.col("l_quantity").cast("long"),
    }
    lines = lineitem.groupBy(F.col("l_suppkey").alias("token")).agg(F.collect_list(F.struct(*(v.alias(k) for k, v in parts.items()))).alias("l"))
    of = {k: F.col(f"l.{k}") for k in parts}
    return lines.select("token", folds.walk(of["date"], [of["a"], of["b"], of["c"]], of["dx"], of["tx"], of["ln"], of["q"]).alias("bars"))


def universe(candles: DataFrame, most: int = 0) -> DataFrame:
    """The stored tokens in order; the first ``most`` of them, if given."""
    tokens = candles.select("token").distinct().orderBy("token")
    return tokens.limit(most) if most > 0 else tokens


def first_table(spark: SparkSession, *names: str) -> DataFrame:
    """The first of the tables that exists."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    raise ValueError(f"none of {names} exists")
