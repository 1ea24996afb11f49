"""The one-shot screen: who breaks out on the latest bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import ICHIMOKU_BARS
from ..operators.signals import STRATEGIES, evaluated
from ..sources.instruments import with_symbol


def scan(candles: DataFrame, symbols: DataFrame, every_bar: bool = False) -> DataFrame:
    """Tokens whose last bar fires the plain buying rule, with how it broke out, by symbol.

    ``GAP_OPEN`` when only the open cleared the cloud top over yesterday's close,
    else ``INTRADAY``. ``every_bar`` gives all bars that would have been listed.
    """
    last = F.col("idx") == F.max("idx").over(Window.partitionBy("token"))
    rows = evaluated(candles, STRATEGIES["ichimoku"]).where(F.col("idx") >= ICHIMOKU_BARS - 1)
    rows = rows if every_bar else rows.withColumn("__last", last).where("__last").drop("__last")
    rows = rows.where(F.col("variant") == "IchimokuKinkoHyo (BUY)")
    inside = F.expr("open <= cloud_top and close > cloud_top")
    gap = F.expr("prev_close <= cloud_top and open > cloud_top")
    rows = rows.withColumn("scenario", F.when(gap & ~inside, "GAP_OPEN").otherwise("INTRADAY"))
    return with_symbol(rows, symbols).select("token", "symbol", "date", "scenario", "open", "close", "prev_close", "cloud_top", "cloud_bottom", "conversion", "base").orderBy("symbol", "date")


def scan_counts(candles: DataFrame) -> DataFrame:
    """``scanned`` and ``skipped`` (too few bars for the rule): one row."""
    n = candles.groupBy("token").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") >= ICHIMOKU_BARS).alias("scanned"), F.count_if(F.col("n") < ICHIMOKU_BARS).alias("skipped"))
