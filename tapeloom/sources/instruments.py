"""Instrument master, symbol maps, index members and token lists."""

from __future__ import annotations

import os

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def symbol_cache(spark: SparkSession, path: str) -> DataFrame:
    """``(token, symbol)`` from a headed or bare CSV; bad rows drop, the last of a token wins, a missing path is empty.

    The path's existence is asked of its own file system.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "token long, symbol string")
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    parts = F.split("value", ",")
    rows = lines.select(F.expr("try_cast(trim(split(value, ',')[0]) as bigint)").alias("token"), F.trim(F.get(parts, F.lit(1))).alias("symbol"), "at")
    return rows.where("token is not null and symbol is not null").groupBy("token").agg(F.max_by("symbol", "at").alias("symbol"))


def write_symbols(symbols: DataFrame, path: str) -> None:
    """Write ``(token, symbol)`` as headed CSV in the order of tokens, for ``symbol_cache`` to read."""
    symbols.select("token", "symbol").orderBy("token").write.mode("overwrite").option("header", True).csv(path)


def constituents(spark: SparkSession, path: str, column: str = "Symbol") -> DataFrame:
    """The distinct trimmed values of a CSV's column, found by name in any case; raises where the column or the values lack."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("encoding", "UTF-8").csv(path)
    found = [c for c in rows.columns if c.lstrip("﻿").strip().lower() == column.lower()]
    if not found:
        raise ValueError(f"no column {column!r} in {path}")
    out = rows.select(F.trim(F.col(f"`{found[0]}`")).alias("symbol")).where("symbol != ''").distinct()
    if out.isEmpty():
        raise ValueError(f"no symbols in {path}")
    return out


def equities(instruments: DataFrame, kind: str = "EQ", segment: str = "NSE") -> DataFrame:
    return instruments.where((F.col("instrument_type") == kind) & (F.col("segment") == segment))


def active(instruments: DataFrame) -> DataFrame:
    """Equities with a last price."""
    return equities(instruments).where("last_price > 0")


def active_counts(instruments: DataFrame) -> DataFrame:
    """``(total, active, filtered)`` of the equities, in one pass."""
    rows = equities(instruments)
    live = F.count_if(F.col("last_price") > 0)
    return rows.agg(F.count("*").alias("total"), live.alias("active"), (F.count("*") - live).alias("filtered"))


def members(instruments: DataFrame, symbols: DataFrame) -> DataFrame:
    """Instruments whose symbol is in an index."""
    return instruments.join(symbols.select("symbol"), "symbol", "left_semi")


def discovered(instruments: DataFrame, sources: list[str | DataFrame], column: str = "Symbol") -> tuple[DataFrame, list[str]]:
    """The equities of an index, whose members come from the first of ``sources`` that can be read; and why those before it could not.

    A source is a CSV's path (``constituents``) or a table with ``symbol``: a live
    list first, then a kept one. Raises where none can be read, or none of the
    members is an instrument.
    """
    spark, why = instruments.sparkSession, []
    for source in sources:
        try:
            symbols = constituents(spark, source, column) if isinstance(source, str) else source
            if symbols.isEmpty():
                raise ValueError("no symbols")
        except (PySparkException, ValueError) as e:
            why.append(str(e).split("\n")[0])
            continue
        found = members(equities(instruments), symbols)
        if found.isEmpty():
            raise ValueError("none of the index's members is an instrument")
        return found, why
    raise ValueError(f"no list of members: {'; '.join(why)}")


def with_symbol(rows: DataFrame, symbols: DataFrame, default: Column | None = None) -> DataFrame:
    """Add ``symbol``; a token without one gets ``T<token>`` (or ``default``)."""
    default = F.concat(F.lit("T"), F.col("token").cast("string")) if default is None else default
    found = symbols.select("token", F.col("symbol").alias("__symbol"))
    return rows.join(found, "token", "left").withColumn("symbol", F.coalesce(F.nullif(F.col("__symbol"), F.lit("")), default)).drop("__symbol")


def index_universe(candles: DataFrame, symbols: DataFrame, index: DataFrame) -> DataFrame:
    """Stored tokens whose symbol is an index member; all of them where none is."""
    tokens = candles.select("token").distinct()
    chosen = tokens.join(symbols.join(index.select("symbol"), "symbol", "left_semi").select("token"), "token", "left_semi")
    return tokens if chosen.isEmpty() else chosen


def token_list(text: Column) -> Column:
    """Comma-separated tokens as longs; blanks drop, anything else that is no number raises."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("long"))


def settings(env: dict[str, str] | None = None) -> dict:
    """Process settings from the environment: the universe mode is ``index``, else ``full``, else ``manual`` with tokens."""
    env = dict(os.environ) if env is None else env
    on = lambda k: env.get(k, "").strip().lower() in ("1", "true", "yes", "on")
    tokens = [int(x) for x in (p.strip() for p in env.get("INSTRUMENT_TOKENS", "").split(",")) if x]
    mode = "index" if on("USE_INDEX") else "full" if on("USE_ALL") else "manual"
    if mode == "manual" and not tokens:
        raise ValueError("INSTRUMENT_TOKENS is needed when no universe is chosen")
    years = env.get("RETENTION_YEARS", "")
    return {"mode": mode, "tokens": tokens, "retention_years": int(years) if years.isdigit() and int(years) > 0 else 3}
