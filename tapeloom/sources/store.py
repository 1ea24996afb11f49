"""The candle store: idempotent writes, retention, cleaning and planning of what to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CANDLE


def open_store(spark: SparkSession, table: str = "candles") -> DataFrame:
    """The store's table, made on first use; making it again does nothing."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({CANDLE}) USING parquet")
    return spark.table(table)


def latest_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(stored: DataFrame | None, fresh: DataFrame, keys: tuple[str, ...] = ("token", "date"), order: str | None = None) -> DataFrame:
    """Stored rows with ``fresh`` over them: one row a key, fresh ones win, of those the largest ``order``.

    One shuffle by the key, however many batches are put together. With nothing
    stored (None) fresh rows keep the partitioning that they have.
    """
    by = [F.col(order).desc()] if order else []
    if stored is None:
        return latest_wins(fresh, list(keys), by) if by else fresh.dropDuplicates(list(keys))
    rows = stored.withColumn("__fresh", F.lit(0)).unionByName(fresh.withColumn("__fresh", F.lit(1)), allowMissingColumns=True)
    return latest_wins(rows, list(keys), [F.col("__fresh").desc(), *by]).drop("__fresh")


def retained(candles: DataFrame, as_of: Column, years: int = 3) -> DataFrame:
    return candles.where(F.col("date") >= F.add_months(as_of, -12 * years).cast("timestamp"))


def listed(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of active tokens. With no active token at all every row goes."""
    return rows.join(active.select("token"), "token", "left_semi")


def delisted_counts(rows: DataFrame, active: DataFrame) -> DataFrame:
    """``(rows, tokens)`` that the cleaning removes."""
    gone = rows.join(active.select("token"), "token", "left_anti")
    return gone.agg(F.count("*").alias("rows"), F.countDistinct("token").alias("tokens"))


def mark_no_data(marked: DataFrame, tokens: DataFrame, at: Column) -> DataFrame:
    """The no-data list with more tokens on it; one that is there keeps its time."""
    new = tokens.select("token").distinct().join(marked, "token", "left_anti").withColumn("recorded_at", at)
    return marked.unionByName(new)


def stats(candles: DataFrame) -> DataFrame:
    return candles.agg(
        F.max("date").alias("latest"), F.min("date").alias("oldest"), F.count("*").alias("rows"),
        F.countDistinct("token").alias("tokens"), F.countDistinct("date").alias("dates"),
    )


def spans(candles: DataFrame) -> DataFrame:
    """``(token, oldest, latest, bars)``."""
    return candles.groupBy("token").agg(F.min("date").alias("oldest"), F.max("date").alias("latest"), F.count("*").alias("bars"))


def latest_tokens(candles: DataFrame, n: int = 5) -> DataFrame:
    """The tokens with the latest bars (smaller token first among equals)."""
    return candles.groupBy("token").agg(F.max("date").alias("latest")).orderBy(F.col("latest").desc(), "token").limit(n)


def stale(candles: DataFrame, as_of: Column) -> DataFrame:
    return spans(candles).where(F.col("latest") < as_of - F.expr("interval 1 day")).select("token", "latest")


def chunks(work: DataFrame, days: int = 1900) -> DataFrame:
    """Cut each row's ``[start, end]`` dates into requests of at most ``days`` days after their first: ``(token, chunk, from, to)``."""
    step = F.expr(f"transform(sequence(start, end, interval {days + 1} days), (f, i) -> struct(i as chunk, f as `from`, least(date_add(f, {days}), end) as `to`))")
    return work.where("start <= end").select("token", F.explode(step).alias("c")).select("token", F.col("c.chunk").alias("chunk"), F.col("c.from").alias("from"), F.col("c.to").alias("to"))


def incremental_plan(candles: DataFrame, as_of: Column) -> DataFrame:
    """From the day after each token's own latest bar to ``as_of``."""
    work = spans(candles).select("token", F.date_add(F.to_date("latest"), 1).alias("start"), as_of.alias("end"))
    return chunks(work)


def deep_plan(candles: DataFrame, as_of: Column, years: int, force: bool = False, tolerance: int = 7) -> DataFrame:
    """From ``years`` before ``as_of`` to each token's oldest bar, for tokens that don't reach back so far within ``tolerance`` days."""
    target = F.add_months(as_of, -12 * years)
    work = spans(candles).select("token", target.alias("start"), F.to_date("oldest").alias("end"))
    return chunks(work if force else work.where(F.col("end") > F.date_add(F.col("start"), tolerance)))


def boot_plan(universe: DataFrame, candles: DataFrame, marked: DataFrame, as_of: Column, years: int = 3) -> DataFrame:
    """What each token of the universe needs at start: ``cached``, ``refresh``, ``skip`` (known to have no data) or ``full``."""
    have = spans(candles)
    rows = universe.select("token").join(have, "token", "left").join(marked.select("token", F.lit(True).alias("none")), "token", "left")
    fresh = F.col("latest") >= as_of - F.expr("interval 1 day")
    action = F.when(fresh, "cached").when(F.col("latest").isNotNull(), "refresh").when(F.col("none"), "skip").otherwise("full")
    start = F.when(F.col("latest").isNotNull(), F.date_add(F.to_date("latest"), 1)).otherwise(F.add_months(F.to_date(as_of), -12 * years))
    return rows.select("token", action.alias("action"), F.when(action.isin("refresh", "full"), start).alias("start"))
