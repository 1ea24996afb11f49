"""Statistics of legs by group, and extremes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import work_folder

#: Rank error of the sketch that brackets a median, as a share of a group's rows.
BRACKET = 1_000
#: Bins of equal width that a bracket is counted in, before the values of the middle ones are ranked.
BINS = 4_096


def _bracket(value: Column) -> Column:
    """Two values with the middle ranks between them, from a mergeable sketch."""
    return F.percentile_approx(value, F.array(F.lit(0.5 - 3 / BRACKET), F.lit(0.5 + 3 / BRACKET)), F.lit(BRACKET * 2))


def _middle(rows: DataFrame, ends: DataFrame, keys: list[str], value: str, few: bool) -> DataFrame:
    """The exact medians, given each group's bracket ``__e`` and count ``__n``.

    Values below the bracket are only counted, by a pre-aggregation. Those within
    are counted by value, then by bin; only the distinct values of the one or two
    bins that hold the middle ranks are ranked, so that no task holds a group's
    bracket.
    """
    ends = ends.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__e")[0].alias("__lo"), F.col("__e")[1].alias("__hi"), "__n")
    rows = rows.where(F.col(value).isNotNull()).select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.col(value).alias("__v"))
    same = lambda a, b: reduce(Column.__and__, (F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys), F.lit(True))
    near = rows.join(F.broadcast(ends) if few else ends, same("__r_", "__k_")).where(F.col("__v") <= F.col("__hi"))
    inside = F.floor((F.col("__v") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * BINS)  # rises with the value
    bin_ = F.when(F.col("__v") >= F.col("__lo"), F.coalesce(inside, F.lit(0))).otherwise(-1)
    near = near.withColumns({"__bin": bin_, "__v": F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))})
    counted = near.groupBy(*(F.col(f"__r_{k}").alias(k) for k in keys), "__bin", "__v").agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))

    def placed(df: DataFrame, by: list[str], order: str, base: Column) -> DataFrame:
        upto = F.sum("__c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("__to", base + upto).withColumn("__from", F.col("__to") - F.col("__c"))

    low, high = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    holds = lambda r: (F.col("__from") < r) & (F.col("__to") >= r)
    bins = counted.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__c"), F.first("__n").alias("__n"))
    middle = placed(bins, keys, "__bin", F.lit(0)).where((holds(low) | holds(high)) & (F.col("__bin") >= 0))
    middle = middle.select(*(F.col(k).alias(f"__m_{k}") for k in keys), F.col("__bin").alias("__b"), F.col("__from").alias("__base"))
    ranked = counted.withColumnsRenamed({k: f"__c_{k}" for k in keys}).join(middle, same("__c_", "__m_") & (F.col("__bin") == F.col("__b")))
    ranked = placed(ranked.withColumnsRenamed({f"__c_{k}": k for k in keys}), [*keys, "__bin"], "__v", F.col("__base"))
    return ranked.groupBy(*keys).agg(((F.max(F.when(holds(low), F.col("__v"))) + F.max(F.when(holds(high), F.col("__v")))) / 2).alias("median_pct"))


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` and ``median_pct``: the exact, interpolated median of each group.

    A built-in exact percentile holds all values of a group in one task; here no
    task holds more than the distinct values of a bin of the bracket, or its bins.
    """
    rows = rows.where(F.col(value).isNotNull())
    return _middle(rows, rows.groupBy(*keys).agg(_bracket(F.col(value)).alias("__e"), F.count("*").alias("__n")), keys, value, few=False)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics of valid legs by ``keys``; trade counts are of all legs."""
    r = F.when(F.col("valid"), F.col("return_pct"))
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("signals"), F.count_if(F.col("direction") == "LONG").alias("longs"), F.count_if(F.col("direction") == "SHORT").alias("shorts"),
        F.count(r).alias("n"), F.count(win).alias("wins"), F.count(loss).alias("losses"), _zero(F.avg(r)).alias("avg_pct"), _zero(F.sum(r)).alias("total_pct"),
        _zero(F.stddev_samp(r)).alias("stddev_pct"), _zero(F.max(r)).alias("best_pct"), _zero(F.min(r)).alias("worst_pct"), _zero(F.avg(win)).alias("avg_win_pct"), _zero(F.avg(loss)).alias("avg_loss_pct"),
        _bracket(r).alias("__e"), _zero(F.sum(win)).alias("__gain"), _zero(F.sum(loss)).alias("__pain"), _zero(F.avg(F.when(F.col("valid"), F.col("mfe_pct")))).alias("avg_mfe_pct"), _zero(F.avg(F.when(F.col("valid"), F.col("mae_pct")))).alias("avg_mae_pct"),
    )
    factor = F.when(F.col("__pain") < 0, F.col("__gain") / -F.col("__pain")).when(F.col("__gain") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.withColumns(
        {
            "flat": F.col("n") - F.col("wins") - F.col("losses"),
            "win_pct": F.when(F.col("n") > 0, F.col("wins") / F.col("n") * 100).otherwise(0.0),
            "sharpe": F.when(F.col("stddev_pct") > 0, F.col("avg_pct") / F.col("stddev_pct")).otherwise(0.0),
            "payoff_ratio": F.when((F.col("wins") > 0) & (F.col("losses") > 0), F.col("avg_win_pct") / F.abs("avg_loss_pct")).otherwise(0.0),
            "profit_factor": factor,
        }
    ).drop("__gain", "__pain")


def summarize(legs: DataFrame) -> DataFrame:
    """18 statistics by horizon for all trades, by signal, by direction and by signal year.

    One pass: each leg counts in its four groups, which are pre-aggregated
    before the shuffle. Only the medians need a second one; the table of groups
    that it reads is broadcast, since rules, sides, years and horizons bound it.
    The legs are measured at once and written to a work folder.
    """
    groups = F.array(
        F.struct(F.lit("overall").alias("t"), F.lit("ALL SIGNALS").alias("g")), F.struct(F.lit("signal").alias("t"), F.col("variant").alias("g")),
        F.struct(F.lit("direction").alias("t"), F.col("direction").alias("g")), F.struct(F.lit("year").alias("t"), F.year("date").cast("string").alias("g")),
    )
    keys = ["group_type", "group", "horizon", "horizon_days"]
    # Read several times: written, so that legs are not measured again, even where an executor is lost.
    path = f"{work_folder(legs.sparkSession)}/legs"
    legs.select("horizon", "horizon_days", "valid", "return_pct", "mfe_pct", "mae_pct", "direction", "variant", "date").write.parquet(path)
    legs = legs.sparkSession.read.parquet(path)
    rows = legs.select("horizon", "horizon_days", "valid", F.when(F.col("valid"), F.col("return_pct")).alias("return_pct"), "mfe_pct", "mae_pct", "direction", F.explode(groups).alias("x"))
    rows = rows.select("*", F.col("x.t").alias("group_type"), F.col("x.g").alias("group")).drop("x")
    stats = _statistics(rows, keys)
    middle = _middle(rows, stats.withColumn("__n", F.col("n")), keys, "return_pct", few=True)
    middle = middle.select(*(F.col(k).alias(f"__m_{k}") for k in keys), "median_pct")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__m_{k}"))
    return stats.drop("__e").join(middle, same, "left").drop(*(f"__m_{k}" for k in keys)).withColumn("median_pct", _zero(F.col("median_pct")))


def ordered(summary: DataFrame, primary: str) -> DataFrame:
    """Summary rows as a report lists them: signals by falling primary average, other groups by name."""
    kind = F.array_position(F.array(*map(F.lit, ("overall", "signal", "direction", "year"))), F.col("group_type"))
    key = F.max(F.when(F.col("horizon") == primary, F.col("avg_pct"))).over(Window.partitionBy("group_type", "group"))
    rows = summary.withColumns({"__kind": kind, "__key": key})
    return rows.orderBy("__kind", F.when(F.col("group_type") == "signal", -F.col("__key")), "group", "horizon_days").drop("__kind", "__key")


def top_trades(legs: DataFrame, horizon: str, n: int, best: bool = True) -> DataFrame:
    """The ``n`` best or worst valid legs of a horizon; ties by date, symbol (token where there is none) and variant."""
    rows = legs.where((F.col("horizon") == horizon) & F.col("valid"))
    return rows.orderBy(F.col("return_pct").desc() if best else F.col("return_pct"), "date", *(["symbol"] if "symbol" in legs.columns else []), "token", "variant").limit(n)


def run_counters(candles: DataFrame, legs: DataFrame, warmup: int) -> DataFrame:
    """Tokens replayed and skipped, sessions evaluated and their span, outlier legs."""
    bars = candles.groupBy("token").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    ran = F.col("n") > warmup
    run = bars.agg(
        F.count("*").alias("universe"), F.count_if(ran).alias("replayed"), F.count_if(~ran).alias("skipped"), F.coalesce(F.sum(F.when(ran, F.col("n") - warmup)), F.lit(0)).alias("sessions"),
        F.min(F.when(ran, F.col("first"))).alias("data_start"), F.max(F.when(ran, F.col("last"))).alias("data_end"),
    )
    seen = legs.agg(F.count_if("outlier").alias("outliers"), F.min("date").alias("first_signal"), F.max("date").alias("last_signal"))
    return run.join(seen, how="cross")  # one row each
