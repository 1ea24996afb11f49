"""Agreement between strategies on one token within a few sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LONG, SHORT, BacktestConfig, ConfluenceOptions, Horizon
from .signals import cooled


def compact(strategy: Column, variant: Column) -> Column:
    """A short name: the strategy's first three letters, upper-cased, and the rest of the variant."""
    rest = F.trim(F.when(F.startswith(variant, strategy), F.substring(variant, F.length(strategy) + 1, F.length(variant))).otherwise(variant))
    tag = F.upper(F.substring(strategy, 1, 3))
    return F.when(rest == "", tag).otherwise(F.concat_ws(" ", tag, rest))


def _matched(trades: DataFrame, strategies: list[str], opt: ConfluenceOptions) -> DataFrame:
    """Each trade as an anchor: how many other strategies agree, whether one only disagrees, the earliest agreeing session, the names.

    The band self-join is a window: for each strategy and side, the latest
    session within the band at or before the anchor. One shuffle by token, and
    the band's rows are all that a frame reads.
    """
    band = Window.partitionBy("token").orderBy("session_idx").rangeBetween(-max(0, opt.window), 0)
    rows = trades
    if opt.require_all:
        rows = rows.withColumn("__fired", F.size(F.collect_set("strategy").over(Window.partitionBy("token")))).where(F.col("__fired") >= len(strategies)).drop("__fired")
    latest = {}
    for k, name in enumerate(strategies):
        for side in (LONG, SHORT):
            hit = (F.col("strategy") == name) & (F.col("direction") == side)
            latest[f"__{side}{k}"] = F.max(F.when(hit, F.struct("session_idx", "strategy", "variant"))).over(band)
    rows = rows.withColumns(latest)
    others = []
    for k, name in enumerate(strategies):
        long_, short = F.col(f"__{LONG}{k}"), F.col(f"__{SHORT}{k}")
        mine = F.col("direction") == LONG
        same, opposite = F.when(mine, long_).otherwise(short), F.when(mine, short).otherwise(long_)
        others.append(F.struct((F.col("strategy") != name).alias("other"), same.alias("best"), (same.isNull() & opposite.isNotNull()).alias("against")))
    rows = rows.withColumn("__o", F.filter(F.array(*others), lambda x: x["other"])).drop(*latest)
    rows = rows.withColumn("__best", F.filter(F.transform("__o", lambda x: x["best"]), lambda b: b.isNotNull()))
    return rows.select(
        *trades.columns, F.size("__best").alias("partners"), F.exists("__o", lambda x: x["against"]).alias("conflict"), F.array_min(F.transform("__best", lambda b: b["session_idx"])).alias("earliest"),
        F.transform("__best", lambda b: compact(b["strategy"], b["variant"])).alias("names"),
    )


def conflicts(trades: DataFrame, strategies: list[str], opt: ConfluenceOptions) -> DataFrame:
    """How many anchors met a strategy that only disagreed (one row)."""
    return _matched(trades, strategies, opt).agg(F.count_if("conflict").alias("conflicts"))


def confluence(trades: DataFrame, strategies: list[str], opt: ConfluenceOptions = ConfluenceOptions(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Events where other strategies (all, or any) agreed within the window before an anchor.

    ``trades`` has one row for each trade (``token, date, session_idx, strategy,
    variant, direction, entry_price``); ``strategies`` names those that took part.
    One event for each token, side and session (the first anchor by variant),
    then the greedy cooldown by token and side. The event's name lists the short
    names in order. ``keep`` names more columns of the anchor that its event keeps.
    Everything happens within one partitioning by token.
    """
    if len(strategies) < 2 or len(set(strategies)) != len(strategies):
        raise ValueError("confluence needs two different strategies or more")
    need = len(strategies) - 1 if opt.require_all else 1
    rows = trades.select("token", "date", "session_idx", "strategy", "variant", "direction", "entry_price", *keep)
    hits = _matched(rows, strategies, opt).where(F.col("partners") >= need)
    first = Window.partitionBy("token", "direction", "session_idx").orderBy("variant", "strategy")
    hits = hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    names = F.array_sort(F.concat(F.array(compact(F.col("strategy"), F.col("variant"))), F.col("names")))
    events = hits.select("token", "direction", "session_idx", "date", "entry_price", F.array_join(names, "  +  ").alias("variant"), (F.col("session_idx") - F.least("session_idx", "earliest")).alias("align_gap"), *keep)
    events = cooled(events, opt.cooldown, ("token", "direction"))
    return events.select("token", "date", "session_idx", F.lit("Confluence").alias("strategy"), "variant", "direction", "entry_price", "align_gap", *keep)


def mean_gap(events: DataFrame) -> DataFrame:
    """How many events there are, and how many sessions their strategies lay apart on average (one row)."""
    return events.agg(F.count("*").alias("events"), F.avg("align_gap").alias("mean_gap"))


def common_horizons(configs: list[BacktestConfig]) -> tuple[Horizon, ...]:
    """The horizons of runs that are put together; they must be the same ones in the same order."""
    if not configs or any(c.horizons != configs[0].horizons for c in configs):
        raise ValueError("runs to be combined need the same horizons")
    return configs[0].horizons


def combined_counters(counters: list[DataFrame], events: DataFrame) -> DataFrame:
    """Counters of runs that are put together, in their order (one row).

    Each of ``counters`` is a row of ``metrics.run_counters``. Sessions and outlier
    legs add up, the span of data widens; tokens are those of the first run, since
    all read the same candles. First and last signal are those of the ``events``.
    """
    rows = reduce(DataFrame.unionByName, (c.withColumn("__k", F.lit(k)) for k, c in enumerate(counters)))
    out = rows.agg(
        *(F.min_by(c, "__k").alias(c) for c in ("universe", "replayed", "skipped")), F.sum("sessions").alias("sessions"),
        F.min("data_start").alias("data_start"), F.max("data_end").alias("data_end"), F.sum("outliers").alias("outliers"),
    )
    seen = events.agg(F.min("date").alias("first_signal"), F.max("date").alias("last_signal"))
    return out.join(seen, how="cross")  # one row each


def notes(strategies: list[str], opt: ConfluenceOptions, conflicts: int, gap: float | None) -> tuple[str, ...]:
    """What a report says of a combined run: its rule, entry, cooldown, conflicts and mean gap."""
    within = f"within {opt.window} sessions" if opt.window > 0 else "in one session"
    return (
        f"Rule: {'all' if opt.require_all else 'two or more'} of {', '.join(strategies)} on the same side {within}",
        "Entry: at the last of the agreeing signals",
        f"Cooldown: {opt.cooldown} sessions for each token and side",
        f"Conflicts: {conflicts:,} setups in which a strategy was on the other side only",
        f"Mean gap: {gap or 0.0:.1f} sessions between the first and the last agreeing signal",
    )
