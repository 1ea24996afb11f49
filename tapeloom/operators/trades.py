"""Trade legs: forward returns by horizon, with and without stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import by_bar, sma, with_extremes
from ..schema import SHORT, BacktestConfig, Horizon, StopRule
from .signals import Strategy, cooled, cooled_within, direction, evaluated, fired_together, in_window, within

TRADE = ["token", "date", "session_idx", "strategy", "variant", "direction", "entry_price"]
LEG = ["horizon", "horizon_days", "valid", "exit_date", "exit_price", "return_pct", "mfe_pct", "mae_pct", "stopped", "held_days"]


def signed_return(entry: Column, exit: Column, sign: Column) -> Column:
    """The move from entry to exit in percent, positive when the side gains; 0 without a positive entry."""
    move = (exit - entry) / F.when(entry > 0, entry) * 100.0
    return F.when(entry > 0, sign * move + 0.0).otherwise(0.0)


def _forward(rows: DataFrame, horizons: tuple[Horizon, ...]) -> DataFrame:
    """Per horizon: the bar that it ends on and the extremes on the way, as forward frames."""
    out = {}
    for k, h in enumerate(horizons):
        out |= {f"__c{k}": F.lead("close", h.days).over(by_bar()), f"__d{k}": F.lead("date", h.days).over(by_bar())}
    return with_extremes(rows, {f"__{k}": (1, h.days) for k, h in enumerate(horizons)}, ahead=True).withColumns(out)


def looks(horizons: tuple[Horizon, ...]) -> tuple[str, ...]:
    """The columns of ``_forward``, which ``fired_together`` gives to signals."""
    return tuple(n for k in range(len(horizons)) for n in (f"__c{k}", f"__d{k}", f"__{k}_hi", f"__{k}_lo"))


def _average(stop: StopRule) -> Column:
    return sma(stop.sma) if stop.sma > 0 else F.lit(None).cast("double")


def _bars() -> Column:
    return F.array_sort(F.collect_list(F.struct("date", "open", "high", "low", "close", F.col("__sma").alias("sma"))))


def _ahead(session: Column, horizons: tuple[Horizon, ...]) -> Column:
    return F.slice("__bars", session + 2, F.lit(max(h.days for h in horizons)))


def _stops(trades: DataFrame, candles: DataFrame, horizons: tuple[Horizon, ...], stop: StopRule) -> DataFrame:
    """``__ahead`` of given trades: the bars that follow each one's, up to the longest horizon, with the stop's average.

    A token's bars are gathered once (its sessions bound them) and only trades
    take their part of them; most bars fire no signal.
    """
    whole = candles.withColumn("__sma", _average(stop)).groupBy("token").agg(_bars().alias("__bars"))
    return trades.join(whole, "token").withColumn("__ahead", _ahead(F.col("session_idx"), horizons)).drop("__bars")


def _first_exit(stop: StopRule) -> Column:
    """``(k, fill)`` of the first bar ahead that ends the trade, in prices signed so that every trade is long.

    Within a bar, resting levels come first (they fill within the session, at the
    open where it gaps through), then close rules; the trailing level is armed or
    tightened last, so it is in force from the next bar. A bar without an average
    skips the close rules only.
    """
    sign, entry = F.col("__sign"), F.col("entry_price")
    hard = entry * F.when(sign > 0, 1 - stop.max_loss_pct / 100).otherwise(1 + stop.max_loss_pct / 100) * sign if stop.max_loss_pct > 0 else F.lit(None).cast("double")
    none = F.lit(None).cast("double")

    def step(s: Column, b: Column) -> Column:
        low = F.when(sign > 0, b["low"]).otherwise(-b["high"])
        open_, close, avg = sign * b["open"], sign * b["close"], sign * b["sma"]
        resting = F.greatest(hard, s["level"]) if stop.trail and stop.intraday else hard
        fill = F.when(low <= resting, F.least(resting, open_))
        level = s["level"]
        if stop.sma > 0 and not stop.trail:
            fill = fill.when(close < avg, close)
        elif stop.sma > 0:
            if not stop.intraday:
                fill = fill.when(avg.isNotNull() & (close < s["level"]), close)
            level = F.when(close < avg, F.greatest(s["level"], low)).otherwise(s["level"])
        done = s["fill"].isNotNull()
        return F.struct(
            F.when(done, s["k"]).otherwise(s["k"] + 1).alias("k"),
            F.when(done, s["fill"]).otherwise(fill).alias("fill"),
            F.when(done, s["level"]).otherwise(level).alias("level"),
        )

    zero = F.struct(F.lit(0).alias("k"), none.alias("fill"), none.alias("level"))
    return F.aggregate("__ahead", zero, step)


def _legs(rows: DataFrame, horizons: tuple[Horizon, ...], config: BacktestConfig) -> DataFrame:
    """Explode trades into one row for each horizon. ``rows`` has the columns of ``_forward`` or ``_stops``."""
    stop = config.stop
    entry, sign = F.col("entry_price"), F.col("__sign")
    if stop.active:
        rows = rows.withColumn("__x", _first_exit(stop)).withColumn("__x", F.when(F.col("__x.fill").isNotNull(), F.col("__x")))
    each = []
    for k, h in enumerate(horizons):
        if stop.active:
            hit = F.col("__x.k") <= h.days
            stopped = F.coalesce(hit, F.lit(False))
            reached = F.size("__ahead") >= h.days
            held = F.when(stopped, F.col("__x.k")).when(reached, F.lit(h.days))
            bar = F.get("__ahead", held - 1)
            price = F.when(stopped, sign * F.col("__x.fill")).otherwise(bar["close"])
            way = F.slice("__ahead", F.lit(1), F.coalesce(held, F.lit(0)))
            date, high, low = bar["date"], F.array_max(F.transform(way, lambda b: b["high"])), F.array_min(F.transform(way, lambda b: b["low"]))
        else:
            stopped, held, price = F.lit(False), F.when(F.col(f"__c{k}").isNotNull(), F.lit(h.days)), F.col(f"__c{k}")
            date, high, low = F.col(f"__d{k}"), F.col(f"__{k}_hi"), F.col(f"__{k}_lo")
        parts = {"horizon": F.lit(h.label), "horizon_days": F.lit(h.days), "exit_date": date, "exit_price": price, "high": high, "low": low, "stopped": stopped, "held_days": held}
        each.append(F.struct(*(v.alias(n) for n, v in parts.items())))
    rows = rows.select(*TRADE, "__sign", F.explode(F.array(*each)).alias("x")).select(*TRADE, "__sign", "x.*")
    up = signed_return(entry, F.when(sign > 0, F.col("high")).otherwise(F.col("low")), sign)
    down = signed_return(entry, F.when(sign > 0, F.col("low")).otherwise(F.col("high")), sign)
    rows = rows.withColumn("return_pct", signed_return(entry, F.col("exit_price"), sign) - config.cost_bps / 100.0)
    measured = F.col("held_days").isNotNull() & (entry > 0)
    outlier = measured & (F.abs("return_pct") > config.max_move_pct) if config.max_move_pct > 0 else F.lit(False)
    rows = rows.withColumns({"outlier": outlier, "valid": measured & ~outlier})
    on = lambda c: F.when(F.col("valid"), c)
    return rows.select(
        *TRADE, "horizon", "horizon_days", "valid", on(F.col("exit_date")).alias("exit_date"), on(F.col("exit_price")).alias("exit_price"),
        on(F.col("return_pct")).alias("return_pct"), on(F.greatest("return_pct", up)).alias("mfe_pct"), on(F.least("return_pct", down)).alias("mae_pct"),
        (F.col("valid") & F.col("stopped")).alias("stopped"), on(F.col("held_days")).alias("held_days"), "outlier",
    )


def legs_of(candles: DataFrame, strategy: Strategy, config: BacktestConfig) -> DataFrame:
    """A strategy's trades, one row for each trade and horizon.

    Nothing is joined, and candles are built once. Without a stop
    ``fired_together`` gives the signals of folded rules with their forward look
    (``candles`` may come gathered); else indicators, rules and the
    forward look are columns over one ordering by token. A signal
    enters at its close; with a stop the horizon is a longest holding time, and a
    trade that is still open where the data end has no valid leg. Excursions are
    gross and start from the net return. Moves beyond ``max_move_pct`` are marked
    ``outlier``, not valid.
    """
    if config.stop.active:
        return _measured(_stopped_trades(evaluated(candles, strategy), strategy, config), config)
    if strategy.folded:
        trades = fired_together(candles, [strategy], config.horizons)
    else:
        rows = _forward(evaluated(candles, strategy), config.horizons)
        ahead = [c for c in rows.columns if c.startswith("__")]
        rows = rows.where(F.col("variant").isNotNull() & (F.col("idx") >= strategy.warmup))
        trades = rows.select(
            "token", "date", F.col("idx").cast("int").alias("session_idx"), F.lit(strategy.name).alias("strategy"), "variant",
            direction(F.col("variant")).alias("direction"), F.col("close").alias("entry_price"), *ahead,
        )
    return _measured(cooled(in_window(trades, config.start, config.end), config.cooldown), config)


def _stopped_trades(rows: DataFrame, strategy: Strategy, config: BacktestConfig) -> DataFrame:
    """The trades of evaluated bars, each with the bars ahead of it.

    A token's bars and trades are gathered together, in the partitioning that the
    rules have left; each trade takes its part of the bars within the array.
    """
    fires = F.col("variant").isNotNull() & (F.col("idx") >= strategy.warmup) & within(config.start, config.end)
    trade = F.struct(F.col("idx").cast("int").alias("session_idx"), "variant", "date", F.col("close").alias("entry_price"))
    held = rows.withColumn("__sma", _average(config.stop)).groupBy("token").agg(_bars().alias("__bars"), F.array_sort(F.collect_list(F.when(fires, trade))).alias("__trades"))
    found = F.col("__trades")
    if config.cooldown > 0:
        kinds = F.array_distinct(F.transform(found, lambda t: t["variant"]))
        found = F.flatten(F.transform(kinds, lambda v: cooled_within(F.filter(found, lambda t: t["variant"] == v), config.cooldown)))
    parted = F.transform(found, lambda t: F.struct(t.alias("t"), _ahead(t["session_idx"], config.horizons).alias("__ahead")))
    got = held.select("token", F.explode(parted).alias("x")).select("token", "x.t.*", F.col("x.__ahead"))
    return got.select("token", "date", "session_idx", F.lit(strategy.name).alias("strategy"), "variant", direction(F.col("variant")).alias("direction"), "entry_price", "__ahead")


def _measured(trades: DataFrame, config: BacktestConfig) -> DataFrame:
    return _legs(trades.withColumn("__sign", F.when(F.col("direction") == SHORT, -1.0).otherwise(1.0)), config.horizons, config)


def legs_of_trades(candles: DataFrame, trades: DataFrame, config: BacktestConfig) -> DataFrame:
    """Legs of given trades (``token, session_idx, strategy, variant, direction``), entered at their session's close."""
    rows = candles.withColumn("idx", F.row_number().over(by_bar()) - 1)
    rows = rows if config.stop.active else _forward(rows, config.horizons)
    ahead = [c for c in rows.columns if c.startswith("__")]
    rows = rows.select("token", "date", F.col("idx").cast("int").alias("session_idx"), F.col("close").alias("entry_price"), *ahead)
    rows = trades.select("token", F.col("session_idx").cast("int").alias("session_idx"), "strategy", "variant", "direction").join(rows, ["token", "session_idx"])
    return _measured(_stops(rows, candles, config.horizons, config.stop) if config.stop.active else rows, config)


def legs_ahead(trades: DataFrame, config: BacktestConfig) -> DataFrame:
    """Legs without stops of trades that have kept their ``looks``, so that no bars are joined to them."""
    if config.stop.active:
        raise ValueError("stops need the bars themselves")
    return _measured(trades, config)


def stop_usage(legs: DataFrame, horizon: str) -> DataFrame:
    """Share of valid legs that stopped, and the mean holding time, at one horizon."""
    rows = legs.where((F.col("horizon") == horizon) & F.col("valid"))
    return rows.agg(F.count("*").alias("legs"), (F.avg(F.col("stopped").cast("double")) * 100).alias("stopped_pct"), F.avg("held_days").alias("avg_held"))
