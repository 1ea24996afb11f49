"""A backtest from candles to legs, tables for CSV, and the text report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as f
from ..operators.metrics import ordered, summarize
from ..operators.signals import Strategy
from ..operators.trades import TRADE, legs_of
from ..schema import BacktestConfig, Horizon
from ..sources.instruments import with_symbol
from .report import render


@dataclass
class Result:
    """A run: its legs (lazy), the candles it read and its parameters."""

    strategy: Strategy
    candles: DataFrame
    legs: DataFrame
    config: BacktestConfig
    notes: tuple[str, ...] = ()

    def filtered(self, keep, note: str = "") -> Result:
        """The run with only some trades; counters of the run itself stay."""
        return Result(self.strategy, self.candles, self.legs.where(keep), self.config, self.notes + ((note,) if note else ()))


def run(candles: DataFrame, strategy: Strategy, config: BacktestConfig = BacktestConfig(), symbols: DataFrame | None = None) -> Result:
    legs = legs_of(candles, strategy, config)
    if symbols is not None:
        legs = with_symbol(legs, symbols)
    return Result(strategy, candles, legs, config)


TRADES_HEAD = ["symbol", "token", "strategy", "signal", "direction", "entry_date", "entry_price"]


def trades_table(legs: DataFrame, horizons: tuple[Horizon, ...]) -> DataFrame:
    """One row for each trade, seven columns for each horizon, as text; cells of invalid legs are null."""
    cells = {
        "exit_date": f.day(F.col("exit_date")), "exit_price": f.fixed(F.col("exit_price"), 2), "return_pct": f.fixed(F.col("return_pct"), 4), "mfe_pct": f.fixed(F.col("mfe_pct"), 4),
        "mae_pct": f.fixed(F.col("mae_pct"), 4), "exit_reason": F.when(F.col("stopped"), "stop").otherwise("horizon"), "held_days": F.col("held_days").cast("string"),
    }
    wide = [F.max(F.when(F.col("valid") & (F.col("horizon") == h.label), c)).alias(f"{h.label.lower()}_{name}") for h in horizons for name, c in cells.items()]
    rows = legs if "symbol" in legs.columns else legs.withColumn("symbol", F.concat(F.lit("T"), F.col("token").cast("string")))
    rows = rows.groupBy("symbol", *TRADE).agg(*wide)
    return rows.select(
        "symbol", "token", "strategy", F.col("variant").alias("signal"), "direction", f.day(F.col("date")).alias("entry_date"), f.fixed(F.col("entry_price"), 2).alias("entry_price"),
        *(f"{h.label.lower()}_{name}" for h in horizons for name in cells),
    )


SUMMARY_STATS = ["win_pct", "wins", "losses", "avg_pct", "median_pct", "stddev_pct", "avg_win_pct", "avg_loss_pct", "profit_factor", "payoff_ratio", "sharpe", "best_pct", "worst_pct", "avg_mfe_pct", "avg_mae_pct", "total_pct"]


def summary_table(summary: DataFrame) -> DataFrame:
    """The summary as text cells, four decimals, empty where not finite."""
    cells = [F.col(c).cast("string").alias(c) if c in ("wins", "losses") else f.fixed(F.col(c), 4).alias(c) for c in SUMMARY_STATS]
    return summary.select("group_type", "group", "horizon", "horizon_days", "signals", "n", *cells)


def write_csv(table: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A headed CSV. Rows are range-sorted by ``order``, so files follow each other; nothing is drawn into one task."""
    rows = table.orderBy(*order) if order else table
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_trades(result: Result, path: str) -> None:
    write_csv(trades_table(result.legs, result.config.horizons), path, ["entry_date", "symbol", "signal"])


def write_summary(result: Result, path: str, primary: str) -> None:
    write_csv(summary_table(ordered(summarize(result.legs), primary)), path)


def emit(result: Result, folder: str, primary: str) -> str:
    """Write the two CSV folders and return the text report; names derive from the strategy."""
    stem = result.strategy.name.lower().translate(str.maketrans({" ": "-", "/": "-", "(": "", ")": ""}))
    write_trades(result, f"{folder}/{stem}-trades")
    write_summary(result, f"{folder}/{stem}-summary", primary)
    return render(result, primary)
