"""The live path as Structured Streaming, with the same functions for batches.

Event time is the tick's own; days are those of one zone. Ticks of a token meet
in one state, in order of time, so no two are evaluated out of order.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.formats import alert_payload
from ..functions import recurrences as rec
from ..functions.indicators import LIVE_MIDPOINTS, by_bar, ichimoku_clouds, month_of, session_index, week_of, with_extremes, with_hilega, with_mtf_rsi
from ..operators.signals import STRATEGIES, direction, gfs_variant, hilega_variant, ichimoku_variant, tier
from ..scratch import delete, exists

ZONE = "Asia/Kolkata"
#: The setting that ``snapshots`` needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def ticks(events: DataFrame) -> DataFrame:
    """``(token, ts, price)`` from an event table or stream."""
    return events.select(F.col("user_id").alias("token"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


def _day(zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp("ts", zone))


def intraday_bars(rows: DataFrame, zone: str = ZONE, late: str | None = None) -> DataFrame:
    """The running bar of each token and local day: first, highest, lowest, last price and the tick count.

    On a stream, ``late`` is the watermark's delay, in local time (an hour at least
    where clocks go back at midnight); output mode ``update`` gives the bar after
    each micro-batch. Partial aggregates combine before the shuffle.
    """
    # In local time a day is a tumbling window, whatever its length, that the watermark can close.
    rows = rows.withColumn("local", F.from_utc_timestamp("ts", zone))
    if late:
        rows = rows.withWatermark("local", late)
    w = F.window("local", "1 day")
    got = rows.groupBy(w.alias("w"), "token").agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("ticks"))
    return got.select("token", F.to_date("w.start").alias("day"), "open", "high", "low", "close", "ticks")


_BAR = "day date, until long, open double, high double, low double, close double, ticks long"


class RunningBars(StatefulProcessor):
    """Each token's running bar as a value state ``bar``: moved by every tick, begun anew on a new day, cleared after its day's end.

    A timer is set for ``until`` (in milliseconds, ``keep`` after local midnight),
    so that a token without further ticks leaves nothing behind.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", _BAR)

    def _hold(self, bar: tuple, now: int) -> None:
        self.bar.update(bar)
        self.handle.registerTimer(max(bar[1], now + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bar = self.bar.get() if self.bar.exists() else None
        ticks = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        for ts, price, day, until in zip(ticks["ts"], ticks["price"], ticks["day"], ticks["until"], strict=True):
            if bar is not None and day < bar[0]:
                continue
            bar = (day, until, price, price, price, price, 1) if bar is None or bar[0] != day else (day, bar[1], bar[2], max(bar[3], price), min(bar[4], price), price, bar[6] + 1)
            out.append((key[0], ts, day, *bar[2:]))
        if bar is not None:
            self._hold(tuple(x.item() if hasattr(x, "item") else x for x in bar), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["token", "ts", "day", "open", "high", "low", "close", "ticks"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.bar.exists() and self.bar.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.bar.clear()
        yield from ()

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self._hold((r["day"], int(r["until"]), *(float(r[c]) for c in ("open", "high", "low", "close")), int(r["ticks"])), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _ends(zone: str, keep: str) -> Column:
    """``keep`` after the end of the local ``day``, in milliseconds."""
    return F.unix_millis(F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp"), zone) + F.expr(f"interval {keep}"))


def snapshots(rows: DataFrame, zone: str = ZONE, keep: str = "2 days", initial: DataFrame | None = None) -> DataFrame:
    """The running bar after every tick of a stream.

    A late tick of a day before the running bar's changes nothing and gives no
    row. A token's bar is a value state that is dropped ``keep`` after its day's
    end; between runs it can be read by ``held_bars``. ``initial`` (rows as
    ``intraday_bars`` gives them, one a token) seeds the bars of a query that
    starts without a checkpoint of its own, after a loss of the old one, say; the
    ticks in them must not come again. Needs the RocksDB state store
    (``STATE_STORE``, which ``tapeloom.session`` sets).
    """
    prepared = rows.withWatermark("ts", keep).withColumn("day", _day(zone)).withColumn("until", _ends(zone, keep))
    seeds = None if initial is None else initial.select("token", "day", _ends(zone, keep).alias("until"), "open", "high", "low", "close", "ticks").groupBy("token")
    schema = "token long, ts timestamp, day date, open double, high double, low double, close double, ticks long"
    return prepared.groupBy("token").transformWithStateInPandas(RunningBars(), schema, "Append", "EventTime", initialState=seeds)


def held_bars(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The running bars that a stopped ``snapshots`` query holds: ``token, day, open, high, low, close, ticks``."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "bar").load()
    return state.select(F.col("key.token").alias("token"), *(F.col(f"value.{c}").alias(c) for c in ("day", "open", "high", "low", "close", "ticks")))


def first_of_day(signals: DataFrame, zone: str = ZONE, late: str | None = None) -> DataFrame:
    """The first signal of each strategy, token and local day (not of each variant).

    On a stream give ``late``, the watermark's delay in local time (an hour at
    least where clocks go back at midnight). The first to arrive passes (of those
    in one micro-batch any one), and a day's keys are held until the watermark is
    past local midnight. No Python worker takes part.
    """
    if late is None:
        rows = signals.withColumn("day", _day(zone))
        order = F.struct("ts", "variant")
        return rows.groupBy("strategy", "token", "day").agg(F.min(order).alias("first")).select("strategy", "token", "day", F.col("first.ts").alias("ts"), F.col("first.variant").alias("variant"))
    # In local time a day is a tumbling window, whatever its length, that the watermark can close.
    rows = signals.withColumn("local", F.from_utc_timestamp("ts", zone)).withWatermark("local", late)
    rows = rows.select("strategy", "token", F.window("local", "1 day").alias("w"), "ts", "variant").dropDuplicates(["strategy", "token", "w"])
    return rows.select("strategy", "token", F.to_date("w.start").alias("day"), "ts", "variant")


def _last_bars(rows: DataFrame, every: bool) -> DataFrame:
    """Each token's last bar (or ``every`` one), with ``idx`` of the bar that comes next."""
    last = F.max("date").over(by_bar().rowsBetween(0, 1)) == F.col("date")  # no bar follows
    rows = rows.withColumns({"__last": last, "idx": session_index() + 1})
    return (rows if every else rows.where("__last")).drop("__last")


def _lines_carried(candles: DataFrame) -> tuple[DataFrame, list[str]]:
    """``candles`` with what the bars so far say of the next one's Ichimoku lines, and the names of these columns.

    The frames of the live session reach the running bar or end before it; each
    is taken here as far as closed bars go, as its highest high and lowest low.
    """
    refs = {f"{c}_{n}": F.lag(c, n - 1).over(by_bar()) for c in ("high", "low") for n in (26, 27)}
    frames = {name: (first + 1, min(to + 1, 0)) for name, (first, to) in LIVE_MIDPOINTS.items()}
    rows = with_extremes(candles, frames).withColumns(refs | {"prev_close": F.col("close")})
    return rows, ["prev_close", *(f"{name}_{s}" for name in frames for s in ("hi", "lo")), *refs]


def _rsi_carried(candles: DataFrame, period: int = 14) -> tuple[DataFrame, list[str]]:
    """``candles`` with the RSI's recurrences by day, week and month, and the bar's RSI; the names of these columns."""
    rows = with_mtf_rsi(candles, period, state=True).withColumnRenamed("rsi", "prev_rsi")
    return rows, ["prev_rsi", "day_state", "week_state", "month_state"]


def _hilega_carried(candles: DataFrame, rsi: int = 9, ema: int = 3, weighted: int = 21) -> tuple[DataFrame, list[str]]:
    """``candles`` with what carries the Hilega lines on: the recurrences, the next weighted average's sum but for its last term, the last two averages and the tier; the names of these columns."""
    rows = with_hilega(candles, rsi, ema, weighted, state=True).withColumn("prev_wma", F.lag("wma", 1).over(by_bar()))
    older = reduce(Column.__add__, (F.lag("rsi", weighted - 2 - k).over(by_bar()) * float(k + 1) for k in range(weighted - 1)))
    rows = rows.withColumns({"older": older, "tier_before": tier(F.col("rsi"), F.col("ema"), F.col("wma"), F.col("prev_wma"))})
    return rows.withColumnRenamed("day_state", "rsi_state"), ["older", "wma", "prev_wma", "tier_before", "rsi_state", "ema_state"]


def _closed(carried: tuple[DataFrame, list[str]], every: bool) -> DataFrame:
    rows, names = carried
    return _last_bars(rows, every).select("token", "idx", *names)


def closed_lines(candles: DataFrame, every: bool = False) -> DataFrame:
    """What each token's closed bars say of its next bar's lines: one row a token, or with ``every`` for each bar as if it were the last."""
    return _closed(_lines_carried(candles), every)


def closed_rsi(candles: DataFrame, period: int = 14, every: bool = False) -> DataFrame:
    """The RSI's recurrences after each token's closed bars, by day, week and month, and the last bar's RSI: one row a token (or bar)."""
    return _closed(_rsi_carried(candles, period), every)


def closed_hilega(candles: DataFrame, rsi: int = 9, ema: int = 3, weighted: int = 21, every: bool = False) -> DataFrame:
    """What carries the Hilega lines on after each token's closed bars: one row a token (or bar)."""
    return _closed(_hilega_carried(candles, rsi, ema, weighted), every)


def _ichimoku_now(rows: DataFrame) -> DataFrame:
    mids = {}
    for name, (_, to) in LIVE_MIDPOINTS.items():
        hi, lo = F.col(f"{name}_hi"), F.col(f"{name}_lo")
        mids[name] = (F.greatest(hi, "high") + F.least(lo, "low")) / 2 if to == 0 else (hi + lo) / 2
    return ichimoku_clouds(rows.withColumns(mids)).withColumn("variant", ichimoku_variant())


def _rsi_now(rows: DataFrame, period: int = 14, mtf_level: float = 60.0) -> DataFrame:
    """One provisional step of each recurrence; a bar that opens a week or month first completes the one before."""
    price = F.col("close")
    rows = rows.withColumns({"__week": rec.finished(F.col("week_state"), week_of(F.col("day")), period), "__month": rec.finished(F.col("month_state"), month_of(F.col("day")), period)})
    now = {"rsi": "day_state", "rsi_weekly": "__week", "rsi_monthly": "__month"}
    rows = rows.withColumns({name: rec.rsi(rec.wilder(F.col(state), price, period), period) for name, state in now.items()})
    return rows.withColumn("variant", gfs_variant(F.col("prev_rsi"), F.col("rsi"), F.col("rsi_weekly"), F.col("rsi_monthly"), mtf_level)).drop("__week", "__month")


def _hilega_now(rows: DataFrame, rsi: int = 9, ema: int = 3, weighted: int = 21, long_only: bool = False) -> DataFrame:
    """The lines one bar on: the recurrences take a step, and the weighted average's sum gets its last term."""
    rows = rows.withColumn("rsi", rec.rsi(rec.wilder(F.col("rsi_state"), F.col("close"), rsi), rsi))
    moved = (F.col("older") + F.col("rsi") * float(weighted)) / (weighted * (weighted + 1) / 2)
    rows = rows.withColumns({"ema": rec.average_of(rec.exponential(F.col("ema_state"), F.col("rsi"), ema), ema), "__now": moved})
    rows = rows.withColumn("tier", tier(F.col("rsi"), F.col("ema"), F.col("__now"), F.col("wma")))
    return rows.withColumn("variant", hilega_variant(F.col("tier"), F.col("tier_before"), F.col("prev_wma"), long_only)).drop("__now")


#: By strategy: what its closed bars carry on, and its rules for a running bar.
LIVE: dict[str, tuple[Callable[..., DataFrame], Callable[..., DataFrame]]] = {
    "ichimoku": (closed_lines, _ichimoku_now),
    "rsi": (closed_rsi, _rsi_now),
    "hilega": (closed_hilega, _hilega_now),
    "hilega-long": (closed_hilega, partial(_hilega_now, long_only=True)),
}
_CARRIED = {"ichimoku": _lines_carried, "rsi": _rsi_carried, "hilega": _hilega_carried, "hilega-long": _hilega_carried}


def closed_states(candles: DataFrame, names: list[str] | None = None, every: bool = False) -> DataFrame:
    """One row a token (or bar) with all that the strategies' rules need of closed bars, each strategy's as a struct of its name.

    Compute it once after the market closes, and again after each roll-up.
    """
    out = None
    for name in names or [n for n in LIVE if n != "hilega-long"]:
        rows = LIVE[name][0](candles, every=every)
        rows = rows.select("token", "idx", F.struct(*(c for c in rows.columns if c not in ("token", "idx"))).alias(name))
        out = rows if out is None else out.join(rows, ["token", "idx"])
    return out


def live_signals(bars: DataFrame, closed: DataFrame, on: tuple[str, ...] = ("token",)) -> DataFrame:
    """Signals of running bars (``token, ts, day, open, high, low, close``), each row evaluated by itself by all strategies of ``closed``.

    ``closed`` comes from ``closed_states``. On a stream of ``snapshots`` this is a
    stream-static join with a row for each token and column rules, so that every
    tick is evaluated by every strategy without a state of its own. ``day`` is the
    bar's date, by which it falls into a week and month. Feed the result to
    ``first_of_day``.
    """
    names = [c for c in closed.columns if c in LIVE]
    rows = bars.join(closed.select(*on, *(["idx"] if "idx" not in on else []), *names), list(on))
    return _signals_of(rows.select(*_RUNNING, *(F.col(n).alias(f"__{n}") for n in names)), names)


_RUNNING = ["token", "ts", "idx", "day", "open", "high", "low", "close"]


def every_bar_signals(candles: DataFrame, names: list[str]) -> DataFrame:
    """The signals of each bar as the running one, against what the bars before it carry on.

    The next bar meets what a bar carries in one ordering by token, so that
    candles are built once and nothing is joined. Folds come first; the windows
    of the lines then stay in one order.
    """
    rows = candles.select("token", "date", "open", "high", "low", "close")
    for name in sorted(names, key=lambda n: n == "ichimoku"):
        got, carried = _CARRIED[name](rows)
        rows = got.select(*rows.columns, F.struct(*carried).alias(f"__{name}"))
    rows = rows.withColumns({"idx": session_index(), **{f"__{n}": F.lag(f"__{n}", 1).over(by_bar()) for n in names}}).where("idx >= 1")
    return _signals_of(rows.withColumns({"ts": F.col("date"), "day": F.to_date("date")}).select(*_RUNNING, *(f"__{n}" for n in names)), names)


def _signals_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """Signals of running bars, each with what its closed bars carry on as a struct for each strategy."""
    for name in names:
        state = rows.schema[f"__{name}"].dataType.names
        got = LIVE[name][1](rows.withColumns({c: F.col(f"__{name}.{c}") for c in state}))
        rows = got.select(*rows.columns, F.when(F.col("idx") >= STRATEGIES[name].warmup, F.col("variant")).alias(f"__v_{name}"))
    found = F.array(*(F.struct(F.lit(STRATEGIES[n].name).alias("strategy"), F.col(f"__v_{n}").alias("variant")) for n in names))
    rows = rows.select("token", "ts", "close", F.explode(F.filter(found, lambda x: x["variant"].isNotNull())).alias("x"))
    return rows.select("x.strategy", "token", "ts", "x.variant", direction(F.col("x.variant")).alias("direction"), F.col("close").alias("entry_price"))


def payloads(signals: DataFrame, symbols: DataFrame) -> DataFrame:
    """The JSON body of each alert; a token without a symbol is ``UNKNOWN``."""
    rows = signals.join(symbols.select("token", "symbol"), "token", "left").withColumn("symbol", F.coalesce("symbol", F.lit("UNKNOWN")))
    return rows.select("strategy", "token", "ts", alert_payload(F.col("symbol"), F.col("variant"), F.col("ts")).alias("body"))


class Outbox:
    """What has been sent, by strategy, token and local day, so that a batch that comes again sends only the rest.

    Each alert leaves a mark as soon as it is sent. When all of a batch are, its
    keys are put into the ledger (JSON files by day) by one Spark job, and the
    marks go. Only a break between a sending and its mark sends an alert twice.
    """

    KEYS = ("strategy", "token", "day")
    _SCHEMA = "strategy string, token long, day date"

    def __init__(self, spark: SparkSession, path: str, zone: str = ZONE) -> None:
        self.spark, self.path, self.zone = spark, path, zone

    def _read(self, folder: str) -> DataFrame:
        found = exists(self.spark, f"{self.path}/{folder}")
        return self.spark.read.schema(self._SCHEMA).json(f"{self.path}/{folder}") if found else self.spark.createDataFrame([], self._SCHEMA)

    def sent(self) -> DataFrame:
        return self._read("ledger").union(self._read("marks")).distinct()

    def open(self, batch: DataFrame) -> DataFrame:
        """The batch's alerts that have not been sent, one for each key, with its ``day``."""
        rows = batch.withColumn("day", F.to_date(F.from_utc_timestamp("ts", self.zone)))
        return rows.join(self.sent(), list(self.KEYS), "left_anti").groupBy(*self.KEYS).agg(F.min(F.struct("ts", "body")).alias("__x")).select(*self.KEYS, "__x.*")

    def mark(self, row: Row) -> None:
        jvm, name = self.spark.sparkContext._jvm, uuid.uuid4().hex
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/marks/{name}.json")
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
        out.write(bytearray(json.dumps({k: str(row[k]) if k == "day" else row[k] for k in self.KEYS}).encode()))
        out.close()

    def close(self, batch: DataFrame) -> None:
        """Put the batch's keys into the ledger."""
        rows = batch.select("strategy", "token", F.to_date(F.from_utc_timestamp("ts", self.zone)).alias("day")).distinct()
        new = rows.join(self._read("ledger"), list(self.KEYS), "left_anti")
        new.coalesce(1).write.mode("append").partitionBy("day").json(f"{self.path}/ledger")
        delete(self.spark, f"{self.path}/marks")


def alerts(stream: DataFrame, send: Callable[[str], None], checkpoint: str, per_second: float = 2.0, burst: int = 5, attempts: int = 5, outbox: Outbox | None = None) -> DataStreamWriter:
    """A writer that posts each row's ``body`` by ``send``, no faster than the limit, trying again after failures.

    An error that carries ``retry_after`` (seconds, from a receiver that limits its
    senders) is waited for just so long, and a little; other errors ever longer.
    After a crash a batch comes again: with an ``outbox`` (rows then need
    ``strategy``, ``token`` and ``ts``) only what is not marked as sent goes out,
    without one all of it. Few rows pass the daily deduplication; they are
    streamed to the driver, which alone knows the limit.
    """
    tokens, last = [float(burst)], [time.monotonic()]

    def wait() -> None:
        now = time.monotonic()
        tokens[0] = min(burst, tokens[0] + (now - last[0]) * per_second)
        last[0] = now
        if tokens[0] < 1:
            time.sleep((1 - tokens[0]) / per_second)
            tokens[0], last[0] = 1.0, time.monotonic()
        tokens[0] -= 1

    def post(batch: DataFrame, _: int) -> None:
        if outbox is None:
            return each(batch.select("body"), lambda row: None)
        each(outbox.open(batch).orderBy("ts", "strategy", "token"), outbox.mark)
        outbox.close(batch)

    def each(rows: DataFrame, done: Callable[[Row], None]) -> None:
        for row in rows.toLocalIterator():
            for attempt in range(attempts):
                wait()
                try:
                    send(row["body"])
                except Exception as e:
                    if attempt == attempts - 1:
                        raise
                    asked = getattr(e, "retry_after", None)
                    time.sleep(asked + 0.05 if asked and asked > 0 else min(2**attempt, 30) * 0.05)
                else:
                    done(row)
                    break

    return stream.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint)
