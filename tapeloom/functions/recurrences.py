"""Recurrences as columns: one step from a state to the next, and a scan of an array by steps.

A step is used both ways: folded over a token's closed bars, and once, as plain
columns, for a bar that is still running. Both keep one order of operations, so
their readings are equal to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column, Column], Column]

#: States that are appended one by one before they are put aside; appending copies an array.
PART = 64


def scan(values: Column, start: Column, step: Step) -> Column:
    """The states after each element of ``values``, from ``start`` on.

    States are gathered in parts, so that the work grows with the length and not
    with its square.
    """
    last = lambda a: F.element_at(a, -1)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PART).cast("int")), lambda k: F.slice(values, k * PART + 1, F.lit(PART)))
    parts = F.when(F.size(values) > 0, parts).otherwise(F.slice(parts, F.lit(1), F.lit(0)))

    def more(out: Column, part: Column) -> Column:
        return F.array_append(out, F.aggregate(part, F.array(last(last(out))), lambda own, x: F.array_append(own, step(last(own), x))))

    done = F.aggregate(parts, F.array(F.array(start)), more)
    return F.flatten(F.transform(done, lambda a: F.slice(a, F.lit(2), F.size(a) - 1)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` reads it; for use within a step."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def no_prices() -> Column:
    """Wilder's state before any price: their count, the last, and the averages (sums, until there are enough) of gains and losses."""
    return F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("last"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))


def wilder(state: Column, price: Column, period: int) -> Column:
    """Wilder's state after one more price."""
    d = price - state["last"]
    up, down = F.when(d > 0, d).otherwise(0.0), F.when(d > 0, 0.0).otherwise(-d)

    def average(held: Column, change: Column) -> Column:
        return (
            F.when(state["n"] == 0, 0.0)
            .when(state["n"] < period, held + change)
            .when(state["n"] == period, (held + change) / float(period))
            .otherwise((held * float(period - 1) + change) / float(period))
        )

    return F.struct((state["n"] + 1).alias("n"), price.alias("last"), average(state["gain"], up).alias("gain"), average(state["loss"], down).alias("loss"))


def rsi(state: Column, period: int) -> Column:
    """The RSI of a state, null before ``period`` changes."""
    return F.when(state["n"] > period, F.when(state["loss"] == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + state["gain"] / state["loss"])))


def no_values() -> Column:
    """An exponential average's state before any value: their count, and the average (the sum, until there are enough)."""
    return F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("value"))


def exponential(state: Column, value: Column, period: int) -> Column:
    """The exponential average's state after one more value; a null one changes nothing."""
    k = 2.0 / (period + 1.0)
    n, held = state["n"], state["value"]
    new = F.when(value.isNull(), held).when(n < period - 1, held + value).when(n == period - 1, (held + value) / float(period)).otherwise(value * k + held * (1 - k))
    return F.struct(F.when(value.isNull(), n).otherwise(n + 1).alias("n"), new.alias("value"))


def average_of(state: Column, period: int) -> Column:
    return F.when(state["n"] >= period, state["value"])


def no_buckets(bucket: str) -> Column:
    """The state of a coarser timeframe before any bar: Wilder's over the buckets before the latest, that bucket (of SQL type ``bucket``) and its close so far."""
    return F.struct(no_prices().alias("done"), F.lit(None).cast(bucket).alias("bucket"), F.lit(0.0).alias("close"))


def finished(state: Column, bucket: Column, period: int) -> Column:
    """Wilder's state over the buckets that are complete when a bar falls into ``bucket``."""
    over = state["bucket"].isNotNull() & (state["bucket"] != bucket)
    return F.when(over, wilder(state["done"], state["close"], period)).otherwise(state["done"])


def bucketed(state: Column, price: Column, bucket: Column, period: int) -> Column:
    """The state of a coarser timeframe after one more bar."""
    return F.struct(finished(state, bucket, period).alias("done"), bucket.alias("bucket"), price.alias("close"))
