import math
import re

from pyspark.sql import functions as F
from tapeloom import queries
from tapeloom.functions import indicators as ind
from tapeloom.functions import recurrences as rec
from tapeloom.operators import signals, trades
from tapeloom.schema import BacktestConfig, Horizon
from tapeloom.sources import candles


def bars(spark):
    """Six tokens with gaps in highs and lows, ends of weeks, and a close that is no number."""
    rows = []
    for token, n in ((1, 1), (2, 9), (3, 15), (4, 700), (5, 120), (6, 90)):
        for k in range(n):
            close = 500.0 + (k * 37 * token) % 41 - (k * k) % 13
            if token == 6 and k == 50:
                close = math.nan
            high, low = (None if k % 29 == 3 else 510.0 + (k * 7) % 31), (None if k % 31 == 5 else 480.0 - (k * 11) % 29)
            rows.append((token, k, high, low, close))
    df = spark.createDataFrame(rows, "token long, k int, high double, low double, close double")
    return df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k") + F.floor(F.col("k") / 5).cast("int") * 2).cast("timestamp")).withColumn("open", F.col("close"))


def folded(df, start, step):
    rows = df.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("b"))
    return rows.select("token", F.explode(F.arrays_zip("b", rec.scan(F.col("b"), start, step).alias("s"))).alias("x")).select("token", "x.b.date", "x.b.close", "x.s")


def same(a, b):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(a) == rows(b)


def test_hilega_folds_as_its_steps(spark):
    def step(s, x):
        now = rec.wilder(s["day"], x["close"], 9)
        return F.struct(now.alias("day"), rec.exponential(s["ema"], rec.rsi(now, 9), 3).alias("ema"))

    df = bars(spark)
    want = folded(df, F.struct(rec.no_prices().alias("day"), rec.no_values().alias("ema")), step)
    want = want.select("token", "date", rec.rsi(F.col("s.day"), 9).alias("rsi"), rec.average_of(F.col("s.ema"), 3).alias("ema"), F.col("s.day").alias("day_state"), F.col("s.ema").alias("ema_state"))
    same(ind.with_hilega(df, state=True).select(want.columns), want)


def test_timeframes_fold_as_their_steps(spark):
    buckets = {"week": ind.week_of, "month": ind.month_of}

    def step(s, x):
        return F.struct(rec.wilder(s["day"], x["close"], 3).alias("day"), *(rec.bucketed(s[k], x["close"], f(x["date"]), 3).alias(k) for k, f in buckets.items()))

    df = bars(spark)
    want = folded(df, F.struct(rec.no_prices().alias("day"), *(rec.no_buckets("date").alias(k) for k in buckets)), step)
    coarse = [rec.rsi(rec.wilder(F.col(f"s.{k}.done"), F.col("close"), 3), 3).alias(f"rsi_{k}ly") for k in buckets]
    want = want.select("token", "date", rec.rsi(F.col("s.day"), 3).alias("rsi"), *coarse, *(F.col(f"s.{k}").alias(f"{k}_state") for k in ("day", *buckets)))
    same(ind.with_mtf_rsi(df, 3, state=True).select(want.columns), want)


def test_nothing_is_known_after_a_null_close(spark):
    df = bars(spark).where("token = 5").withColumn("close", F.when(F.col("k") != 60, F.col("close")))
    for rows in (ind.with_hilega(df), ind.with_mtf_rsi(df)):
        assert [r["k"] for r in rows.where("rsi is not null").orderBy("k").collect()] == list(range(9 if "ema" in rows.columns else 14, 60))


def test_no_bars_give_none(spark):
    assert ind.with_hilega(bars(spark).where("token < 0")).count() == 0
    assert ind.with_mtf_rsi(bars(spark).where("token < 0"), state=True).count() == 0


def test_extremes_are_those_of_the_frames(spark):
    df = bars(spark).select("token", "date", "high", "low")
    for ahead, frames in ((False, {"a": (0, 0), "b": (-8, 0), "c": (-76, -25), "d": (-102, -51), "e": (-7, -1), "f": (-150, -3)}), (True, {"a": (1, 1), "b": (1, 5), "c": (1, 21), "d": (1, 63), "e": (1, 126), "f": (4, 36)})):
        got = ind.with_extremes(df, frames, ahead)
        want = df.withColumns({f"{k}_{s}": of(c).over(ind.frame(*f)) for k, f in frames.items() for s, c, of in (("hi", "high", F.max), ("lo", "low", F.min))})
        same(got, want)


def test_a_bar_costs_no_more_with_wider_frames(spark):
    """No frame that is read anew for each bar has more than NARROW rows, and no recurrence is interpreted element by element."""
    plan = ind.with_ichimoku(bars(spark))._jdf.queryExecution().optimizedPlan().toString()
    sliding = [(int(a), int(b)) for a, b in re.findall(r"(?:max|min)\([^)]*\) windowspecdefinition\([^)]*?specifiedwindowframe\(RowFrame, (-?\d+), (?:currentrow\$\(\)|(-?\d+))\)", plan) if b] + [(int(a), 0) for a in re.findall(r"specifiedwindowframe\(RowFrame, (-\d+), currentrow", plan)]
    assert sliding and all(b - a < ind.NARROW for a, b in sliding)
    for rows in (ind.with_hilega(bars(spark)), ind.with_mtf_rsi(bars(spark))):
        assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString().replace("Aggregate", "")


def test_folded_rules_are_the_columns_rules(spark):
    df = bars(spark)
    for name, s in signals.STRATEGIES.items():
        s = signals.Strategy(s.name, 8, s.rules, s.folded)  # short tokens count too
        want = signals.fired(df, s)
        same(signals.fired_together(df, [s]).select(want.columns), want)
        same(signals.fired_together(ind.gathered(df), [s]).select(want.columns), want)
        assert name == "rsi" or want.count()


def test_folded_legs_are_the_columns_legs(spark):
    df, s = bars(spark), signals.STRATEGIES["hilega"]
    config = BacktestConfig(horizons=(Horizon("A", 1), Horizon("B", 9), Horizon("C", 40)))
    want = trades.legs_of(df, signals.Strategy(s.name, s.warmup, s.rules), config)
    same(trades.legs_of(df, s, config).select(want.columns), want)
    assert want.count()


def test_gathered_lines_are_the_walks_bars(spark):
    rows = []
    for k in range(400):
        odd = lambda n, v: None if (k * 7 + n) % 23 == 0 else v
        rows.append((odd(0, 1 + k % 3), k // 2, odd(1, k % 2), k % 5, odd(2, float(k % 50)), odd(3, k % 11 / 100), odd(4, k % 9 / 100), odd(5, f"1995-01-{1 + k * 13 % 28:02d}")))
    lines = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_tax double, d string").withColumn("l_shipdate", F.to_date("d"))
    want = candles.from_lineitem(lines)
    same(candles.gathered_lineitem(lines).select("token", F.explode("bars").alias("x")).select("token", "x.*"), want)
    assert candles.gathered_lineitem(lines.limit(0)).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_confluence_moves_bars_once(spark):
    """Lines meet by token, then only signals do: no fold is followed by another exchange of the bars, and legs join none."""
    d = "/root/testdata/sf0.001"
    found = plan(queries.confluence_any(spark, d))
    assert found.count("Exchange hashpartitioning(token") + found.count("Exchange hashpartitioning(l_suppkey") == 2
    legs = plan(queries.confluence_legs(spark, d))
    assert legs.count("FileScan") == 1 and "Join" not in legs


def test_backtests_take_one_exchange_and_no_window(spark):
    for q in (queries.trades_table, queries.legs_fixed):
        found = plan(q(spark, "/root/testdata/sf0.001"))
        assert "Window" not in found and found.count("FileScan") == 1
