import math

import loops
import numpy as np
import pytest

from tapeloom.functions import indicators as ind
from tapeloom.operators import signals


def bars(spark, closes, start="2025-01-01"):
    import datetime as dt

    d = dt.datetime.fromisoformat(start)
    return spark.createDataFrame([(1, d + dt.timedelta(days=i), float(c), c * 1.01, c * 0.99, float(c), 1) for i, c in enumerate(closes)], "token long, date timestamp, open double, high double, low double, close double, volume long")


def column(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


def test_sma(spark):
    assert column(bars(spark, [10, 20, 30, 40, 50]).withColumn("x", ind.sma(3)), "x") == [None, None, 20, 30, 40]
    assert column(bars(spark, [5] * 5 + [100] + [5] * 5).withColumn("x", ind.sma(3)), "x")[-1] == 5
    assert column(bars(spark, [1, 2]).withColumn("x", ind.sma(0)), "x") == [None, None]


def test_wma_ema():
    assert loops.wma_values([1, 2, 3, 4], 3)[2:].tolist() == [14 / 6, 20 / 6]
    assert loops.ema_values([10, 20, 30, 40, 50], 3)[2:].tolist() == [20, 30, 40]
    assert np.isnan(loops.ema_values([1, 2], 3)).all() and np.isnan(loops.wma_values([], 3)).all()


def test_wma_column(spark):
    got = column(bars(spark, [1, 2, 3, 4]).withColumn("x", ind.wma(3)), "x")
    assert got == [None, None, 14 / 6, 20 / 6]


def test_rsi_edges():
    assert loops.rsi_values(range(1, 16), 14)[-1] == 100
    assert loops.rsi_values(range(15, 0, -1), 14)[-1] == 0
    assert np.isnan(loops.rsi_values(range(14), 14)).all()
    assert loops.rsi_values([5] * 15, 14)[-1] == 100  # flat


def test_rsi_worked_example():
    closes = [44.3389, 44.0902, 44.1497, 43.6124, 44.3278, 44.8264, 45.0955, 45.4245, 45.8433, 46.0826, 45.8931, 46.0328, 45.6140, 46.2820, 46.2820]
    assert abs(loops.rsi_values(closes, 14)[-1] - 70.53) < 0.1


def test_bucket_rsi_equals_recomputation():
    rng = np.random.default_rng(3)
    c = 500 + np.cumsum(rng.integers(-5, 6, 300)).astype(float)
    buckets = np.arange(300) // 7
    got = loops.bucket_rsi_values(c, buckets, 14)
    for i in range(0, 300, 11):
        closes = [c[j] for j in range(i + 1) if j == i or buckets[j] != buckets[j + 1]]
        want = loops.rsi_values(closes, 14)[-1]
        assert (math.isnan(want) and math.isnan(got[i])) or abs(want - got[i]) < 1e-9


@pytest.mark.parametrize(("unit", "dates", "want"), [("week", "2024-01-01", [12.0, 15.0]), ("month", "2024-01-01", [15.0])])
def test_resample(spark, unit, dates, want):
    closes = [8, 9, 10, 11, 12, 12, 12, 13, 14, 15]
    got = ind.resampled(bars(spark, closes, dates), unit).orderBy("bucket").collect()
    assert [r["close"] for r in got] == want


def test_iso_year_boundary(spark):
    rows = spark.createDataFrame([(1, "2024-12-30", 50.0), (1, "2025-01-02", 55.0), (1, "2025-01-06", 60.0)], "token long, d string, close double").selectExpr("token", "cast(d as timestamp) as date", "close")
    assert [r["close"] for r in ind.resampled(rows, "week").orderBy("bucket").collect()] == [55.0, 60.0]


def walks(spark):
    """Walks of several lengths with flat stretches, and the closes by token."""
    import datetime as dt

    rng = np.random.default_rng(8)
    closes = {t: (500 + np.cumsum(rng.integers(-4, 5, n) * rng.integers(0, 2, n) * 0.35)).tolist() for t, n in enumerate((700, 430, 131, 64, 22, 15, 14, 9, 1))}
    days = {t: sorted(rng.choice(900, len(c), replace=False).tolist()) for t, c in closes.items()}
    rows = [(t, dt.datetime(2020, 12, 20) + dt.timedelta(days=i), x, x, x, x, 1) for t, c in closes.items() for i, x in zip(days[t], c, strict=True)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "token long, date timestamp, open double, high double, low double, close double, volume long").repartition(3), closes, days


def by_token(df, *names):
    out = {}
    for r in df.orderBy("date").collect():
        for c in names:
            out.setdefault((r["token"], c), []).append(r[c])
    return out


def plain(values):
    return [None if math.isnan(v) else float(v) for v in values]


def test_recurrences_equal_loops_to_the_last_bit(spark):
    df, closes, days = walks(spark)
    got = by_token(ind.with_hilega(df), "rsi", "ema", "wma")
    for t, c in closes.items():
        r = loops.rsi_values(c, 9)
        assert got[t, "rsi"] == plain(r) and got[t, "ema"] == plain(loops.ema_values(r, 3)) and got[t, "wma"] == plain(loops.wma_values(r, 21))
    got = by_token(ind.with_mtf_rsi(df, 5), "rsi", "rsi_weekly", "rsi_monthly")
    start = np.datetime64("2020-12-20")
    for t, c in closes.items():
        d = start + np.array(days[t], "timedelta64[D]")
        assert got[t, "rsi"] == plain(loops.rsi_values(c, 5))
        assert got[t, "rsi_weekly"] == plain(loops.bucket_rsi_values(c, (d.astype(np.int64) + 3) // 7, 5))
        assert got[t, "rsi_monthly"] == plain(loops.bucket_rsi_values(c, d.astype("datetime64[M]").astype(np.int64), 5))


def test_no_candles(spark):
    df = bars(spark, [1.0]).where("false")
    assert ind.with_hilega(df).collect() == [] and ind.with_mtf_rsi(df).collect() == []


def test_bands_are_disjoint_and_bounded(spark):
    from pyspark.sql import functions as F

    grid = spark.range(201).selectExpr("id / 2.0D as p").crossJoin(spark.range(201).selectExpr("id / 2.0D as n"))
    both = grid.where(signals.turned_up(F.col("p"), F.col("n"), signals.GFS) & signals.turned_up(F.col("p"), F.col("n"), signals.ADVANCED_GFS))
    assert both.count() == 0
    edge = spark.createDataFrame([(57.0, 60.0), (57.0, 60.1), (63.0, 63.1), (63.1, 64.0), (56.9, 61.0), (62.0, 61.0)], "p double, n double")
    assert [r[0] for r in edge.select(signals.turned_up(F.col("p"), F.col("n"), signals.ADVANCED_GFS)).collect()] == [False, True, True, False, False, False]


def test_tiers(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(
        [(60.0, 58.0, 52.0, 51.0), (60.0, 58.0, 49.0, 48.0), (40.0, 42.0, 45.0, 46.0), (40.0, 42.0, 55.0, 56.0), (50.0, 49.0, 48.0, 47.0), (60.0, 58.0, 52.0, 53.0), (55.0, 54.0, 52.0, 51.0)],
        "r double, e double, w double, p double",
    )
    got = [x[0] for x in rows.select(signals.tier(F.col("r"), F.col("e"), F.col("w"), F.col("p"))).collect()]
    assert got == ["BUY-2", "BUY-1", "SELL-2", "SELL-1", None, None, None]


def transcribed_ichimoku(rows):
    """A bar-by-bar check of the rules on plain lists."""
    out = []
    H, L, C, O = ([r[k] for r in rows] for k in ("high", "low", "close", "open"))
    for i in range(len(rows)):
        if i < 110:
            continue

        def mid(a, b):
            return (max(H[i + a : i + b + 1]) + min(L[i + a : i + b + 1])) / 2

        cv, bl, pcv, pbl, c26, c27 = mid(-8, 0), mid(-25, 0), mid(-8, -1), mid(-25, -1), mid(-33, -25), mid(-34, -26)
        a, b = (mid(-33, -25) + mid(-50, -25)) / 2, mid(-76, -25)
        a52, b52 = (mid(-59, -51) + mid(-76, -51)) / 2, mid(-102, -51)
        top, bottom, top52, bottom52 = max(a, b), min(a, b), max(a52, b52), min(a52, b52)
        p, y, o = C[i], C[i - 1], O[i]
        up = p > top and p > H[i - 26] and cv >= bl and p > cv and p > top52
        down = bl > cv > p and bottom52 > p and p < L[i - 26] and p < bottom
        tests = [
            ("(BUY)", up and ((o <= top < p) or (y <= top < o))), ("(BUY) 1A", up and y < H[i - 27]),
            ("(BUY) Gold Cross", pbl >= pcv and bl < cv and p > H[i - 26] and p > c26 and p > cv), ("(BUY) Gold Cross A", cv >= bl and p > H[i - 26] and p > cv and y < c27 and p > c26),
            ("(SELL)", down and ((o >= bottom > p) or (y >= bottom > o))), ("(SELL) 1A", down and y > L[i - 27]),
            ("(SELL) Death Cross", pcv >= pbl and bl > cv > p and p < L[i - 26] and c26 > p), ("(SELL) Death Cross A", y >= c27 and p < c26 and cv > p and bl > cv),
        ]
        hit = next((n for n, t in tests if t), None)
        if hit:
            out.append((i, f"IchimokuKinkoHyo {hit}"))
    return out


def test_ichimoku_against_a_loop(spark):
    import datetime as dt

    rng = np.random.default_rng(11)
    px = 500 + np.cumsum(rng.integers(-6, 7, 420))
    rows = [{"open": float(c + rng.integers(-3, 4)), "close": float(c)} for c in px]
    for r in rows:
        r |= {"high": max(r["open"], r["close"]) + float(rng.integers(0, 4)), "low": min(r["open"], r["close"]) - float(rng.integers(0, 4))}
    d = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, d + dt.timedelta(days=i), r["open"], r["high"], r["low"], r["close"], 1) for i, r in enumerate(rows)], "token long, date timestamp, open double, high double, low double, close double, volume long")
    got = signals.fired(df, signals.STRATEGIES["ichimoku"]).orderBy("session_idx").collect()
    assert [(r["session_idx"], r["variant"]) for r in got] == transcribed_ichimoku(rows)
    assert got


def test_lists_and_fragments(spark):
    rows = spark.createDataFrame([("A (BUY)",), ("A (SELL) Death Cross",)], "variant string")
    assert signals.allow(rows, []).count() == 0
    assert signals.allow(rows, [" a (buy)"]).count() == 1
    assert signals.matching(rows, []).count() == 2
    assert signals.matching(rows, ["death"]).count() == 1
    assert [r[0] for r in rows.select(signals.direction(rows["variant"])).collect()] == ["LONG", "SHORT"]


def test_cooldown_is_greedy(spark):
    rows = spark.createDataFrame([(1, "v", i) for i in (0, 3, 5, 6, 9, 10)], "token long, variant string, session_idx int")
    assert sorted(r["session_idx"] for r in signals.cooled(rows, 5).collect()) == [0, 5, 10]
    assert signals.cooled(rows, 0).count() == 6


def test_resolve():
    assert [s.name for s in signals.resolve("all, hilega-long")] == ["IchimokuKinkoHyo", "RSI", "HilegaMilega"]
    with pytest.raises(ValueError):
        signals.resolve("none such")
