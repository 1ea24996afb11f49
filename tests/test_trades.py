import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import metrics, trades
from tapeloom.schema import BacktestConfig, Horizon, StopRule, horizon_index, parse_horizons

CANDLE = "token long, date timestamp, open double, high double, low double, close double, volume long"


def candles(spark, rows, pad=0, level=100.0):
    rows = [(level,) * 4] * pad + rows
    return spark.createDataFrame([(1, dt.datetime(2025, 1, 1) + dt.timedelta(days=i), *map(float, r), 1) for i, r in enumerate(rows)], CANDLE)


def closes(spark, values):
    return candles(spark, [(c, c * 1.01, c * 0.99, c) for c in values])


def leg(spark, df, entry, days, side="LONG", stop=StopRule(), cost=0.0, cap=0.0):
    t = spark.createDataFrame([(1, entry, "S", "S (X)", side)], "token long, session_idx int, strategy string, variant string, direction string")
    return trades.legs_of_trades(df, t, BacktestConfig(horizons=(Horizon("H", days),), stop=stop, cost_bps=cost, max_move_pct=cap)).first()


def test_fixed_leg(spark):
    x = leg(spark, closes(spark, [100, 110, 90, 120]), 0, 3)
    assert x["valid"] and abs(x["return_pct"] - 20) < 1e-9 and x["held_days"] == 3
    assert not leg(spark, closes(spark, [100, 110]), 0, 3)["valid"]
    assert abs(leg(spark, closes(spark, [100, 100]), 0, 1, cost=20.0)["return_pct"] + 0.2) < 1e-12


def test_outlier_and_zero_entry(spark):
    x = leg(spark, closes(spark, [100, 190]), 0, 1, cap=60.0)
    assert x["outlier"] and not x["valid"]
    assert not leg(spark, closes(spark, [0, 10]), 0, 1)["valid"]


def test_average_stop(spark):
    x = leg(spark, closes(spark, [10, 11, 12, 13, 14, 5, 30, 40]), 4, 3, stop=StopRule(sma=3))
    assert (x["exit_price"], x["held_days"], x["stopped"]) == (5.0, 1, True)
    x = leg(spark, closes(spark, [20, 19, 18, 17, 16, 40, 5, 4]), 4, 3, "SHORT", StopRule(sma=3))
    assert x["exit_price"] == 40.0 and x["return_pct"] < 0


def flat_then(spark, rows, n=50):
    """Bars after enough quiet ones that a long average stays close to 100."""
    return candles(spark, [(100, 100, 100, 100)] * n + rows), n - 1


# Rows are (open, high, low, close); the average of 50 bars stays near 100.
CASES = [
    ("arms, no exit", [(99, 99, 95, 96), (97, 105, 96, 104), (105, 113, 104, 112)], "LONG", StopRule(50, True), (112.0, 3, False)),
    ("close exit", [(99, 99, 95, 96), (96, 96, 93, 94), (105, 113, 104, 112)], "LONG", StopRule(50, True), (94.0, 2, True)),
    ("intraday fill", [(99, 99, 95, 96), (97, 97, 90, 96.5), (105, 113, 104, 112)], "LONG", StopRule(50, True, True), (95.0, 2, True)),
    ("gap", [(99, 99, 95, 96), (90, 91, 88, 90), (105, 113, 104, 112)], "LONG", StopRule(50, True, True), (90.0, 2, True)),
    ("tightens", [(99, 99, 90, 96), (96, 98, 95, 96), (96, 96, 93, 93)], "LONG", StopRule(50, True), (93.0, 3, True)),
    ("never loosens", [(99, 99, 95, 96), (96, 97, 91, 95.5), (96, 96, 93, 93)], "LONG", StopRule(50, True), (93.0, 3, True)),
    ("short", [(101, 105, 101, 104), (104, 108, 103, 107), (90, 91, 89, 90)], "SHORT", StopRule(50, True), (107.0, 2, True)),
    ("floor", [(99, 99, 88, 95), (96, 97, 91, 95.5), (96, 96, 93, 93)], "LONG", StopRule(max_loss_pct=10.0), (90.0, 1, True)),
    ("floor gap", [(80, 85, 79, 84), (96, 97, 91, 95.5), (96, 96, 93, 93)], "LONG", StopRule(max_loss_pct=10.0), (80.0, 1, True)),
    ("floor short", [(101, 115, 100, 104), (96, 97, 91, 95.5), (96, 96, 93, 93)], "SHORT", StopRule(max_loss_pct=10.0), (110.0, 1, True)),
    ("nearer level", [(99, 99, 95, 96), (97, 97, 85, 96), (96, 96, 93, 93)], "LONG", StopRule(50, True, True, 10.0), (95.0, 2, True)),
]


@pytest.mark.parametrize(("name", "rows", "side", "stop", "want"), CASES, ids=[c[0] for c in CASES])
def test_stops(spark, name, rows, side, stop, want):
    df, at = flat_then(spark, rows)
    x = leg(spark, df, at, 3, side, stop)
    assert (x["exit_price"], x["held_days"], x["stopped"]) == pytest.approx(want)


def test_data_edge(spark):
    df, at = flat_then(spark, [(99, 99, 88, 95), (96, 97, 91, 95.5)])
    assert leg(spark, df, at, 126, stop=StopRule(max_loss_pct=10.0))["valid"]
    assert not leg(spark, df, at, 126, stop=StopRule(max_loss_pct=30.0))["valid"]
    assert not leg(spark, df, at, 126)["valid"]


def test_horizons():
    assert parse_horizons("1D:1, 1M:21") == (Horizon("1D", 1), Horizon("1M", 21))
    assert horizon_index(parse_horizons(""), "5d") == 1 and horizon_index(parse_horizons(""), "zz") == 3
    with pytest.raises(ValueError):
        parse_horizons("1D:x")


def _stat_rows(spark, values, group="v"):
    return spark.createDataFrame([(group, "LONG", dt.datetime(2024, 5, 1), "H", 1, v is not None, v, v, v) for v in values], "variant string, direction string, date timestamp, horizon string, horizon_days int, valid boolean, return_pct double, mfe_pct double, mae_pct double")


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [0.0, 0.0], [-1.0, 2.0, 3.0, None], [5.0] * 7 + [-1.0] * 2])
def test_statistics(spark, values):
    import statistics

    r = metrics.summarize(_stat_rows(spark, values)).where("group_type = 'overall'").first()
    v = [x for x in values if x is not None]
    assert r["n"] == len(v) and r["median_pct"] == statistics.median(v)
    assert r["stddev_pct"] == pytest.approx(statistics.stdev(v) if len(v) > 1 else 0.0)
    gain, pain = sum(x for x in v if x > 0), -sum(x for x in v if x < 0)
    assert r["profit_factor"] == (gain / pain if pain else float("inf") if gain else 0.0)


def test_exact_median_of_many(spark):
    import random
    import statistics

    random.seed(4)
    v = [float(random.choice((3, 3, 3, random.gauss(0, 9)))) for _ in range(20_001)]
    rows = spark.createDataFrame([("g", x) for x in v[:-1]] + [("h", x) for x in v], "k string, x double")
    got = {r["k"]: r["median_pct"] for r in metrics.exact_median(rows, ["k"], "x").collect()}
    assert got == {"g": statistics.median(v[:-1]), "h": statistics.median(v)}


def test_no_legs(spark):
    assert metrics.summarize(_stat_rows(spark, [1.0]).where(F.lit(False))).count() == 0


def candles_of(spark):
    from tapeloom.sources.candles import from_lineitem

    return from_lineitem(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))


@pytest.mark.parametrize("cooldown", [0, 7])
def test_stops_in_one_pass_equal_stops_of_given_trades(spark, cooldown):
    """With and without a cooldown and a window of dates; the plan reads the table once and builds candles once."""
    from tapeloom.operators import signals

    rows, strategy = candles_of(spark), signals.STRATEGIES["ichimoku"]
    config = BacktestConfig(stop=StopRule(sma=20, trail=True, max_loss_pct=3.0), cooldown=cooldown, start="1996-02-01", end="1999-12-31")
    legs = trades.legs_of(rows, strategy, config)
    assert legs._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    picked = signals.cooled(signals.in_window(signals.fired(rows, strategy), config.start, config.end), cooldown)
    other = trades.legs_of_trades(rows, picked, config)
    order = [c for c in legs.columns]
    got, want = (sorted(map(tuple, x.select(order).collect()), key=str) for x in (legs, other))
    assert got == want and len(got) > 100


def test_several_strategies_in_one_pass(spark):
    from tapeloom.operators import signals

    rows = candles_of(spark)
    some = [signals.STRATEGIES[n] for n in ("ichimoku", "rsi", "hilega")]
    together = signals.fired_together(rows, some)
    assert together._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    each = [r for s in some for r in signals.fired(rows, s).select(together.columns).collect()]
    assert sorted(map(tuple, together.collect()), key=str) == sorted(map(tuple, each), key=str) and each


def test_cooldown_over_many_signals_and_ties(spark):
    """Against the greedy loop: long runs over several parts of the fold, equal sessions, several keys."""
    import random

    from tapeloom.operators import signals

    rng = random.Random(6)
    items = [(t, v, rng.randrange(0, 900), n) for t in (1, 2) for v in "ab" for n in range(400)]
    got = signals.cooled(spark.createDataFrame(items, "token long, variant string, session_idx int, n int"), 5)
    want = []
    for key in {x[:2] for x in items}:
        last = None
        for x in sorted((x for x in items if x[:2] == key), key=lambda x: x[2:]):
            if last is None or x[2] - last >= 5:
                want.append(x)
                last = x[2]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_median_bins_with_ties_infinities_and_small_groups(spark, monkeypatch, bins):
    """Ties that fill the middle, groups of one and two values, values as near as floats go, and no values at all."""
    import random
    import statistics

    monkeypatch.setattr(metrics, "BINS", bins)
    rng = random.Random(2)
    groups = {
        "ties": [0.0] * 900 + [rng.random() for _ in range(500)], "one": [4.5], "two": [1.0, 2.0], "near": [1.0 + k * 2.0**-52 for k in range(401)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(777)], "even": [rng.gauss(0, 1) for _ in range(5000)], "same": [7.25] * 1000, None: [3.0, 1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("two", None)]
    rng.shuffle(rows)
    got = {r["k"]: r["median_pct"] for r in metrics.exact_median(spark.createDataFrame(rows, "k string, x double").repartition(6), ["k"], "x").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}
