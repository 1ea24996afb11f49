import datetime as dt
import time
import types

import pytest
from pyspark.sql import functions as F

from tapeloom.streaming import live


def write_ticks(spark, path, items):
    spark.createDataFrame(items, "token long, ts timestamp, price double").coalesce(1).write.mode("append").parquet(path)


T = dt.datetime(2024, 1, 1, 18, 0)  # half an hour before local midnight
ITEMS = [(1, T, 10.0), (1, T + dt.timedelta(minutes=10), 12.0), (1, T + dt.timedelta(minutes=31), 11.0), (2, T, 5.0), (1, T + dt.timedelta(minutes=40), 9.0)]


def test_replay_equals_batch(spark, tmp_path):
    path = str(tmp_path / "ticks")
    write_ticks(spark, path, ITEMS[:3])
    write_ticks(spark, path, ITEMS[3:])
    stream = spark.readStream.schema("token long, ts timestamp, price double").option("maxFilesPerTrigger", 1).parquet(path)
    q = live.intraday_bars(stream, late="1 day").writeStream.format("memory").queryName("bars_t").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("bars_t").collect()))
    assert got == sorted(map(tuple, live.intraday_bars(spark.read.parquet(path)).collect()))
    assert (1, dt.date(2024, 1, 1), 10.0, 12.0, 10.0, 12.0, 2) in got and (1, dt.date(2024, 1, 2), 11.0, 11.0, 9.0, 9.0, 2) in got


def test_snapshots_after_every_tick(spark, tmp_path):
    path = str(tmp_path / "ticks")
    write_ticks(spark, path, ITEMS)
    stream = spark.readStream.schema("token long, ts timestamp, price double").parquet(path)
    q = live.snapshots(stream).writeStream.format("memory").queryName("snaps_t").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(180)
    got = [(r["high"], r["low"], r["close"], r["ticks"]) for r in spark.table("snaps_t").where("token = 1").orderBy("ts").collect()]
    assert got == [(10.0, 10.0, 10.0, 1), (12.0, 10.0, 12.0, 2), (11.0, 11.0, 11.0, 1), (11.0, 9.0, 9.0, 2)]


def run_snapshots(spark, stream, checkpoint, **kw):
    """All snapshots that the query of this checkpoint has given."""
    q = live.snapshots(stream, **kw).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).start(f"{checkpoint}-out")
    q.awaitTermination(240)
    return sorted(map(tuple, spark.read.parquet(f"{checkpoint}-out").collect()))


TICK = "token long, ts timestamp, price double"


def test_bars_are_held_and_cleared(spark, tmp_path):
    """The state read back between runs: a bar a token, begun anew on a new day, gone after its day's end."""
    path, checkpoint = str(tmp_path / "ticks"), str(tmp_path / "c")
    write_ticks(spark, path, ITEMS)
    stream = lambda: spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(path)
    run_snapshots(spark, stream(), checkpoint, keep="1 hour")
    held = {r["token"]: (str(r["day"]), r["open"], r["high"], r["low"], r["close"], r["ticks"]) for r in live.held_bars(spark, checkpoint).collect()}
    assert held == {1: ("2024-01-02", 11.0, 11.0, 9.0, 9.0, 2), 2: ("2024-01-01", 5.0, 5.0, 5.0, 5.0, 1)}
    write_ticks(spark, path, [(1, T + dt.timedelta(hours=20), 8.0)])
    write_ticks(spark, path, [(1, T + dt.timedelta(hours=20, minutes=1), 10.0)])
    run_snapshots(spark, stream(), checkpoint, keep="1 hour")
    held = {r["token"]: (str(r["day"]), r["open"], r["high"], r["low"], r["close"], r["ticks"]) for r in live.held_bars(spark, checkpoint).collect()}
    assert held == {1: ("2024-01-02", 11.0, 11.0, 8.0, 10.0, 4)}


def test_seeded_bars_go_on_as_if_never_stopped(spark, tmp_path):
    """A query that starts anew from the day's bars so far gives the snapshots that the first one would have given, none twice."""
    early, later, both = (str(tmp_path / x) for x in ("early", "later", "both"))
    cut = [x for x in ITEMS if x[1] <= T + dt.timedelta(minutes=31)], [x for x in ITEMS if x[1] > T + dt.timedelta(minutes=31)] + [(3, T, 1.0)]
    for path, items in ((early, cut[0]), (later, cut[1]), (both, cut[0] + cut[1])):
        write_ticks(spark, path, items)
    read = lambda path: spark.readStream.schema(TICK).parquet(path)
    whole = run_snapshots(spark, read(both), str(tmp_path / "a"))
    days = live.intraday_bars(spark.read.schema(TICK).parquet(early)).groupBy("token").agg(F.max("day").alias("day"))
    latest = live.intraday_bars(spark.read.schema(TICK).parquet(early)).join(days, ["token", "day"])
    first = run_snapshots(spark, read(early), str(tmp_path / "b"))
    second = run_snapshots(spark, read(later), str(tmp_path / "c"), initial=latest)
    assert sorted(first + second) == whole and len(whole) == len(ITEMS) + 1


def test_daily_dedup_crosses_the_local_day(spark, tmp_path):
    path = str(tmp_path / "signals")
    rows = [("S", 1, T, "S (A)"), ("S", 1, T + dt.timedelta(minutes=5), "S (B)"), ("S", 1, T + dt.timedelta(minutes=31), "S (A)"), ("R", 1, T, "R")]
    schema = "strategy string, token long, ts timestamp, variant string"
    spark.createDataFrame(rows, schema).write.parquet(path)
    q = live.first_of_day(spark.readStream.schema(schema).parquet(path), late="2 days").writeStream.format("memory").queryName("sig_t").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("sig_t").count() == 3
    batch = live.first_of_day(spark.read.parquet(path))
    assert sorted((r["strategy"], r["variant"], str(r["day"])) for r in batch.collect()) == [("R", "R", "2024-01-01"), ("S", "S (A)", "2024-01-01"), ("S", "S (A)", "2024-01-02")]


SIGNAL = "strategy string, token long, ts timestamp, variant string"


def test_one_signal_a_day_with_a_short_delay(spark, tmp_path):
    """Signals hours apart, in batches of their own, with a delay of minutes: the day's state outlives the delay."""
    path = str(tmp_path / "signals")
    hours = [0, 2, 4, 6, 30, 31]
    for k, h in enumerate(hours):
        spark.createDataFrame([("S", 1, dt.datetime(2024, 1, 2, 3) + dt.timedelta(hours=h), f"S ({k})")], SIGNAL).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 1).parquet(path)
    q = live.first_of_day(stream, late="10 minutes").writeStream.format("memory").queryName("day_t").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(240)
    got = sorted((str(r["day"]), r["variant"]) for r in spark.table("day_t").collect())
    assert got == [("2024-01-02", "S (0)"), ("2024-01-03", "S (4)")]


def test_days_across_a_change_of_clocks(spark):
    """Local midnight in New York is 05:00 UTC in winter and 04:00 in summer."""
    at = [dt.datetime(2024, 7, 10, 3, 50), dt.datetime(2024, 7, 10, 4, 10), dt.datetime(2024, 1, 10, 4, 50), dt.datetime(2024, 1, 10, 5, 10)]
    rows = spark.createDataFrame([(1, t, float(k)) for k, t in enumerate(at)], "token long, ts timestamp, price double")
    got = sorted((r["day"], r["close"]) for r in live.intraday_bars(rows, "America/New_York").collect())
    assert got == [(dt.date(2024, 1, 9), 2.0), (dt.date(2024, 1, 10), 3.0), (dt.date(2024, 7, 9), 0.0), (dt.date(2024, 7, 10), 1.0)]


@pytest.mark.parametrize("name", ["ichimoku", "rsi", "hilega", "hilega-long"])
def test_replayed_ticks_give_the_signals_of_the_finished_bars(spark, tmp_path, name):
    """Ticks of a bar of each token, evaluated one by one against what the bars before it carry on."""
    from tapeloom.functions.indicators import session_index
    from tapeloom.operators import signals
    from tapeloom.sources.candles import from_lineitem

    strategy = signals.LIVE_ICHIMOKU if name == "ichimoku" else signals.STRATEGIES[name]
    bars = from_lineitem(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")).withColumn("idx", session_index()).cache()
    first = {}
    for r in signals.fired(bars, strategy).orderBy("session_idx").collect():
        first.setdefault(r["token"], r)
    cut = spark.createDataFrame([(t, r["session_idx"]) for t, r in first.items()], "token long, cut int")
    rows = bars.join(cut, "token")
    closed = live.closed_states(rows.where("idx < cut").drop("cut", "idx"), [name]).cache()
    running = rows.where("idx = cut").collect()
    path = str(tmp_path / "ticks")
    ticks = [(r["token"], r["date"] + dt.timedelta(hours=4, minutes=m), p) for r in running for m, p in enumerate((r["open"], r["high"], r["low"], r["close"]))]
    write_ticks(spark, path, sorted(ticks, key=lambda x: x[1]))
    stream = spark.readStream.schema("token long, ts timestamp, price double").parquet(path)
    q = live.live_signals(live.snapshots(stream, keep="20000 days"), closed).writeStream.format("memory").queryName("live_" + name.replace("-", "_")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(240)
    got = {(r["token"], r["variant"]) for r in spark.table("live_" + name.replace("-", "_")).where("minute(ts) = 3").collect()}
    assert got == {(t, r["variant"]) for t, r in first.items()} and len(got) >= (2 if name == "rsi" else 5)
    batch = live.live_signals(rows.where("idx = cut").withColumn("day", F.to_date("date")).withColumnRenamed("date", "ts").drop("idx"), closed)
    assert {(r["token"], r["variant"]) for r in batch.collect()} == got


def test_all_strategies_in_one_pass_over_running_bars(spark):
    """Each strategy's signals as if it ran alone; a token with too few bars has none."""
    from tapeloom.functions.indicators import session_index
    from tapeloom.sources.candles import from_lineitem

    bars = from_lineitem(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    running = bars.withColumns({"idx": session_index(), "day": F.to_date("date")}).withColumnRenamed("date", "ts").cache()
    found = lambda names: {tuple(r) for r in live.live_signals(running, live.closed_states(bars, names, every=True), on=("token", "idx")).collect()}
    each = [found([n]) for n in ("ichimoku", "rsi", "hilega")]
    assert found(["ichimoku", "rsi", "hilega"]) == set().union(*each) and all(each)
    short = live.closed_states(bars.withColumn("n", session_index()).where("n < 16").drop("n"))
    assert live.live_signals(running.where("idx = 16").drop("idx"), short).count() == 0


def test_alerts_try_again(spark, tmp_path):
    path = str(tmp_path / "signals")
    spark.createDataFrame([("S", 1, T, "S (A)"), ("S", 2, T, "S (A)")], "strategy string, token long, ts timestamp, variant string").write.parquet(path)
    stream = spark.readStream.schema("strategy string, token long, ts timestamp, variant string").parquet(path)
    symbols = spark.createDataFrame([(1, "AAA")], "token long, symbol string")
    sent, fails = [], [1]

    def send(body):
        if fails:
            fails.pop()
            raise OSError("again")
        sent.append(body)

    q = live.alerts(live.payloads(stream, symbols), send, str(tmp_path / "c"), per_second=100.0).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(sent) == 2 and sum("AAA" in b for b in sent) == 2 - sum("UNKNOWN" in b for b in sent) == 1


def test_alerts_wait_as_long_as_asked(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "signals")
    spark.createDataFrame([("x",)], "body string").write.parquet(path)
    sent, slept = [], []

    class Limited(Exception):
        retry_after = 0.4

    def send(body):
        if not slept:
            raise Limited
        sent.append(body)

    monkeypatch.setattr(live, "time", types.SimpleNamespace(sleep=slept.append, monotonic=time.monotonic))
    batch = spark.read.parquet(path)
    post = {}

    class Writer:
        def foreachBatch(self, f):
            post["f"] = f
            return self

        def option(self, *_):
            return self

    class Stream:
        writeStream = Writer()

    live.alerts(Stream(), send, str(tmp_path / "c"))
    post["f"](batch, 0)
    assert sent == ["x"] and slept == [pytest.approx(0.45)]


def test_a_batch_that_comes_again_sends_only_the_rest(spark, tmp_path):
    """A crash in the middle of a batch, then the same query again: each body once, and none for a day that has had its alert."""
    path, checkpoint = str(tmp_path / "signals"), str(tmp_path / "c")
    schema = "strategy string, token long, ts timestamp, body string"
    rows = [("S", k, T + dt.timedelta(seconds=k), f"body {k}") for k in range(6)]
    spark.createDataFrame(rows, schema).write.parquet(path)
    sent, left = [], [3]

    def send(body):
        if left[0] == 0:
            raise OSError("gone")
        left[0] -= 1
        sent.append(body)

    def run(outbox):
        q = live.alerts(spark.readStream.schema(schema).parquet(path), send, checkpoint, per_second=1000.0, attempts=1, outbox=outbox).trigger(availableNow=True).start()
        q.awaitTermination(120)

    box = live.Outbox(spark, str(tmp_path / "box"))
    with pytest.raises(Exception):
        run(box)
    assert sent == ["body 0", "body 1", "body 2"] and box.sent().count() == 3
    left[0] = 99
    run(live.Outbox(spark, str(tmp_path / "box")))
    assert sent == [f"body {k}" for k in range(6)] and box.sent().count() == 6
    again = [("S", 1, T + dt.timedelta(minutes=3), "same day"), ("S", 1, T + dt.timedelta(hours=3), "next day"), ("R", 1, T, "other")]
    spark.createDataFrame(again, schema).coalesce(1).write.mode("append").parquet(path)
    run(box)
    assert sent[6:] == ["other", "next day"]


def test_tick_source_is_bounded_ordered_and_resumes(spark, tmp_path):
    from fakes import TickFile

    from tapeloom.streaming.feed import tick_stream

    feed, out, checkpoint = tmp_path / "ticks.csv", str(tmp_path / "out"), str(tmp_path / "c")
    lines = [f"{k % 7},{k},{k * 1.5}" for k in range(95)]
    feed.write_text("\n".join(lines[:60]) + "\n")
    sizes = []

    def keep(batch, n):
        batch = batch.withColumns({"part": F.spark_partition_id(), "n": F.monotonically_increasing_id(), "batch": F.lit(n)}).cache()
        sizes.append(batch.count())
        batch.write.mode("append").parquet(out)

    def run():
        q = tick_stream(spark, TickFile(feed), lanes=3, most=25).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert [n for n in sizes if n] == [25, 25, 10]
    feed.write_text("\n".join(lines) + "\n")
    run()
    assert [n for n in sizes if n] == [25, 25, 10, 25, 10]
    got = spark.read.parquet(out).orderBy("batch", "n").collect()
    assert sorted((r["token"], r["price"]) for r in got) == sorted((k % 7, k * 1.5) for k in range(95))
    assert all(len({r["part"] for r in got if r["token"] == t and r["batch"] == b}) <= 1 for t in range(7) for b in range(5))
    assert all([r["price"] for r in got if r["token"] == t] == [k * 1.5 for k in range(95) if k % 7 == t] for t in range(7))


def test_formats(spark):
    from tapeloom.functions import formats as fm

    r = spark.range(1).select(
        fm.ellipsis(F.lit("abcdef"), 4), fm.centred(F.lit("ab"), 5), fm.signed(F.lit(1.236)), fm.ratio(F.lit(float("inf"))), fm.ratio(F.lit(0.0)), fm.fixed(F.lit(float("nan")), 4),
        fm.day(F.lit(None).cast("timestamp")), fm.file_stem(F.lit("A B/(C)")), fm.log_level(F.lit("a Warning")), fm.log_message(F.lit("x.go:1: a: b\n")), fm.thousands(F.lit(-1234567)),
        fm.same_day(F.lit("2024-01-01 18:00:00").cast("timestamp"), F.lit("2024-01-01 19:00:00").cast("timestamp")),
    ).first()
    assert list(r) == ["abc…", " ab  ", "+1.24", "∞", "—", None, "—", "a-b-c", "WARN", "a: b", "-1,234,567", False]


def test_every_bar_meets_what_the_bar_before_carries_without_a_join(spark):
    """One pass over the candles gives the rows of the join of each bar with the closed states before it."""
    from tapeloom.functions.indicators import session_index

    rows = spark.range(3 * 260).selectExpr("id % 3 as token", "timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id div 3 as int)) as date", "500 + 60 * sin(id div 3 / 9 + id % 3) + pmod(xxhash64(id), 17) as close")
    rows = rows.selectExpr("token", "date", "close - 2 as open", "close + 3 as high", "close - 4 as low", "close", "1L as volume")
    names = ["ichimoku", "rsi", "hilega"]
    got = live.every_bar_signals(rows, names)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    running = rows.withColumns({"idx": session_index(), "day": F.to_date("date")}).withColumnRenamed("date", "ts")
    want = live.live_signals(running, live.closed_states(rows, names, every=True), on=("token", "idx"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
