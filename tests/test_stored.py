import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from fakes import Client
from tapeloom import queries
from tapeloom.plans import daily
from tapeloom.sources import fetch, store, stored
from tapeloom.sources.stored import CandleStore

CANDLE = "token long, date timestamp, open double, high double, low double, close double, volume long"


def rows(spark, *items):
    return spark.createDataFrame([(t, dt.datetime.fromisoformat(d), c, c, c, c, 1) for t, d, c in items], CANDLE)


def values(df):
    return sorted((r["token"], str(r["date"].date()), r["close"]) for r in df.collect())


def files(s):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{s.path}/candles") for f in names if f.endswith(".parquet")}


FIRST = [(1, "2021-03-01", 1.0), (1, "2022-03-01", 2.0), (2, "2021-03-01", 3.0), (2, "2023-03-01", 4.0), (3, "2022-05-05", 5.0)]


@pytest.fixture
def held(spark, tmp_path):
    s = CandleStore(spark, str(tmp_path / "store"), buckets=4)
    assert s.read().count() == 0
    s.merge(rows(spark, *FIRST))
    return s


def test_merge_touches_only_its_partitions(spark, held):
    before = files(held)
    fresh = rows(spark, (1, "2022-03-01", 9.0), (1, "2022-03-02", 8.0))
    parts = held.merge(fresh)
    assert len(parts) == 1 and parts[0][1] == 2022
    here = f"bucket={parts[0][0]}/year=2022/"
    after = files(held)
    assert {f: t for f, t in before.items() if here not in f} == {f: t for f, t in after.items() if here not in f}
    want = values(rows(spark, *[x for x in FIRST if x[:2] != (1, "2022-03-01")], (1, "2022-03-01", 9.0), (1, "2022-03-02", 8.0)))
    assert values(held.read()) == want
    held.merge(fresh)
    assert values(held.read()) == want
    assert held.merge(fresh.where("false")) == [] and values(held.read(2023)) == [(2, "2023-03-01", 4.0)]


def test_a_break_before_the_stage_is_complete_leaves_the_store(spark, held):
    @F.udf("double")
    def broken(x):
        raise OSError("gone")

    before = files(held)
    with pytest.raises(Exception, match="gone"):
        held.merge(rows(spark, (1, "2022-03-01", 9.0)).withColumn("close", broken("close")))
    assert files(held) == before and values(held.read()) == sorted((t, d, c) for t, d, c in FIRST)


def test_a_break_while_a_stage_is_applied_is_made_good(spark, held, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(CandleStore, "recover", lambda self: False)  # staged, never applied
        held.merge(rows(spark, (1, "2022-03-01", 9.0)))
    assert (1, "2022-03-01", 9.0) in values(held.read())
    assert not os.path.exists(f"{held.path}/stage")


def test_retention_and_delisting_drop_partitions(spark, held):
    as_of = F.lit("2025-02-01").cast("date")
    held.retain(as_of, 3)
    assert values(held.read()) == [(1, "2022-03-01", 2.0), (2, "2023-03-01", 4.0), (3, "2022-05-05", 5.0)]
    assert {y for _, y in held.parts()} == {2022, 2023} and not any("year=2021" in f for f in files(held))
    before = files(held)
    held.keep_listed(spark.createDataFrame([(1,), (2,), (2,)], "token long"))
    assert values(held.read()) == [(1, "2022-03-01", 2.0), (2, "2023-03-01", 4.0)]
    (bucket, year), = held.parts(rows(spark, FIRST[-1]))
    apart = lambda x: {f: t for f, t in x.items() if f"bucket={bucket}/year={year}/" not in f}
    assert apart(files(held)) == apart(before) != {}
    assert held.keep_listed(spark.createDataFrame([(1,), (2,)], "token long")) == []
    held.keep_listed(spark.createDataFrame([], "token long"))
    assert held.read().count() == 0


def counted(spark, df):
    """The rows with a count of how often a date of theirs was made."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("timestamp")
    def look(x):
        seen.add(1)
        return x

    return df.withColumn("date", look("date")), seen


def test_an_empty_store_takes_candles_evaluated_once(spark, tmp_path):
    fresh, seen = counted(spark, rows(spark, *FIRST, FIRST[0]))
    s = CandleStore(spark, str(tmp_path / "store"), buckets=4)
    assert s.merge(fresh) == s.parts() == s.parts(rows(spark, *FIRST)) and seen.value == len(FIRST) + 1
    assert values(s.read()) == sorted(FIRST)


def test_a_day_is_closed_by_one_change(spark, tmp_path, held, monkeypatch):
    as_of, active = F.lit("2025-02-01").cast("date"), spark.createDataFrame([(1,), (2,)], "token long")
    today = [(2, "2023-03-01", 7.0), (3, "2025-01-31", 8.0), (2, "2021-03-01", 9.0), (1, "2025-01-31", 6.0)]
    other = CandleStore(spark, str(tmp_path / "other"), buckets=4)
    other.merge(held.read())
    other.merge(rows(spark, *today))
    other.retain(as_of, 3)
    other.keep_listed(active)
    changes = []
    change = CandleStore._change
    monkeypatch.setattr(CandleStore, "_change", lambda self, *a: changes.append(1) or change(self, *a))
    daily.end_of_day(held, rows(spark, *today), as_of, 3, active)
    assert len(changes) == 1 and held.parts() == other.parts()
    assert values(held.read()) == values(other.read()) == [(1, "2022-03-01", 2.0), (1, "2025-01-31", 6.0), (2, "2023-03-01", 7.0)]


def test_a_store_takes_its_own_candles(spark, held):
    held.merge(held.read(2022).withColumn("close", F.col("close") + 1))
    assert values(held.read()) == [(t, d, c + (d >= "2022")) for t, d, c in sorted(FIRST)]


def test_a_break_between_two_partitions_is_made_good(spark, held, monkeypatch):
    put, done = stored.replace, []

    def broken(*of):
        if done:
            raise OSError("gone")
        done.append(put(*of))

    with monkeypatch.context() as m:
        m.setattr(stored, "replace", broken)
        with pytest.raises(OSError, match="gone"):
            held.close_day(rows(spark, (1, "2022-03-01", 9.0), (2, "2023-03-01", 8.0)), F.lit("2025-01-01").cast("date"), 3)
    assert values(held.read()) == [(1, "2022-03-01", 9.0), (2, "2023-03-01", 8.0), (3, "2022-05-05", 5.0)]
    assert not os.path.exists(f"{held.path}/stage") and {y for _, y in held.parts()} == {2022, 2023}


def test_a_roll_up_walks_the_lines_once(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    bars, made = queries.bars, []
    monkeypatch.setattr(queries, "bars", lambda *of: (made.append(counted(spark, bars(*of))), made[-1][0])[1])
    n = queries.QUERIES["rolled_up"](spark, d).count()
    assert n > 0 and sum(seen.value for _, seen in made) == bars(spark, d).count()


def test_backfill_of_planned_gaps(spark, tmp_path, held):
    calls = tmp_path / "calls"
    calls.mkdir()
    plan = store.deep_plan(held.read(), F.lit("2024-01-01").cast("date"), 12)
    asked = {(r["token"], r["chunk"]) for r in plan.collect()}
    assert asked == {(t, k) for t in (1, 2, 3) for k in (0, 1)}
    before = values(held.read())
    began = time.monotonic()
    done = daily.backfill(held, plan, Client(calls, fails=[1], broken=[3]), lanes=2, per_second=20.0, attempts=2)
    assert time.monotonic() - began > 0.3  # eight calls, twenty a second
    assert (done.updated, done.empty, done.failed) == (2, 0, 1)
    made = sorted(f.split(".")[0] for f in os.listdir(calls))
    assert made == ["1"] * 4 + ["2"] * 2 + ["3"] * 2  # 1 failed once for each chunk, 3 twice; its second chunk is skipped
    got = values(held.read())
    assert set(before) <= set(got) and len(got) == len(before) + done.candles - len({x[:2] for x in before} & {(t, d) for t, d, _ in values(daily.candles_of(done.answers))})
    assert {r["token"]: r["error"] for r in done.answers.where("chunk = 1 and error is not null").collect()} == {3: "skipped"}


def test_filters_leave_requests_out(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    plan = spark.createDataFrame([(t, k, dt.date(2020 + k, 1, 1), dt.date(2020 + k, 12, 31)) for t in (1, 2, 3, 4) for k in (0, 1)], "token long, chunk int, from date, to date")
    got = fetch.answers(plan, Client(calls), lanes=3, per_second=1000.0)
    assert got.where("token in (2, 3) and `from` >= date '2021-01-01'").count() == 2
    assert sorted({f.split(".")[0] for f in os.listdir(calls)}) == ["2", "3"] and len(os.listdir(calls)) == 2
    assert got.where("token = 1 and size(bars) > 0").select("chunk").collect() and len(os.listdir(calls)) == 4


def test_boot_and_end_of_day(spark, tmp_path, held):
    calls = tmp_path / "calls"
    calls.mkdir()
    universe = spark.createDataFrame([(t,) for t in (1, 2, 3, 4, 5, 6)], "token long")
    marked = spark.createDataFrame([(6, dt.datetime(2020, 1, 1))], "token long, recorded_at timestamp")
    as_of = F.lit("2023-06-01 00:00:00").cast("timestamp")
    done, none = daily.boot(held, universe, marked, Client(calls), as_of, 3, lanes=2, per_second=1000.0)
    assert {f.split(".")[0] for f in os.listdir(calls)} == {"1", "2", "3", "4", "5"} and done.failed == 0
    assert sorted(r["token"] for r in none.collect()) == [5, 6]
    today = rows(spark, *((t, "2023-06-01", 42.0) for t in (1, 2, 3, 4)))
    active = spark.createDataFrame([(1,), (2,), (4,)], "token long")
    for _ in range(2):
        states = daily.end_of_day(held, today, F.lit("2023-06-01").cast("date"), 2, active)
        kept = values(held.read())
        assert {t for t, _, _ in kept} == {1, 2, 4} and min(d for _, d, _ in kept) >= "2021-06-01" and all((t, "2023-06-01", 42.0) in kept for t in (1, 2, 4))
        assert {r["token"]: r["n"] for r in states.select("token", F.col("idx").alias("n")).collect()} == {t: sum(x[0] == t for x in kept) for t in (1, 2, 4)}


def test_archive_answers_from_files(spark, tmp_path):
    rows(spark, *FIRST).write.partitionBy("token").parquet(str(tmp_path / "a"))
    client = fetch.archive(str(tmp_path / "a"))
    assert [(str(d.date()), c) for d, _, _, _, c, _ in client(1, dt.date(2021, 3, 1), dt.date(2022, 3, 1))] == [("2021-03-01", 1.0), ("2022-03-01", 2.0)]
    assert client(1, dt.date(2021, 3, 2), dt.date(2022, 2, 28)) == [] and client(9, dt.date(2021, 1, 1), dt.date(2023, 1, 1)) == []
