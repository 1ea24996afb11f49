import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import candles as src
from tapeloom.sources import instruments as ins
from tapeloom.sources import store

CANDLE = "token long, date timestamp, open double, high double, low double, close double, volume long"


def day(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=i)


def rows(spark, *items):
    return spark.createDataFrame([(t, day(i), c, c, c, c, 1) for t, i, c in items], CANDLE)


def values(df):
    return sorted((r["token"], r["date"], r["close"]) for r in df.collect())


def test_upsert_is_idempotent(spark):
    old, new = rows(spark, (1, 0, 1.0), (1, 1, 2.0)), rows(spark, (1, 1, 3.0), (2, 0, 9.0))
    once = store.upsert(old, new)
    assert values(once) == [(1, day(0), 1.0), (1, day(1), 3.0), (2, day(0), 9.0)]
    assert values(store.upsert(once, new)) == values(once)


def test_retention_and_cleaning(spark):
    df = rows(spark, (1, 0, 1.0), (1, 800, 2.0), (2, 800, 3.0))
    assert store.retained(df, F.lit("2027-01-02").cast("date"), 3).count() == 2
    active = spark.createDataFrame([(1,)], "token long")
    assert store.listed(df, active).count() == 2
    assert store.delisted_counts(df, active).first().asDict() == {"rows": 1, "tokens": 1}


def test_no_data_list_keeps_the_first_time(spark):
    held = spark.createDataFrame([(1, day(0))], "token long, recorded_at timestamp")
    got = store.mark_no_data(held, spark.createDataFrame([(1,), (2,), (2,)], "token long"), F.lit(day(9)))
    assert sorted((r[0], r[1]) for r in got.collect()) == [(1, day(0)), (2, day(9))]


def test_chunks_cover_without_overlap(spark):
    work = spark.sql("select 1L as token, date '2000-01-01' as start, date '2012-06-01' as end")
    got = [(r["from"], r["to"]) for r in store.chunks(work).orderBy("chunk").collect()]
    assert got[0][0] == dt.date(2000, 1, 1) and got[-1][1] == dt.date(2012, 6, 1)
    assert all((b[0] - a[1]).days == 1 and (a[1] - a[0]).days == 1900 for a, b in zip(got, got[1:], strict=False))


def test_boot_plan(spark):
    uni = spark.createDataFrame([(1,), (2,), (3,), (4,)], "token long")
    plan = store.boot_plan(uni, rows(spark, (1, 100, 1.0), (2, 50, 1.0)), spark.createDataFrame([(3,)], "token long"), F.lit(day(100)))
    assert {r["token"]: r["action"] for r in plan.collect()} == {1: "cached", 2: "refresh", 3: "skip", 4: "full"}


def test_open_store_twice(spark):
    assert store.open_store(spark, "candles_t").count() == 0
    assert store.open_store(spark, "candles_t").columns[:2] == ["token", "date"]
    assert src.first_table(spark, "no_such", "candles_t").count() == 0
    with pytest.raises(ValueError):
        src.first_table(spark, "no_such")


def test_bad_dates(spark):
    raw = spark.createDataFrame([(1, "2024-01-01T18:30:00Z"), (1, "2024-01-03"), (2, "soon"), (2, "2024-01-04")], "token long, date string")
    assert src.scan(raw).count() == 3
    assert src.scan(raw, "keep").where("date is null").count() == 1
    assert [r["token"] for r in src.scan(raw, "fail_token").select("token").distinct().collect()] == [1]


def test_symbol_cache(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("token,symbol\n1, AAA\nbad,row\n2\n3,CCC\n1,ABC\n")
    assert sorted(tuple(r) for r in ins.symbol_cache(spark, str(path)).collect()) == [(1, "ABC"), (3, "CCC")]
    assert ins.symbol_cache(spark, str(tmp_path / "none.csv")).count() == 0


def test_symbols_written_and_read(spark, tmp_path):
    rows = [(12, "BBB"), (3, "A&B"), (7, "C C")]
    ins.write_symbols(spark.createDataFrame(rows, "token long, symbol string"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in ins.symbol_cache(spark, str(tmp_path / "c")).collect()) == sorted(rows)
    parts = sorted((tmp_path / "c").glob("*.csv"))
    lines = [x for p in parts for x in p.read_text().split("\n") if x and x != "token,symbol"]
    assert lines == ["3,A&B", "7,C C", "12,BBB"]


def test_constituents(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text("﻿Company, SYMBOL ,x\nA, AAA ,1\nB,,2\nC,CCC,3\n", encoding="utf-8")
    assert sorted(r[0] for r in ins.constituents(spark, str(path)).collect()) == ["AAA", "CCC"]
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        ins.constituents(spark, str(path))


def test_settings_and_lists(spark):
    assert ins.settings({"USE_INDEX": "1", "USE_ALL": "1"})["mode"] == "index"
    assert ins.settings({"INSTRUMENT_TOKENS": "5, ,7"})["tokens"] == [5, 7]
    with pytest.raises(ValueError):
        ins.settings({})
    assert spark.range(1).select(ins.token_list(F.lit(" 1,, 22 "))).first()[0] == [1, 22]


def test_symbols_default(spark):
    got = ins.with_symbol(spark.createDataFrame([(1,), (2,), (3,)], "token long"), spark.createDataFrame([(1, "A"), (2, "")], "token long, symbol string"))
    assert {r["token"]: r["symbol"] for r in got.collect()} == {1: "A", 2: "T2", 3: "T3"}


def test_members_come_from_the_first_source_that_can_be_read(spark, tmp_path):
    kinds = [(1, "AAA", "EQ", "NSE", 1.0), (2, "BBB", "EQ", "NSE", 0.0), (3, "AAA", "FUT", "NSE", 1.0), (4, "DDD", "EQ", "NSE", 1.0)]
    master = spark.createDataFrame(kinds, "token long, symbol string, instrument_type string, segment string, last_price double")
    live, kept = tmp_path / "live.csv", spark.createDataFrame([("BBB",), ("ZZZ",)], "symbol string")
    found, why = ins.discovered(master, [str(live), kept])
    assert [r["token"] for r in found.collect()] == [2] and len(why) == 1
    live.write_text("Company,Symbol\nA,AAA\nD,DDD\n")
    found, why = ins.discovered(master, [str(live), kept])
    assert sorted(r["token"] for r in found.collect()) == [1, 4] and why == []
    live.write_text("something,else\n1,2\n")
    assert ins.discovered(master, [str(live), kept])[0].count() == 1
    with pytest.raises(ValueError, match="no list"):
        ins.discovered(master, [str(live), kept.where("false")])
    with pytest.raises(ValueError, match="instrument"):
        ins.discovered(master, [kept.where("symbol = 'ZZZ'")])


def test_log_lines_are_appended_as_json(spark, tmp_path):
    import json

    from tapeloom.plans import logs

    path, source = str(tmp_path / "logs"), str(tmp_path / "lines")
    lines = [("2026/01/01 a.go:1: [x] ERROR: \"no\"\n", day(0)), ("plain", day(1)), ("b.go:2: a warning", day(1))]
    df = spark.createDataFrame(lines, "line string, at timestamp")
    logs.append(df, path)
    df.write.parquet(source)
    q = logs.sink(spark.readStream.schema(df.schema).parquet(source), path + "s", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    logs.append(df.limit(1), path)
    for where, n in ((path, 4), (path + "s", 3)):
        got = [(str(r["day"]), json.loads(r["value"])) for r in spark.read.text(where).collect()]
        assert len(got) == n and ("2024-01-01", {"time": "2024-01-01T00:00:00Z", "level": "ERROR", "msg": '[x] ERROR: "no"'}) in got
        assert ("2024-01-02", {"time": "2024-01-02T00:00:00Z", "level": "WARN", "msg": "a warning"}) in got
