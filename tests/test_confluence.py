import datetime as dt

import pytest

from tapeloom.operators import confluence as con
from tapeloom.schema import ConfluenceOptions

TRADE = "token long, date timestamp, session_idx int, strategy string, variant string, direction string, entry_price double"


def trades(spark, *items):
    return spark.createDataFrame([(t, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i, s, f"{s} ({v})", d, 10.0 + i) for t, i, s, v, d in items], TRADE)


def brute(rows, names, opt):
    """Event by event, as plain loops."""
    out, conflicts = [], 0
    for token in {r["token"] for r in rows}:
        mine = sorted((r for r in rows if r["token"] == token), key=lambda r: (r["session_idx"], r["variant"]))
        if opt.require_all and len({r["strategy"] for r in mine}) < len(names):
            continue
        last, seen = {}, set()
        for a in mine:
            partners, bad = [], False
            for s in names:
                near = [t for t in mine if t["strategy"] == s and s != a["strategy"] and 0 <= a["session_idx"] - t["session_idx"] <= opt.window]
                same = [t for t in near if t["direction"] == a["direction"]]
                if same:
                    partners.append(max(same, key=lambda t: t["session_idx"]))
                elif near:
                    bad = True
            conflicts += bad
            side = a["direction"]
            if len(partners) < (len(names) - 1 if opt.require_all else 1) or (side, a["session_idx"]) in seen or (side in last and a["session_idx"] - last[side] < opt.cooldown):
                continue
            last[side] = a["session_idx"]
            seen.add((side, a["session_idx"]))
            out.append((token, a["session_idx"], side, a["session_idx"] - min([a["session_idx"], *(p["session_idx"] for p in partners)])))
    return sorted(out), conflicts


@pytest.mark.parametrize("require_all", [True, False])
def test_against_loops(spark, require_all):
    import random

    random.seed(8)
    items = [(t, i, s, v, d) for t in range(4) for i in range(60) for s in ("Alpha", "Beta", "Gamma") if random.random() < 0.15 for v, d in [random.choice((("X", "LONG"), ("Y", "SHORT")))]]
    df = trades(spark, *items)
    opt = ConfluenceOptions(window=4, cooldown=3, require_all=require_all)
    rows = [r.asDict() for r in df.collect()]
    names = ["Alpha", "Beta", "Gamma"]
    want, conflicts = brute(rows, names, opt)
    got = sorted((r["token"], r["session_idx"], r["direction"], r["align_gap"]) for r in con.confluence(df, names, opt).collect())
    assert got == want and want
    assert con.conflicts(df, names, opt).first()[0] == conflicts


def test_names(spark):
    df = trades(spark, (1, 3, "Alpha", "BUY", "LONG"), (1, 5, "Beta", "BUY-2", "LONG"))
    r = con.confluence(df, ["Alpha", "Beta"]).first()
    assert r["variant"] == "ALP (BUY)  +  BET (BUY-2)" and r["align_gap"] == 2 and r["entry_price"] == 15.0


def test_needs_two():
    with pytest.raises(ValueError):
        con.confluence(None, ["Alpha"])


def test_combined_runs(spark):
    import datetime as dt

    day = lambda k: dt.datetime(2024, 1, k)
    kind = "universe long, replayed long, skipped long, sessions long, data_start timestamp, data_end timestamp, outliers long, first_signal timestamp, last_signal timestamp"
    a = spark.createDataFrame([(9, 7, 2, 100, day(3), day(20), 4, day(4), day(5))], kind)
    b = spark.createDataFrame([(9, 8, 1, 130, day(2), day(19), 5, day(6), day(7))], kind)
    events = spark.createDataFrame([(day(10),), (day(12),)], "date timestamp")
    assert tuple(con.combined_counters([a, b], events).first()) == (9, 7, 2, 230, day(2), day(20), 9, day(10), day(12))
    lines = con.notes(["A", "B"], ConfluenceOptions(window=0), 1234, None)
    assert len(lines) == 5 and "in one session" in lines[0] and "1,234" in lines[3] and "0.0" in lines[4]
