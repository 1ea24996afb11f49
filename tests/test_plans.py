from tapeloom.operators import metrics
from tapeloom.operators.signals import STRATEGIES
from tapeloom.plans import backtest, report, scanner
from tapeloom.schema import BacktestConfig, Horizon, StopRule
from tapeloom.sources.candles import from_lineitem

SF = "/root/testdata/sf0.001"


def test_run_report_and_files(spark, tmp_path):
    bars = from_lineitem(spark.read.parquet(f"{SF}/lineitem.parquet")).cache()
    result = backtest.run(bars, STRATEGIES["ichimoku"], symbols=spark.createDataFrame([(1, "AAA")], "token long, symbol string"))
    text = backtest.emit(result, str(tmp_path), "1M")
    counts = metrics.run_counters(bars, result.legs, 110).first()
    assert f"- Tokens: {counts['universe']:,}, of which {counts['replayed']:,}" in text and f"{counts['outliers']:,} legs beyond ±60 %" in text and "0 basis points" in text
    total = next(r for r in metrics.summarize(result.legs).collect() if r["group_type"] == "overall" and r["horizon"] == "1M")
    assert f"- Signals: {total['signals']:,} ({total['longs']:,} long, {total['shorts']:,} short)" in text
    row = next(x for x in text.split("\n") if x.startswith("| 1M (21 sessions)"))
    assert [c.strip() for c in row.split("|")[2:8]] == [f"{total['n']:,}", *(f"{total[c]:.2f}" for c in ("win_pct", "avg_pct", "median_pct", "avg_win_pct", "avg_loss_pct"))]
    assert "## By signal" in text and "## Worst of 1M" in text and "with no stop" in text and f"{total['n']:,} legs ended within 1M" in text
    head = next((tmp_path / "ichimokukinkohyo-trades").glob("*.csv")).read_text().split("\n")[0]
    assert head.startswith("symbol,token,strategy,signal,direction,entry_date,entry_price,1d_exit_date,1d_exit_price,1d_return_pct,1d_mfe_pct,1d_mae_pct,1d_exit_reason,1d_held_days,5d_")
    head = next((tmp_path / "ichimokukinkohyo-summary").glob("*.csv")).read_text().split("\n")[0]
    assert head == "group_type,group,horizon,horizon_days,signals,n,win_pct,wins,losses,avg_pct,median_pct,stddev_pct,avg_win_pct,avg_loss_pct,profit_factor,payoff_ratio,sharpe,best_pct,worst_pct,avg_mfe_pct,avg_mae_pct,total_pct"
    longs = result.filtered("direction = 'LONG'", "longs only")
    assert longs.legs.where("direction = 'SHORT'").count() == 0 and "longs only" in backtest.render(longs, "1M")
    none = result.filtered("false")
    assert "no signal in the chosen" in backtest.render(none, "1M")


def test_report_hides_small_groups_and_names_the_stop(spark):
    bars = from_lineitem(spark.read.parquet(f"{SF}/lineitem.parquet")).cache()
    stop = StopRule(sma=20, trail=True, intraday=True, max_loss_pct=2.5)
    result = backtest.run(bars, STRATEGIES["ichimoku"], BacktestConfig(cost_bps=12.5, cooldown=4, stop=stop, max_move_pct=0.0))
    least = sorted(r["signals"] for r in metrics.summarize(result.legs).where("group_type = 'signal' and horizon = '1D'").collect())
    text = report.render(result, "1D", top=0, min_signals=least[0] + 1, by_year=False)
    assert f"Not shown: {sum(n <= least[0] for n in least)} with fewer than {least[0] + 1} signals." in text
    assert "price touches the extreme of the last session that closed through its 20-session average or price touches a level 2.5 % against the entry" in text
    assert "12.5 basis points" in text and "Cooldown: 4 sessions" in text and "Outliers" not in text and "By year" not in text and "Best" not in text
    assert report.stop_text(StopRule()) == "" and report.stop_text(StopRule(sma=5)) == "the close passes its 5-session average"


def test_horizons_that_have_not_ended(spark):
    bars = from_lineitem(spark.read.parquet(f"{SF}/lineitem.parquet"))
    text = report.render(backtest.run(bars, STRATEGIES["ichimoku"], BacktestConfig(horizons=(Horizon("1D", 1), Horizon("9Y", 2300)))), "9Y")
    assert "as old as 9Y" in text and "No leg of 9Y has ended yet." in text


def test_scan_text(spark):
    bars = from_lineitem(spark.read.parquet(f"{SF}/lineitem.parquet"))
    found = scanner.scan(bars, spark.createDataFrame([(1, "AAA")], "token long, symbol string"), every_bar=True).limit(3)
    counts = scanner.scan_counts(bars).first()
    text = report.scan_text(found, counts["scanned"], counts["skipped"])
    assert text.startswith(f"3 of {counts['scanned']} tokens") and len([x for x in text.split("\n") if x.startswith("| T") or x.startswith("| AAA")]) == 3
    assert report.scan_text(found.where("false"), 5, 2) == "0 of 5 tokens meet the rule; 2 have too few bars.\n"


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
