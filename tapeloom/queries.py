"""The registered queries of the engine, each with the DuckDB SQL that gives its rows.

Candles are the integer walk of ``lineitem``; ticks are ``events``; symbols are
supplier names, an index is a region's suppliers, and ``part`` is the
instrument master. Computed doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats as fm
from .functions import indicators as ind
from .operators import confluence as con
from .operators import metrics, signals, trades
from .plans import backtest, daily, logs, scanner
from .schema import DEFAULT_HORIZONS, BacktestConfig, ConfluenceOptions, StopRule
from .sources import candles as src
from .scratch import work_folder
from .sources import fetch, store
from .sources import instruments as ins
from .sources.stored import CandleStore
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = "1998-06-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bars(spark: SparkSession, d: str) -> DataFrame:
    return src.from_lineitem(table(spark, d, "lineitem"))


def gathered_bars(spark: SparkSession, d: str) -> DataFrame:
    return src.gathered_lineitem(table(spark, d, "lineitem"))


def day(c: str = "date") -> Column:
    return F.to_date(c).alias(c)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) + 0.0 for n in names})


# SQL pieces.
_BARS = """
r as (
  select l_suppkey as token, l_shipdate as d,
         row_number() over (partition by l_suppkey, l_shipdate order by l_orderkey, l_linenumber, l_partkey) as k,
         cast(round(l_discount * 100) as bigint) - 5 as dx, cast(round(l_tax * 100) as bigint) as tx, l_linenumber as ln, cast(l_quantity as bigint) as q
  from lineitem),
t as (select *, 500 + sum(dx) over (partition by token order by d, k rows unbounded preceding) as px from r),
g as (select token, d, arg_min(px - dx + ln - 4, k) as o0, arg_max(px, k) as c0, max(px) as h0, min(px) as l0, max(tx) as tx, sum(q) as v from t group by 1, 2),
b as (select token, cast(d as date) as date, o0::double as open, (greatest(h0, o0) + tx)::double as high, (least(l0, o0) - (v % 5))::double as low, c0::double as close, v::bigint as volume,
             row_number() over (partition by token order by d) - 1 as idx from g)"""


def _with(*parts: str, select: str) -> str:
    return "with recursive " + ",".join((_BARS, *parts)) + "\n" + select


_P = "partition by token order by idx"


def _mid(a: int, z: int) -> str:
    f = f"({_P} rows between {-a} preceding and {'current row' if z == 0 else f'{-z} preceding'})"
    return f"(max(high) over {f} + min(low) over {f}) / 2"


#: Rows back from the bar that a line's midpoint is of, first and last; spelled out here, apart from the library's own.
_FRAMES = {
    "conversion": (-8, 0), "base": (-25, 0), "prev_conversion": (-8, -1), "prev_base": (-25, -1), "past_conversion": (-33, -25), "past_prev_conversion": (-34, -26),
    "past_base": (-50, -25), "past_conversion_52": (-59, -51), "past_base_52": (-76, -51), "span_b": (-76, -25), "span_b_52": (-102, -51),
}
_LIVE_FRAMES = _FRAMES | {"prev_conversion": (-9, -1), "prev_base": (-26, -1)}


def _ichimoku_sql(lines: dict[str, tuple[int, int]] = _FRAMES) -> str:
    mids = ", ".join(f"case when idx >= 104 then {_mid(*f)} end as {n}" for n, f in lines.items())
    lags = ", ".join(f"lag({c}, {n}) over ({_P}) as {c}_{n}" for c in ("high", "low") for n in (26, 27))
    return f"""
m as (select *, {mids}, {lags}, lag(close) over ({_P}) as prev_close from b),
i as (select *, (past_conversion + past_base) / 2 as span_a, (past_conversion_52 + past_base_52) / 2 as span_a_52 from m),
ich as (select *, greatest(span_a, span_b) as cloud_top, least(span_a, span_b) as cloud_bottom, greatest(span_a_52, span_b_52) as cloud_top_52, least(span_a_52, span_b_52) as cloud_bottom_52 from i)"""


_ICH_RULES = """
ichr as (select *, case
  when close > cloud_top and close > high_26 and conversion >= base and close > conversion and close > cloud_top_52
       and ((open <= cloud_top and close > cloud_top) or (prev_close <= cloud_top and open > cloud_top)) then ' (BUY)'
  when close > cloud_top and close > high_26 and conversion >= base and close > conversion and close > cloud_top_52 and prev_close < high_27 then ' (BUY) 1A'
  when prev_base >= prev_conversion and base < conversion and close > high_26 and close > past_conversion and close > conversion then ' (BUY) Gold Cross'
  when conversion >= base and close > high_26 and close > conversion and prev_close < past_prev_conversion and close > past_conversion then ' (BUY) Gold Cross A'
  when ((open >= cloud_bottom and close < cloud_bottom) or (prev_close >= cloud_bottom and open < cloud_bottom))
       and base > conversion and conversion > close and cloud_bottom_52 > close and close < low_26 and close < cloud_bottom then ' (SELL)'
  when base > conversion and conversion > close and cloud_bottom_52 > close and close < low_26 and close < cloud_bottom and prev_close > low_27 then ' (SELL) 1A'
  when prev_conversion >= prev_base and base > conversion and conversion > close and close < low_26 and past_conversion > close then ' (SELL) Death Cross'
  when prev_close >= past_prev_conversion and close < past_conversion and conversion > close and base > conversion then ' (SELL) Death Cross A' end as rule from ich),
ichs as (select token, date, idx, 'IchimokuKinkoHyo' as strategy, 'IchimokuKinkoHyo' || rule as variant,
         case when regexp_matches(upper(rule), 'SELL|BEARISH|DEATH|SHORT') then 'SHORT' else 'LONG' end as direction, close as entry from ichr where rule is not null and idx >= 110)"""


def _rsi_sql(name: str, p: int) -> str:
    return f"""
{name}c as (select token, idx, close - lag(close) over ({_P}) as d from b),
{name}s as (select token, {p}::bigint as idx, sum(greatest(d, 0)) / {p} as g, sum(greatest(-d, 0)) / {p} as l from {name}c where idx between 1 and {p} group by token having count(*) = {p}),
{name}r as (select token, idx, g, l from {name}s union all
  select r.token, c.idx, (r.g * {p - 1} + greatest(c.d, 0)) / {p}, (r.l * {p - 1} + greatest(-c.d, 0)) / {p} from {name}r r join {name}c c on c.token = r.token and c.idx = r.idx + 1),
{name} as (select token, idx, case when l = 0 then 100.0::double else 100.0 - 100.0 / (1.0 + g / l) end as rsi from {name}r)"""


_WMA21 = " + ".join(f"lag(rsi, {20 - k}) over ({_P}) * {k + 1}.0::double" for k in range(21))
_HILEGA = (
    _rsi_sql("h", 9)
    + f""",
e0 as (select token, 11::bigint as idx, (max(case when idx = 9 then rsi end) + max(case when idx = 10 then rsi end) + max(case when idx = 11 then rsi end)) / 3 as ema from h where idx between 9 and 11 group by token having count(*) = 3),
e as (select token, idx, ema from e0 union all select e.token, h.idx, h.rsi * 0.5 + e.ema * 0.5 from e join h on h.token = e.token and h.idx = e.idx + 1),
hw as (select token, idx, rsi, ({_WMA21}) / 231.0::double as wma from h),
hl as (select b.token, b.date, b.idx, b.close, hw.rsi, e.ema, hw.wma from b left join hw using (token, idx) left join e using (token, idx))"""
)
_HILEGA_RULES = f"""
ht as (select *, lag(wma) over ({_P}) as w1, lag(wma, 2) over ({_P}) as w2 from hl),
hti as (select *, case when rsi > 55 and ema < rsi and wma < ema and wma > w1 then case when wma > 50 then 'BUY-2' else 'BUY-1' end
                      when rsi < 48 and ema > rsi and wma > ema and wma < w1 then case when wma < 50 then 'SELL-2' else 'SELL-1' end end as tier from ht),
hf as (select *, lag(tier) over ({_P}) as before from hti),
hils as (select token, date, idx, 'HilegaMilega' as strategy, 'HilegaMilega (' || tier || ')' as variant, case when tier like 'SELL%' then 'SHORT' else 'LONG' end as direction, close as entry
         from hf where tier is not null and tier is distinct from before and w2 is not null and idx >= 60)"""


def _bucket_sql(unit: str, p: int = 14) -> str:
    n = unit[0]
    return f"""
{n}b as (select token, date_trunc('{unit}', date) as bucket, arg_max(close, date) as close, row_number() over (partition by token order by date_trunc('{unit}', date)) - 1 as k from b group by 1, 2),
{n}d as (select *, close - lag(close) over (partition by token order by k) as d from {n}b),
{n}s as (select token, {p}::bigint as k, sum(greatest(d, 0)) / {p} as g, sum(greatest(-d, 0)) / {p} as l from {n}d where k between 1 and {p} group by token having count(*) = {p}),
{n}r as (select token, k, g, l from {n}s union all select r.token, c.k, (r.g * {p - 1} + greatest(c.d, 0)) / {p}, (r.l * {p - 1} + greatest(-c.d, 0)) / {p} from {n}r r join {n}d c on c.token = r.token and c.k = r.k + 1),
{n}q as (select token, sum(greatest(d, 0)) as g, sum(greatest(-d, 0)) as l from {n}d where k between 1 and {p - 1} group by token),
{n}x as (select b.token, b.idx, v.k, b.close - pv.close as d from b join {n}b v on v.token = b.token and v.bucket = date_trunc('{unit}', b.date) left join {n}b pv on pv.token = b.token and pv.k = v.k - 1),
{n}y as (select x.token, x.idx,
   case when x.k = {p} then (q.g + greatest(x.d, 0)) / {p} when x.k > {p} then (r.g * {p - 1} + greatest(x.d, 0)) / {p} end as g,
   case when x.k = {p} then (q.l + greatest(-x.d, 0)) / {p} when x.k > {p} then (r.l * {p - 1} + greatest(-x.d, 0)) / {p} end as l
   from {n}x x left join {n}r r on r.token = x.token and r.k = x.k - 1 left join {n}q q on q.token = x.token),
{n}rsi as (select token, idx, case when g is null then null when l = 0 then 100.0::double else 100.0 - 100.0 / (1.0 + g / l) end as rsi from {n}y)"""


_MTF = (
    _rsi_sql("f", 14)
    + ","
    + _bucket_sql("week")
    + ","
    + _bucket_sql("month")
    + ", mtf as (select b.token, b.date, b.idx, b.close, f.rsi, wrsi.rsi as rsi_weekly, mrsi.rsi as rsi_monthly from b left join f using (token, idx) left join wrsi using (token, idx) left join mrsi using (token, idx))"
)


def _gfs_rules(level: float) -> str:
    return f"""
gp as (select *, lag(rsi) over ({_P}) as prev from mtf),
gfss as (select token, date, idx, 'RSI' as strategy, case when prev between 57 and 63 and rsi > prev and rsi > 60 then 'RSI (Advanced GFS)' else 'RSI (GFS)' end as variant, 'LONG' as direction, close as entry
         from gp where idx >= 18 and rsi_weekly > {level} and rsi_monthly > {level} and ((prev between 57 and 63 and rsi > prev and rsi > 60) or (prev between 37 and 44 and rsi > prev and rsi > 40)))"""


_SIGNAL = "select token, date, idx::int as session_idx, variant, direction, entry as entry_price from "


def _signals(df: DataFrame) -> DataFrame:
    return df.select("token", day(), "session_idx", "variant", "direction", "entry_price")


# Sources.
@query(_with(select="select token, date, open, high, low, close, volume from b"))
def candles(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select("token", day(), "open", "high", "low", "close", "volume")


@query("select distinct l_suppkey as token from lineitem")
def universe(spark: SparkSession, d: str) -> DataFrame:
    return src.universe(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("token")))


@query("select distinct l_suppkey as token from lineitem order by token limit 25")
def capped_universe(spark: SparkSession, d: str) -> DataFrame:
    return src.universe(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("token")), most=25)


_RAW_SQL = "with s as (select o_custkey as token, case o_orderkey % 3 when 2 then null else o_orderdate::date end as date, o_totalprice as close from orders where o_orderkey % 9 != 8) "


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Orders as raw rows with dates as text, in two formats or none."""
    o, k = table(spark, d, "orders").where("o_orderkey % 9 != 8"), F.col("o_orderkey") % 3
    at = F.col("o_orderdate").cast("timestamp")
    text = F.when(k == 0, fm.rfc3339(at)).when(k == 1, F.date_format(at, "yyyy-MM-dd")).otherwise("soon")
    return o.select(F.col("o_custkey").alias("token"), text.alias("date"), F.col("o_totalprice").alias("close"))


def _scan_query(mode: str, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return src.scan(_raw(spark, d), mode).groupBy("token").agg(F.count("*").alias("bars"), F.count("date").alias("dated"), F.to_date(F.max("date")).alias("latest"))

    run.__name__ = f"scanned_{mode}"
    query(f"{_RAW_SQL}select token, count(*) as bars, count(date) as dated, max(date) as latest from s {where} group by token")(run)


for _mode, _where in (("skip", "where date is not null"), ("keep", ""), ("fail_token", "where token not in (select token from s where date is null)")):
    _scan_query(_mode, _where)


@query(_with(select="select date, close from b where token = 7 and date >= date '1995-01-01'"))
def history_scan(spark: SparkSession, d: str) -> DataFrame:
    return src.history(bars(spark, d), 7, "1995-01-01").select(day(), "close")


def _instruments(spark: SparkSession, d: str) -> DataFrame:
    """``part`` as an instrument master: promotional types are equities, the main segment is the first two brand groups."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("token"), F.col("p_name").alias("symbol"), F.when(F.col("p_type").rlike("BRASS|STEEL|ECONOMY|LARGE"), "EQ").otherwise("FUT").alias("instrument_type"),
        F.when(F.col("p_size") <= 25, "NSE").otherwise("BSE").alias("segment"), F.when(F.col("p_partkey") % 7 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("last_price"),
    )


_INS = "with i as (select p_partkey as token, p_name as symbol, case when regexp_matches(p_type, 'BRASS|STEEL|ECONOMY|LARGE') then 'EQ' else 'FUT' end as instrument_type, case when p_size <= 25 then 'NSE' else 'BSE' end as segment, case when p_partkey % 7 = 0 then 0.0 else p_retailprice end as last_price from part) "


@query(_INS + "select token, symbol from i where instrument_type = 'EQ' and segment = 'NSE' and last_price > 0")
def active_instruments(spark: SparkSession, d: str) -> DataFrame:
    return ins.active(_instruments(spark, d)).select("token", "symbol")


@query(_INS + "select count(*) as total, count(*) filter (where last_price > 0) as active, count(*) filter (where not last_price > 0) as filtered from i where instrument_type = 'EQ' and segment = 'NSE'")
def active_counts(spark: SparkSession, d: str) -> DataFrame:
    return ins.active_counts(_instruments(spark, d))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("token"), F.col("s_name").alias("symbol"), "s_nationkey", "s_acctbal")


def _index(spark: SparkSession, d: str) -> DataFrame:
    asia = table(spark, d, "region").where("r_name = 'ASIA'")
    nations = table(spark, d, "nation").join(asia, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    s = _suppliers(spark, d)
    return s.join(nations, s["s_nationkey"] == nations["n_nationkey"], "left_semi").select("symbol")


_INDEX = "x as (select s_name as symbol from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_name = 'ASIA')))"


@query(f"with {_INDEX} select s_suppkey as token, s_name as symbol from supplier where s_name in (select symbol from x)")
def index_members(spark: SparkSession, d: str) -> DataFrame:
    return ins.members(_suppliers(spark, d), _index(spark, d)).select("token", "symbol")


@query(f"with {_INDEX}, u as (select distinct l_suppkey as token from lineitem) select token from u where token in (select s_suppkey from supplier where s_name in (select symbol from x)) or not exists (select 1 from u join supplier on s_suppkey = token where s_name in (select symbol from x))")
def index_universe(spark: SparkSession, d: str) -> DataFrame:
    return ins.index_universe(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("token")), _suppliers(spark, d), _index(spark, d))


@query(_with(select="select token, case when token % 3 = 0 then 'T' || token else s_name end as symbol, count(*) as bars from b left join supplier on s_suppkey = token group by all"))
def symbol_defaults(spark: SparkSession, d: str) -> DataFrame:
    known = _suppliers(spark, d).where("token % 3 != 0")
    return ins.with_symbol(bars(spark, d), known).groupBy("token", "symbol").agg(F.count("*").alias("bars"))


# Store.
def _fresh(rows: DataFrame) -> DataFrame:
    return rows.where("token % 2 = 0 and date >= '1998-01-01'").withColumn("close", F.col("close") + 1).withColumn("date", F.when(F.col("token") % 4 == 0, F.date_add("date", 400)).otherwise(F.col("date")).cast("timestamp"))


@query(_with("f as (select * replace (close + 1 as close, case when token % 4 = 0 then date + 400 else date end as date) from b where token % 2 = 0 and date >= date '1998-01-01')", select="select token, date, close from f union all select token, date, close from b where (token, date) not in (select token, date from f)"))
def upserted(spark: SparkSession, d: str) -> DataFrame:
    rows = bars(spark, d)
    return store.upsert(rows, _fresh(rows)).select("token", day(), "close")


@query(_with(select=f"select token, count(*) as bars, min(date) as oldest from b where date >= date '{AS_OF}' - interval 3 year group by token"))
def retained(spark: SparkSession, d: str) -> DataFrame:
    rows = store.retained(bars(spark, d), F.lit(AS_OF).cast("date"), 3)
    return rows.groupBy("token").agg(F.count("*").alias("bars"), F.to_date(F.min("date")).alias("oldest"))


@query(_with(select="select token, count(*) as bars from b where token in (select s_suppkey from supplier where s_acctbal > 0) group by token"))
def listed_only(spark: SparkSession, d: str) -> DataFrame:
    return store.listed(bars(spark, d), _suppliers(spark, d).where("s_acctbal > 0")).groupBy("token").agg(F.count("*").alias("bars"))


@query(_with(select="select count(*) as rows, count(distinct token) as tokens from b where token not in (select s_suppkey from supplier where s_acctbal > 0)"))
def delisted_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.delisted_counts(bars(spark, d), _suppliers(spark, d).where("s_acctbal > 0"))


@query("select s_suppkey as token, case when s_suppkey % 3 = 0 then date '2020-01-01' else date '2021-01-01' end as recorded from supplier where s_acctbal <= 0 or s_suppkey % 3 = 0")
def no_data_marks(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    held = s.where("token % 3 = 0").select("token", F.lit("2020-01-01").cast("timestamp").alias("recorded_at"))
    return store.mark_no_data(held, s.where("s_acctbal <= 0"), F.lit("2021-01-01").cast("timestamp")).select("token", F.to_date("recorded_at").alias("recorded"))


@query(_with(select="select max(date) as latest, min(date) as oldest, count(*) as rows, count(distinct token) as tokens, count(distinct date) as dates from b"))
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.stats(bars(spark, d)).withColumns({"latest": F.to_date("latest"), "oldest": F.to_date("oldest")})


@query(_with(select="select token, max(date) as latest from b group by token order by latest desc, token limit 5"))
def latest_tokens(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_tokens(bars(spark, d)).withColumn("latest", F.to_date("latest"))


@query(_with(select="select token, min(date) as oldest, max(date) as latest, count(*) as bars from b group by token"))
def token_spans(spark: SparkSession, d: str) -> DataFrame:
    return store.spans(bars(spark, d)).withColumns({"latest": F.to_date("latest"), "oldest": F.to_date("oldest")})


@query(_with(select="select token, max(date) as latest from b group by token having max(date) < date '2001-10-27'"))
def stale_tokens(spark: SparkSession, d: str) -> DataFrame:
    return store.stale(bars(spark, d), F.lit("2001-10-28").cast("timestamp")).withColumn("latest", F.to_date("latest"))


_CHUNK = "from w, generate_series(0, 20) as s(i) where start <= stop and start + 1901 * i <= stop"
_CHUNKS = f'select token, i::int as chunk, (start + 1901 * i::int)::date as "from", least(start + 1901 * i::int + 1900, stop)::date as "to" {_CHUNK}'


@query(_with("w as (select token, max(date) + 1 as start, date '2010-01-01' as stop from b group by token)", select=_CHUNKS.replace("* i ", "* i::int ")))
def incremental_plan(spark: SparkSession, d: str) -> DataFrame:
    return store.incremental_plan(bars(spark, d), F.lit("2010-01-01").cast("date"))


@query(_with("w as (select token, (date '2000-01-01' - interval 20 year)::date as start, min(date) as stop from b group by token having min(date) > (date '2000-01-01' - interval 20 year)::date + 7)", select=_CHUNKS.replace("* i ", "* i::int ")))
def deep_plan(spark: SparkSession, d: str) -> DataFrame:
    return store.deep_plan(bars(spark, d), F.lit("2000-01-01").cast("date"), 20)


@query(
    _with(
        "h as (select token, max(date) as latest from b where token % 5 != 0 group by token)",
        select="""select s_suppkey as token, case when latest >= date '1998-11-29' then 'cached' when latest is not null then 'refresh' when s_suppkey % 10 = 0 then 'skip' else 'full' end as action,
  case when latest >= date '1998-11-29' then null when latest is not null then latest + 1 when s_suppkey % 10 = 0 then null else date '1995-11-30' end as start from supplier left join h on token = s_suppkey""",
    )
)
def boot_plan(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    return store.boot_plan(s, bars(spark, d).where("token % 5 != 0"), s.where("token % 10 = 0"), F.lit("1998-11-30").cast("timestamp"), 3)


@query(
    _with(
        "f as (select * replace (close + 1 as close, case when token % 4 = 0 then date + 400 else date end as date) from b where token % 2 = 0 and date >= date '1998-01-01')",
        "u as (select token, date, close, volume from f union all select token, date, close, volume from b where (token, date) not in (select token, date from f))",
        select=f"select token, date, close, volume from u where date >= date '{AS_OF}' - interval 1 year and token in (select s_suppkey from supplier where s_acctbal > 2000)",
    )
)
def rolled_up(spark: SparkSession, d: str) -> DataFrame:
    """The store's files after a day's roll-up: fresh candles merged, old ones and delisted tokens gone."""
    held = CandleStore(spark, f"{work_folder(spark)}/store", buckets=8)
    held.merge(bars(spark, d))
    daily.end_of_day(held, _fresh(held.read(1998)), F.lit(AS_OF).cast("date"), 1, _suppliers(spark, d).where("s_acctbal > 2000"))
    return held.read().select("token", day(), "close", "volume")


@query(_with(select="select token, date, close from b where date >= date '1991-06-01' and token in (select token from b where date >= date '1996-01-01')"))
def backfilled(spark: SparkSession, d: str) -> DataFrame:
    """A store that begins in 1996, deepened by the answers of an archive of all candles."""
    folder = work_folder(spark)
    rows = bars(spark, d)
    rows.write.partitionBy("token").parquet(f"{folder}/archive")
    held = CandleStore(spark, f"{folder}/store", buckets=8)
    held.merge(rows.where("date >= '1996-01-01'"))
    plan = store.deep_plan(held.read(), F.lit(AS_OF).cast("date"), 7)
    daily.backfill(held, plan, fetch.archive(f"{folder}/archive"), lanes=8, per_second=1e6)
    return held.read().select("token", day(), "close")


# Indicators.
_LINES = ["conversion", "base", "prev_conversion", "prev_base", "past_conversion", "past_prev_conversion", "past_base", "span_a", "span_b", "span_a_52", "span_b_52", "cloud_top", "cloud_bottom", "high_26", "low_27", "prev_close"]


@query(_with(_ichimoku_sql(), select=f"select token, date, {', '.join(_LINES)} from ich where idx >= 104"))
def ichimoku_lines(spark: SparkSession, d: str) -> DataFrame:
    return ind.with_ichimoku(bars(spark, d)).where("idx >= 104").select("token", day(), *_LINES)


@query(_with(_ichimoku_sql(_LIVE_FRAMES), select="select token, date, prev_conversion, prev_base from ich where idx >= 104"))
def ichimoku_live_lines(spark: SparkSession, d: str) -> DataFrame:
    return ind.with_ichimoku(bars(spark, d), live=True).where("idx >= 104").select("token", day(), "prev_conversion", "prev_base")


@query(_with(select=f"select token, date, round(case when idx >= 19 then avg(close) over ({_P} rows 19 preceding) end, 6) as sma from b"))
def sma20(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars(spark, d).select("token", day(), ind.sma(20).alias("sma")), "sma")


@query(_with(select=f"select token, date, round(({' + '.join(f'lag(close, {4 - k}) over ({_P}) * {k + 1}' for k in range(5))}) / 15, 6) as wma from b"))
def wma5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars(spark, d).select("token", day(), ind.wma(5).alias("wma")), "wma")


@query(_with(_HILEGA, select="select token, date, round(rsi, 6) as rsi, round(ema, 6) as ema, round(wma, 6) as wma from hl"))
def hilega_lines(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.with_hilega(bars(spark, d)).select("token", day(), "rsi", "ema", "wma"), "rsi", "ema", "wma")


@query(_with(select="select token, date_trunc('week', date)::date as bucket, arg_max(close, date) as close from b group by 1, 2"))
def weekly_closes(spark: SparkSession, d: str) -> DataFrame:
    return ind.resampled(bars(spark, d), "week")


@query(_with(select="select token, date_trunc('month', date)::date as bucket, arg_max(close, date) as close from b group by 1, 2"))
def monthly_closes(spark: SparkSession, d: str) -> DataFrame:
    return ind.resampled(bars(spark, d), "month")


@query(_with(_MTF, select="select token, date, round(rsi, 6) as rsi, round(rsi_weekly, 6) as rsi_weekly, round(rsi_monthly, 6) as rsi_monthly from mtf"))
def multi_timeframe_rsi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.with_mtf_rsi(bars(spark, d)).select("token", day(), "rsi", "rsi_weekly", "rsi_monthly"), "rsi", "rsi_weekly", "rsi_monthly")


# Signals.
@query(_with(_ichimoku_sql(), _ICH_RULES, select=_SIGNAL + "ichs"))
def ichimoku_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(signals.fired(bars(spark, d), signals.STRATEGIES["ichimoku"]))


@query(_with(_HILEGA, _HILEGA_RULES, select=_SIGNAL + "hils"))
def hilega_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(signals.fired(bars(spark, d), signals.STRATEGIES["hilega"]))


@query(_with(_HILEGA, _HILEGA_RULES, select=_SIGNAL + "hils where direction = 'LONG'"))
def hilega_long_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(signals.fired(bars(spark, d), signals.STRATEGIES["hilega-long"]))


@query(_with(_MTF, _gfs_rules(60), select=_SIGNAL + "gfss"))
def gfs_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(signals.fired(bars(spark, d), signals.STRATEGIES["rsi"]))


@query(_with(_MTF, _gfs_rules(50), select=_SIGNAL + "gfss"))
def gfs_signals_low_level(spark: SparkSession, d: str) -> DataFrame:
    return _signals(signals.fired(bars(spark, d), signals.Strategy("RSI", 18, signals.gfs_rules(mtf_level=50.0))))


@query(_with(_ichimoku_sql(), _ICH_RULES, select=_SIGNAL + "ichs where variant in ('IchimokuKinkoHyo (BUY)', 'IchimokuKinkoHyo (SELL)')"))
def allowed_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.fired(bars(spark, d), signals.STRATEGIES["ichimoku"])
    return _signals(signals.allow(rows, [" ichimokukinkohyo (buy) ", "IchimokuKinkoHyo (SELL)", "no such signal"]))


@query(_with(_ichimoku_sql(), _ICH_RULES, select=_SIGNAL + "ichs where variant like '%Cross%' or variant like '%1A%'"))
def matching_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.fired(bars(spark, d), signals.STRATEGIES["ichimoku"])
    return _signals(signals.matching(rows, ["cross", " 1a"]))


@query(_with(_ichimoku_sql(), _ICH_RULES, select=_SIGNAL + "ichs where date between date '1996-01-01' and date '1997-06-30'"))
def windowed_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(signals.in_window(signals.fired(bars(spark, d), signals.STRATEGIES["ichimoku"]), "1996-01-01", "1997-06-30"))


def _cool_sql(source: str, keys: str, n: int) -> str:
    return f"""
cl as (select {keys}, list_reduce(list_transform(list_sort(list(distinct idx)), lambda x: [x]), lambda a, x: case when x[1] - a[-1] >= {n} then list_concat(a, x) else a end) as kept from {source} group by {keys}),
cool as (select s.* from {source} s join cl using ({keys}) where list_contains(cl.kept, s.idx))"""


@query(_with(_ichimoku_sql(), _ICH_RULES, _cool_sql("ichs", "token, variant", 10), select=_SIGNAL + "cool"))
def cooled_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(signals.cooled(signals.fired(bars(spark, d), signals.STRATEGIES["ichimoku"]), 10))


def _cut(rows: DataFrame) -> DataFrame:
    """Bars up to a session that differs by token, so that the latest bars fall in all kinds of markets."""
    return rows.withColumn("idx", ind.session_index()).where("idx <= 180 + token * 97 % 300").drop("idx")


@query(_with(_ichimoku_sql(), _ICH_RULES, select="select token, s_name as symbol, date, case when prev_close <= cloud_top and open > cloud_top and not (open <= cloud_top and close > cloud_top) then 'GAP_OPEN' else 'INTRADAY' end as scenario, close from ichr join supplier on s_suppkey = token where rule = ' (BUY)'"))
def scanner_history(spark: SparkSession, d: str) -> DataFrame:
    return scanner.scan(bars(spark, d), _suppliers(spark, d), every_bar=True).select("token", "symbol", day(), "scenario", "close")


@query(_with(_ichimoku_sql(), _ICH_RULES, "z as (select *, max(idx) over (partition by token) as n from ichr where idx <= 180 + token * 97 % 300)", select="select token, s_name as symbol, date, case when prev_close <= cloud_top and open > cloud_top and not (open <= cloud_top and close > cloud_top) then 'GAP_OPEN' else 'INTRADAY' end as scenario, close from z join supplier on s_suppkey = token where rule = ' (BUY)' and idx = n"))
def scanner_latest(spark: SparkSession, d: str) -> DataFrame:
    return scanner.scan(_cut(bars(spark, d)), _suppliers(spark, d)).select("token", "symbol", day(), "scenario", "close")


@query(_with(_ichimoku_sql(_LIVE_FRAMES), _ICH_RULES, select=_SIGNAL + "ichs"))
def live_session_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(signals.fired(bars(spark, d), signals.LIVE_ICHIMOKU))


@query(_with(_ichimoku_sql(_LIVE_FRAMES), _ICH_RULES, select="select token, date, variant, direction, entry as entry_price from ichs where idx = 180 + token * 97 % 300 + 1"))
def live_signals(spark: SparkSession, d: str) -> DataFrame:
    """Running bars against the lines of the closed ones: the bar after each token's cut is the running one."""
    rows = bars(spark, d)
    running = _running(rows).where("idx = 180 + token * 97 % 300 + 1").drop("idx")
    return _live(live.live_signals(running, live.closed_states(_cut(rows), ["ichimoku"])))


def _running(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"idx": ind.session_index(), "day": F.to_date("date")}).withColumnRenamed("date", "ts")


def _live(df: DataFrame) -> DataFrame:
    return df.select("token", F.to_date("ts").alias("date"), "variant", "direction", "entry_price")


def _every_running_bar(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Each bar as the running one, against what the bars before it carry on."""
    return _live(live.every_bar_signals(bars(spark, d), list(names)))


_LIVE_SELECT = "select token, date, variant, direction, entry as entry_price from "


@query(_with(_MTF, _gfs_rules(60), select=_LIVE_SELECT + "gfss"))
def live_rsi_signals(spark: SparkSession, d: str) -> DataFrame:
    return _every_running_bar(spark, d, "rsi")


@query(_with(_HILEGA, _HILEGA_RULES, select=_LIVE_SELECT + "hils"))
def live_hilega_signals(spark: SparkSession, d: str) -> DataFrame:
    return _every_running_bar(spark, d, "hilega")


@query(_with(_HILEGA, _HILEGA_RULES, select=_LIVE_SELECT + "hils where direction = 'LONG'"))
def live_hilega_long_signals(spark: SparkSession, d: str) -> DataFrame:
    return _every_running_bar(spark, d, "hilega-long")


@query(_with(_ichimoku_sql(_LIVE_FRAMES), _ICH_RULES, _HILEGA, _HILEGA_RULES, _MTF, _gfs_rules(60), select=_LIVE_SELECT + "ichs union all " + _LIVE_SELECT + "hils union all " + _LIVE_SELECT + "gfss"))
def live_all_signals(spark: SparkSession, d: str) -> DataFrame:
    """Every strategy on every running bar, in one pass over the bars."""
    return _every_running_bar(spark, d, "ichimoku", "rsi", "hilega")


@query(_with(select="select token, count(*) as bars, max(date) as latest from b where date < date '1998-06-01' group by token"))
def closed_bars(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.closed_bars(bars(spark, d), F.lit(AS_OF).cast("date"))
    return rows.groupBy("token").agg(F.count("*").alias("bars"), F.to_date(F.max("date")).alias("latest"))


# Trades.
_HZ = [(h.label, h.days) for h in DEFAULT_HORIZONS]
_LEG = ["exit_price", "return_pct", "mfe_pct", "mae_pct"]


def _legs(df: DataFrame) -> DataFrame:
    df = rounded(df, *_LEG)
    return df.select("token", "session_idx", "variant", "horizon", "valid", F.to_date("exit_date").alias("exit_date"), *_LEG, "stopped", F.col("held_days").cast("double").alias("held_days"))


def _fixed_sql(source: str, cost: float = 0.0, cap: float = 60.0, name: str = "leg") -> str:
    """Legs without stops of the signals in ``source``."""
    ahead = ", ".join(
        f"lead(close, {n}) over ({_P}) as c{n}, lead(date, {n}) over ({_P}) as d{n}, max(high) over ({_P} rows between 1 following and {n} following) as h{n}, min(low) over ({_P} rows between 1 following and {n} following) as l{n}" for _, n in _HZ
    )
    each = " union all ".join(f"select s.token, s.date, s.idx, s.strategy, s.variant, s.direction, s.entry, '{lab}' as horizon, {n} as days, c{n} as x, d{n} as xd, h{n} as h, l{n} as l from {source} s join fw using (token, idx)" for lab, n in _HZ)
    return f"""
fw as (select token, idx, {ahead} from b),
fx as ({each}),
fy as (select *, case direction when 'SHORT' then -1.0::double else 1.0::double end as sg from fx),
fz as (select *, sg * ((x - entry) / entry * 100.0) + 0.0 - {cost / 100.0}::double as ret, sg * (((case when sg > 0 then h else l end) - entry) / entry * 100.0) as up, sg * (((case when sg > 0 then l else h end) - entry) / entry * 100.0) as down from fy),
{name} as (select *, x is not null and entry > 0 and abs(ret) <= {cap} as valid, x is not null and abs(ret) > {cap} as outlier, false as stopped, case when x is not null then days end as held from fz)"""


def _leg_select(name: str = "leg") -> str:
    on = lambda e: f"case when valid then {e} end"
    return (
        f"select token, idx::int as session_idx, variant, horizon, valid, {on('xd')} as exit_date, {on('round(x, 6)')} as exit_price, {on('round(ret, 6) + 0.0')} as return_pct, "
        f"{on('round(greatest(ret, up), 6) + 0.0')} as mfe_pct, {on('round(least(ret, down), 6) + 0.0')} as mae_pct, valid and stopped as stopped, {on('held::double')} as held_days from {name}"
    )


def _stop_sql(source: str, stop: StopRule, cost: float = 0.0, name: str = "leg") -> str:
    """Legs under a stop rule, as windows over the bars that follow each signal (all prices signed so that trades are long)."""
    avg = f"case when idx >= {stop.sma - 1} then avg(close) over ({_P} rows {stop.sma - 1} preceding) end" if stop.sma else "null::double"
    hard = f"entry * (case when sg > 0 then {1 - stop.max_loss_pct / 100}::double else {1 + stop.max_loss_pct / 100}::double end) * sg" if stop.max_loss_pct else "null::double"
    longest = max(n for _, n in _HZ)
    trail = stop.trail and stop.sma
    resting = "greatest(hard, level)" if trail and stop.intraday else "hard"
    close_rule = "cl < level and av is not null" if trail and not stop.intraday else "cl < av" if stop.sma and not stop.trail else "false"
    each = " union all ".join(
        f"""select s.*, '{lab}' as horizon, {n} as days, coalesce(e.k <= {n}, false) as stopped, case when e.k <= {n} then e.k when n.left_ >= {n} then {n} end as held, case when e.k <= {n} then e.fill * sg end as fill
        from su s left join ex e using (token, idx, variant) join (select token, idx, count(*) over (partition by token) - 1 - idx as left_ from b) n using (token, idx)"""
        for lab, n in _HZ
    )
    return f"""
av as (select *, {avg} as avg_ from b),
su as (select *, case direction when 'SHORT' then -1.0::double else 1.0::double end as sg from {source}),
fo as (select s.token, s.idx, s.variant, s.sg, {hard} as hard, f.idx - s.idx as k, case when sg > 0 then f.low else -f.high end as lo, sg * f.open as op, sg * f.close as cl, sg * f.avg_ as av
       from su s join av f on f.token = s.token and f.idx between s.idx + 1 and s.idx + {longest}),
lv as (select *, max(case when cl < av then lo end) over (partition by token, idx, variant order by k rows between unbounded preceding and 1 preceding) as level from fo),
fi as (select *, case when lo <= {resting} then least({resting}, op) when {close_rule} then cl end as fill from lv),
ex as (select token, idx, variant, min(k) as k, arg_min(fill, k) as fill from fi where fill is not null group by all),
se as ({each}),
sp as (select se.*, coalesce(se.fill, x.close) as x, x.date as xd,
         (select max(high) from b w where w.token = se.token and w.idx between se.idx + 1 and se.idx + se.held) as h, (select min(low) from b w where w.token = se.token and w.idx between se.idx + 1 and se.idx + se.held) as l
       from se left join b x on x.token = se.token and x.idx = se.idx + se.held),
sq as (select *, sg * ((x - entry) / entry * 100.0) + 0.0 - {cost / 100.0}::double as ret, sg * (((case when sg > 0 then h else l end) - entry) / entry * 100.0) as up, sg * (((case when sg > 0 then l else h end) - entry) / entry * 100.0) as down from sp),
{name} as (select *, held is not null and entry > 0 and abs(ret) <= 60 as valid from sq)"""


def _run(spark: SparkSession, d: str, strategy: str = "ichimoku", **config) -> DataFrame:
    run = BacktestConfig(**config)
    return trades.legs_of(bars(spark, d) if run.stop.active else gathered_bars(spark, d), signals.STRATEGIES[strategy], run)


@query(_with(_ichimoku_sql(), _ICH_RULES, _fixed_sql("ichs"), select=_leg_select()))
def legs_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _legs(_run(spark, d))


@query(_with(_ichimoku_sql(), _ICH_RULES, _fixed_sql("ichs", cost=20.0), select=_leg_select()))
def legs_with_costs(spark: SparkSession, d: str) -> DataFrame:
    return _legs(_run(spark, d, cost_bps=20.0))


@query(_with(_ichimoku_sql(), _ICH_RULES, _fixed_sql("ichs", cap=5.0), select="select horizon, count(*) as legs, count(*) filter (where outlier) as outliers, count(*) filter (where valid) as valid from leg group by horizon"))
def legs_outlier(spark: SparkSession, d: str) -> DataFrame:
    rows = _run(spark, d, max_move_pct=5.0)
    return rows.groupBy("horizon").agg(F.count("*").alias("legs"), F.count_if("outlier").alias("outliers"), F.count_if("valid").alias("valid"))


_STOPS = {
    "legs_sma_stop": StopRule(sma=20),
    "legs_trailing_close": StopRule(sma=20, trail=True),
    "legs_trailing_intraday": StopRule(sma=20, trail=True, intraday=True),
    "legs_hard_floor": StopRule(max_loss_pct=3.0),
    "legs_sma_and_floor": StopRule(sma=20, max_loss_pct=2.0),
    "legs_trailing_and_floor": StopRule(sma=10, trail=True, intraday=True, max_loss_pct=2.0),
}


def _stop_query(name: str, stop: StopRule) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _legs(_run(spark, d, stop=stop))

    run.__name__ = name
    query(_with(_ichimoku_sql(), _ICH_RULES, _stop_sql("ichs", stop), select=_leg_select()))(run)


for _name, _stop in _STOPS.items():
    _stop_query(_name, _stop)


@query(_with(_ichimoku_sql(), _ICH_RULES, _stop_sql("ichs", StopRule(sma=20)), select="select count(*) as legs, round(avg(stopped::int) * 100, 6) as stopped_pct, round(avg(held), 6) as avg_held from leg where valid and horizon = '1M'"))
def stop_usage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.stop_usage(_run(spark, d, stop=StopRule(sma=20)), "1M"), "stopped_pct", "avg_held")


# Statistics.
_STATS_SQL = """
lg as (select *, case when valid then ret end as r, greatest(ret, up) as mfe, least(ret, down) as mae from leg),
gr as (select 'overall' as group_type, 'ALL SIGNALS' as "group", * from lg union all select 'signal', variant, * from lg union all select 'direction', direction, * from lg union all select 'year', year(date)::varchar, * from lg),
su0 as (select group_type, "group", horizon, days as horizon_days, count(*) as signals, count(*) filter (where direction = 'LONG') as longs, count(*) filter (where direction = 'SHORT') as shorts,
  count(r) as n, count(*) filter (where r > 0) as wins, count(*) filter (where r < 0) as losses, coalesce(avg(r), 0) as avg_pct, coalesce(sum(r), 0) as total_pct, coalesce(median(r), 0) as median_pct,
  coalesce(stddev_samp(r), 0) as stddev_pct, coalesce(max(r), 0) as best_pct, coalesce(min(r), 0) as worst_pct, coalesce(avg(r) filter (where r > 0), 0) as avg_win_pct, coalesce(avg(r) filter (where r < 0), 0) as avg_loss_pct,
  coalesce(sum(r) filter (where r > 0), 0) as gain, coalesce(sum(r) filter (where r < 0), 0) as pain, coalesce(avg(mfe) filter (where valid), 0) as avg_mfe_pct, coalesce(avg(mae) filter (where valid), 0) as avg_mae_pct
  from gr group by all),
summary as (select *, n - wins - losses as flat, case when n > 0 then wins / n * 100 else 0 end as win_pct, case when stddev_pct > 0 then avg_pct / stddev_pct else 0 end as sharpe,
  case when wins > 0 and losses > 0 then avg_win_pct / abs(avg_loss_pct) else 0 end as payoff_ratio, case when pain < 0 then gain / -pain when gain > 0 then 'inf'::double else 0 end as profit_factor from su0)"""
_STAT_DOUBLES = ["avg_pct", "total_pct", "median_pct", "stddev_pct", "best_pct", "worst_pct", "avg_win_pct", "avg_loss_pct", "avg_mfe_pct", "avg_mae_pct", "win_pct", "sharpe", "payoff_ratio", "profit_factor"]
_STAT_LONGS = ["signals", "longs", "shorts", "n", "wins", "losses", "flat"]
_STATS_SELECT = 'select group_type, "group", horizon, ' + ", ".join([*_STAT_LONGS, *(f"round({c}, 5)::double + 0.0 as {c}" for c in _STAT_DOUBLES)]) + " from summary"


def _stats(df: DataFrame) -> DataFrame:
    return rounded(df, *_STAT_DOUBLES, places=5).select("group_type", "group", "horizon", *_STAT_LONGS, *_STAT_DOUBLES)


@query(_with(_ichimoku_sql(), _ICH_RULES, _fixed_sql("ichs"), _STATS_SQL, select=_STATS_SELECT))
def summary_ichimoku(spark: SparkSession, d: str) -> DataFrame:
    return _stats(metrics.summarize(_run(spark, d)))


@query(_with(_HILEGA, _HILEGA_RULES, _fixed_sql("hils"), _STATS_SQL, select=_STATS_SELECT))
def summary_hilega(spark: SparkSession, d: str) -> DataFrame:
    return _stats(metrics.summarize(_run(spark, d, "hilega")))


def _cell(x: str, places: int = 4) -> str:
    """Fixed decimals, ties to even on the shortest decimal that names the double; null where not finite."""
    n = f"({x}::varchar::decimal(38,18) * 1{'0' * places})"
    return f"case when isfinite({x}) then printf('%.{places}f', (floor({n}) + case when {n} - floor({n}) > 0.5 or {n} - floor({n}) = 0.5 and floor({n})::hugeint % 2 != 0 then 1 else 0 end)::double / 1{'0' * places}) end"


_SUMMARY_CELLS = "win_pct, wins, losses, avg_pct, median_pct, stddev_pct, avg_win_pct, avg_loss_pct, profit_factor, payoff_ratio, sharpe, best_pct, worst_pct, avg_mfe_pct, avg_mae_pct, total_pct".split(", ")


@query(_with(_ichimoku_sql(), _ICH_RULES, _fixed_sql("ichs"), _STATS_SQL, select='select group_type, "group", horizon, horizon_days, signals, n, ' + ", ".join(f"{f'{c}::varchar' if c in ('wins', 'losses') else _cell(f'round({c}, 9)')} as {c}" for c in _SUMMARY_CELLS) + " from summary"))
def summary_table(spark: SparkSession, d: str) -> DataFrame:
    """All groupings and cells; sums differ in their last bits by order, so nine places are kept before the cells' four."""
    rows = metrics.summarize(_run(spark, d))
    return backtest.summary_table(rounded(rows, *_STAT_DOUBLES, places=9))


def _top(order: str) -> str:
    return f"select token, date, variant, round(ret, 6) as return_pct from leg where valid and horizon = '1M' order by ret {order}, date, token, variant limit 10"


@query(_with(_ichimoku_sql(), _ICH_RULES, _fixed_sql("ichs"), select=_top("desc")))
def best_trades(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.top_trades(_run(spark, d), "1M", 10).select("token", day(), "variant", "return_pct"), "return_pct")


@query(_with(_ichimoku_sql(), _ICH_RULES, _fixed_sql("ichs"), select=_top("asc")))
def worst_trades(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.top_trades(_run(spark, d), "1M", 10, best=False).select("token", day(), "variant", "return_pct"), "return_pct")


@query(
    _with(
        _ichimoku_sql(), _ICH_RULES, _fixed_sql("ichs"),
        select="select 'T' || token as symbol, token, strategy, variant as signal, direction, strftime(date, '%Y-%m-%d') as entry_date, printf('%.2f', entry) as entry_price, "
        + ", ".join(
            f"max(case when valid and horizon = '{h}' then {cell} end) as \"{h.lower()}_{name}\""
            for h, _ in _HZ
            for name, cell in {
                "exit_date": "strftime(xd, '%Y-%m-%d')", "exit_price": _cell("x", 2), "return_pct": _cell("ret"), "mfe_pct": _cell("greatest(ret, up)"), "mae_pct": _cell("least(ret, down)"),
                "exit_reason": "'horizon'", "held_days": "held::varchar",
            }.items()
        )
        + " from leg group by token, strategy, variant, direction, date, entry",
    )
)
def trades_table(spark: SparkSession, d: str) -> DataFrame:
    return backtest.trades_table(_run(spark, d), DEFAULT_HORIZONS)


@query(_with(_ichimoku_sql(), _ICH_RULES, _fixed_sql("ichs"), "tn as (select token, count(*) as n, min(date) as f, max(date) as l from b group by token)", select="select count(*) as universe, count(*) filter (where n > 110) as replayed, count(*) filter (where n <= 110) as skipped, coalesce(sum(n - 110) filter (where n > 110), 0)::bigint as sessions, min(f) filter (where n > 110) as data_start, max(l) filter (where n > 110) as data_end, (select count(*) from leg where outlier) as outliers, (select min(date) from leg) as first_signal, (select max(date) from leg) as last_signal from tn"))
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = bars(spark, d)
    got = metrics.run_counters(rows, _run(spark, d), 110)
    return got.withColumns({c: F.to_date(c) for c in ("data_start", "data_end", "first_signal", "last_signal")})


# Confluence.
_TWO = ["IchimokuKinkoHyo", "HilegaMilega"]
_COMPACT = "case when trim(substr(variant, length(strategy) + 1)) = '' then upper(substr(strategy, 1, 3)) else upper(substr(strategy, 1, 3)) || ' ' || trim(substr(variant, length(strategy) + 1)) end"


def _confluence_sql(sources: list[str], require_all: bool, window: int = 5, cooldown: int = 5) -> str:
    n = len(sources)
    eligible = f"where token in (select token from tr0 group by token having count(distinct strategy) = {n})" if require_all else ""
    return (
        f"""
tr0 as ({" union all ".join(f"select * from {s}" for s in sources)}),
tr as (select *, {_COMPACT} as short from tr0 {eligible}),
pr as (select a.token, a.idx, a.strategy, a.variant, a.direction, p.strategy as other, max(case when p.direction = a.direction then p.idx end) as best, arg_max(p.short, p.idx) filter (where p.direction = a.direction) as name, bool_or(p.direction != a.direction) as opp
       from tr a join tr p on p.token = a.token and p.strategy != a.strategy and a.idx - p.idx between 0 and {window} group by all),
an as (select token, idx, strategy, variant, direction, count(best) as partners, max((best is null and opp)::int) as conflict, min(best) as earliest, list(name) filter (where best is not null) as names from pr group by all),
ev0 as (select *, row_number() over (partition by token, direction, idx order by variant) as rn from an where partners >= {n - 1 if require_all else 1}),
ev as (select * from ev0 where rn = 1),"""
        + _cool_sql("ev", "token, direction", cooldown).lstrip("\n")
    ).strip()


def _confluence_select() -> str:
    return f"select c.token, t.date, c.idx::int as session_idx, array_to_string(list_sort(list_concat([t.short], c.names)), '  +  ') as variant, c.direction, t.entry as entry_price, (c.idx - c.earliest)::int as align_gap from cool c join tr t on t.token = c.token and t.idx = c.idx and t.strategy = c.strategy and t.variant = c.variant"


def _trades(spark: SparkSession, d: str, *names: str, horizons: tuple = ()) -> DataFrame:
    return signals.fired_together(gathered_bars(spark, d), [signals.STRATEGIES[n] for n in names], horizons)


def _events(df: DataFrame) -> DataFrame:
    return df.select("token", day(), "session_idx", "variant", "direction", "entry_price", "align_gap")


@query(_with(_ichimoku_sql(), _ICH_RULES, _HILEGA, _HILEGA_RULES, _confluence_sql(["ichs", "hils"], True), select=_confluence_select()))
def confluence_all(spark: SparkSession, d: str) -> DataFrame:
    return _events(con.confluence(_trades(spark, d, "ichimoku", "hilega"), _TWO))


@query(_with(_ichimoku_sql(), _ICH_RULES, _HILEGA, _HILEGA_RULES, _MTF, _gfs_rules(60), _confluence_sql(["ichs", "hils", "gfss"], False), select=_confluence_select()))
def confluence_any(spark: SparkSession, d: str) -> DataFrame:
    return _events(con.confluence(_trades(spark, d, "ichimoku", "hilega", "rsi"), [*_TWO, "RSI"], ConfluenceOptions(require_all=False)))


@query(_with(_ichimoku_sql(), _ICH_RULES, _HILEGA, _HILEGA_RULES, _confluence_sql(["ichs", "hils"], True), select="select coalesce(sum(conflict), 0)::bigint as conflicts from an"))
def confluence_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return con.conflicts(_trades(spark, d, "ichimoku", "hilega"), _TWO, ConfluenceOptions())


@query(_with(_ichimoku_sql(), _ICH_RULES, _HILEGA, _HILEGA_RULES, _confluence_sql(["ichs", "hils"], True), f"evs as (select e.token, e.date, e.session_idx as idx, 'Confluence' as strategy, e.variant, e.direction, e.entry_price as entry from ({_confluence_select()}) e)", _fixed_sql("evs"), select=_leg_select()))
def confluence_legs(spark: SparkSession, d: str) -> DataFrame:
    run = BacktestConfig()
    found = _trades(spark, d, "ichimoku", "hilega", horizons=run.horizons)
    return _legs(trades.legs_ahead(con.confluence(found, _TWO, keep=trades.looks(run.horizons)), run))


@query(_with(_ichimoku_sql(), _ICH_RULES, _HILEGA, _HILEGA_RULES, _confluence_sql(["ichs", "hils"], True), select=f"select count(*) as events, round(avg(align_gap), 6) as mean_gap from ({_confluence_select()})"))
def confluence_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(con.mean_gap(con.confluence(_trades(spark, d, "ichimoku", "hilega"), _TWO)), "mean_gap")


@query(_with(_ichimoku_sql(), _ICH_RULES, _HILEGA, _HILEGA_RULES, _confluence_sql(["ichs", "hils"], True), "two as (select token, date, idx, strategy, variant, direction, entry from ichs union all select token, date, idx, strategy, variant, direction, entry from hils)", _fixed_sql("two", cap=5.0), "tn as (select token, count(*) as n, min(date) as f, max(date) as l from b group by token)", f"wu as (select n, f, l, w from tn, (values (110), ({signals.STRATEGIES['hilega'].warmup})) as t(w) where n > w)", f"met as ({_confluence_select()})", select="select (select count(*) from tn) as universe, (select count(*) from tn where n > 110) as replayed, (select count(*) from tn where n <= 110) as skipped, sum(n - w)::bigint as sessions, min(f) as data_start, max(l) as data_end, (select count(*) from leg where outlier) as outliers, (select min(date)::date from met) as first_signal, (select max(date)::date from met) as last_signal from wu"))
def combined_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = bars(spark, d)
    each = [metrics.run_counters(rows, _run(spark, d, n, max_move_pct=5.0), signals.STRATEGIES[n].warmup) for n in ("ichimoku", "hilega")]
    got = con.combined_counters(each, con.confluence(_trades(spark, d, "ichimoku", "hilega"), _TWO))
    return got.withColumns({c: F.to_date(c) for c in ("data_start", "data_end", "first_signal", "last_signal")})


@query(_with(_ichimoku_sql(), _ICH_RULES, _fixed_sql("ichs"), select="select horizon, count(*) as legs, count(*) filter (where valid) as valid from leg where direction = 'LONG' group by horizon"))
def filtered_run(spark: SparkSession, d: str) -> DataFrame:
    result = backtest.run(bars(spark, d), signals.STRATEGIES["ichimoku"]).filtered("direction = 'LONG'", "longs only")
    return result.legs.groupBy("horizon").agg(F.count("*").alias("legs"), F.count_if("valid").alias("valid"))


# Ticks and alerts.
@query("select user_id as token, (ts + interval 330 minute)::date as day, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*) as ticks from events group by 1, 2")
def intraday_bars(spark: SparkSession, d: str) -> DataFrame:
    return live.intraday_bars(live.ticks(table(spark, d, "events")))


@query("select event_type as strategy, user_id as token, (ts + interval 330 minute)::date as day, min(ts) as ts, arg_min(event_type || ' (' || (event_id % 3) || ')', ts) as variant from events group by 1, 2, 3")
def first_of_day(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("strategy"), F.col("user_id").alias("token"), F.col("ts").cast("timestamp").alias("ts"), F.format_string("%s (%d)", "event_type", F.col("event_id") % 3).alias("variant"))
    return live.first_of_day(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""select event_id, '{"username":"Signals","embeds":[{"title":"📊 S' || user_id || '","description":"**S' || user_id || '** triggered the **' || event_type || '** strategy.","color":51283,"footer":{"text":"Signals Engine"},"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}]}' as body from events""")
def alert_payloads(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", fm.alert_payload(F.concat(F.lit("S"), F.col("user_id").cast("string")), F.col("event_type"), ts).alias("body"))


@query("""select event_type as strategy, user_id as token, ts, '{"username":"Signals","embeds":[{"title":"📊 ' || coalesce(s_name, 'UNKNOWN') || '","description":"**' || coalesce(s_name, 'UNKNOWN') || '** triggered the **' || event_type || '** strategy.","color":51283,"footer":{"text":"Signals Engine"},"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}]}' as body from events left join supplier on s_suppkey = user_id""")
def named_payloads(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("strategy"), F.col("user_id").alias("token"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("variant"))
    return live.payloads(e, _suppliers(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select event_id, '[' || event_type || '] S' || user_id || ' | Time: ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as line from events")
def signal_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fm.signal_line(F.col("event_type"), F.concat(F.lit("S"), F.col("user_id").cast("string")), F.col("ts").cast("timestamp")).alias("line"))


@query("select s_suppkey as token, unnest([s_suppkey, s_suppkey * 10, 7])::bigint as listed from supplier")
def token_lists(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(", ", F.col("token"), F.lit(""), F.col("token") * 10, F.lit(" 7 "))
    return _suppliers(spark, d).select("token", F.explode(ins.token_list(text)).alias("listed"))


@query("select event_type, sum(cast(props->>'k' as bigint))::bigint as total, count(*) as n from events group by event_type")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


# Formats.
@query("""select s_suppkey as token, case when length(s_name) <= 12 then s_name else left(s_name, 11) || '…' end as short, printf('%+.2f', s_acctbal) as signed, case when s_acctbal = 0 then '—' else printf('%.2f', s_acctbal) end as ratio,
  replace(replace(translate(lower(s_name || ' (A/B)'), ' /', '--'), '(', ''), ')', '') as stem, format('{:,}', s_suppkey * 12345) as grouped from supplier""")
def formatted(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    bal = F.col("s_acctbal")
    return s.select(
        "token", fm.ellipsis(F.col("symbol"), 12).alias("short"), fm.signed(bal).alias("signed"), fm.ratio(bal).alias("ratio"),
        fm.file_stem(F.concat("symbol", F.lit(" (A/B)"))).alias("stem"), fm.thousands(F.col("token") * 12345).alias("grouped"),
    )


@query("""with m as (select o_orderkey, '2026/01/01 main.go:42: ' || case o_orderpriority when '1-URGENT' then 'Fatal ' when '2-HIGH' then 'warning ' else '' end || o_orderstatus || ': done' as line from orders)
select o_orderkey, substr(line, instr(line, ': ') + 2) as msg, case when upper(line) like '%FATAL%' or upper(line) like '%ERROR%' then 'ERROR' when upper(line) like '%WARN%' then 'WARN' else 'INFO' end as level from m""")
def log_records(spark: SparkSession, d: str) -> DataFrame:
    pri = F.col("o_orderpriority")
    line = F.concat(F.lit("2026/01/01 main.go:42: "), F.when(pri == "1-URGENT", "Fatal ").when(pri == "2-HIGH", "warning ").otherwise(""), F.col("o_orderstatus"), F.lit(": done"))
    return table(spark, d, "orders").select("o_orderkey", fm.log_message(line).alias("msg"), fm.log_level(line).alias("level"))


@query("""with m as (select o_orderkey, o_orderdate, case o_orderpriority when '1-URGENT' then 'Fatal ' when '2-HIGH' then 'warning ' else '' end || o_orderstatus || ': "done"' as msg from orders)
select o_orderdate::date as day, '{"time":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '","level":"' || case when upper(msg) like '%FATAL%' then 'ERROR' when upper(msg) like '%WARN%' then 'WARN' else 'INFO' end || '","msg":"' || replace(msg, '"', '\\"') || ' ' || o_orderkey || '"}' as value from m""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    pri = F.col("o_orderpriority")
    line = F.concat(F.lit("2026/01/01 error.go:42: "), F.when(pri == "1-URGENT", "Fatal ").when(pri == "2-HIGH", "warning ").otherwise(""), F.col("o_orderstatus"), F.lit(': "done" '), F.col("o_orderkey").cast("string"), F.lit("\n"))
    return logs.records(table(spark, d, "orders").select(line.alias("line"), F.col("o_orderdate").cast("timestamp").alias("at")))


@query("""select event_id, '{"username":"Signals","embeds":[{"title":"' || case when event_id % 3 = 0 then '⚠️ ' else 'ℹ️ ' end || event_type || '","description":"token ' || user_id || '","color":' || case when event_id % 3 = 0 then 16739584 else 2718207 end || ',"footer":{"text":"Signals Engine"},"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}]}' as body from events""")
def notice_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.select("event_id", fm.notice_payload(F.col("event_type"), F.format_string("token %d", "user_id"), F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp")).alias("body"))


@query(_INS + f", {_INDEX.replace('s_name as symbol from supplier', 'p_name as symbol from part join supplier on s_suppkey = p_partkey % 10 + 1')} select token, symbol from i where instrument_type = 'EQ' and segment = 'NSE' and symbol in (select symbol from x)")
def discovered_members(spark: SparkSession, d: str) -> DataFrame:
    """The index's list can't be read where it is asked for first; a kept table is the next source."""
    some = _index_of(spark, d)
    found, _ = ins.discovered(_instruments(spark, d), [f"{d}/no-such-list.csv", some])
    return found.select("token", "symbol")


def _index_of(spark: SparkSession, d: str) -> DataFrame:
    asia = _suppliers(spark, d).join(_index(spark, d), "symbol", "left_semi").select(F.col("token").alias("__s"))
    return table(spark, d, "part").join(asia, F.col("p_partkey") % 10 + 1 == F.col("__s"), "left_semi").select(F.col("p_name").alias("symbol"))


@query("select o_orderkey, case o_orderkey % 3 when 2 then null else o_orderdate::date end as d from orders")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey") % 3, F.col("o_orderdate").cast("timestamp")
    text = F.when(k == 0, fm.rfc3339(at)).when(k == 1, F.date_format(at, "yyyy-MM-dd")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", F.to_date(src.parsed_date(text)).alias("d"))
