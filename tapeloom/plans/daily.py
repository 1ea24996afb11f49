"""Jobs over the candle store: back-fill, boot and the roll-up after the market closes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import work_folder
from ..sources.fetch import Fetch, answers
from ..sources.store import boot_plan, chunks, mark_no_data
from ..sources.stored import CandleStore
from ..streaming.live import closed_states


@dataclass(frozen=True)
class Filled:
    """What a back-fill did, by token, and its answers."""

    updated: int
    empty: int
    failed: int
    candles: int
    answers: DataFrame


def candles_of(got: DataFrame) -> DataFrame:
    return got.select("token", F.explode("bars").alias("b")).select("token", "b.*")


def backfill(store: CandleStore, plan: DataFrame, fetch: Fetch, **limits) -> Filled:
    """Ask for every chunk of ``plan`` and put the answers into the store.

    The answers are written first, so that no chunk is asked for twice; a token
    whose later chunk failed keeps what came before.
    """
    path = f"{work_folder(store.spark)}/answers"
    answers(plan, fetch, **limits).write.parquet(path)
    got = store.spark.read.parquet(path)
    store.merge(candles_of(got))
    by_token = got.groupBy("token").agg(F.sum(F.size("bars")).alias("n"), F.count("error").alias("errors"))
    r = by_token.agg(
        F.count_if((F.col("errors") == 0) & (F.col("n") > 0)).alias("updated"), F.count_if((F.col("errors") == 0) & (F.col("n") == 0)).alias("empty"),
        F.count_if(F.col("errors") > 0).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("candles"),
    ).first()
    return Filled(r["updated"], r["empty"], r["failed"], r["candles"], got)


def boot(store: CandleStore, universe: DataFrame, marked: DataFrame, fetch: Fetch, as_of: Column, years: int = 3, **limits) -> tuple[Filled, DataFrame]:
    """Bring every token of the universe up to ``as_of``: what is fresh or known to be empty is not asked for.

    Returns what was done and the list of tokens without data, with those on it
    that were asked for their whole history and gave none.
    """
    path = f"{work_folder(store.spark)}/plan"
    boot_plan(universe, store.read(), marked, as_of, years).where("start is not null").write.parquet(path)  # of the store as it is now
    plan = store.spark.read.parquet(path)
    asked = chunks(plan.select("token", "start", F.to_date(as_of).alias("end")))
    done = backfill(store, asked, fetch, **limits)
    full = plan.where("action = 'full'").select("token")
    none = done.answers.groupBy("token").agg(F.sum(F.size("bars")).alias("n"), F.count("error").alias("errors")).where("n = 0 and errors = 0")
    return done, mark_no_data(marked, none.join(full, "token", "left_semi"), as_of)


def end_of_day(store: CandleStore, today: DataFrame, as_of: Column, years: int = 3, active: DataFrame | None = None) -> DataFrame:
    """Close the day: merge ``today``'s candles, drop what is too old and (given ``active``) what is no longer listed.

    Returns the closed states of all strategies for the next session
    (``closed_states``), to be written and joined by ``live_signals``. Running it
    again for the same day gives the same store.
    """
    store.close_day(today, as_of, years, active)
    return closed_states(store.read())
