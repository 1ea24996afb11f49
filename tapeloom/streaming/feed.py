"""Ticks from an injected feed as a streaming data source."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TICK = "token long, ts timestamp, price double"


class Feed(Protocol):
    """Numbered ticks that can be read again from any number on, as a recorder or a broker keeps them.

    It is sent to the tasks, so it must be picklable and open its connections where it is used.
    """

    def end(self) -> int:
        """One more than the last tick's number."""

    def ticks(self, start: int, stop: int, lane: int, lanes: int) -> Iterator[tuple]:
        """``(token, ts, price)`` of ticks ``start`` to ``stop`` (not included) whose token belongs to the lane (``token % lanes == lane``), in order of number."""


class _Lane(InputPartition):
    def __init__(self, start: int, stop: int, lane: int) -> None:
        super().__init__((start, stop, lane))


class TickReader(DataSourceStreamReader):
    """Micro-batches of at most ``most`` ticks; a lane of tokens is a task, so that a token's ticks keep their order.

    The offset is the number of the next tick. Spark keeps it in the query's
    checkpoint and names it by ``partitions`` when the query starts again, which
    bounds the next batch from there. Ticks beyond the bound wait in the feed;
    none is dropped.
    """

    def __init__(self, feed: Feed, lanes: int, most: int) -> None:
        self.feed, self.lanes, self.most = feed, lanes, most
        self.at = 0

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": max(self.at, min(self.at + self.most, self.feed.end()))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at, end["next"])
        return [_Lane(start["next"], end["next"], k) for k in range(self.lanes)] if end["next"] > start["next"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, stop, lane = partition.value
        yield from self.feed.ticks(start, stop, lane, self.lanes)

    def commit(self, end: dict) -> None:
        pass


def tick_stream(spark: SparkSession, feed: Feed, lanes: int = 3, most: int = 50_000) -> DataFrame:
    """The feed's ticks as a stream (``token, ts, price``), at most ``most`` a micro-batch, from ``lanes`` connections."""

    class Ticks(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tapeloom_ticks"

        def schema(self) -> str:
            return TICK

        def streamReader(self, schema) -> DataSourceStreamReader:
            return TickReader(feed, lanes, most)

    spark.dataSource.register(Ticks)
    return spark.readStream.format("tapeloom_ticks").load()
