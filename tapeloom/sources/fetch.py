"""Planned requests for candles as a Spark data source: partitions are lanes of requests, rows their answers."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

#: A client: the bars ``(date, open, high, low, close, volume)`` of a token from one day to another, both included; dates are datetimes.
Fetch = Callable[[int, dt.date, dt.date], Sequence[tuple]]

ANSWER = "token long, chunk int, from date, to date, error string, bars array<struct<date: timestamp, open: double, high: double, low: double, close: double, volume: long>>"
ASKED, FAILED, SKIPPED = None, "failed", "skipped"
_BAR = pa.struct([("date", pa.timestamp("us", "UTC")), *((c, pa.float64()) for c in ("open", "high", "low", "close")), ("volume", pa.int64())])


def _answer(token: int, chunk: int, first: dt.date, last: dt.date, error: str | None, bars: Sequence[tuple]) -> pa.RecordBatch:
    """One answer as a batch; its bars become columns at once, not value by value."""
    columns = list(zip(*bars, strict=True)) or [()] * _BAR.num_fields
    listed = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BAR, strict=True)], fields=list(_BAR))
    cells = [pa.array([token], pa.int64()), pa.array([chunk], pa.int32()), pa.array([first], pa.date32()), pa.array([last], pa.date32()), pa.array([error], pa.string())]
    return pa.RecordBatch.from_arrays([*cells, pa.ListArray.from_arrays(pa.array([0, len(bars)], pa.int32()), listed)], names=["token", "chunk", "from", "to", "error", "bars"])


class _Lane(InputPartition):
    def __init__(self, requests: list[tuple]) -> None:
        super().__init__(requests)


class _Requests(DataSourceReader):
    def __init__(self, requests: list[tuple], fetch: Fetch, lanes: int, per_second: float, attempts: int) -> None:
        self.requests, self.fetch, self.lanes, self.attempts = requests, fetch, lanes, attempts
        self.pause = lanes / per_second

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Requests that a filter on ``token``, ``from`` or ``to`` leaves out are not made."""
        place = {"token": 0, "from": 2, "to": 3}
        for f in filters:
            at = place.get(f.attribute[0]) if isinstance(f, (EqualTo, In, GreaterThanOrEqual, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if at is None:
                yield f
            elif isinstance(f, EqualTo):
                self.requests = [r for r in self.requests if r[at] == f.value]
            elif isinstance(f, In):
                self.requests = [r for r in self.requests if r[at] in f.value]
            elif isinstance(f, GreaterThanOrEqual):
                self.requests = [r for r in self.requests if r[at] >= f.value]
            else:
                self.requests = [r for r in self.requests if r[at] <= f.value]

    def partitions(self) -> Sequence[InputPartition]:
        lanes: list[list[tuple]] = [[] for _ in range(self.lanes)]
        of: dict[int, list[tuple]] = {}
        for r in sorted(self.requests):  # a token's requests share a lane, in order
            if r[0] not in of:
                of[r[0]] = min(lanes, key=len)
            of[r[0]].append(r)
        return [_Lane(lane) for lane in lanes if lane]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        failed, after = None, 0.0
        for token, chunk, first, last in partition.value:
            if token == failed:
                yield _answer(token, chunk, first, last, SKIPPED, [])
                continue
            for attempt in range(self.attempts):
                time.sleep(max(0.0, after - time.monotonic()))
                after = time.monotonic() + self.pause
                try:
                    yield _answer(token, chunk, first, last, ASKED, self.fetch(token, first, last))
                    break
                except Exception as e:
                    if attempt == self.attempts - 1:
                        failed = token
                        yield _answer(token, chunk, first, last, f"{FAILED}: {e}", [])
                    else:
                        time.sleep(min(2**attempt, 30) * self.pause)


def answers(plan: DataFrame, fetch: Fetch, lanes: int = 3, per_second: float = 3.0, attempts: int = 3) -> DataFrame:
    """An answer for each request of ``plan`` (``token, chunk, from, to``): its ``bars``, or its ``error``.

    ``lanes`` tasks ask at most ``per_second`` times in all, each chunk up to
    ``attempts`` times. After a chunk that fails, the token's later ones are
    skipped; what came before is kept. The plan's rows, a few for each token of
    the universe, are listed on the driver. Each evaluation asks again: write the
    answers before they are read twice (``backfill`` does).
    """
    spark = plan.sparkSession
    requests = [(r["token"], r["chunk"], r["from"], r["to"]) for r in plan.select("token", "chunk", "from", "to").collect()]

    class History(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tapeloom_history"

        def schema(self) -> str:
            return ANSWER

        def reader(self, schema) -> DataSourceReader:
            return _Requests(requests, fetch, lanes, per_second, attempts)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(History)
    return spark.read.format("tapeloom_history").load()


def archive(path: str) -> Fetch:
    """A client that answers from a Parquet folder of candles, partitioned by ``token``; for replays and tests."""

    def fetch(token: int, first: dt.date, last: dt.date) -> list[tuple]:
        where, at = fs.FileSystem.from_uri(f"{path}/token={token}")
        if where.get_file_info(at).type == fs.FileType.NotFound:
            return []
        data = ds.dataset(at, filesystem=where, format="parquet")
        kind, date = data.schema.field("date").type, ds.field("date")
        lo, hi = (pa.scalar(dt.datetime.combine(x, dt.time()), pa.timestamp("us")).cast(pa.timestamp(kind.unit)).cast(kind) for x in (first, last + dt.timedelta(days=1)))
        rows = data.to_table(filter=(date >= lo) & (date < hi), columns=["date", "open", "high", "low", "close", "volume"])
        rows = rows.set_column(0, "date", rows["date"].cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")))
        return list(zip(*(c.to_pylist() for c in rows.columns), strict=True))

    return fetch
