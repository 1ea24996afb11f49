"""The candle store as files: merged, trimmed and cleaned one partition at a time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CANDLE
from ..scratch import delete, exists, folders, replace
from .store import listed, retained, upsert

Part = tuple[int, int]


def _folders(spark: SparkSession, root: str) -> dict[Part, str]:
    """The partitions below a folder, each with its own folder there."""
    found = folders(spark, root, "bucket=*/year=*")
    return {(int(b.split("=")[1]), int(y.split("=")[1])): f"{b}/{y}" for b, y in (f.split("/")[-2:] for f in found)}


@dataclass(frozen=True)
class CandleStore:
    """Candles in a Parquet folder, partitioned by a bucket of tokens and by year.

    Each change names the partitions that it touches and writes their new
    contents to a stage beside the store, and last the partitions that are to go,
    which completes it. Only a complete stage is applied: its partitions' folders
    take the place of the store's, so rows are written once. A change that breaks
    off while it is staged leaves the store as it was; one that breaks off while
    it is applied is carried on by the next change (or by ``recover``), which
    gives the same files. Partitions that aren't touched keep their files.

    One writer at a time. Readers see the store between changes. Candles that are
    merged may come from the store itself.
    """

    spark: SparkSession
    path: str
    buckets: int = 16

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"bucket": F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int"), "year": F.year("date")})

    def _rows(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/candles"):
            return self._keyed(self.spark.createDataFrame([], CANDLE))
        return self.spark.read.schema(f"{CANDLE}, bucket int, year int").parquet(f"{self.path}/candles")

    def read(self, since: int | None = None) -> DataFrame:
        """All candles, or those of the year ``since`` and later."""
        self.recover()
        rows = self._rows() if since is None else self._rows().where(F.col("year") >= since)
        return rows.drop("bucket", "year")

    def parts(self, rows: DataFrame | None = None) -> list[Part]:
        """The partitions of these rows, or (by their folders) those that there are: as many as buckets and years, however many rows."""
        if rows is None:
            return sorted(_folders(self.spark, f"{self.path}/candles"))
        return sorted((r["bucket"], r["year"]) for r in self._keyed(rows).select("bucket", "year").distinct().collect())

    def _of(self, parts: list[Part]) -> DataFrame:
        """The rows of some partitions; the scan leaves the others out."""
        by_year: dict[int, list[int]] = {}
        for bucket, year in parts:
            by_year.setdefault(year, []).append(bucket)
        wanted = [(F.col("year") == y) & F.col("bucket").isin(b) for y, b in by_year.items()]
        return self._rows().where(reduce(Column.__or__, wanted, F.lit(False)))

    def _change(self, rows: DataFrame, parts: list[Part] | None = None) -> list[Part]:
        """Replace ``parts`` by ``rows``; parts that none of the rows falls into go. Without ``parts``, those of the rows."""
        if parts == []:
            return parts
        stage = f"{self.path}/stage"
        delete(self.spark, stage)
        # Rows of a partition meet in few files; one that is large is split.
        rows.hint("rebalance", "bucket", "year").write.partitionBy("bucket", "year").parquet(f"{stage}/candles")
        new = sorted(_folders(self.spark, f"{stage}/candles"))
        gone = sorted(set(parts or []) - set(new))
        self.spark.createDataFrame(gone, "bucket int, year int").coalesce(1).write.json(f"{stage}/gone")
        self.recover()
        return new if parts is None else parts

    def recover(self) -> bool:
        """Apply a stage that is complete, and remove any. True if one was applied."""
        stage = f"{self.path}/stage"
        if not exists(self.spark, f"{stage}/gone/_SUCCESS"):
            return False
        for r in self.spark.read.schema("bucket int, year int").json(f"{stage}/gone").collect():
            delete(self.spark, f"{self.path}/candles/bucket={r['bucket']}/year={r['year']}")
        for folder in _folders(self.spark, f"{stage}/candles").values():
            replace(self.spark, f"{stage}/candles/{folder}", f"{self.path}/candles/{folder}")
        delete(self.spark, stage)
        self.spark.catalog.refreshByPath(f"{self.path}/candles")
        return True

    def _update(self, fresh: DataFrame | None = None, as_of: Column | None = None, years: int = 0, active: DataFrame | None = None) -> list[Part]:
        """Put ``fresh`` in, drop what is older than ``years`` before ``as_of`` and tokens that are not in ``active``, as one change."""
        self.recover()
        held = self.parts()
        parts, read = set(), held

        def kept(rows: DataFrame) -> DataFrame:
            rows = rows if as_of is None else retained(rows, as_of, years)
            return rows if active is None else listed(rows, active)

        if as_of is not None:
            cut = self.spark.range(1).select(F.year(F.add_months(as_of, -12 * years))).first()[0]
            parts |= {p for p in held if p[1] <= cut}
            read = [p for p in held if p[1] >= cut]
        if fresh is not None:
            fresh = kept(fresh)
            if not held:
                return self._change(upsert(None, self._keyed(fresh)))
            parts |= set(self.parts(fresh))
        if active is not None:
            gone = self._of(sorted(set(held) - parts)).join(active.select("token"), "token", "left_anti").select("bucket", "year").distinct()
            parts |= {(r["bucket"], r["year"]) for r in gone.collect()}
        rows = kept(self._of([p for p in read if p in parts]))
        return self._change(rows if fresh is None else upsert(rows, self._keyed(fresh)), sorted(parts))

    def merge(self, fresh: DataFrame) -> list[Part]:
        """Put candles into the store, over those of the same token and date. The partitions that were written anew.

        Only these are read. Merging the same candles again changes nothing. A
        store without candles takes them as they come, evaluated once.
        """
        return self._update(fresh)

    def retain(self, as_of: Column, years: int = 3) -> list[Part]:
        """Drop candles older than ``years`` before ``as_of``: whole partitions, and the part of one year that is."""
        return self._update(None, as_of, years)

    def keep_listed(self, active: DataFrame) -> list[Part]:
        """Drop the candles of tokens that are not in ``active``; only partitions that hold some are written anew."""
        return self._update(active=active)

    def close_day(self, fresh: DataFrame, as_of: Column, years: int = 3, active: DataFrame | None = None) -> list[Part]:
        """``merge``, ``retain`` and (given ``active``) ``keep_listed`` as one change: a partition that several of them touch is written once."""
        return self._update(fresh, as_of, years, active)
