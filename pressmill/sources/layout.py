"""Rows laid out in the order in which they are read, so that a page opens a few files however large the table is.

`write` sorts a table by ranges into files that do not overlap in the reading order, and keeps one row a file of a zone map: the
file's first and last place in that order, the range of every column that is filtered on, and how many rows it has. A page then
walks the files in order, leaves out those that its cursor or its filter rules out, opens a few, and stops as soon as it is full;
where a filter leaves too few rows it opens twice as many files each round.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "_file"


@dataclass(frozen=True)
class By:
    """A column of the reading order."""

    column: str
    descending: bool = False

    @property
    def order(self) -> Column:
        return F.desc(self.column) if self.descending else F.asc(self.column)


@dataclass(frozen=True)
class Range:
    """What a filter asks of one column: at least, at most; None asks for nothing."""

    column: str
    least: object = None
    most: object = None


class OrderedTable:
    FIRST_FILES = 2

    def __init__(self, spark: SparkSession, path: str, order: Sequence[By]):
        self.spark, self.path, self.order = spark, path, tuple(order)
        self.zones = spark.read.parquet(f"{path}/zones")
        self.opened = 0  # files that the last page opened

    @classmethod
    def write(cls, rows: DataFrame, path: str, order: Sequence[By], *, zoned: Sequence[str] = (), rows_per_file: int = 100_000) -> OrderedTable:
        """Lay out `rows`. The columns of the order are not null and tell rows apart; `zoned`: other columns filtered on by range."""
        spark, files = rows.sparkSession, max(1, -(-rows.count() // rows_per_file))
        by = [b.order for b in order]
        rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.parquet(f"{path}/rows")
        place = F.struct(*[F.col(b.column) for b in order])
        read = spark.read.parquet(f"{path}/rows").withColumn(FILE, F.col("_metadata.file_path"))
        ends = [F.min_by(place, "_at").alias("first"), F.max_by(place, "_at").alias("last")]
        ranges = [f(c).alias(f"{name}_{c}") for c in dict.fromkeys([*zoned, *[b.column for b in order]]) for f, name in ((F.min, "least"), (F.max, "most"))]
        # A file's rows lie in reading order.
        read.withColumn("_at", F.col("_metadata.row_index")).groupBy(FILE).agg(F.count("*").alias("n"), *ends, *ranges).coalesce(1).write.parquet(f"{path}/zones")
        return cls(spark, path, order)

    def _behind(self, place: str, cursor: Sequence, inclusive: bool = False) -> Column:
        """Whether a place (prefix of its columns) is behind the cursor in reading order."""
        out, same = F.lit(False), F.lit(True)
        for b, value in zip(self.order, cursor, strict=True):
            c, v = F.col(f"{place}{b.column}"), F.lit(value)
            out = out | (same & (c < v if b.descending else c > v))
            same = same & (c == v)
        return out | same if inclusive else out

    def page(self, limit: int, *, where: Sequence[Column] = (), ranges: Sequence[Range] = (), behind: Sequence | None = None) -> DataFrame:
        """The first `limit` rows in reading order that meet all conditions and stand behind the cursor.

        ranges reach the zone map; `where` is whatever else rows must meet. At most `limit` rows and, a round, a few file names
        pass through the driver."""
        zones, conditions = self.zones, list(where)
        if behind is not None:
            conditions.append(self._behind("", behind))
            zones = zones.where(self._behind("last.", behind))
        for r in ranges:
            if r.least is not None:
                conditions.append(F.col(r.column) >= F.lit(r.least))
                zones = zones.where(F.col(f"most_{r.column}") >= F.lit(r.least))
            if r.most is not None:
                conditions.append(F.col(r.column) <= F.lit(r.most))
                zones = zones.where(F.col(f"least_{r.column}") <= F.lit(r.most))
        starts = [F.desc(f"first.{b.column}") if b.descending else F.asc(f"first.{b.column}") for b in self.order]
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        got, take, seen, self.opened = [], self.FIRST_FILES, None, 0
        while len(got) < limit:
            left = zones if seen is None else zones.where(self._behind("first.", seen))
            files = left.orderBy(*starts).limit(take).select(FILE, "first").collect()
            if not files:
                break
            rows = self.spark.read.schema(schema).parquet(*[r[FILE] for r in files])
            for c in conditions:
                rows = rows.where(c)
            got += rows.orderBy(*[b.order for b in self.order]).limit(limit - len(got)).collect()
            self.opened += len(files)
            seen, take = tuple(files[-1]["first"]), take * 2
        return self.spark.createDataFrame(got, schema)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that all executors see."""
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"
