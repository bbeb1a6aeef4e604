"""State that micro-batches merge into, written as runs of Parquet files.

A batch writes only the rows that it adds or replaces, as one run a table; of a key the row of the latest run counts. So a
batch costs what it brings, however large the state is, and as replacing is decided before a row is written, reading needs no
rule of its own. Runs lie in partitions by day of retention and by a hash of the column that they are looked up by: a batch
reads only the partitions that its keys fall into, and retention drops whole days. As in a log-structured tree, `fan` runs of
a level are merged into one of the next, so a row is rewritten once a level.

Which runs count is said by the newest manifest alone, one small file a batch that lists the runs of all tables: a batch is
there as a whole or not at all, one that comes again changes nothing, and one that broke off is written over.

Rows move once: they are dealt by bucket and slice of their key, and one key's rows are compared and written where they lie.
What a table's other columns tell is not moved but worked out anew, and rows of tables whose keys come once are not compared.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN, DAY, BUCKET, BATCH, SLICE, ASKED = "_run", "_day", "_bucket", "_batch", "_slice", "_asked"
SLICES = 8  # tasks that may share a bucket
FEW = 100_000  # hits of a lookup that are broadcast, eight bytes each
NEVER = "9999-12-31"


@dataclass(frozen=True)
class TableSpec:
    """key: what replaces a row; by: the column that rows are looked up by; kept_from: the time that retention counts from;
    follows: columns that follow from another one (name, the other, SQL); once: no key is written again while its row counts."""

    schema: str
    key: tuple[str, ...]
    by: str
    kept_from: str | None = None
    follows: tuple[tuple[str, str, str], ...] = ()
    once: bool = False


class RunStore:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, TableSpec], *, buckets: int = 16, fan: int = 8, keep: timedelta | None = timedelta(days=7), manifests: int = 3):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.buckets, self.fan, self.keep, self.manifests = buckets, fan, keep, manifests
        self._written: dict[int, dict[str, str]] = {}
        self._cutoff = ""
        jvm = spark._jvm
        self._path, self._utils = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests: one file a batch, renamed into place when the batch's runs are written ---

    def _manifests(self) -> list[str]:
        folder = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        names = self._manifests()
        if not names:
            return {"batch": -1, "cutoff": "", "runs": {name: [] for name in self.tables}, "merged": []}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{names[-1]}"))
        try:
            return json.loads(self._utils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        final = f"{self.path}/manifests/{manifest['batch']:012d}.json"
        out = self._fs.create(self._path(f"{final}.new"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.rename(self._path(f"{final}.new"), self._path(final))
        for name in self._manifests()[: -self.manifests]:
            self._fs.delete(self._path(f"{self.path}/manifests/{name}"), False)

    @property
    def batch(self) -> int:
        return self.manifest()["batch"]

    def versions(self) -> list[int]:
        """The batches whose manifests are kept."""
        return [int(name[:12]) for name in self._manifests()]

    # --- reading ---

    def _runs(self, table: str, runs: list[dict]) -> DataFrame | None:
        spec = self.tables[table]
        if not runs:
            return None
        schema = T.StructType.fromDDL(f"{spec.schema}, {BATCH} BIGINT, {RUN} STRING, {DAY} STRING, {BUCKET} INT")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[r["dir"] for r in runs])

    def _latest(self, table: str, rows: DataFrame) -> DataFrame:
        """Of each key the row of the latest run."""
        if self.tables[table].once:
            return rows
        return self.best(table, rows, F.col(BATCH))

    def dealt(self, table: str, rows: DataFrame) -> DataFrame:
        """`rows` with BUCKET and SLICE and dealt by them, so that a key's rows lie together and as they are written."""
        if SLICE in rows.columns:
            return rows
        spec = self.tables[table]
        rows = rows.withColumns({BUCKET: self.bucket(F.col(spec.by)), SLICE: F.pmod(F.xxhash64(F.lit(1), *spec.key), F.lit(SLICES)).cast("int")})
        again = {name: F.expr(sql) for name, source, sql in spec.follows if {name, source} <= set(rows.columns)}
        return rows.drop(*again).repartition(BUCKET, SLICE).withColumns(again).select(*rows.columns)

    def best(self, table: str, rows: DataFrame, order: Column, also: dict[str, Column] | None = None) -> DataFrame:
        """Of each key the row that is last in `order`, dealt; rows without an order are none. `also`: sums over all rows of a
        key. Nothing but `dealt` shuffles."""
        rows, place, also = self.dealt(table, rows), [BUCKET, SLICE, *self.tables[table].key], also or {}
        whole = F.struct(*[c for c in rows.columns if c not in place and c not in also])
        last = rows.groupBy(*place).agg(F.max_by(whole, order).alias("r"), *[c.alias(name) for name, c in also.items()])
        return last.where("r is not null").select(*place, "r.*", *also)

    def expire(self, now: datetime) -> None:
        """From now on rows past retention at `now` are not seen. Their days are deleted with the next commit."""
        if self.keep is not None:
            self._cutoff = max(self._cutoff, (now - self.keep).isoformat(timespec="microseconds"))

    def _current(self, table: str, manifest: dict, keys: DataFrame | None = None, on: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        spec, runs = self.tables[table], manifest["runs"][table]
        wanted = columns or T.StructType.fromDDL(spec.schema).names
        rows = self._runs(table, runs)
        if rows is None:
            return self.spark.createDataFrame([], T.StructType.fromDDL(spec.schema)).select(*wanted)
        cutoff = max(manifest["cutoff"], self._cutoff)
        if cutoff and spec.kept_from:
            rows = rows.where((F.col(DAY) >= cutoff[:10]) & (F.col(spec.kept_from) >= F.lit(datetime.fromisoformat(cutoff)).cast("timestamp_ntz")))
        if keys is not None:
            # At most `buckets` numbers; they prune folders before a file is opened.
            touched = [r[0] for r in keys.select(self.bucket(F.col(spec.by)).alias("b")).distinct().collect()]
            rows = rows.where(F.col(BUCKET).isin(touched))
            rows = self._asked(rows, keys.select(*on), on) if on else rows
        sources = [source for name, source, _ in spec.follows if name in (*wanted, *spec.key)]
        rows = rows.select(*dict.fromkeys([*wanted, *spec.key, *sources, BATCH]))
        return (rows if len(runs) == 1 else self._latest(table, rows)).select(*wanted)

    def _asked(self, rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
        """Rows whose columns `on` occur in `keys`. Hashes of both sides meet first; where few do, neither side is moved."""
        hashed = lambda side: side.withColumn(ASKED, F.xxhash64(*on))
        met = hashed(rows).select(ASKED).join(hashed(keys).select(ASKED).distinct(), ASKED, "left_semi").distinct().checkpoint()
        met = F.broadcast(met) if met.count() <= FEW else met
        meeting = lambda side: hashed(side).join(met, ASKED, "left_semi").drop(ASKED)
        return meeting(rows).join(meeting(keys).distinct(), on, "left_semi")

    def read(self, table: str, columns: list[str] | None = None) -> DataFrame:
        """All rows that count now, or some of their columns."""
        return self._current(table, self.manifest(), columns=columns)

    def lookup(self, table: str, keys: DataFrame, on: list[str], columns: list[str] | None = None) -> DataFrame:
        """Rows whose columns `on` occur in `keys`, which has the column that the table is looked up by: only the files that
        may hold them are read, of them only `columns`, and nothing but hits is shuffled. Without `on`: all of these files."""
        return self._current(table, self.manifest(), keys, on, columns)

    def bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    # --- writing ---

    def _write(self, table: str, rows: DataFrame, folder: str) -> None:
        spec = self.tables[table]
        names = T.StructType.fromDDL(spec.schema).names
        day = F.date_format(spec.kept_from, "yyyy-MM-dd") if spec.kept_from else F.lit(NEVER)
        laid = self.dealt(table, rows).select(*names, BATCH, F.coalesce(day, F.lit(NEVER)).alias(DAY), BUCKET)
        laid.sortWithinPartitions(DAY, BUCKET, spec.by).write.mode("overwrite").partitionBy(DAY, BUCKET).parquet(folder)

    def write_run(self, table: str, rows: DataFrame, batch: int, part: str = "") -> DataFrame:
        """Write rows of a batch and read them back; they count once the batch is committed. Parts of a batch hold different
        keys. A batch that is committed is left as it is."""
        folder = f"{self.path}/{table}/{RUN}=b{batch:012d}{part}-l0"
        if batch > self.batch:
            self._write(table, rows.withColumn(BATCH, F.lit(batch).cast("bigint")), folder)
        self._written.setdefault(batch, {})[folder] = table
        return self._runs(table, [{"dir": folder}]).select(*T.StructType.fromDDL(self.tables[table].schema).names)

    def commit(self, batch: int, now: datetime | None = None) -> None:
        """Make the runs of a batch count, merge runs where a level is full, and drop days that are past."""
        manifest = self.manifest()
        if batch <= manifest["batch"]:
            return
        manifest["batch"] = batch
        for folder, table in self._written.pop(batch, {}).items():
            manifest["runs"][table].append({"dir": folder, "level": 0})
        if now is not None:
            self.expire(now)
        manifest["cutoff"] = max(manifest["cutoff"], self._cutoff)
        # Runs merged away go when no manifest that is kept lists them any more.
        gone = [r["dir"] for r in manifest["merged"] if r["at"] <= batch - self.manifests]
        manifest["merged"] = [r for r in manifest["merged"] if r["at"] > batch - self.manifests]
        for table in self.tables:
            self._merge_full_levels(table, manifest)
        past = self._past_days(manifest)
        self._publish(manifest)
        for folder in [*gone, *past]:
            self._fs.delete(self._path(folder), True)

    def _merge_full_levels(self, table: str, manifest: dict) -> None:
        runs, level = manifest["runs"][table], 0
        while sum(r["level"] == level for r in runs) >= self.fan:
            old = [r for r in runs if r["level"] == level]
            folder = f"{self.path}/{table}/{RUN}=b{manifest['batch']:012d}-l{level + 1}"
            rows = self._runs(table, old).drop(RUN)
            if manifest["cutoff"] and self.tables[table].kept_from:
                rows = rows.where(F.col(DAY) >= manifest["cutoff"][:10])
            self._write(table, self._latest(table, rows.drop(DAY)), folder)
            manifest["merged"] += [{"dir": r["dir"], "at": manifest["batch"]} for r in old]
            runs = [r for r in runs if r["level"] != level] + [{"dir": folder, "level": level + 1}]
            level += 1
        manifest["runs"][table] = runs

    def _past_days(self, manifest: dict) -> list[str]:
        """Folders of days before the cutoff's, which no reader opens any more. Runs without a day left are not listed further."""
        out = []
        for table, runs in manifest["runs"].items():
            first = manifest["cutoff"][:10] if manifest["cutoff"] and self.tables[table].kept_from else ""
            for run in list(runs):
                days = [s.getPath() for s in self._fs.listStatus(self._path(run["dir"])) if s.getPath().getName().startswith(f"{DAY}=")]
                past = [p.toString() for p in days if p.getName()[len(DAY) + 1 :] < first]
                out += past
                if len(past) == len(days):
                    runs.remove(run)
        return out

    def drop(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def bytes_stored(self, table: str | None = None) -> int:
        """Bytes of the runs that count."""
        runs = [r["dir"] for name, rows in self.manifest()["runs"].items() if table in (None, name) for r in rows]
        return sum(self._fs.getContentSummary(self._path(d)).getLength() for d in runs if self._fs.exists(self._path(d)))

    def runs(self, table: str) -> list[int]:
        """The levels of the table's runs."""
        return [r["level"] for r in self.manifest()["runs"][table]]
