"""15-minute slot files: index, landing folder, zipped members, and the state of each slot and file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = {"gkg": "gkg.csv.zip", "events": "export.CSV.zip", "mentions": "mentions.CSV.zip"}
MAX_ATTEMPTS = 4


def parse_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """(slot, kind, md5, url) of the index lines that have three tokens and name a slot file."""
    parts = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    found = r"(\d{14})\.(gkg\.csv|export\.CSV|mentions\.CSV)\.zip$"
    url = F.get(parts, F.lit(2))
    tail = F.regexp_extract(url, found, 2)
    kind = F.when(tail == "gkg.csv", "gkg").when(tail == "export.CSV", "events").when(tail == "mentions.CSV", "mentions")
    return lines.where((F.size(parts) == 3) & url.rlike(found)).select(F.regexp_extract(url, found, 1).alias("slot"), kind.alias("kind"), F.get(parts, F.lit(1)).alias("md5"), url.alias("url"))


def newest_articles(index: DataFrame) -> DataFrame:
    """The newest article file of an index, or none."""
    return index.where("kind = 'gkg'").orderBy(F.desc("slot")).limit(1)


def slot_url(base: str, slot: Column, kind: Column) -> Column:
    suffix = F.when(kind == "gkg", SUFFIX["gkg"]).when(kind == "events", SUFFIX["events"]).when(kind == "mentions", SUFFIX["mentions"])
    return F.concat(F.lit(base.rstrip("/") + "/"), slot, F.lit("."), suffix)


def slots_back(spark: SparkSession, end: datetime, count: int) -> DataFrame:
    """The `count` quarter-hour slots up to `end`, newest last."""
    first = end - timedelta(minutes=15 * (count - 1))
    times = F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("interval 15 minutes"))
    return spark.range(1).select(F.explode(times).alias("at")).select(F.date_format("at", "yyyyMMddHHmmss").alias("slot"))


def landed(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """(slot, kind, md5, content, path) of zip files in a landing folder, or of files by their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.endswith(SUFFIX["gkg"]), "gkg").when(name.endswith(SUFFIX["events"]), "events").when(name.endswith(SUFFIX["mentions"]), "mentions")
    return files.select(F.substring(name, 1, 14).alias("slot"), kind.alias("kind"), F.md5("content").alias("md5"), "content", "path").where("kind is not null")


def checked(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose checksum is the index's; a wrong file counts as missing."""
    return files.join(index.select("slot", "kind", "md5"), ["slot", "kind", "md5"], "left_semi")


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for slot, kind, content in zip(pdf["slot"], pdf["kind"], pdf["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    lines = z.read(z.namelist()[0]).decode(errors="replace").splitlines()
            except (zipfile.BadZipFile, IndexError):
                continue
            yield pd.DataFrame({"slot": slot, "row_no": range(len(lines)), "line": lines, "kind": kind})


def raw_messages(files: DataFrame) -> DataFrame:
    """(slot, row_no, line, kind) of every line of every file's first member. A broken or empty zip gives none."""
    return files.select("slot", "kind", "content").mapInPandas(_lines, "slot string, row_no int, line string, kind string")


def keyed(messages: DataFrame) -> DataFrame:
    """(key, value) as a message log takes them."""
    key = F.when(F.col("kind") == "gkg", F.concat_ws(":", "slot", "row_no")).otherwise(F.concat_ws(":", "slot", "kind", "row_no"))
    return messages.select(key.alias("key"), F.to_json(F.struct("slot", "row_no", "line", "kind")).alias("value"))


def advance(state: DataFrame, index: DataFrame, published: DataFrame, force: DataFrame | None = None, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """State of every (slot, kind) after a cycle: (slot, kind, status, attempts, row_count).

    published (slot, kind, row_count) came through; what was wanted and did not counts an attempt and fails at the last.
    Each file stands alone: a missing one blocks no other. `force` (slot, kind) publishes again what is already there."""
    wanted = index.select("slot", "kind").distinct()
    all_ = state.select("slot", "kind").unionByName(wanted).distinct()
    s = all_.join(state, ["slot", "kind"], "left").join(published.select("slot", "kind", F.col("row_count").alias("got")), ["slot", "kind"], "left")
    s = s.join(wanted.withColumn("asked", F.lit(True)), ["slot", "kind"], "left")
    again = F.lit(False)
    if force is not None:
        s = s.join(force.select("slot", "kind").distinct().withColumn("forced", F.lit(True)), ["slot", "kind"], "left")
        again = F.coalesce("forced", F.lit(False))
    status, tries = F.coalesce("status", F.lit("pending")), F.coalesce("attempts", F.lit(0))
    open_ = ((status == "pending") | again) & F.coalesce("asked", F.lit(False))
    missed = open_ & F.col("got").isNull()
    return s.select(
        "slot", "kind",
        F.when(open_ & F.col("got").isNotNull(), "published").when(missed & (tries + 1 >= max_attempts), "failed").otherwise(status).alias("status"),
        (tries + missed.cast("int")).alias("attempts"),
        F.when(open_ & F.col("got").isNotNull(), F.col("got")).otherwise(F.col("row_count")).alias("row_count"),
    )


def pending(state: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return state.where((F.col("status") == "pending") & (F.col("attempts") < max_attempts)).orderBy("slot", "kind")


def label_export(articles: DataFrame) -> DataFrame:
    """(title, themes): one row a title, the first by arrival, themes joined with ';'."""
    first = articles.groupBy("title").agg(F.min_by("themes", F.struct("arrival")).alias("themes"))
    return first.select("title", F.array_join("themes", ";").alias("themes"))
