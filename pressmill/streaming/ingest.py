"""Landing folder to store: slot files named by an index are read, checked, parsed and merged, and their state moves with the rows.

A cycle asks for the files of the index and for those that earlier cycles missed. A file that is not there, or has another
checksum, counts an attempt, and its slot fails at the last; it holds up no other. Lines and slot states are one commit of the
store, so after a restart a slot is either wholly there or asked for again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.sources import slots
from pressmill.streaming.feed import FeedStore

KEY = ["slot", "kind"]


def asked_files(state: DataFrame, index: DataFrame, force: DataFrame | None = None) -> DataFrame:
    """(slot, kind, md5) to read in a cycle: new ones of the index, pending ones, and those that are forced. The index, which
    may correct a checksum, goes before what was known."""
    known = state.select(*KEY, F.col("md5").alias("old"), "status")
    both = index.select(*KEY, "md5").dropDuplicates(KEY).join(known, KEY, "full")
    again = F.lit(False)
    if force is not None:
        both = both.join(force.select(*KEY).distinct().withColumn("forced", F.lit(True)), KEY, "left")
        again = F.coalesce("forced", F.lit(False))
    return both.where(F.col("status").isNull() | (F.col("status") == "pending") | again).select(*KEY, F.coalesce("md5", "old").alias("md5"))


def cycle(store: FeedStore, folder: str, index: DataFrame, batch: int, now: datetime, force: DataFrame | None = None, max_attempts: int = slots.MAX_ATTEMPTS) -> None:
    """One cycle over a landing folder; a batch that is committed already changes nothing. index (slot, kind, md5)."""
    if batch <= store.store.batch:
        return
    spark, state = store.spark, store.slots.read()
    asked = asked_files(state, index, force).persist()
    # The names alone first; as many paths as files are asked for. Of all other files nothing is read.
    paths = [r.path for r in slots.landed(spark, folder).select(*KEY, "path").join(asked.select(*KEY), KEY, "left_semi").select("path").collect()]
    files = slots.landed(spark, paths) if paths else slots.landed(spark, folder).where("false")
    good = slots.checked(files, asked).persist()
    messages = slots.raw_messages(good).persist()
    counts = good.select(*KEY).distinct().join(messages.groupBy(*KEY).agg(F.count("*").alias("n")), KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("row_count"))
    moved = slots.advance(state.drop("md5"), asked, counts, force, max_attempts).join(asked, KEY)
    try:
        store.absorb(messages, batch, now, {"slots": moved})
    finally:
        for kept in (asked, good, messages):
            kept.unpersist()
