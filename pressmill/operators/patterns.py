"""Which texts hold which of many patterns, without comparing every pattern with every text.

`holding` walks each text once through an automaton of a slice of the patterns (Aho and Corasick's), which every task builds
from a bounded list. `held_by` is the other way round, for many texts inside few long ones: a text that stands in another
begins there, so the two are joined on their first characters and compared where these are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_CHARS, START = 400_000, 12


def holding(texts: DataFrame, patterns: DataFrame, *, slice_chars: int = SLICE_CHARS, per_slice: int = 20_000) -> DataFrame:
    """(text_id, pattern_id) where the text holds the pattern. texts (text_id, text), patterns (pattern_id, pattern).

    A null text holds nothing, a null or empty pattern stands nowhere. The texts are read once for each slice of the patterns;
    a slice has some `slice_chars` characters, or `per_slice` patterns if these are
    fewer, and is the only thing sent to the tasks."""
    wanted = patterns.where("pattern <> ''").select("pattern_id", "pattern")
    groups = wanted.groupBy("pattern").agg(F.collect_set("pattern_id").alias("ids"))
    count, chars = groups.agg(F.count("*"), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    slices = max(1, -(-chars // slice_chars), -(-count // per_slice))
    dealt = groups.withColumn("slice", F.pmod(F.xxhash64("pattern"), F.lit(slices)))
    kinds = f"text_id {dict(texts.dtypes)['text_id']}, pattern string"
    out = None
    for k in range(slices):
        words = [r.pattern for r in dealt.where(F.col("slice") == k).select("pattern").collect()]
        found = texts.select("text_id", "text").mapInArrow(_walk(words), kinds)
        out = found if out is None else out.unionByName(found)
    return out.join(groups.hint("merge"), "pattern").select("text_id", F.explode("ids").alias("pattern_id"))


def _walk(words: list[str]):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        if words:
            automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for k, text in enumerate(batch.column("text").to_pylist() if words else ()):
                if text:
                    mine = {w for _, w in automaton.iter(text)}
                    rows += [k] * len(mine)
                    hits += mine
            yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], ["text_id", "pattern"])

    return walk


def held_by(long: DataFrame, inside: DataFrame) -> DataFrame:
    """(long_id, inside_id) where one of the texts `inside` (inside_id, text) stands in one of `long` (long_id, text).

    Every place of the long texts is a row for each length that a beginning may have, so these should be few, such as queries;
    the others, which may be many, give one row each."""
    longest = long.agg(F.max(F.length("text")).alias("longest"))  # a longer text stands in none; most titles are longer than any query
    inside = inside.where("text <> ''").join(F.broadcast(longest), F.length("text") <= F.col("longest")).select("inside_id", "text").distinct()
    inside = inside.withColumn("start", F.substring("text", 1, START))
    lengths = F.sequence(F.lit(1), F.lit(START))
    places = long.where("text <> ''").select("long_id", F.col("text").alias("whole"), F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    starts = places.select("long_id", "whole", F.explode(F.filter(lengths, lambda n: F.col("at") + n - 1 <= F.length("whole"))).alias("n"), "at")
    starts = starts.select("long_id", "whole", F.col("whole").substr(F.col("at"), F.col("n")).alias("start")).distinct()
    met = inside.join(starts, "start").where(F.contains("whole", "text"))
    return met.select("long_id", "inside_id").distinct()
