"""Interval algebra on timelines (video_id, start, end in seconds).

Merging and complements are window passes over one video's sorted spans; all windows share the partition
key, so one exchange serves them. Joins of two interval tables go by time bucket, so a long video does
not become one quadratic group, and the overlap test is a residual filter of an equi-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake import constants as C

#: Seconds of a join bucket.
BUCKET = 600.0


def _before(order: list[str]):
    return Window.partitionBy("video_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def word_spans(segments: DataFrame, words: DataFrame) -> DataFrame:
    """WIN-1: the words' spans; for a video without any word, those of its segments."""
    spans = words.select("video_id", "start", "end")
    return spans.unionByName(segments.join(spans.select("video_id").distinct(), "video_id", "left_anti").select("video_id", "start", "end"))


def covered(spans: DataFrame, bridge: float = C.COVERED_GAP_BRIDGE) -> DataFrame:
    """WIN-2: spans merged where the gap is at most ``bridge``."""
    reach = F.max("end").over(_before(["start", "end"]))
    fresh = F.when(F.col("start") <= F.col("reach") + bridge, 0).otherwise(1)
    island = F.sum("fresh").over(Window.partitionBy("video_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("reach", reach).withColumn("fresh", fresh).withColumn("island", island)
    return marked.groupBy("video_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("video_id", "start", "end")


def blanks(spans: DataFrame, durations: DataFrame, least: float) -> DataFrame:
    """WIN-3/WIN-4: what spans leave of [0, duration], where it is at least ``least`` long."""
    cursor = F.greatest(F.lit(0.0), F.coalesce(F.max("end").over(_before(["start", "end"])), F.lit(0.0)))
    inner = spans.select("video_id", cursor.alias("start"), F.col("start").alias("end"))
    ends = spans.groupBy("video_id").agg(F.max("end").alias("last"))
    tail = durations.join(ends, "video_id", "left").select("video_id", F.greatest(F.lit(0.0), F.coalesce("last", F.lit(0.0))).alias("start"), F.col("duration").alias("end"))
    return inner.unionByName(tail).where(F.col("end") - F.col("start") >= least)


def windows_of(regions: DataFrame, size: float = C.SECOND_PASS_WINDOW) -> DataFrame:
    """WIN-5: regions in slices of ``size``; the last may be shorter."""
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / size), F.lit(0)).cast("int")
    each = regions.where(n > 0).select("video_id", "start", "end", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    at = F.col("start") + F.col("k") * size
    return each.select("video_id", at.alias("start"), F.least(at + size, F.col("end")).alias("end"))


def rewinds(packets: DataFrame, order: str, value: str) -> DataFrame:
    """WIN-12: how often a time stamp goes back."""
    prev = F.lag(value).over(Window.partitionBy("video_id").orderBy(order))
    return packets.withColumn("back", prev > F.col(value)).groupBy("video_id").agg(F.count_if("back").alias("n_rewinds"))


def _buckets(start: Column, end: Column, size: float) -> Column:
    return F.sequence(F.floor(start / size).cast("long"), F.floor(F.greatest(start, end) / size).cast("long"))


def overlap_pairs(a: DataFrame, b: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """Each overlapping pair of a row of a and a span of b once: a's columns, b_start, b_end.

    A pair is made in the bucket where its overlap begins, so pairs that share buckets are not doubled.
    """
    left = a.withColumn("_bucket", F.explode(_buckets(F.col("start"), F.col("end"), bucket)))
    right = b.select("video_id", F.col("start").alias("b_start"), F.col("end").alias("b_end")).withColumn("_bucket", F.explode(_buckets(F.col("b_start"), F.col("b_end"), bucket)))
    first = F.floor(F.greatest("start", "b_start") / bucket).cast("long")
    met = left.join(right, ["video_id", "_bucket"]).where((F.least("end", "b_end") > F.greatest("start", "b_start")) & (first == F.col("_bucket")))
    return met.drop("_bucket")


def free_of(candidates: DataFrame, spans: DataFrame, tolerance: float = C.OVERLAP_TOLERANCE, key: str = "seg_no") -> DataFrame:
    """JOIN-1: candidates (with a ``key`` unique in the video) that no span overlaps by more than the tolerance."""
    hit = overlap_pairs(candidates, spans).where(F.least("end", "b_end") - F.greatest("start", "b_start") > tolerance).select("video_id", key).distinct()
    return candidates.join(hit, ["video_id", key], "left_anti")


def covered_seconds(speech: DataFrame, words: DataFrame) -> DataFrame:
    """JOIN-2/AGG-6: video_id, speech, covered: overlapping words count each time."""
    met = overlap_pairs(speech, words).groupBy("video_id").agg(F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("covered"))
    total = speech.groupBy("video_id").agg(F.sum(F.col("end") - F.col("start")).alias("speech"))
    return total.join(met, "video_id", "left").select("video_id", "speech", F.coalesce("covered", F.lit(0.0)).alias("covered"))


def misses(speech: DataFrame, words: DataFrame, least: float = C.MIN_MISS) -> DataFrame:
    """JOIN-3: runs of at least ``least`` seconds within speech that no word covers."""
    met = overlap_pairs(speech, words).select("video_id", "start", "end", F.greatest("start", "b_start").alias("s"), F.least("end", "b_end").alias("e"))
    within = Window.partitionBy("video_id", "start", "end").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    inner = met.select("video_id", F.coalesce(F.max("e").over(within), F.col("start")).alias("from"), F.col("s").alias("to"))
    last = met.groupBy("video_id", "start", "end").agg(F.max("e").alias("last"))
    tail = speech.join(last, ["video_id", "start", "end"], "left").select("video_id", F.coalesce("last", "start").alias("from"), F.col("end").alias("to"))
    return inner.unionByName(tail).where(F.col("to") - F.col("from") >= least).select("video_id", F.col("from").alias("start"), F.col("to").alias("end"))


def touched(lines: DataFrame, marked: DataFrame, tolerance: float = C.OVERLAP_TOLERANCE) -> DataFrame:
    """JOIN-4: lines with touched: whether a marked span overlaps them by more than the tolerance."""
    hit = overlap_pairs(lines, marked).where(F.least("end", "b_end") - F.greatest("start", "b_start") > tolerance).select("video_id", "index").distinct().withColumn("touched", F.lit(True))
    return lines.join(hit, ["video_id", "index"], "left").withColumn("touched", F.coalesce("touched", F.lit(False)))


def agreement(lines: DataFrame, marked: DataFrame, tolerance: float = C.OVERLAP_TOLERANCE) -> DataFrame:
    """JOIN-4/AGG-18: lines by is_lyric and whether a marked span touches them: video_id, is_lyric, touched, n."""
    return touched(lines, marked, tolerance).groupBy("video_id", "is_lyric", "touched").agg(F.count(F.lit(1)).alias("n"))


def disagreement(lines: DataFrame, marked: DataFrame, tolerance: float = C.OVERLAP_TOLERANCE) -> DataFrame:
    """JOIN-4: the lines that only one side marks, with touched: false are ours alone, true theirs alone."""
    return touched(lines, marked, tolerance).where(F.col("is_lyric") != F.col("touched"))


def merge_segments(first_pass: DataFrame, recovered: DataFrame) -> DataFrame:
    """SET-1/TOP-7: both passes in order of start, the first pass before recovered ones."""
    tables = [t.withColumn("recovered", F.lit(r)) for t, r in ((first_pass, False), (recovered, True))]
    order = Window.partitionBy("video_id").orderBy("start", "recovered", "seg_no")
    return reduce(DataFrame.unionByName, tables).withColumn("pos", F.row_number().over(order))
