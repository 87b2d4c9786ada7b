"""A container's packets and subtitle cues merged in the order of time.

Packets come in their order of decoding, which is not that of showing, so a film is not sorted by time: a cue goes before the
first packet that is shown at or after it, packets keep their order. On a partition sorted by film that is one pass
over both: the cues of a film (a few hundred) are held, packets go by in Arrow batches with a running maximum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.session import ship

MERGED = "video_id long, place long, kind string, item long, at double, pts long, dts long"


def aligned_packets(packets: DataFrame) -> DataFrame:
    """SNK-5: packets (video_id, seq, pts, dts in ticks, tick in seconds, size, start_time in seconds) without empty ones,
    moved so that the earlier of the container's start and its first decoding time is 0, and at, the time of
    showing in seconds (0 where it is not known). Shifts are whole ticks, the same for pts and dts, so decoding times
    keep their order."""
    first = F.min_by(F.col("dts") * F.col("tick"), F.when(F.col("dts").isNotNull(), F.col("seq")))
    zero = packets.groupBy("video_id").agg(F.least(F.coalesce(F.max("start_time"), F.lit(0.0)), F.coalesce(first, F.lit(0.0))).alias("_zero"))
    moved = packets.where("size > 0").join(zero, "video_id")
    shift = F.bround(F.col("_zero") / F.col("tick")).cast("long")
    out = moved.withColumns({"pts": F.col("pts") - shift, "dts": F.col("dts") - shift})
    return out.withColumn("at", F.coalesce(F.col("pts") * F.col("tick"), F.lit(0.0))).drop("_zero")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    film, cues, numbers, told, seen, high = None, np.zeros(0), np.zeros(0, np.int64), 0, 0, -np.inf

    def of_cues(lo: int, hi: int, places) -> list:
        n = hi - lo
        none = pa.nulls(n, pa.int64())
        return [pa.array([film] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(["cue"] * n, pa.string()), pa.array(numbers[lo:hi]), pa.array(cues[lo:hi]), none, none]

    names = [c.split()[0] for c in MERGED.split(", ")]
    for b in batches:
        ids = b.column(0).to_numpy()
        for lo, hi in _runs(ids):
            part = b.slice(lo, hi - lo)
            if ids[lo] != film:
                if film is not None and told < len(cues):
                    yield pa.RecordBatch.from_arrays(of_cues(told, len(cues), np.arange(told, len(cues)) + seen), names=names)
                film, cues, numbers, told, seen, high = int(ids[lo]), np.zeros(0), np.zeros(0, np.int64), 0, 0, -np.inf
            is_cue, at = np.asarray(part.column(1)) == 0, part.column(3).to_numpy()
            n = int(is_cue.sum())  # a film's cues stand before its packets
            if n:
                cues, numbers = np.concatenate((cues, at[:n])), np.concatenate((numbers, part.column(2).to_numpy()[:n]))
            if n == len(at):
                continue
            part, at = part.slice(n), at[n:]
            reach = np.maximum.accumulate(np.maximum(at, high))
            before = np.searchsorted(cues, reach, side="right")  # cues that go before each packet
            where = np.arange(len(at)) + seen
            upto = int(before[-1])
            cue_at = np.searchsorted(before, np.arange(told, upto), side="right")  # the packet each new cue goes before
            rows = of_cues(told, upto, where[cue_at] + np.arange(told, upto))
            own = [part.column(0), pa.array(where + before), pa.array(["packet"] * len(at)), part.column(2), part.column(3), part.column(4), part.column(5)]
            if upto > told:
                yield pa.RecordBatch.from_arrays(rows, names=names)
            yield pa.RecordBatch.from_arrays(own, names=names)
            told, seen, high = upto, seen + len(at), float(reach[-1])
    if film is not None and told < len(cues):
        yield pa.RecordBatch.from_arrays(of_cues(told, len(cues), np.arange(told, len(cues)) + seen), names=names)


def _runs(ids: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def merge_streams(packets: DataFrame, cues: DataFrame) -> DataFrame:
    """SNK-5: video_id, place (from 0), kind (packet or cue), item (seq or cue_no), at, pts, dts of all packets that are not empty
    and all cues (video_id, cue_no, start): each cue before the first packet in order of decoding that is
    shown at or after its start, else after the last; cues with equal starts in order of their numbers."""
    ship(packets.sparkSession)
    none = F.lit(None).cast("long")
    own = aligned_packets(packets).select("video_id", F.lit(1).alias("src"), F.col("seq").cast("long").alias("item"), F.col("at").cast("double").alias("at"), F.col("pts").cast("long").alias("pts"), F.col("dts").cast("long").alias("dts"))
    new = cues.select("video_id", F.lit(0).alias("src"), F.col("cue_no").cast("long").alias("item"), F.col("start").cast("double").alias("at"), none.alias("pts"), none.alias("dts"))
    when = F.when(F.col("src") == 0, F.col("at"))
    ordered = own.unionByName(new).repartition("video_id").sortWithinPartitions("video_id", "src", when, "item")
    return ordered.mapInArrow(_merge, MERGED)
