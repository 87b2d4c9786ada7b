"""What a speech recogniser says, before it is segmented: blanks dropped, films that are nothing but blanks asked again."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.session import cut

#: Share of blank segments from which they are worth a warning.
BLANK_WARNING = 0.3


class Recogniser(Protocol):
    def decode(self, videos: DataFrame, primed: bool) -> DataFrame:
        """videos (video_id) to segments (video_id, start, end, text, ...). primed: each window is primed with the text of
        the window before."""


def collected(segments: DataFrame) -> DataFrame:
    """SRC-4: segments with their text stripped, without empty ones, and blank for those without letters or numbers."""
    bare = segments.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    return bare.withColumn("blank", ~T.has_content(F.col("text")))


def transcribe(videos: DataFrame, recogniser: Recogniser) -> tuple[DataFrame, DataFrame]:
    """SRC-4/AGG-15: (segments, report). A film whose segments are all blank is no quiet film but a decoder in a loop,
    which its own output primes: it is decoded once more unprimed, and what comes then counts, also if it is blank again.

    segments have content. report: video_id, kept, blank, share of blanks, warn (from 30 % on), retried; a film
    without any segment has zeros and no share."""
    own = videos.select("video_id").distinct()
    first = cut(collected(recogniser.decode(own, True)))
    looped = cut(_counts(first).where((F.col("blank") > 0) & (F.col("kept") == 0)).select("video_id"))
    if looped.isEmpty():
        said, again = first, looped
    else:
        second = cut(collected(recogniser.decode(looped, False)))
        said, again = first.join(looped, "video_id", "left_anti").unionByName(second), looped
    counted = own.join(_counts(said), "video_id", "left").join(again.withColumn("retried", F.lit(True)), "video_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    share: Column = zero("blank") / F.nullif(zero("blank") + zero("kept"), F.lit(0))
    report = counted.select(
        "video_id",
        zero("kept").alias("kept"),
        zero("blank").alias("blank"),
        share.alias("share"),
        F.coalesce(share >= BLANK_WARNING, F.lit(False)).alias("warn"),
        F.coalesce("retried", F.lit(False)).alias("retried"),
    )
    return said.where(~F.col("blank")).drop("blank"), report


def _counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("video_id").agg(F.count_if(~F.col("blank")).alias("kept"), F.count_if("blank").alias("blank"))
