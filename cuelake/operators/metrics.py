"""Transcript metrics. All are plain aggregates over any number of videos at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake import constants as C
from cuelake.functions import text as T
from cuelake.session import broadcast_if_small, cut


def confident(segments: DataFrame) -> DataFrame:
    """FLT-2: neither too repetitive nor too unlikely; a missing score passes."""
    return segments.where((F.coalesce("compression_ratio", F.lit(0.0)) <= C.MAX_COMPRESSION) & (F.coalesce("avg_logprob", F.lit(0.0)) >= C.MIN_LOGPROB))


def open_ended_ratio(text: str) -> Column:
    """AGG-1: share of cues that do not end a sentence, 0 without cues. AGG-2 compares it with 0.5."""
    return F.coalesce(F.avg(F.when(T.ends_sentence(F.col(text)), 0.0).otherwise(1.0)), F.lit(0.0))


def percentiles(df: DataFrame, key: str, value: str, points: tuple[int, ...]) -> DataFrame:
    """AGG-5: key, p, value. The element at int(n * p / 100) of the sorted values, n - 1 at most.

    Equal values are counted first and dealt by range over (key, value), so that one key may hold all rows: each
    range ranks its own values after the number of those in earlier ranges, of which there are few.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    # Written once: dealing by range looks at its input twice, and what it deals is read twice.
    dealt = cut(cut(counts).repartitionByRange("_key", "value").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("_key", "part").agg(F.sum("c").alias("size"))
    own = Window.partitionBy("_key").orderBy("part")
    sizes = sizes.select("_key", "part", (F.sum("size").over(own) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy("_key")).alias("n"))
    within = F.sum("c").over(Window.partitionBy("_key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    a, b = dealt.withColumn("upto", within).alias("a"), sizes.alias("b")
    met = a.join(broadcast_if_small(b), F.col("a._key").eqNullSafe(F.col("b._key")) & (F.col("a.part") == F.col("b.part")))
    last = F.col("before") + F.col("upto")
    place = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) + 1
    wanted = F.explode(F.filter(F.array(*map(F.lit, points)), lambda p: (place(p) <= last) & (place(p) > last - F.col("c"))))
    return met.select(F.col("a._key").alias(key), wanted.alias("p"), "value")


def length_correlation(lines: DataFrame, *keys: str) -> DataFrame:
    """AGG-11: keys, n, r: how text and translation lengths go together; null under 20 lines or without
    variance. VER-8 compares r with 0.45."""
    a, b = F.length("text").cast("double"), F.length("translation").cast("double")
    by = lines.where("translation <> ''").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("c"), (F.stddev_pop(a) * F.stddev_pop(b)).alias("s"))
    return by.select(*keys, "n", F.when(F.col("n") >= C.ALIGNMENT_MIN_LINES, F.try_divide("c", "s")).alias("r"))


def better_attempt(attempts: DataFrame, *keys: str) -> DataFrame:
    """VER-8: of two attempts (keys, attempt, r) the second only if its r is strictly better; aligned says
    whether the first needed no other. An r that can't be told is aligned and never better."""
    by = attempts.groupBy(*keys).agg(F.max(F.when(F.col("attempt") == 1, F.col("r"))).alias("r1"), F.max(F.when(F.col("attempt") == 2, F.col("r"))).alias("r2"))
    return by.select(*keys, F.when(F.coalesce(F.col("r2") > F.col("r1"), F.lit(False)), 2).otherwise(1).alias("attempt"), F.coalesce(F.col("r1") >= C.ALIGNMENT_MIN_CORRELATION, F.lit(True)).alias("aligned"))


def usage_line(label: str) -> Column:
    """STR-16: label, calls and tokens of a row of tally() as one line."""
    n = lambda c: F.format_number(c, 0)
    said = F.concat(F.lit(f"{label}: "), n("calls"), F.lit(" calls, "), n("prompt"), F.lit(" tokens in ("), n("cached"), F.lit(" cached), "), n("completion"), F.lit(" out"))
    return F.when(F.col("calls") > 0, said).otherwise(F.lit(f"{label}: no usage reported"))


def tally(calls: DataFrame, key: str) -> DataFrame:
    """AGG-12: calls and token sums, missing counts as 0."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    return calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), total("prompt_tokens").alias("prompt"), total("completion_tokens").alias("completion"), total("cached_tokens").alias("cached"))


def level_profile(samples: Column) -> Column:
    """AGG-7: 20 log10 of the root mean square of one second of samples, -140 at least."""
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return 20 * F.log10(F.greatest(F.sqrt(square / F.size(samples)), F.lit(1e-7)))


#: Seconds of one block of levels.
LEVEL_BLOCK = 64


def median_level(intervals: DataFrame, levels: DataFrame, block: int = LEVEL_BLOCK) -> DataFrame:
    """AGG-8: intervals with level, the median of the seconds they touch; -140 where there are none.

    Levels are joined as blocks of ``block`` seconds: an interval meets one row for each block it touches, so an ordinary one
    meets one or two rows and a long one a sixty-fourth of its seconds, and takes its own seconds out of them.
    """
    row = F.struct("sec", F.col("db").cast("double").alias("db"))
    blocks = levels.where("db is not null").groupBy("video_id", F.floor(F.col("sec") / block).alias("_block")).agg(F.collect_list(row).alias("_levels"))
    first = F.floor("start").cast("int")
    last = F.greatest(F.floor("end").cast("int"), first + 1) - 1
    own = intervals.select("video_id", "start", "end", first.alias("_first"), last.alias("_last"))
    each = own.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / block), F.floor(F.col("_last") / block))))
    mine = F.filter("_levels", lambda x: x["sec"].between(F.col("_first"), F.col("_last")))
    met = each.join(blocks, ["video_id", "_block"], "left").select("video_id", "start", "end", F.transform(mine, lambda x: x["db"]).alias("_db"))
    by = met.groupBy("video_id", "start", "end").agg(F.array_sort(F.flatten(F.collect_list("_db"))).alias("_db"))
    n = F.size("_db")
    middle = (F.get("_db", F.floor((n - 1) / 2).cast("int")) + F.get("_db", F.floor(n / 2).cast("int"))) / 2
    return by.select("video_id", "start", "end", F.when(n > 0, middle).otherwise(-140.0).alias("level"))


def speech_level(intervals: DataFrame) -> DataFrame:
    """AGG-9: video_id, speech_db: median level of the intervals of 2 s or more, else of the first."""
    long = F.col("end") - F.col("start") >= C.MIN_MISS
    return intervals.groupBy("video_id").agg(F.coalesce(F.median(F.when(long, F.col("level"))), F.min_by("level", "start")).alias("speech_db"))


def undetected(gaps: DataFrame, speech: DataFrame) -> DataFrame:
    """AGG-10: gaps of 5 s or more that are nearly as loud as speech."""
    return gaps.join(speech, "video_id").where((F.col("end") - F.col("start") >= C.MIN_UNDETECTED) & (F.col("level") >= F.col("speech_db") - C.LEVEL_SUSPICIOUS_DB)).select(*gaps.columns)


def batch_status(jobs: DataFrame) -> DataFrame:
    """AGG-13: jobs (batch_id, job_id, seq, stage) to counts by outcome and the last running job."""
    settled = ("done", "failed", "cancelled", "pending")
    counts = [F.count_if(F.col("stage") == s).alias(s) for s in settled]
    running = ~F.col("stage").isin(*settled)
    return jobs.groupBy("batch_id").agg(*counts, F.count_if(running).alias("running"), F.max_by(F.when(running, F.col("job_id")), F.when(running, F.col("seq"))).alias("current"))


def recovered_stats(segments: DataFrame) -> DataFrame:
    """AGG-14: count, seconds and share with song marks by provenance."""
    return segments.groupBy("recovered").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("seconds"), F.avg(F.contains("text", F.lit("♪")).cast("double")).alias("song_share"))


def blank_share(segments: DataFrame, key: str) -> DataFrame:
    """AGG-15: share of segments without content, and whether it is 0.3 or more."""
    share = F.avg(F.when(T.has_content(F.col("text")), 0.0).otherwise(1.0))
    return segments.groupBy(key).agg(share.alias("blank_share"), (share >= 0.3).alias("warn"))
