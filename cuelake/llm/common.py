"""What several of the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.columns import let as let
from cuelake.session import broadcast_if_small, cut, remove_folder
from cuelake.session import shared_folder as shared_folder

#: The six ASCII white-space characters that end a word, as a regex class body for Java and Python.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def row_key(text: str = "text") -> Column:
    """Tells versions of a document apart where an id repeats: XXH64 of the text, null as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def words(text: Column) -> Column:
    """Maximal runs of non-space characters, null text as none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), "")


#: The tables written within the innermost scratch() of this thread.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a lineage cut for wide rows, which a
    checkpoint would keep uncompressed. scratch() deletes what is written within it; without one, the table is there
    as long as the folder of spark.checkpoint.dir is kept, as what is returned may read it at any time."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    if (own := _WRITTEN.get()) is not None:
        own.append(path)  # also if the writing fails
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes within, in this thread, are deleted at the end, also of a stage that failed, when
    nothing reads them any more. Pipelines in other threads of the driver have their own."""
    own: list[str] = []
    token = _WRITTEN.set(own)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for path in own:
            remove_folder(spark, path)


#: Rows of one key from which a join deals them over several tasks.
HOT = 20_000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per keys, however many rows of left have the same keys: those of a
    hot key are dealt over parts, and the one row of right goes to each part. No key is null.

    sizes: keys and n, how many rows of left each key has, where that is known already.
    """
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    hot = cut(sizes.where(F.col("n") > HOT).select(*keys, F.ceil(F.col("n") / HOT).cast("int").alias("_parts")))
    if not hot.limit(1).count():
        return left.join(right, keys, how)
    hot = broadcast_if_small(hot)  # a hot key stands for over HOT rows
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    each = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(each, [*keys, "_part"], how).drop("_part")


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 1024) -> float | None:
    """The exact k-th largest value of a double column, by repeated histograms.

    Each round sends ``bins`` rows to the driver, however long the column is. df should be
    checkpointed, as it is read once per round.
    """
    values = df.select(F.col(key).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    lo, hi, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while lo < hi:
        width = (hi - lo) / bins or 5e-324
        part = values.where(F.col("v").between(lo, hi))
        by = part.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("bin"))
        for row in sorted(by.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: -r["bin"]):
            if k <= row["n"]:
                lo, hi = row["lo"], row["hi"]
                break
            k -= row["n"]
    return lo
