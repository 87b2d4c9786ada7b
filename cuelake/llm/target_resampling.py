"""Importance resampling towards a target distribution, with whole-number scores.

Documents and target texts are counted in one array of hashed word 1- to 3-grams each. A bucket's gain is its log
ratio in thousandths, a document's weight the sum over its n-grams, read from the array of gains. A Gumbel number hashed
from the id is added. The draw needs no sort of all rows: a histogram of the whole-number scores, summed
from the top, says which score the last place has and which rank each score begins at, and only within a
score are the drawn rows ordered by id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake.session import cut, read_table, ship

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Ranges of scores in the first, coarse histogram: the most rows that go to the driver.
RANGES = 4096
#: Equal rows that one task writes out at most.
COPIES = 50_000
#: Lower case for A-Z; every other ASCII character but letters and digits ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def features(text: str | None, longest: int = LONGEST) -> tuple[int, list[int]]:
    """The number of words, and the CRC-32 of every run of 1 to ``longest`` words joined by a space, repeats
    included. The CRC of a run goes on from the one that lacks its last word, so no run is put together."""
    words = (text or "").encode().translate(_FOLD).split()
    runs = list(map(zlib.crc32, words))
    found, after = list(runs), [b" " + w for w in words]
    for n in range(1, longest):
        runs = list(map(zlib.crc32, after[n:], runs))
        found += runs
    return len(words), found


def _counts(buckets: int, longest: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                crc = np.array(features(text.as_py(), longest)[1], dtype=np.int64)
                total += np.bincount(crc % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return rows


def counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features in each bucket over all rows of texts (text). One array per task, summed by bucket."""
    ship(texts.sparkSession)
    by = texts.select("text").mapInArrow(_counts(buckets, longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in by.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in target over its share in raw."""
    s, t, n = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def _weights(table, longest: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for b in batches:
            n_words, n, weight = [], [], []
            for text in b.column(1):
                words, crc = features(text.as_py(), longest)
                n_words.append(words)
                n.append(len(crc))
                weight.append(int(gain[np.array(crc, dtype=np.int64) % len(gain)].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return rows


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number in whole thousandths from 32 hashed bits of ``seed:doc_id``; a null id is written null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, places: int) -> DataFrame:
    """The ``places`` rows of scored (score long, doc_id, ...; cheap to read) with the largest scores, ties to smaller
    doc_id, then by the other columns; null ids last. Adds rank from 1; equal rows have ranks that follow one another.

    Scores are counted in at most RANGES ranges first, which says where the last place is; then within each
    range that has a place. Equal rows are one row with a count until ranks are known, so a row
    that makes up a third of the table is no large group.
    """
    spark, columns = scored.sparkSession, scored.columns
    lo, hi = scored.agg(F.min("score"), F.max("score")).first()
    if lo is None or places < 1:
        return scored.limit(0).withColumn("rank", F.lit(None).cast("long"))
    width = max(1, -(-(hi - lo + 1) // RANGES))
    part = F.floor((F.lit(hi) - F.col("score")) / width).cast("int")  # 0 for the highest scores
    by_part = {r["part"]: r["n"] for r in scored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(by_part):
        if before < places:
            starts.append((p, before))
        before += by_part[p]
    reached = F.broadcast(spark.createDataFrame(starts, "part int, above long"))  # at most RANGES rows
    top = scored.withColumn("part", part).join(reached, "part")
    # The score histogram within the reached ranges, summed from the top: how many rows are above each score.
    higher = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("score"))) - F.col("n")
    offsets = top.groupBy("part", "above", "score").agg(F.count(F.lit(1)).alias("n")).select("score", (F.col("above") + higher).alias("above")).where(F.col("above") < places)
    rest = [c for c in columns if c not in ("doc_id", "score")]
    distinct = top.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    within = F.sum("copies").over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), *rest)) - F.col("copies")
    first = distinct.join(offsets, "score").withColumn("first", F.col("above") + within + 1).where(F.col("first") <= places)
    last = F.least(F.col("first") + F.col("copies") - 1, F.lit(places))
    parts = first.withColumn("last", last).withColumn("from", F.explode(F.sequence("first", "last", F.lit(COPIES))))
    ranks = F.sequence("from", F.least(F.col("from") + COPIES - 1, F.col("last")))
    return parts.select(*columns, F.explode(ranks).alias("rank"))


def resample_to_target(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of docs (doc_id, text) against all texts of target (text).

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred are drawn, the highest scores first; the
    others have a null rank. A null or empty text has no features and weight 0. All rows count towards
    the models, whole texts however long. Rows that repeat have equal scores and a rank each, in no order among equal rows; null ids share one random
    number and come after others of their score. Other columns are left out. No rows give no rows; an empty target is uniform.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(gains(counts(docs, buckets, longest), counts(target, buckets, longest)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighted = own.mapInArrow(_weights(table, longest), "doc_id long, n_words long, n_features long, weight long")
    scored = cut(weighted.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.col("n_words") >= min_words
    places = percent * scored.where(able).count() // 100
    drawn = draw(scored.where(able), places)
    # What is not drawn: rows under the last place's score as they are, and those of that score that had no place.
    if places < 1:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    drawn = cut(drawn)
    last = drawn.agg(F.min("score")).first()[0]
    columns = scored.columns
    tied = scored.where(able & (F.col("score") == last)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    taken = drawn.where(F.col("score") == last).groupBy(*columns).agg(F.count(F.lit(1)).alias("taken"))
    same = [tied[c].eqNullSafe(taken[c]) for c in columns]
    left = tied.join(taken, same, "left").select(*(tied[c] for c in columns), (F.col("n") - F.coalesce("taken", F.lit(0))).alias("left")).where("left > 0")
    deal = left.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("left"), F.lit(COPIES))))
    untaken = deal.select(*columns, F.explode(F.sequence("from", F.least(F.col("from") + COPIES - 1, F.col("left")))).alias("k")).drop("k")
    under = scored.where(~able | (F.col("score") < last))
    return drawn.unionByName(under.unionByName(untaken).withColumn("rank", F.lit(None).cast("long")))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample_to_target(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
