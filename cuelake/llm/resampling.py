"""Quality classifier by importance resampling.

Two generative models of hashed word 1- and 2-grams are estimated: one of the raw documents, all of them,
and one of a target, documents labelled good. A document's log weight is the sum over its n-grams of the
log ratio of their probabilities in the two models. Adding a Gumbel number hashed from the document's id
to each log weight and keeping the k largest sums draws k documents without replacement in proportion to
their weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import kth_largest
from cuelake.session import cut, read_table, ship

BUCKETS = 10_000
#: Labelled rows that are used at most: those whose id has the smallest hash.
LABELLED = 20_000
#: Added to each bucket's count.
SMOOTHING = 1.0
SEED = 29
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Hashes(dict):
    """word -> CRC-32, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = zlib.crc32(word)
        if len(word) <= 32:
            self[word] = got
        return got


def grams(text: str | None, hashes: _Hashes, buckets: int) -> np.ndarray:
    """Buckets of a text's 1-grams and 2-grams, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (np.concatenate((h * np.uint64(0xD6E8FEB86659FD93), pairs)) >> np.uint64(20)) % np.uint64(buckets)


def _counts(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = _Hashes(), np.zeros((2, buckets), dtype=np.int64)
        for b in batches:
            for text, good in zip(b.column(0), b.column(1).to_pylist()):
                n = np.bincount(grams(text.as_py(), hashes, buckets).astype(np.int64), minlength=buckets)
                total[0] += n
                if good:
                    total[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])], names=["bucket", "raw", "target"])

    return rows


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the share of the labelled documents whose quality is 1. The
    target are those of them that are not toxic."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 1).alias("fine"), (F.coalesce("toxic", F.lit(0)) == 0).alias("mild")).where("_id is not null and fine is not null")
    drawn = known.groupBy("_id").agg(F.min("fine").alias("fine"), F.min(F.col("fine") & F.col("mild")).alias("good")).orderBy(F.xxhash64("_id"), "_id").limit(labelled).collect()  # at most ``labelled`` rows
    if not any(r["good"] for r in drawn):
        return np.zeros(buckets), 1.0
    good = F.broadcast(docs.sparkSession.createDataFrame([(r["_id"], True) for r in drawn if r["good"]], "_id long, good boolean"))
    marked = docs.join(good, docs.doc_id.cast("long") == good._id, "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = marked.mapInArrow(_counts(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    both = np.zeros((2, buckets))
    for bucket, raw, target in counts:  # one row per bucket
        both[:, bucket] = raw, target
    both += SMOOTHING
    p = both / both.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0]), sum(r["fine"] for r in drawn) / len(drawn)


def _weights(ratios):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            n, w = [], []
            for text in b.column(1):
                g = grams(text.as_py(), hashes, len(ratios.value))
                n.append(len(g))
                w.append(float(ratios.value[g].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=["doc_id", "n_grams", "log_weight"])

    return rows


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, labelled: int = LABELLED, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_grams, log_weight, gumbel_key, kept.

    kept marks the documents drawn: the ``share`` of all rows with the largest keys, by default the share
    of the labelled documents whose quality is 1. labels has doc_id, quality and toxic.

    A null or empty text has no n-grams and weight 0, long texts are read whole; null ids draw one number of their own. Rows that repeat a doc_id and text have the same key
    and share their fate: all rows with the key of the last place are kept. Other columns are ignored.
    Without usable labels all weights are 0 and all rows are kept. No rows give no rows.
    """
    spark = docs.sparkSession
    ratios, good = log_ratios(docs, labels, buckets, labelled)
    table = spark.sparkContext.broadcast(ratios)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighted = own.mapInArrow(_weights(table), "doc_id long, n_grams long, log_weight double")
    # A uniform number strictly between 0 and 1 from 52 hashed bits.
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    keyed = cut(weighted.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))))
    k = math.ceil((good if share is None else share) * keyed.count())
    last = kth_largest(keyed, "gumbel_key", k)
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(last) if last is not None else F.lit(False))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
