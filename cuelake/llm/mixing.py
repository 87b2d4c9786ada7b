"""Mixing sources to target weights by Poisson replication.

Each source s with n_s documents and target share w_s of ``total`` documents has the repetition rate
total * w_s / n_s. A document's count is the Poisson quantile of that rate at a uniform number hashed
from its id, so it is the same on every run and on every machine; the document is then repeated that
often, and all copies are put in the order of another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import join_unique
from cuelake.session import cut, read_table

SEED = 17
#: Default target shares go with n_s to this power: large sources give way to small ones.
POWER = 0.7


def _hash(bits: int, *parts) -> Column:
    """The first bits / 4 hex digits of the MD5 of the parts, joined by colons, as a number."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def _log_factorial(k: Column) -> Column:
    """ln k! of whole numbers from 100 on, by Stirling's series: exact to double precision there."""
    return k * F.ln(k) - k + F.ln(2 * math.pi * k) / 2 + 1 / (12 * k) - 1 / (360 * F.pow(k, F.lit(3))) + 1 / (1260 * F.pow(k, F.lit(5)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, power: float = POWER) -> DataFrame:
    """source, rate, low, cdf for each source of docs: the mean repetition rate and the Poisson distribution
    function at low, low + 1, ... up to where it is 1 in double precision. Below low it is under 2 ** -52, which no
    hashed number tells from 0; the table has about 24 times the root of the rate."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.pow("n", F.lit(power)))
    else:
        pairs = docs.sparkSession.createDataFrame([*weights.items()], "s string, w double")
        weighted = counts.join(pairs, counts.source.eqNullSafe(pairs.s), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    all_w, all_n = weighted.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = float(all_n if total is None else total)
    rate = F.lit(wanted) * F.col("w") / F.lit(float(all_w)) / F.col("n") if all_w else F.lit(0.0)
    reach = 12 * F.sqrt("rate") + 30
    top, least = F.ceil(F.col("rate") + reach).cast("int"), F.floor(F.col("rate") - reach).cast("int")
    low = F.when(least > 100, least).otherwise(0)
    first = F.when(F.col("low") > 0, -F.col("rate") + F.col("low") * F.ln("rate") - _log_factorial(F.col("low").cast("double"))).otherwise(-F.col("rate"))
    # ln p(k) = ln p(k - 1) + ln(rate / k), so no rate under- or overflows.
    step = lambda acc, k: F.struct(
        (log := acc["log"] + F.ln(F.col("rate") / k)).alias("log"), (acc["sum"] + F.exp(log)).alias("sum"), F.concat(acc["cdf"], F.array(acc["sum"] + F.exp(log))).alias("cdf")
    )
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"), F.array(F.exp(first)).alias("cdf"))
    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.col("low") + 1, top), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))
    placed = weighted.select("source", rate.alias("rate")).select("source", "rate", low.alias("low"))
    return placed.select("source", "rate", "low", cdf.alias("cdf"))


#: Numbers in the tables of all sources together (8 bytes each) up to which they are broadcast.
BROADCAST_NUMBERS = 4_000_000


def _drawn(rows: DataFrame, by: DataFrame) -> DataFrame:
    """rows (id, source, row) with the table of their source: by broadcast if all tables together are small, else
    with each source's rows dealt over tasks."""
    if by.agg(F.coalesce(F.sum(F.size("_cdf")), F.lit(0))).first()[0] <= BROADCAST_NUMBERS:
        return rows.join(F.broadcast(by), rows.source.eqNullSafe(by._source))
    keyed = lambda t, c: t.withColumn("_key", F.struct(F.col(c).isNull().alias("none"), F.coalesce(c, F.lit("")).alias("value")))
    return join_unique(keyed(rows, "source"), keyed(by, "_source"), ["_key"], rows.transform(lambda t: keyed(t, "source")).groupBy("_key").agg(F.count(F.lit(1)).alias("n")))


def replicate_rows(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, power: float = POWER) -> DataFrame:
    """row (the columns of docs as one), copy (from 1) and order_key of each copy, in the order of order_key over
    all partitions. order_key is uniform, so that its range is known and partitions follow from it alone: no pass over
    the rows is needed to find them."""
    by = cut(rates(docs, weights, total, power)).select(F.col("source").alias("_source"), F.col("low").alias("_low"), F.col("cdf").alias("_cdf"))
    rows = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    u = _hash(52, F.col("doc_id"), F.lit(seed)).cast("double") / float(1 << 52)
    more = F.size(F.filter("_cdf", lambda c: c < F.col("_u")))
    count = F.when(F.col("_u") > 0, F.col("_low") + more).otherwise(0)
    drawn = _drawn(rows, by).withColumn("_u", u).select("doc_id", "row", count.alias("_count")).where("_count > 0")
    copies = drawn.select("doc_id", "row", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("copy"))
    keyed = copies.withColumn("order_key", _hash(60, F.col("doc_id"), F.col("copy"), F.lit(seed)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col("order_key") / float(1 << 60) * n), F.lit(n - 1)).cast("int")
    return keyed.repartitionById(n, part).sortWithinPartitions("order_key", "doc_id", "copy").select("row", "copy", "order_key")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, power: float = POWER) -> DataFrame:
    """docs, each row as often as its count says, with copy (from 1) and order_key, in the order of
    order_key over all partitions.

    weights: target share by source (sources not named get none); by default n_s ** power. total: how
    many rows the result has on average, by default as many as docs. A null source is a source of its
    own; a null doc_id hashes like any other value; rows that repeat an id get the same count each. A
    column of docs named copy or order_key is replaced (mix keeps it). Texts are not looked at: null, empty and
    long ones are copied as they are. No rows give no rows.
    """
    return replicate_rows(docs.drop("copy", "order_key"), weights, total, seed, power).select("row.*", "copy", "order_key")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, power: float = POWER) -> DataFrame:
    """As replicate, with the columns of docs and no others."""
    return replicate_rows(docs, weights, total, seed, power).select("row.*")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(read_table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (sum(n) OVER ()) * pow(n, {POWER}) / (sum(pow(n, {POWER})) OVER ()) / n AS rate FROM n),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, range(0, 200) AS t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents),
c AS (SELECT u.*, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND cdf < u.u) AS times FROM u)
SELECT * EXCLUDE (u, times, copy), copy::INT AS copy, ('0x' || substr(md5(doc_id::VARCHAR || ':' || copy::VARCHAR || ':{SEED}'), 1, 15))::BIGINT AS order_key
FROM (SELECT *, unnest(range(1, times + 1)) AS copy FROM c WHERE times > 0)
"""
