"""Timed-text tables from the driver's tables. These are stand-ins: no transcript is among the data.

lines: the non-blank lines of documents on a synthetic timeline (reading time, then a pause that depends
on the line's number), in whole milliseconds. words: events as spoken words of their user. turns:
a user turn and the assistant turn that follows it as text and translation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake.functions import text as T
from cuelake.session import read_table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, index, start, end, text, lang."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    kept = F.filter(F.transform(F.split("text", "\n"), T.strip_given), lambda x: x != "")
    each = docs.select(F.col("doc_id").alias("video_id"), "lang", F.posexplode(kept).alias("pos", "text"))
    spoken = F.greatest(F.floor(F.length("text") * 1000 / 3), F.lit(500)).cast("long")
    pause = (((F.col("pos") + 1) * 7) % 5 * 500).cast("long")
    before = F.sum(spoken + pause).over(Window.partitionBy("video_id").orderBy("pos")) - spoken - pause
    return each.select("video_id", (F.col("pos") + 1).alias("index"), (before / 1000).alias("start"), ((before + spoken) / 1000).alias("end"), "text", "lang")


LINES = r"""
lines0 AS (SELECT doc_id, lang, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS text FROM (
  SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x:
    regexp_replace(regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ''), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+\z', '')), lambda x: x <> '') AS t FROM documents)),
lines1 AS (SELECT *, greatest(length(text) * 1000 // 3, 500) AS spoken, i * 7 % 5 * 500 AS pause FROM lines0),
lines2 AS (SELECT *, sum(spoken + pause) OVER (PARTITION BY doc_id ORDER BY i) - spoken - pause AS before FROM lines1),
lines AS (SELECT doc_id AS video_id, i::INT AS index, before / 1000 AS start, (before + spoken) / 1000 AS "end", text, lang FROM lines2)
"""


def words(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """video_id, word_no, start, end, text, from the events of one type or all."""
    e = read_table(spark, sf_dir, "events")
    e = e.where(F.col("event_type") == kind) if kind else e
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("word_no"), start.alias("start"), (start + F.col("value")).alias("end"), F.col("event_type").alias("text"))


WORDS = """words AS (SELECT user_id AS video_id, event_id AS word_no, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value AS "end", event_type AS text FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, index, text, translation: a turn and what the next turn answers."""
    c = read_table(spark, sf_dir, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("index"), "role", "text", nxt.alias("translation")).where("role = 'user' and translation is not null").drop("role")


TURNS = """turns AS (SELECT video_id, index, text, translation FROM (SELECT conv_id AS video_id, turn::INT AS index, role, text,
  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS translation FROM conversations) WHERE role = 'user' AND translation IS NOT NULL)"""
