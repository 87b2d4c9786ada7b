"""Queries on files and containers as a whole: packets merged with cues, files written under their names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuelake.plans.timeline_queries import ORACLES as TIMELINE
from cuelake.plans.timeline_queries import film_lines
from cuelake.session import cut, read_table, remove_folder, shared_folder
from cuelake.sources import mux, named_files, subtitles

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("mux_merge", """WITH p AS (SELECT user_id AS video_id, event_id AS seq, event_id * 40 + event_id * 7919 % 5 * 40 + 500 AS pts0,
  event_id * 40 + 100 AS dts0, value AS size FROM events WHERE event_type <> 'purchase'),
z AS (SELECT video_id, least(7.5, arg_min(dts0, seq) / 1000) AS zero FROM p GROUP BY video_id),
q AS (SELECT video_id, seq, pts0 - round_even(zero / 0.001, 0)::BIGINT AS pts, dts0 - round_even(zero / 0.001, 0)::BIGINT AS dts FROM p
  JOIN z USING (video_id) WHERE size > 5),
r AS (SELECT *, pts * 0.001 AS "at", max(pts * 0.001) OVER (PARTITION BY video_id ORDER BY seq) AS reach FROM q),
c AS (SELECT user_id AS video_id, event_id AS cue_no, (event_id * 40 - 3000) / 1000 AS "at" FROM events WHERE event_type = 'purchase'),
m AS (SELECT video_id, 'packet' AS kind, seq AS item, "at", pts, dts, reach, 1 AS src FROM r UNION ALL SELECT video_id, 'cue', cue_no, "at", NULL, NULL, "at", 0 FROM c)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY reach, src, item) - 1 AS place, kind, item, round("at", 6) AS "at", pts, dts FROM m""")
def mux_merge(spark, sf_dir):
    """Events as packets shown out of order, of which small ones are empty, and purchases as cues."""
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", "event_type", "value")
    packets = e.where("event_type <> 'purchase'").select(
        "video_id",
        F.col("event_id").alias("seq"),
        (F.col("event_id") * 40 + F.col("event_id") * 7919 % 5 * 40 + 500).alias("pts"),
        (F.col("event_id") * 40 + 100).alias("dts"),
        F.lit(0.001).alias("tick"),
        F.when(F.col("value") > 5, F.col("value")).otherwise(0).alias("size"),
        F.lit(7.5).alias("start_time"),
    )
    cues = e.where("event_type = 'purchase'").select("video_id", F.col("event_id").alias("cue_no"), ((F.col("event_id") * 40 - 3000) / 1000).alias("start"))
    return mux.merge_streams(packets, cues).withColumn("at", F.round("at", 6))


@query("sink_named", TIMELINE["sink_srt"])
def sink_named(spark, sf_dir):
    """SRT files written under their names, a thousand ids to a folder, and what a reader finds there."""
    files = subtitles.files_of(subtitles.srt_blocks(film_lines(spark, sf_dir)))
    name = F.concat(F.floor(F.col("video_id") / 1000).cast("string"), F.lit("/"), F.col("video_id").cast("string"), F.lit(".zh.srt"))
    path = f"{shared_folder(spark)}/named-{uuid.uuid4().hex}"
    try:
        names = named_files.write_named(files.select(name.alias("name"), "text"), path)
        number = F.regexp_extract("name", r"([0-9-]+)\.zh\.srt$", 1).cast("long")
        out = cut(named_files.read_named(names, path).select(number.alias("video_id"), F.md5("text").alias("digest")))
        named_files.remove_named(names, path)
        return out
    finally:
        remove_folder(spark, path)
