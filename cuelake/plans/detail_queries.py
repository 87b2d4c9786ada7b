"""Queries on operators that others use inside, each on its own with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import cues, verify
from cuelake.plans import duck as D
from cuelake.plans import film
from cuelake.plans.adapters import LINES, lines
from cuelake.session import read_table
from cuelake.sources import media, subtitles
from cuelake.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("txt_unspaced_run", f"WITH {LINES} SELECT video_id, index, NOT contains(text, ' ') AND {D.count_in('text', T.UNSPACED)} >= length(text) * 0.6 AS run FROM lines")
def txt_unspaced_run(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.is_unspaced_run(F.col("text")).alias("run"))


@query("txt_rejects_thinking", f"WITH {LINES} SELECT video_id, index, contains(lower(text), 'the ') OR contains(lower(text), 'ing') AS rejects FROM lines")
def txt_rejects_thinking(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.rejects_thinking(F.col("text"), ["the ", "ing"]).alias("rejects"))


@query("fmt_log_time", f"WITH {LINES} SELECT video_id, index, {D.clock('start', 1000, '%d:%02d:%02d.%03d')} AS t FROM lines")
def fmt_log_time(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.log_time(F.col("start")).alias("t"))


_FRAMES = f"""frames AS (SELECT video_id, {D.half_even('start')} AS start, {D.half_even('start + 2.5')} AS "end", text FROM (
  SELECT video_id, start, CASE index % 4 WHEN 0 THEN '' WHEN 1 THEN '[无文字]' ELSE text END AS text FROM lines) WHERE text <> '' AND NOT contains(text, '[无文字]'))"""


def _frames(x):
    reply = F.when(F.col("index") % 4 == 0, " \n").when(F.col("index") % 4 == 1, "[无文字]").otherwise(F.concat(F.lit(" "), "text"))
    return subtitles.frame_cues(x.select("video_id", "start", F.lit(2.5).alias("duration"), reply.alias("reply")))


@query("src_frames", f"""WITH {LINES}, {_FRAMES} SELECT video_id, start, "end", text FROM frames""")
def src_frames(spark, sf_dir):
    return _frames(lines(spark, sf_dir))


@query("set_frames", f"""WITH {LINES}, {_FRAMES} SELECT video_id, index::INT AS index, start, "end", text, 'T' AS translation, false AS is_frame FROM lines
UNION ALL SELECT video_id, 0, start, "end", '', text, true FROM frames""")
def set_frames(spark, sf_dir):
    x = lines(spark, sf_dir).select("video_id", F.col("index").cast("int").alias("index"), "start", "end", "text", F.lit("T").alias("translation"))
    return subtitles.with_frames(x, _frames(x))


@query("req_numbered", f"""WITH {LINES} SELECT video_id, ((index - 1) // 20)::INT AS chunk_id, string_agg('[' || index || '] ' || text, chr(10)
  ORDER BY index) AS body FROM lines GROUP BY ALL""")
def req_numbered(spark, sf_dir):
    x = cues.batches(lines(spark, sf_dir), 20).withColumnRenamed("batch", "chunk_id")
    return film.requests(x, "translate").select("video_id", "chunk_id", "body")


def _chunks_sql(budget, marker):
    return f"""WITH RECURSIVE {LINES}, cost AS (SELECT video_id, index, {D.tokens('text')} + {marker} AS c FROM lines),
f AS (SELECT video_id, 1 AS index, 0 AS chunk_id, c AS used FROM cost WHERE index = 1
  UNION ALL SELECT n.video_id, n.index, f.chunk_id + (f.used + n.c > {budget})::INT, CASE WHEN f.used + n.c > {budget} THEN n.c ELSE f.used + n.c END
  FROM f JOIN cost n ON n.video_id = f.video_id AND n.index = f.index + 1)
SELECT video_id, index, chunk_id::INT AS chunk_id FROM f"""


@query("fold_review_chunks", _chunks_sql(2000, 3))
def fold_review_chunks(spark, sf_dir):
    """Vetting and lyrics chunks: the budget of a small context."""
    return cues.chunks(lines(spark, sf_dir), cues.token_budget(3000, 2000, 12_000), 3).select("video_id", "index", "chunk_id")


@query("fold_long_chunks", _chunks_sql(300, 6))
def fold_long_chunks(spark, sf_dir):
    """The way of long films on films of over ten lines."""
    return cues.chunks(lines(spark, sf_dir), 300, 6, long_film=10, block=8).select("video_id", "index", "chunk_id")


@query("join_lyrics", f"""WITH {LINES} SELECT l.video_id, l.index, bool_or(r.index IS NOT NULL) AS is_lyric FROM lines l LEFT JOIN lines r
  ON r.video_id = l.video_id AND r.index % 7 = 1 AND l.index BETWEEN r.index AND r.index + r.video_id % 9 GROUP BY ALL""")
def join_lyrics(spark, sf_dir):
    x = lines(spark, sf_dir).select("video_id", "index", "text")
    accepted = x.where("index % 7 = 1").select("video_id", F.col("index").alias("first"), (F.col("index") + F.col("video_id") % 9).alias("last"))
    return verify.mark_lyrics(x, accepted).select("video_id", "index", "is_lyric")


@query("ver_times", """WITH t AS (SELECT l_orderkey AS video_id, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN l_linenumber || ':' || l_partkey % 70
  WHEN 1 THEN '1:2:3:4' WHEN 2 THEN '-' || l_linenumber WHEN 3 THEN 'soon' ELSE l_partkey % 900 || '.5' END AS time,
  CASE l_partkey % 5 WHEN 0 THEN l_linenumber * 60.0 + l_partkey % 70 WHEN 4 THEN l_partkey % 900 + 0.5 END AS seconds FROM lineitem)
SELECT video_id, time, seconds::DOUBLE AS seconds, coalesce(seconds <= o_orderkey % 700, false) AS valid FROM t JOIN orders ON o_orderkey = video_id""")
def ver_times(spark, sf_dir):
    n, p = (F.col(c).cast("string") for c in ("l_linenumber", "l_partkey"))
    k = F.col("l_partkey") % 5
    time = F.when(k == 0, F.concat(n, F.lit(":"), (F.col("l_partkey") % 70).cast("string"))).when(k == 1, "1:2:3:4").when(k == 2, F.concat(F.lit("-"), n)).when(k == 3, "soon").otherwise(F.concat((F.col("l_partkey") % 900).cast("string"), F.lit(".5")))
    tasks = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), time.alias("time"))
    durations = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), (F.col("o_orderkey") % 700).cast("double").alias("duration"))
    return verify.time_valid(tasks, durations).select("video_id", "time", "seconds", "valid")


@query("trk_describe", """SELECT l_orderkey, l_linenumber, '音轨 #' || l_linenumber || ' ' || CASE l_partkey % 4 WHEN 0 THEN '日语' WHEN 1 THEN '未标注语言'
  WHEN 2 THEN 'xyz' ELSE '德语' END
  || CASE WHEN l_suppkey % 2 = 0 THEN ' 「cut ' || l_suppkey || '」' ELSE '' END || ' aac' || CASE l_linenumber WHEN 1 THEN ' 单声道' WHEN 2 THEN ' 立体声'
    WHEN 6 THEN ' 5.1 声道' ELSE ' ' || l_linenumber || ' 声道' END || CASE WHEN l_linenumber = 1 THEN ' (默认)' ELSE '' END AS description FROM lineitem""")
def trk_describe(spark, sf_dir):
    k = F.col("l_partkey") % 4
    tracks = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_linenumber").alias("index"),
        F.when(k == 0, "JA").when(k == 1, "").when(k == 2, "XYZ").otherwise("deu").alias("language"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("cut "), F.col("l_suppkey").cast("string"))).otherwise("").alias("title"),
        F.lit("aac").alias("codec"),
        F.col("l_linenumber").cast("int").alias("channels"),
        (F.col("l_linenumber") == 1).alias("default"),
    )
    return media.describe(tracks).select("l_orderkey", "l_linenumber", "description")


@query("top_log_tail", "SELECT event_id AS line_no, event_type AS line FROM events ORDER BY event_id DESC LIMIT 200")
def top_log_tail(spark, sf_dir):
    return media.log_tail(read_table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("line")), 200)


@query("json_events", "SELECT event_id, event_type, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events")
def json_events(spark, sf_dir):
    """Rows to JSON texts and back."""
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", value.alias("value"))
    return jobs.from_json(jobs.as_json(e), e.schema)
