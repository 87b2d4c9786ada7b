"""Queries on transcripts as they come in, on lyric ranges that do not hold up, and on diagnostic logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import segments, verify
from cuelake.plans import duck as D
from cuelake.plans.adapters import LINES, lines
from cuelake.session import read_table
from cuelake.streaming import logs

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


class _Decoder:
    """Lines as what a recogniser says: primed it loops on every seventh film; unprimed it hears half of those."""

    def __init__(self, said):
        self.said = said

    def decode(self, videos, primed):
        v, i = F.col("video_id"), F.col("index")
        lost = (v % 7 == 0) | (i % 4 == 0) if primed else (v % 14 != 0) | (i % 2 == 0)
        own = self.said.join(videos, "video_id", "left_semi")
        return own.withColumn("text", F.when(lost, F.lit(" - " if primed else "♪")).otherwise(F.col("text")))


_HEARD = rf"""{LINES}, h AS (SELECT video_id, index, regexp_matches(text, '[\p{{L}}\p{{N}}]') AS c FROM lines),
p AS (SELECT video_id, index, c AND video_id % 7 <> 0 AND index % 4 <> 0 AS ok FROM h), u AS (SELECT video_id, index, c AND video_id % 14 = 0
  AND index % 2 = 1 AS ok FROM h),
looped AS (SELECT video_id FROM p GROUP BY video_id HAVING NOT bool_or(ok)),
said AS (SELECT * FROM p WHERE video_id NOT IN (FROM looped) UNION ALL SELECT * FROM u WHERE video_id IN (FROM looped))"""


@query("src_retry", f"""WITH {_HEARD} SELECT video_id, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS blank, round(avg(1 - ok::INT), 9) AS share,
  avg(1 - ok::INT) >= 0.3 AS warn, video_id IN (FROM looped) AS retried FROM said GROUP BY video_id""")
def src_retry(spark, sf_dir):
    x = lines(spark, sf_dir)
    return segments.transcribe(x, _Decoder(x))[1].withColumn("share", F.round("share", 9))


@query("src_segments", f"WITH {_HEARD} SELECT video_id, index FROM said WHERE ok")
def src_segments(spark, sf_dir):
    x = lines(spark, sf_dir)
    return segments.transcribe(x, _Decoder(x))[0].select("video_id", "index")


def _part(which, a, b):
    """A snippet that is empty, the line, its first half, or another line."""
    return F.when(which == 0, "").when(which == 1, a).when(which == 2, F.left(a, F.floor(F.length(a) / 2).cast("int"))).otherwise(b)


def _part_sql(which, a, b):
    return f"CASE {which} WHEN 0 THEN '' WHEN 1 THEN {a} WHEN 2 THEN left({a}, length({a}) // 2) ELSE {b} END"


def _fits_sql(snippet, line):
    n = f"length({D.words(snippet)})"
    return f"({n} > 0 AND {D.bag_kept(D.words(snippet), D.words(line))} >= greatest(1, round({n} * 0.6)))"


@query("ver_snippets", f"""WITH {LINES}, n AS (SELECT video_id, count(*) AS total FROM lines GROUP BY ALL),
r AS (SELECT a.video_id, a.index AS first, b.index AS last, a.text AS ta, b.text AS tb, total,
  {_part_sql('a.index % 4', 'a.text', 'b.text')} AS head, {_part_sql('(a.index + a.video_id) % 4', 'b.text', 'a.text')} AS tail
  FROM lines a JOIN lines b ON b.video_id = a.video_id AND b.index = a.index + 2 JOIN n ON n.video_id = a.video_id)
SELECT video_id, first::INT AS first, last::INT AS last, CASE WHEN NOT {_fits_sql('head', 'ta')} THEN 'head'
  WHEN NOT {_fits_sql('tail', 'tb')} THEN 'tail' ELSE '' END AS reason FROM r""")
def ver_snippets(spark, sf_dir):
    """Ranges of three lines whose snippets are empty, whole, half or of another line."""
    x = lines(spark, sf_dir).select("video_id", "index", "text")
    last = x.select("video_id", (F.col("index") - 2).alias("index"), F.col("text").alias("tb"))
    r = x.join(last, ["video_id", "index"])
    head = _part(F.col("index") % 4, F.col("text"), F.col("tb"))
    tail = _part((F.col("index") + F.col("video_id")) % 4, F.col("tb"), F.col("text"))
    ranges = r.select("video_id", F.col("index").alias("first"), (F.col("index") + 2).alias("last"), head.alias("head"), tail.alias("tail"))
    return verify.verify_ranges(ranges, x).select("video_id", "first", "last", "reason")


_RULE = logs.RULE


@query("log_debug", f"""WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'kv' WHEN 'view' THEN 'block'
  WHEN 'purchase' THEN 'section' ELSE 'line' END AS kind,
  event_type || event_id AS title, repeat(event_type, (event_id % 7)::INT) AS body, event_id * 6.0 AS elapsed FROM events),
t AS (SELECT job_id, seq, CASE kind WHEN 'section' THEN chr(10) || chr(10) || '{_RULE}' || chr(10) || '== ' || title || '    [任务开始后 ' || printf('%.1f', elapsed / 60) || ' 分钟]' || chr(10) || '{_RULE}' || chr(10)
  WHEN 'kv' THEN CASE WHEN length(title) < 28 THEN rpad(title, 28, ' ') ELSE title END || ': ' || body || chr(10)
  WHEN 'block' THEN chr(10) || '--- ' || title || ' ---' || chr(10) || CASE WHEN length(body) > 20 THEN left(body, 20) || chr(10) || '…（已截断，原长度 ' || length(body) || ' 字符）' ELSE body END || chr(10) || '--- /' || title || ' ---' || chr(10)
  ELSE body || chr(10) END AS t FROM e)
SELECT job_id, md5(string_agg(t, '' ORDER BY seq)) AS digest FROM t GROUP BY job_id""")
def log_debug(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "kv").when(F.col("event_type") == "view", "block").when(F.col("event_type") == "purchase", "section").otherwise("line")
    entries = e.select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.concat("event_type", F.col("event_id").cast("string")).alias("title"),
        F.repeat("event_type", (F.col("event_id") % 7).cast("int")).alias("body"),
        (F.col("event_id") * 6.0).alias("elapsed"),
    )
    return logs.debug_logs(entries, most=20).select("job_id", F.md5("text").alias("digest"))
