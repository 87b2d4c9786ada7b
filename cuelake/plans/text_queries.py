"""Queries on scalar text functions, filters and text metrics, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import metrics
from cuelake.plans import duck as D
from cuelake.plans.adapters import LINES, TURNS, lines, turns

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _lines_sql(select: str) -> str:
    return f"WITH {LINES} SELECT {select} FROM lines"


@query("transcript_report", f"""WITH {LINES} SELECT lang, count(*) AS n_lines, round(avg(CASE WHEN {D.ends_sentence('text')} THEN 0.0 ELSE 1.0 END), 9) AS open_ended,
  count(*) FILTER (WHERE {D.is_fragment('text')}) AS n_fragments, sum({D.tokens('text')})::BIGINT AS tokens FROM lines GROUP BY lang""")
def transcript_report(spark, sf_dir):
    x = lines(spark, sf_dir)
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.round(metrics.open_ended_ratio("text"), 9).alias("open_ended"), F.count_if(T.is_fragment(F.col("text"))).alias("n_fragments"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


@query("flt_has_content", _lines_sql("video_id, index, regexp_matches(text, '[\\p{L}\\p{N}]') AS has_content"))
def flt_has_content(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.has_content(F.col("text")).alias("has_content"))


@query("flt_confidence_gate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(l_tax * 60, 0) <= 2.4 AND coalesce(l_discount * -12, 0) >= -1.0")
def flt_confidence_gate(spark, sf_dir):
    from cuelake.session import read_table

    x = read_table(spark, sf_dir, "lineitem").withColumns({"compression_ratio": F.col("l_tax") * 60, "avg_logprob": F.col("l_discount") * -12})
    return metrics.confident(x).select("l_orderkey", "l_linenumber")


@query("txt_units", _lines_sql(f"video_id, index, {D.units('text')}::INT AS units"))
def txt_units(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.units(F.col("text")).alias("units"))


@query("txt_tokens", _lines_sql(f"video_id, index, {D.tokens('text')} AS tokens"))
def txt_tokens(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("txt_fragment", _lines_sql(f"video_id, index, {D.is_fragment('text')} AS fragment"))
def txt_fragment(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.is_fragment(F.col("text")).alias("fragment"))


@query("txt_single_sentence", _lines_sql(f"video_id, index, {D.is_single_sentence('text')} AS single"))
def txt_single_sentence(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.is_single_sentence(F.col("text")).alias("single"))


_WRAP = f"WITH {LINES} {D.wrap('lines', 'text')}"


@query("txt_wrap", _WRAP)
def txt_wrap(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", F.array_join(T.wrap(F.col("text")), "\n").alias("wrapped"))


@query("agg_overflow_cues", f"SELECT video_id, count(*) AS n_overflow FROM ({_WRAP}) WHERE list_max(list_transform(string_split(wrapped, chr(10)), lambda x: length(x))) > 42 GROUP BY video_id")
def agg_overflow_cues(spark, sf_dir):
    wide = F.exists(T.wrap(F.col("text")), lambda p: F.length(p) > 42)
    return lines(spark, sf_dir).where(wide).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_overflow"))


@query("txt_join", f"WITH {LINES} SELECT video_id, index, {D.join_text('text', 'nxt')} AS joined FROM (SELECT *, lead(text) OVER (PARTITION BY video_id ORDER BY index) AS nxt FROM lines) WHERE nxt IS NOT NULL")
def txt_join(spark, sf_dir):
    from pyspark.sql import Window

    x = lines(spark, sf_dir).withColumn("nxt", F.lead("text").over(Window.partitionBy("video_id").orderBy("index"))).where("nxt is not null")
    return x.select("video_id", "index", T.join_text(F.col("text"), F.col("nxt")).alias("joined"))


@query("fmt_srt_time", _lines_sql(f"video_id, index, {D.clock('start', 1000, '%02d:%02d:%02d,%03d')} AS t"))
def fmt_srt_time(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.srt_time(F.col("start")).alias("t"))


@query("fmt_ass_time", _lines_sql(f"video_id, index, {D.clock('start', 100, '%d:%02d:%02d.%02d')} AS t"))
def fmt_ass_time(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.ass_time(F.col("start")).alias("t"))


@query("fmt_parse_time", "SELECT event_id, m * 60.0 + s AS seconds FROM (SELECT event_id, event_id % 120 AS m, event_id % 60 AS s FROM events)")
def fmt_parse_time(spark, sf_dir):
    from cuelake.session import read_table

    stamp = F.concat_ws(":", (F.col("event_id") % 120).cast("string"), (F.col("event_id") % 60).cast("string"))
    return read_table(spark, sf_dir, "events").select("event_id", T.parse_time(stamp).alias("seconds"))


@query("fmt_ass_color", "SELECT c_custkey, '&H00' || upper(substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS color FROM (SELECT c_custkey, printf('%06x', c_custkey * 7919 % 16777216) AS h FROM customer)")
def fmt_ass_color(spark, sf_dir):
    from cuelake.session import read_table

    rgb = F.format_string("#%06x", F.col("c_custkey") * 7919 % 16777216)
    return read_table(spark, sf_dir, "customer").select("c_custkey", T.ass_color(rgb).alias("color"))


@query("txt_cap_duration", _lines_sql("""video_id, index, CASE WHEN ("end" + index) - start > 2 * greatest(length(text) / 3.0,
  0.5) THEN round(start + greatest(length(text) / 3.0, 0.5), 6) ELSE round("end" + index, 6) END AS capped"""))
def txt_cap_duration(spark, sf_dir):
    x = lines(spark, sf_dir)
    return x.select("video_id", "index", F.round(T.plausible_end(F.col("text"), F.col("start"), F.col("end") + F.col("index")), 6).alias("capped"))


@query("txt_marks", _lines_sql("video_id, index, CASE WHEN index % 3 = 0 THEN '♪ ' || regexp_replace(text, '\\s+', ' ', 'g') || ' ♪' ELSE regexp_replace(text, '\\s+', ' ', 'g') END AS marked"))
def txt_marks(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "index", T.apply_marks(F.concat(F.lit("♪ "), "text"), F.col("index") % 3 == 0).alias("marked"))


@query("agg_open_ended", f"""WITH {LINES} SELECT lang, round(avg(CASE WHEN {D.ends_sentence('text')} THEN 0.0 ELSE 1.0 END), 9) AS ratio, avg(CASE
  WHEN {D.ends_sentence('text')} THEN 0.0 ELSE 1.0 END) > 0.5 AS unpunctuated,
  bool_or({D.ends_sentence('text')}) AS any_end FROM lines GROUP BY lang""")
def agg_open_ended(spark, sf_dir):
    r = metrics.open_ended_ratio("text")
    return lines(spark, sf_dir).groupBy("lang").agg(F.round(r, 9).alias("ratio"), (r > 0.5).alias("unpunctuated"), F.bool_or(T.ends_sentence(F.col("text"))).alias("any_end"))


@query("agg_percentiles", f"""WITH {LINES}, s AS (SELECT lang, list_sort(list("end" - start)) AS a FROM lines GROUP BY lang)
SELECT lang, unnest([5, 25, 50, 75, 95]) AS p, unnest([a[least(len(a) * q // 100, len(a) - 1) + 1] for q in [5, 25, 50, 75, 95]]) AS value FROM s""")
def agg_percentiles(spark, sf_dir):
    x = lines(spark, sf_dir).select("lang", (F.col("end") - F.col("start")).alias("v"))
    return metrics.percentiles(x, "lang", "v", (5, 25, 50, 75, 95))


@query("agg_length_corr", f"""WITH {TURNS}, g AS (SELECT index, count(*) AS n, covar_pop(length(text), length(translation)) AS c,
  stddev_pop(length(text)) * stddev_pop(length(translation)) AS s FROM turns WHERE translation <> '' GROUP BY index)
SELECT index, n, CASE WHEN n >= 20 AND s > 0 THEN round(c / s, 6) END AS r FROM g""")
def agg_length_corr(spark, sf_dir):
    return metrics.length_correlation(turns(spark, sf_dir), "index").select("index", "n", F.round("r", 6).alias("r"))


@query("agg_token_tally", f"WITH {TURNS} SELECT index, count(*) AS calls, sum({D.tokens('text')})::BIGINT AS prompt, sum({D.tokens('translation')})::BIGINT AS completion FROM turns GROUP BY index")
def agg_token_tally(spark, sf_dir):
    x = turns(spark, sf_dir).select("index", T.estimate_tokens(F.col("text")).alias("prompt_tokens"), T.estimate_tokens(F.col("translation")).alias("completion_tokens"), F.lit(None).cast("long").alias("cached_tokens"))
    return metrics.tally(x, "index").select("index", "calls", "prompt", "completion")


@query("ver_bag_overlap", f"""WITH {TURNS}, w AS (SELECT video_id, index, {D.words('translation')} AS a, {D.words('text')} AS b FROM turns),
a AS (SELECT video_id, index, w, count(*) AS n FROM (SELECT video_id, index, unnest(a) AS w FROM w) GROUP BY ALL), b AS (SELECT video_id, index, w,
  count(*) AS n FROM (SELECT video_id, index, unnest(b) AS w FROM w) GROUP BY ALL),
k AS (SELECT video_id, index, sum(least(a.n, b.n))::BIGINT AS kept FROM a JOIN b USING (video_id, index, w) GROUP BY ALL)
SELECT video_id, index, coalesce(kept, 0) AS kept, len(w.b) AS total, len(w.a) - coalesce(kept, 0) AS added,
  len(w.b) = 0 OR (coalesce(kept, 0) >= 0.6 * len(w.b) AND len(w.a) - coalesce(kept, 0) <= greatest(2, 0.25 * len(w.a))) AS faithful FROM w LEFT
    JOIN k USING (video_id, index)""")
def ver_bag_overlap(spark, sf_dir):
    from cuelake.operators import verify

    # Each user turn is the source of the answer to it: one pair per row.
    pairs = turns(spark, sf_dir).select("video_id", "index", F.col("translation").alias("candidate"), F.col("text").alias("source"))
    return verify.faithful(pairs, "video_id", "index").select("video_id", "index", "kept", "total", "added", "faithful")
