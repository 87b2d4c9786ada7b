"""Queries on timelines, cues, replies and files, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake.functions import text as T
from cuelake.operators import cues, glossary, intervals, metrics, replies, verify
from cuelake.plans import duck as D
from cuelake.plans.adapters import LINES, TURNS, WORDS, lines, turns, words
from cuelake.session import cut, read_table
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


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _speech(spark, sf_dir):
    return words(spark, sf_dir, "click").select("video_id", "start", "end")


def _spoken(spark, sf_dir):
    return words(spark, sf_dir, "view").select("video_id", "start", "end")


_SPEECH = """speech AS (SELECT video_id, start, "end" FROM words WHERE text = 'click'), spoken AS (SELECT video_id, start, "end" FROM words WHERE text = 'view')"""

# --- intervals


@query("iv_covered", f"""WITH {WORDS}, a AS (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING) AS reach FROM words),
b AS (SELECT *, sum(CASE WHEN start <= reach + 600 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT video_id, round(min(start), 6) AS start, round(max("end"), 6) AS "end" FROM b GROUP BY video_id, island""")
def iv_covered(spark, sf_dir):
    return _round(intervals.covered(words(spark, sf_dir).select("video_id", "start", "end"), 600.0), "start", "end")


_REL = """m AS (SELECT min(start) AS t0 FROM words), rel AS (SELECT video_id, start - t0 AS start, "end" - t0 AS "end" FROM words, m),
  dur AS (SELECT video_id, max("end") + 7200 AS duration FROM rel GROUP BY video_id),
k AS (SELECT video_id, greatest(0.0, coalesce(max("end") OVER (PARTITION BY video_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0.0)) AS s, start AS e FROM rel
  UNION ALL SELECT d.video_id, greatest(0.0, max(rel."end")), any_value(d.duration) FROM dur d JOIN rel USING (video_id) GROUP BY d.video_id),
blank AS (SELECT video_id, s, e FROM k WHERE e - s >= 3600)"""


def _relative(spark, sf_dir):
    w = words(spark, sf_dir).select("video_id", "start", "end")
    t0 = w.agg(F.min("start")).first()[0] or 0.0
    rel = w.select("video_id", (F.col("start") - t0).alias("start"), (F.col("end") - t0).alias("end"))
    return rel, rel.groupBy("video_id").agg((F.max("end") + 7200).alias("duration"))


@query("iv_blanks", f"""WITH {WORDS}, {_REL} SELECT video_id, round(s, 6) AS start, round(e, 6) AS "end" FROM blank""")
def iv_blanks(spark, sf_dir):
    rel, durations = _relative(spark, sf_dir)
    return _round(intervals.blanks(rel, durations, 3600.0), "start", "end")


@query("iv_windows", f"""WITH {WORDS}, {_REL} SELECT video_id, round(s + i * 3000, 6) AS start, round(least(s + i * 3000 + 3000, e), 6) AS "end"
FROM (SELECT video_id, s, e, unnest(range(0, ceil((e - s) / 3000)::BIGINT)) AS i FROM blank)""")
def iv_windows(spark, sf_dir):
    rel, durations = _relative(spark, sf_dir)
    return _round(intervals.windows_of(intervals.blanks(rel, durations, 3600.0), 3000.0), "start", "end")


@query("iv_gaps", f"""WITH {LINES} SELECT video_id, index, round(lead(start) OVER (PARTITION BY video_id ORDER BY index) - "end", 6) AS gap FROM lines""")
def iv_gaps(spark, sf_dir):
    return _round(cues.gaps(lines(spark, sf_dir)).select("video_id", "index", "gap"), "gap")


@query("iv_fix_overlaps", f"""WITH {LINES} SELECT video_id, index, CASE WHEN start < p THEN round_even(least(p, "end" - 0.05), 3) ELSE start END AS start
FROM (SELECT video_id, index, start, "end" + 1 AS "end", lag("end" + 1) OVER (PARTITION BY video_id ORDER BY index) AS p FROM lines)""")
def iv_fix_overlaps(spark, sf_dir):
    return cues.fix_overlaps(lines(spark, sf_dir).withColumn("end", F.col("end") + 1)).select("video_id", "index", "start")


@query("iv_gap_limit", f"""WITH {LINES}, g AS (SELECT video_id, lead(start) OVER (PARTITION BY video_id ORDER BY index) - "end" AS gap FROM lines),
  a AS (SELECT video_id, list_sort(list(gap) FILTER (WHERE gap > 0)) AS l FROM g GROUP BY video_id)
SELECT video_id, round(CASE WHEN l IS NULL OR len(l) = 0 THEN 1.2 ELSE least(greatest(l[least(floor(len(l) * 0.40)::BIGINT, len(l) - 1) + 1], 1.2),
  2.5) END, 6) AS gap_limit FROM a""")
def iv_gap_limit(spark, sf_dir):
    return _round(cues.gap_limit(lines(spark, sf_dir)), "gap_limit")


@query("iv_rewinds", "SELECT user_id AS video_id, count(*) FILTER (WHERE prev > value) AS n_rewinds FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY user_id")
def iv_rewinds(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", "value")
    return intervals.rewinds(e, "event_id", "value")


@query("iv_word_spans", f"""WITH {WORDS}, c AS (SELECT * FROM words WHERE text = 'click'), w AS (SELECT * FROM c WHERE video_id % 2 = 0)
SELECT video_id, round(start, 6) AS start, round("end", 6) AS "end" FROM w UNION ALL SELECT video_id, round(start, 6), round("end", 6) FROM words
  WHERE video_id NOT IN (SELECT video_id FROM w)""")
def iv_word_spans(spark, sf_dir):
    w = words(spark, sf_dir, "click").where("video_id % 2 = 0")
    return _round(intervals.word_spans(words(spark, sf_dir).select("video_id", "start", "end"), w), "start", "end")


@query("join_overlap_anti", f"""WITH {WORDS}, {_SPEECH} SELECT video_id, word_no FROM words a WHERE NOT EXISTS (SELECT 1 FROM speech b
  WHERE a.video_id = b.video_id AND least(a."end", b."end") - greatest(a.start, b.start) > 0.2)""")
def join_overlap_anti(spark, sf_dir):
    return intervals.free_of(words(spark, sf_dir), _speech(spark, sf_dir), key="word_no").select("video_id", "word_no")


@query("join_coverage", f"""WITH {WORDS}, {_SPEECH}, c AS (SELECT a.video_id, sum(greatest(0, least(a."end", b."end") - greatest(a.start,
  b.start))) AS covered FROM speech a JOIN spoken b USING (video_id) GROUP BY ALL)
SELECT s.video_id, round(s.t, 4) AS speech, round(coalesce(c.covered, 0), 4) AS covered FROM (SELECT video_id, sum("end" - start) AS t FROM speech
  GROUP BY ALL) s LEFT JOIN c USING (video_id)""")
def join_coverage(spark, sf_dir):
    x = intervals.covered_seconds(_speech(spark, sf_dir), _spoken(spark, sf_dir))
    return x.select("video_id", F.round("speech", 4).alias("speech"), F.round("covered", 4).alias("covered"))


_MISSES = f"""WITH {WORDS}, {_SPEECH}, p AS (SELECT a.video_id, a.start, a."end", greatest(a.start, b.start) AS s, least(a."end", b."end") AS e
  FROM speech a JOIN spoken b ON a.video_id = b.video_id AND least(a."end", b."end") > greatest(a.start, b.start)),
g AS (SELECT video_id, coalesce(max(e) OVER (PARTITION BY video_id, start, "end" ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  start) AS f, s AS t FROM p
  UNION ALL SELECT a.video_id, coalesce((SELECT max(e) FROM p WHERE p.video_id = a.video_id AND p.start = a.start AND p."end" = a."end"), a.start), a."end" FROM speech a)
SELECT video_id, round(f, 6) AS start, round(t, 6) AS "end" FROM g WHERE t - f >= 2"""


@query("join_misses", _MISSES)
def join_misses(spark, sf_dir):
    return _round(intervals.misses(_speech(spark, sf_dir), _spoken(spark, sf_dir)), "start", "end")


@query("top_longest_misses", f"""SELECT video_id, start, "end" FROM ({_MISSES}) ORDER BY "end" - start DESC, video_id, start LIMIT 60""")
def top_longest_misses(spark, sf_dir):
    x = join_misses(spark, sf_dir)
    return x.orderBy(F.desc(F.col("end") - F.col("start")), "video_id", "start").limit(60)


@query("join_agreement", f"""WITH {WORDS}, {_SPEECH} SELECT video_id, is_lyric, touched, count(*) AS n FROM (SELECT video_id, word_no % 2 = 0 AS is_lyric,
  EXISTS (SELECT 1 FROM speech b WHERE a.video_id = b.video_id AND least(a."end", b."end") - greatest(a.start, b.start) > 0.2) AS touched FROM words a) GROUP BY ALL""")
def join_agreement(spark, sf_dir):
    x = words(spark, sf_dir).select("video_id", F.col("word_no").alias("index"), "start", "end", (F.col("word_no") % 2 == 0).alias("is_lyric"))
    return intervals.agreement(x, _speech(spark, sf_dir))


@query("union_sorted", f"""WITH {WORDS} SELECT video_id, word_no, row_number() OVER (PARTITION BY video_id ORDER BY start, text <> 'click',
  word_no)::INT AS pos FROM words WHERE text IN ('click', 'view')""")
def union_sorted(spark, sf_dir):
    a, b = (words(spark, sf_dir, k).withColumnRenamed("word_no", "seg_no") for k in ("click", "view"))
    return intervals.merge_segments(a, b).select("video_id", F.col("seg_no").alias("word_no"), "pos")


# --- levels


@query("agg_level_profile", "SELECT vec_id, round(20 * log10(greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 1e-7)), 6) AS db FROM embeddings")
def agg_level_profile(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(metrics.level_profile(F.col("embedding")), 6).alias("db"))


def _levels(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").groupBy((F.col("event_id") % 10).alias("video_id"), F.floor(F.col("event_id") / 10).cast("int").alias("sec")).agg(F.max("value").alias("value"))
    return e.select("video_id", "sec", (-F.col("value") / 10).alias("db"))


_LEVELS = """levels AS (SELECT event_id % 10 AS video_id, (event_id // 10)::INT AS sec, -max(value) / 10 AS db FROM events GROUP BY ALL),
iv AS (SELECT event_id % 10 AS video_id, (event_id % 700)::DOUBLE AS start, event_id % 700 + value / 20 AS "end" FROM events),
lv AS (SELECT i.video_id, i.start, i."end", coalesce(median(l.db), -140.0) AS level FROM (SELECT DISTINCT * FROM iv) i LEFT JOIN levels l
  ON i.video_id = l.video_id AND l.sec >= floor(i.start) AND l.sec < greatest(floor(i."end"), floor(i.start) + 1) GROUP BY ALL)"""


def _leveled(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    iv = e.select((F.col("event_id") % 10).alias("video_id"), (F.col("event_id") % 700).cast("double").alias("start"), (F.col("event_id") % 700 + F.col("value") / 20).alias("end")).distinct()
    return metrics.median_level(iv, _levels(spark, sf_dir))


@query("agg_median_level", f"""WITH {_LEVELS} SELECT video_id, start, round("end", 6) AS "end", round(level, 6) AS level FROM lv""")
def agg_median_level(spark, sf_dir):
    return _round(_leveled(spark, sf_dir), "end", "level")


@query("agg_speech_level", f"""WITH {_LEVELS}, s AS (SELECT video_id, coalesce(median(level) FILTER (WHERE "end" - start >= 2), arg_min(level,
  start)) AS speech_db FROM lv GROUP BY ALL)
SELECT l.video_id, l.start, round(l."end", 6) AS "end", round(level, 6) AS level FROM lv l JOIN s USING (video_id) WHERE l."end" - l.start >= 5
  AND level >= speech_db - 12""")
def agg_speech_level(spark, sf_dir):
    lv = _leveled(spark, sf_dir)
    return _round(metrics.undetected(lv, metrics.speech_level(lv)), "end", "level")


# --- cues and folds


@query("num_review", f"""WITH {LINES} SELECT video_id, index, recovered, CASE WHEN recovered THEN sum(recovered::INT) OVER w
  ELSE sum((NOT recovered)::INT) OVER w END::BIGINT AS number
FROM (SELECT video_id, index, index % 3 = 0 AS recovered FROM lines) WINDOW w AS (PARTITION BY video_id ORDER BY index ROWS UNBOUNDED PRECEDING)""")
def num_review(spark, sf_dir):
    x = lines(spark, sf_dir).withColumn("recovered", F.col("index") % 3 == 0).withColumnRenamed("index", "pos")
    return cues.review_numbers(x).select("video_id", F.col("pos").alias("index"), "recovered", "number")


@query("top_renumber", f"""WITH {LINES} SELECT video_id, index, row_number() OVER (PARTITION BY video_id ORDER BY -start, "end", index)::INT AS n FROM lines""")
def top_renumber(spark, sf_dir):
    x = lines(spark, sf_dir)
    flipped = x.select("video_id", "index", F.col("index").alias("old"), (-F.col("start")).alias("start"), "end")
    return cues.renumber(flipped).select("video_id", F.col("old").alias("index"), F.col("index").alias("n"))


_CHUNKS = f"""WITH RECURSIVE {LINES}, cost AS (SELECT video_id, index, text, {D.tokens('text')} + 6 AS c FROM lines),
f AS (SELECT video_id, 1 AS index, 0 AS chunk_id, c AS used FROM cost WHERE index = 1
  UNION ALL SELECT n.video_id, n.index, CASE WHEN f.used + n.c > 1500 THEN f.chunk_id + 1 ELSE f.chunk_id END, CASE WHEN f.used + n.c > 1500 THEN n.c
    ELSE f.used + n.c END
  FROM f JOIN cost n ON n.video_id = f.video_id AND n.index = f.index + 1)"""


def _chunked(spark, sf_dir):
    from cuelake import constants as C

    budget = cues.token_budget(C.CONTEXT_LIMIT, C.REFINE_FLOOR, C.REFINE_CHUNK_TOKENS)
    return cues.chunks(lines(spark, sf_dir), budget, C.REFINE_MARKER)


@query("fold_chunks", f"{_CHUNKS} SELECT video_id, index, chunk_id::INT AS chunk_id FROM f")
def fold_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir).select("video_id", "index", "chunk_id")


@query("ctx_tail", f"""{_CHUNKS}, t AS (SELECT f.video_id, f.index, f.chunk_id, list(c.text) OVER (PARTITION BY f.video_id
  ORDER BY f.index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS context, lag(f.chunk_id) OVER (PARTITION BY f.video_id ORDER BY f.index) AS p
  FROM f JOIN cost c ON f.video_id = c.video_id AND f.index = c.index) SELECT video_id, chunk_id::INT AS chunk_id, coalesce(array_to_string(context,
    chr(10)), '') AS context FROM t WHERE p IS NULL OR p <> chunk_id""")
def ctx_tail(spark, sf_dir):
    return cues.context_tail(_chunked(spark, sf_dir))


@query("fold_batches", f"WITH {LINES} SELECT video_id, index, ((index - 1) // 20)::INT AS batch FROM lines")
def fold_batches(spark, sf_dir):
    return cues.batches(lines(spark, sf_dir), 20).select("video_id", "index", "batch")


_N = "'[' || index::VARCHAR || '] ' || text"


@query("fold_sample", f"""WITH {LINES}, p AS (SELECT video_id, index, count(*) OVER (PARTITION BY video_id) AS n, {D.tokens(f"({_N})")} AS cost FROM lines),
h AS (SELECT video_id, string_agg({_N}, chr(10) ORDER BY index) AS t FROM lines WHERE index <= 50 GROUP BY video_id), s AS (SELECT video_id,
  {D.tokens('t')} AS tokens FROM h),
k AS (SELECT p.*, greatest(n * tokens // (50 * 2000), 1) AS step FROM p JOIN s USING (video_id)), q AS (SELECT * FROM k WHERE (index - 1) % step = 0),
r AS (SELECT *, sum(cost) OVER (PARTITION BY video_id ORDER BY index) AS spent FROM q) SELECT video_id, index FROM r WHERE spent <= 2000""")
def fold_sample(spark, sf_dir):
    return cues.sample(lines(spark, sf_dir), 6000).select("video_id", "index")


def _cut_lines(spark, sf_dir):
    """Pieces of at most 40 characters of the lines, closer together, so that there is something to merge."""
    x = lines(spark, sf_dir)
    n = F.ceil(F.length("text") / 40).cast("int")
    each = x.select("video_id", "index", "start", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), "text").withColumn("text", T.strip(F.substring("text", F.col("k") * 40 + 1, F.lit(40)))).where("text <> ''")
    return each.select("video_id", (F.col("index") * 1000 + F.col("k")).alias("index"), (F.col("start") + F.col("k") * 3).alias("start"), (F.col("start") + F.col("k") * 3 + 2.5).alias("end"), "text")


_CUT = f"""cut AS (SELECT video_id, index, start, "end", text, row_number() OVER (PARTITION BY video_id ORDER BY start, "end", index) AS i FROM (
  SELECT video_id, index * 1000 + k AS index, start + k * 3 AS start, start + k * 3 + 2.5 AS "end", {D.strip('substr(text, k * 40 + 1, 40)')} AS text
  FROM (SELECT *, unnest(range(0, ceil(length(text) / 40)::INT)) AS k FROM lines)) WHERE text <> '')"""


@query("fold_merge", f"""WITH RECURSIVE {LINES}, {_CUT}, {D.merged('cut')} SELECT video_id, index, round(start, 6) AS start, round("end", 6) AS "end", text FROM merged""")
def fold_merge(spark, sf_dir):
    return _round(cues.merge_cues(_cut_lines(spark, sf_dir)), "start", "end")


def _spoken_words(spark, sf_dir, kind=None):
    """Events as words of segments of a few hundred, some with punctuation, with pauses of 0.2 or 2.5 s."""
    k = F.col("word_no")
    start = k * 0.7 + F.floor(k / 13) * 2
    text = F.concat(F.lit(" "), "text", F.when(k % 11 == 3, ",").when(k % 17 == 5, ".").otherwise(""))
    return words(spark, sf_dir, kind).select("video_id", F.floor(k / 500).alias("seg_no"), "word_no", start.alias("start"), (start + 0.5).alias("end"), text.alias("text"))


_SPOKEN = """spoken AS (SELECT video_id, word_no // 500 AS seg_no, word_no, word_no * 0.7::DOUBLE + word_no // 13 * 2 AS start,
  word_no * 0.7::DOUBLE + word_no // 13 * 2 + 0.5::DOUBLE AS "end",
  ' ' || text || CASE WHEN word_no % 11 = 3 THEN ',' WHEN word_no % 17 = 5 THEN '.' ELSE '' END AS text FROM words)"""


@query("fold_words", f"WITH RECURSIVE {WORDS}, {_SPOKEN}, {D.word_cues('spoken')} SELECT * FROM word_cues")
def fold_words(spark, sf_dir):
    return cues.cues_from_words(_spoken_words(spark, sf_dir))


def _bare(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", F.col("index").cast("long").alias("seg_no"), "start", "end", "text")


_BARE = """bare AS (SELECT video_id, index::BIGINT AS seg_no, start, "end", text FROM lines)"""


@query("fold_split_text", f"WITH RECURSIVE {LINES}, {_BARE}, {D.text_cues('bare')} SELECT * FROM text_cues")
def fold_split_text(spark, sf_dir):
    return cues.cues_from_text(_bare(spark, sf_dir))


@query("segment_cues", f"""WITH RECURSIVE {LINES}, {WORDS}, {_SPOKEN}, click AS (SELECT * FROM spoken WHERE text LIKE ' click%'), {_BARE},
  {D.word_cues('click')}, {D.text_cues('bare')},
both_ AS (SELECT * FROM word_cues UNION ALL SELECT * FROM text_cues), sorted AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start,
  "end", seg_no, cue_no) AS i FROM both_), {D.merged('sorted')}
SELECT video_id, index, CASE WHEN start < p THEN round_even(least(p, "end" - 0.05), 3) ELSE start END AS start, "end", text FROM (SELECT *,
  lag("end") OVER (PARTITION BY video_id ORDER BY index) AS p FROM merged)""")
def segment_cues(spark, sf_dir):
    return cues.segment(_spoken_words(spark, sf_dir, "click"), _bare(spark, sf_dir))


@query("fold_give_up", """WITH c AS (SELECT user_id AS video_id, event_id AS chunk_id, value < 250 AS failed FROM events), r AS (SELECT *,
  sum((NOT failed)::INT) OVER (PARTITION BY video_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
s AS (SELECT *, sum(failed::INT) OVER (PARTITION BY video_id, run ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS streak FROM r)
SELECT video_id, chunk_id, failed, coalesce(max((streak >= 3)::INT) OVER (PARTITION BY video_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING) = 1, false) AS skipped FROM s""")
def fold_give_up(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("chunk_id"), (F.col("value") < 250).alias("failed"))
    return verify.give_up(e, 3)


# --- replies and verification


def _units(lines_):
    """A reply that groups lines in pairs, with every seventh pair left out."""
    films = lines_.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("index", "text"))).alias("l"))

    def unit(pair):
        a, b = F.get("l", 2 * pair), F.get("l", 2 * pair + 1)
        last = F.coalesce(b["index"], a["index"])
        return F.concat(F.lit("["), a["index"].cast("string"), F.lit("-"), last.cast("string"), F.lit("] "), F.concat_ws(" ", a["text"], b["text"]))

    pairs = F.filter(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 2).cast("int")), lambda k: (k % 7 != 6) | (F.col("video_id") % 2 == 0))
    reply = F.concat(F.lit("```\n"), F.array_join(F.transform(pairs, unit), "\n"), F.lit("\n```"))
    return films.select("video_id", F.lit(0).alias("chunk_id"), reply.alias("reply"))


_UNITS = f"""{LINES}, pairs AS (SELECT video_id, (index - 1) // 2 AS pair, min(index)::INT AS first, max(index)::INT AS last, string_agg(text, ' '
  ORDER BY index) AS text FROM lines GROUP BY ALL),
units AS (SELECT video_id, 0 AS chunk_id, row_number() OVER (PARTITION BY video_id ORDER BY pair) AS unit_no, first, last, text FROM pairs
  WHERE pair % 7 <> 6 OR video_id % 2 = 0)"""


@query("parse_units", f"WITH {_UNITS} SELECT video_id, chunk_id, unit_no::BIGINT AS unit_no, first, last, text FROM units")
def parse_units(spark, sf_dir):
    return replies.parse_units(_units(lines(spark, sf_dir)))


@query("ver_coverage", f"""WITH {_UNITS}, l AS (SELECT video_id, max(index) AS n FROM lines GROUP BY video_id), u AS (SELECT *, lag(last)
  OVER (PARTITION BY video_id ORDER BY unit_no) AS p FROM units)
SELECT l.video_id, 0 AS chunk_id, coalesce(bool_and(last >= first AND (p IS NULL OR first = p + 1)) AND min(first) = 1 AND max(last) = any_value(n),
  false) AS covers FROM l LEFT JOIN u USING (video_id) GROUP BY l.video_id""")
def ver_coverage(spark, sf_dir):
    whole = lines(spark, sf_dir).groupBy("video_id").agg(F.lit(0).alias("chunk_id"), F.lit(1).alias("first_index"), F.max("index").alias("last_index"))
    return verify.covers_exactly(parse_units(spark, sf_dir), whole)


@query("join_units", f"WITH {_UNITS} SELECT u.video_id, unit_no::BIGINT AS unit_no, index, l.text AS line_text FROM units u JOIN lines l ON u.video_id = l.video_id AND l.index BETWEEN u.first AND u.last")
def join_units(spark, sf_dir):
    return replies.lines_of(parse_units(spark, sf_dir), lines(spark, sf_dir)).select("video_id", "unit_no", "index", "line_text")


_JUDGED = f"""{_UNITS}, g AS (SELECT video_id, lead(start) OVER (PARTITION BY video_id ORDER BY index) - "end" AS gap FROM lines),
  gl AS (SELECT video_id, list_sort(list(gap) FILTER (WHERE gap > 0)) AS l FROM g GROUP BY video_id),
lim AS (SELECT video_id, CASE WHEN l IS NULL OR len(l) = 0 THEN 1.2 ELSE least(greatest(l[least(floor(len(l) * 0.40)::BIGINT, len(l) - 1) + 1], 1.2),
  2.5) END AS gap_limit FROM gl),
src AS (SELECT u.video_id, u.unit_no, u.first, u.last, u.text, l.index, l.start, l."end", l.text AS lt, {D.is_fragment('l.text')} AS frag,
  lag(l."end") OVER w AS pe, lag({D.is_fragment('l.text')}) OVER w AS pf,
  CASE WHEN {D.is_single_sentence('u.text')} THEN greatest(gap_limit, 6.0) ELSE gap_limit END AS lim FROM units u JOIN lines l
    ON u.video_id = l.video_id AND l.index BETWEEN u.first AND u.last JOIN lim ON u.video_id = lim.video_id
  WINDOW w AS (PARTITION BY u.video_id, u.unit_no ORDER BY l.index)),
un AS (SELECT video_id, unit_no, first, last, text, count(*) AS n, coalesce(bool_or(start - pe > lim AND NOT frag AND NOT pf), false) AS far,
  bool_or(frag) AS any_frag, min(start) AS s, max("end") AS e, arg_min(frag, index) AS hf, arg_max(frag, index) AS tf,
  list_reduce(list(lt ORDER BY index), lambda a, b: {D.join_text('a', 'b')}) AS joined FROM src GROUP BY ALL),
fa AS (SELECT *, {D.words('text')} AS cw, {D.words('joined')} AS sw FROM un),
fb AS (SELECT *, {D.bag_kept('cw', 'sw')} AS kept FROM fa),
judged AS (SELECT *, CASE WHEN NOT (len(sw) = 0 OR (kept >= 0.6 * len(sw) AND len(cw) - kept <= greatest(2, 0.25 * len(cw)))) THEN 'fidelity'
  WHEN n > 1 AND far THEN 'pause'
  WHEN n > 1 AND length(text) > CASE WHEN any_frag THEN 126 ELSE 84 END THEN 'width' WHEN n > 1 AND e - s > 7.0 AND NOT hf AND NOT tf THEN 'span'
    ELSE '' END AS reason FROM fb)"""


def _judged(spark, sf_dir):
    x = lines(spark, sf_dir).select("video_id", "index", "start", "end", "text")
    return verify.judge_units(replies.parse_units(_units(x)), x, cues.gap_limit(x))


@query("ver_apply_units", f"""WITH {_JUDGED} SELECT video_id, first, round_even(CASE WHEN n > 1 AND e - s > 7.0 AND hf THEN e - 7.0 ELSE s END,
  3) AS start, round_even(CASE WHEN n > 1 AND e - s > 7.0 AND NOT hf THEN s + 7.0 ELSE e END, 3) AS "end", text, true AS accepted FROM judged
  WHERE reason = ''
UNION ALL SELECT src.video_id, index, start, "end", lt, false FROM src JOIN judged USING (video_id, unit_no) WHERE reason <> ''""")
def ver_apply_units(spark, sf_dir):
    x = lines(spark, sf_dir).select("video_id", "index", "start", "end", "text")
    return verify.apply_units(replies.parse_units(_units(x)), x, cues.gap_limit(x))


@query("agg_refine_counters", f"WITH {_JUDGED} SELECT video_id, sum(CASE WHEN reason = '' THEN n - 1 ELSE 0 END)::BIGINT AS merged, count(*) FILTER (WHERE reason = '' AND text <> joined) AS corrected, count(*) FILTER (WHERE reason <> '') AS rejected FROM judged GROUP BY video_id")
def agg_refine_counters(spark, sf_dir):
    return verify.refine_counters(_judged(spark, sf_dir))


@query("ver_rejections", f"WITH {_JUDGED} SELECT video_id, first, last, reason, text FROM judged WHERE reason <> ''")
def ver_rejections(spark, sf_dir):
    return verify.rejections(_judged(spark, sf_dir))


_T = f"{TURNS}, said AS (SELECT video_id, index, {D.strip('''regexp_replace(translation, '[\\s]+', ' ', 'g')''')} AS t FROM turns)"


def _translated(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("t", T.strip(F.regexp_replace("translation", r"[\s]+", " ")))
    row = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), "t")
    return t.where("(index + video_id) % 5 <> 4 and t <> ''").groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", row.alias("r")))), lambda x: x["r"]), "\n").alias("reply")).withColumn("chunk_id", F.lit(0))


@query("join_translations", f"WITH {_T} SELECT video_id, index, CASE WHEN (index + video_id) % 5 <> 4 AND t <> '' THEN t ELSE '' END AS translation FROM said")
def join_translations(spark, sf_dir):
    parsed = replies.parse_translations(_translated(spark, sf_dir))
    return replies.apply_translations(turns(spark, sf_dir).withColumn("translation", F.lit("")), parsed).select("video_id", "index", "translation")


@query("ver_missing", f"WITH {_T} SELECT video_id, index FROM said WHERE NOT ((index + video_id) % 5 <> 4 AND t <> '')")
def ver_missing(spark, sf_dir):
    return verify.missing_translations(turns(spark, sf_dir), replies.parse_translations(_translated(spark, sf_dir))).select("video_id", "index")


@query("join_verdicts", "SELECT conv_id AS video_id, turn AS pos FROM conversations WHERE role <> 'assistant' OR turn % 3 <> 0")
def join_verdicts(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("pos"), "text", (F.col("role") == "assistant").alias("recovered"))
    numbered = cues.review_numbers(c)
    r = numbered.where("recovered").withColumn("row", F.concat(F.lit("[R"), F.col("number").cast("string"), F.when(F.col("pos") % 3 == 0, "] drop: odd").otherwise("] keep")))
    reply = r.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "row"))), lambda x: x["row"]), "\n").alias("reply")).withColumn("chunk_id", F.lit(0))
    return replies.apply_verdicts(numbered, replies.parse_verdicts(reply)).select("video_id", "pos")


@query("ver_lyrics", f"""WITH {LINES}, n AS (SELECT video_id, count(*) AS total FROM lines GROUP BY ALL), r AS (SELECT video_id, index AS first,
  index + index % 4 - 1 AS last, total FROM lines JOIN n USING (video_id) WHERE index % 6 = 1 OR index % 6 = 4)
SELECT video_id, first::INT AS first, last::INT AS last, CASE WHEN last < first THEN 'inverted' WHEN last > total THEN 'out of range'
  WHEN last - first + 1 > greatest(60, total // 5) THEN 'too long' ELSE '' END AS reason FROM r""")
def ver_lyrics(spark, sf_dir):
    x = lines(spark, sf_dir)
    r = x.where("index % 6 in (1, 4)").select("video_id", F.col("index").alias("first"), (F.col("index") + F.col("index") % 4 - 1).alias("last"), F.col("text").alias("head"))
    tail = x.select("video_id", F.col("index").alias("last"), F.col("text").alias("tail"))
    r = r.join(tail, ["video_id", "last"], "left").withColumn("tail", F.coalesce("tail", F.lit("")))
    return verify.verify_ranges(r, x).select("video_id", "first", "last", "reason")


@query("fold_ranges", """WITH RECURSIVE r AS (SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id
  ORDER BY event_id)::INT AS range_no, (event_id % 97 + 1)::INT AS first, (event_id % 97 + 1 + event_id % 5)::INT AS last FROM events),
f AS (SELECT video_id, 0 AS range_no, 0 AS first, 0 AS last, false AS ok FROM r WHERE range_no = 1
  UNION ALL SELECT r.video_id, r.range_no, r.first, CASE WHEN r.first > f.last THEN r.last ELSE f.last END, r.first > f.last FROM f JOIN r
    ON r.video_id = f.video_id AND r.range_no = f.range_no + 1)
SELECT video_id, range_no, first, last FROM f WHERE ok""")
def fold_ranges(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    r = e.select(F.col("user_id").alias("video_id"), F.lit(0).alias("chunk_id"), n.alias("range_no"), (F.col("event_id") % 97 + 1).cast("int").alias("first"), (F.col("event_id") % 97 + 1 + F.col("event_id") % 5).cast("int").alias("last"), F.lit("").alias("reason"))
    return verify.accept_ranges(r).drop("chunk_id")


_R = """r AS (SELECT conv_id AS video_id, turn AS pos, role = 'assistant' AS recovered, row_number() OVER (PARTITION BY conv_id, role = 'assistant'
  ORDER BY turn)::INT AS n FROM conversations),
asked AS (SELECT video_id, (pos // 4)::INT AS chunk_id, n FROM r WHERE recovered), got AS (SELECT video_id, chunk_id, n FROM asked WHERE n % 5 <> 0 OR video_id % 2 = 0),
met AS (SELECT video_id, chunk_id, count(*) = count(g.n) AS covers FROM asked a LEFT JOIN got g USING (video_id, chunk_id, n) GROUP BY ALL)"""


def _review(spark, sf_dir):
    """Assistant turns as recovered segments in chunks of four turns, and a reply that leaves some numbers out."""
    c = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("pos"), "text", (F.col("role") == "assistant").alias("recovered"))
    numbered = cues.review_numbers(c)
    asked = numbered.where("recovered").select("video_id", F.floor(F.col("pos") / 4).cast("int").alias("chunk_id"), F.col("number").cast("int").alias("n"))
    got = asked.where("n % 5 <> 0 or video_id % 2 = 0").withColumns({"keep": F.col("n") % 3 != 0, "reason": F.lit("")})
    return numbered, asked, got


@query("ver_same_keys", f"WITH {_R} SELECT * FROM met")
def ver_same_keys(spark, sf_dir):
    _, asked, got = _review(spark, sf_dir)
    return verify.same_keys(got, asked)


@query("ver_vetted", f"WITH {_R} SELECT r.video_id, r.pos FROM r LEFT JOIN got g ON r.recovered AND r.video_id = g.video_id AND r.n = g.n LEFT JOIN met m ON g.video_id = m.video_id AND g.chunk_id = m.chunk_id WHERE NOT r.recovered OR (m.covers AND g.n % 3 <> 0)")
def ver_vetted(spark, sf_dir):
    numbered, asked, got = _review(spark, sf_dir)
    return verify.vetted(numbered, got, asked).select("video_id", "pos")


@query("ver_alignment", f"""WITH {TURNS}, t AS (SELECT index AS k, video_id % 3 AS g, length(text) AS a, length(translation) AS b1,
  length(translation) + 3 * length(text) AS b2 FROM turns WHERE translation <> ''),
r AS (SELECT k, g, CASE WHEN count(*) >= 20 AND stddev_pop(a) * stddev_pop(b1) > 0 THEN covar_pop(a,
  b1) / (stddev_pop(a) * stddev_pop(b1)) END AS r1, CASE WHEN count(*) >= 20 AND stddev_pop(a) * stddev_pop(b2) > 0 THEN covar_pop(a,
  b2) / (stddev_pop(a) * stddev_pop(b2)) END AS r2 FROM t GROUP BY ALL)
SELECT k AS index, g::BIGINT AS grp, CASE WHEN coalesce(r2 > r1, false) THEN 2 ELSE 1 END AS attempt, coalesce(r1 >= 0.45, true) AS aligned FROM r""")
def ver_alignment(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("grp", (F.col("video_id") % 3).cast("long"))
    better = t.withColumn("translation", F.when(F.col("translation") != "", F.concat("translation", F.repeat("text", F.lit(3)))).otherwise(""))
    r = [metrics.length_correlation(x, "index", "grp").withColumn("attempt", F.lit(k)) for k, x in ((1, t), (2, better))]
    return metrics.better_attempt(r[0].unionByName(r[1]), "index", "grp")


@query("join_disagreement", f"""WITH {WORDS}, {_SPEECH} SELECT * FROM (SELECT video_id, word_no AS index, word_no % 2 = 0 AS is_lyric,
  EXISTS (SELECT 1 FROM speech b WHERE a.video_id = b.video_id AND least(a."end", b."end") - greatest(a.start, b.start) > 0.2) AS touched
    FROM words a) WHERE is_lyric <> touched""")
def join_disagreement(spark, sf_dir):
    x = words(spark, sf_dir).select("video_id", F.col("word_no").alias("index"), "start", "end", (F.col("word_no") % 2 == 0).alias("is_lyric"))
    return intervals.disagreement(x, _speech(spark, sf_dir)).select("video_id", "index", "is_lyric", "touched")


@query("win_progress", """WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id AS seq, value / 500 AS progress, row_number()
  OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT job_id, i, seq, progress, progress AS last, true AS said FROM e WHERE i = 1
  UNION ALL SELECT e.job_id, e.i, e.seq, e.progress, CASE WHEN e.progress - f.last >= 0.05 THEN e.progress ELSE f.last END,
    e.progress - f.last >= 0.05 FROM f JOIN e ON e.job_id = f.job_id AND e.i = f.i + 1)
SELECT job_id, seq, progress FROM f WHERE said""")
def win_progress(spark, sf_dir):
    return cues.progress_logged(_events(spark, sf_dir))


@query("win_stalls", """WITH e AS (SELECT user_id AS job_id, event_id AS seq, event_id * 7.0 AS ts, event_id // 400 AS done FROM events),
  c AS (SELECT *, lag(done) OVER (PARTITION BY job_id ORDER BY seq) AS p FROM e),
s AS (SELECT *, ts - max(CASE WHEN p IS NULL OR p <> done THEN ts END) OVER (PARTITION BY job_id ORDER BY seq) AS stalled FROM c), t AS (SELECT *,
  floor(stalled / 60) AS k FROM s)
SELECT job_id, seq, stalled, k > 0 AND k > coalesce(CASE WHEN p IS NULL OR p <> done THEN 0 ELSE lag(k) OVER (PARTITION BY job_id ORDER BY seq) END, 0) AS warn FROM t""")
def win_stalls(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 7.0).alias("ts"), F.floor(F.col("event_id") / 400).alias("done"))
    return cues.stalls(e).select("job_id", "seq", "stalled", "warn")


# --- glossary, media, files, jobs


def terms(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("batch_id"), F.floor(F.col("event_id") / 1000).alias("episode_no"), "event_id", F.concat(F.lit("- "), "event_type", F.lit("-"), (F.col("event_id") % 11).cast("string"), F.lit(" → v"), (F.col("event_id") % 7).cast("string")).alias("row"))
    r = e.groupBy("batch_id", "episode_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "row"))), lambda x: x["row"]), "\n").alias("reply"))
    return glossary.terms_of(r)


TERMS = """t AS (SELECT user_id % 5 AS batch_id, event_id // 1000 AS episode_no, event_id, event_type || '-' || (event_id % 11)::VARCHAR AS source,
  'v' || (event_id % 7)::VARCHAR AS target FROM events),
learned AS (SELECT batch_id, source, target, n FROM (SELECT batch_id, source, arg_min(target, event_id) AS target, row_number()
  OVER (PARTITION BY batch_id ORDER BY min(event_id))::INT AS n FROM t GROUP BY batch_id, source) WHERE n <= 40)"""


@query("glossary_first_wins", f"WITH {TERMS} SELECT * FROM learned")
def glossary_first_wins(spark, sf_dir):
    return glossary.learn(terms(spark, sf_dir), 40)


@query("glossary_clashes", f"WITH {TERMS} SELECT batch_id, source, settled, target, count(*) AS n FROM (SELECT t.batch_id, t.source, l.target AS settled, t.target FROM t JOIN learned l USING (batch_id, source) WHERE t.target <> l.target) GROUP BY ALL")
def glossary_clashes(spark, sf_dir):
    t = terms(spark, sf_dir)
    return glossary.clashes(t, glossary.learn(t, 40)).groupBy("batch_id", "source", "settled", "target").agg(F.count(F.lit(1)).alias("n"))


@query("glossary_anti", f"WITH {TERMS} SELECT batch_id, source, count(*) AS n FROM t WHERE source NOT LIKE 'click-%' GROUP BY ALL")
def glossary_anti(spark, sf_dir):
    t = terms(spark, sf_dir)
    own = t.where(F.col("source").like("click-%")).select("source").distinct()
    return glossary.unprotected(t, own).groupBy("batch_id", "source").agg(F.count(F.lit(1)).alias("n"))


@query("join_language", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fre' WHEN 'de' THEN 'ger' WHEN 'es' THEN 'spa' ELSE lang END AS code FROM documents")
def join_language(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", media.canon_language(F.col("lang")).alias("code"))


@query("join_targets", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'zh' WHEN 1 THEN 'ko' WHEN 2 THEN 'de' WHEN 3 THEN 'en'
  ELSE 'sub' END AS suffix, CASE o_orderkey % 5 WHEN 0 THEN 'chi' WHEN 1 THEN 'kor' WHEN 2 THEN 'ger' WHEN 3 THEN 'eng' ELSE 'und' END AS code
  FROM orders""")
def join_targets(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("简体中文", "한국어", " Deutsch ", "English", "Klingon"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", media.target_track(name).alias("t")).select("o_orderkey", "t.*")


@query("out_names", """WITH t AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_linenumber END AS n FROM lineitem WHERE l_partkey % 3 <> 0)
SELECT 'film' || o_orderkey AS stem, 'zh' AS suffix, 'film' || o_orderkey || '.zh' || CASE WHEN n = 1 THEN '' ELSE '.' || n END || '.mkv' AS path
FROM (SELECT o_orderkey, (SELECT min(i) FROM range(1, 20) r(i) WHERE i NOT IN (SELECT n FROM t WHERE k = o_orderkey)) AS n FROM orders)""")
def out_names(spark, sf_dir):
    stem = lambda c: F.concat(F.lit("film"), F.col(c).cast("string"))
    n = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string"))
    taken = read_table(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0").select(F.concat_ws(".", stem("l_orderkey"), F.lit("zh"), n, F.lit("mkv")).alias("path"))
    return media.output_name(read_table(spark, sf_dir, "orders").select(stem("o_orderkey").alias("stem"), F.lit("zh").alias("suffix")), taken)


_FILES = """f AS (SELECT regexp_replace(url, '/+$', '') || CASE page_id % 3 WHEN 0 THEN '.mkv' WHEN 1 THEN '.MP4' ELSE '.txt' END AS path, page_id
  FROM pages UNION ALL SELECT regexp_replace(url, '/+$', '') || '.srt', page_id FROM pages WHERE page_id % 2 = 0)"""


@query("scan_split", f"""WITH {_FILES}, p AS (SELECT path, regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 1) AS stem, lower(regexp_extract(path,
  '(\\.[^./]*)$', 1)) AS ext FROM f)
SELECT path, stem IN (SELECT stem FROM p WHERE ext = '.srt') AS has_subtitle FROM p WHERE ext IN ('.mkv', '.mp4') AND NOT regexp_matches(path, '(^|/)\\.[^/]')""")
def scan_split(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    base = F.regexp_replace("url", "/+$", "")
    ext = F.when(F.col("page_id") % 3 == 0, ".mkv").when(F.col("page_id") % 3 == 1, ".MP4").otherwise(".txt")
    return media.scan_videos(p.select(F.concat(base, ext).alias("path")).unionByName(p.where("page_id % 2 = 0").select(F.concat(base, F.lit(".srt")).alias("path"))))


@query("top_pick_track", """WITH t AS (SELECT l_orderkey AS video_id, l_linenumber::INT AS index, CASE l_suppkey % 3 WHEN 0 THEN 'eng'
  WHEN 1 THEN 'jpn' ELSE 'fre' END AS language, l_linenumber = 2 AS d,
  CASE WHEN l_orderkey % 4 = 0 THEN 3 END AS wi, CASE WHEN l_orderkey % 3 = 0 THEN 'jpn' ELSE '' END AS wl FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN index = wi THEN 0 WHEN wl <> '' AND language = wl THEN 1 WHEN d THEN 2
  ELSE 3 END, index, language) AS r FROM t) SELECT video_id, index, language FROM r WHERE r = 1""")
def top_pick_track(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    lang = F.when(F.col("l_suppkey") % 3 == 0, "eng").when(F.col("l_suppkey") % 3 == 1, "jpn").otherwise("fre")
    t = li.select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").cast("int").alias("index"), lang.alias("language"), (F.col("l_linenumber") == 2).alias("default"))
    want = li.select(F.col("l_orderkey").alias("video_id")).distinct().withColumns({"want_index": F.when(F.col("video_id") % 4 == 0, 3), "want_language": F.when(F.col("video_id") % 3 == 0, "ja").otherwise("")})
    return media.pick_track(t, want).select("video_id", "index", "language")


@query("top_newest_logs", "SELECT user_id AS job_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def top_newest_logs(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("name"), F.col("ts").alias("mtime"))
    return media.newest(e).select("job_id", F.col("name").alias("event_id"))


def film_lines(spark, sf_dir):
    return lines(spark, sf_dir).withColumn("translation", F.when(F.col("index") % 4 == 0, "").otherwise(F.concat(F.lit("T: "), "text")))


_FILM = f"""{LINES}, film0 AS (SELECT video_id, index, start, "end", text, CASE WHEN index % 4 = 0 THEN text ELSE 'T: ' || text END AS tr
  FROM lines), wt AS ({D.wrap('film0', 'text')}), wr AS ({D.wrap('film0', 'tr')}),
film AS (SELECT video_id, index, start, "end", wt.wrapped AS text, wr.wrapped AS tr, row_number() OVER (PARTITION BY video_id ORDER BY start,
  index) AS n FROM film0 JOIN wt USING (video_id, index) JOIN wr USING (video_id, index))"""
_SRT_SPAN = f"""{D.clock('start', 1000, '%02d:%02d:%02d,%03d')} || ' --> ' || {D.clock('"end"', 1000, '%02d:%02d:%02d,%03d')}"""
_ASS_SPAN = f"""'Dialogue: 0,' || {D.clock('start', 100, '%d:%02d:%02d.%02d')} || ',' || {D.clock('"end"', 100, '%d:%02d:%02d.%02d')} || ',Default,,0,0,0,,'"""
_ASS_TEXT = """replace(replace(replace({0}, '{{', '（'), '}}', '）'), chr(10), '\\N')"""
_ASS_ROW = f"""{_ASS_SPAN} || '{{\\fs40\\c&H00C0C0C0&}}' || {_ASS_TEXT.format('text')} || '{{\\r}}\\N' || {_ASS_TEXT.format('tr')}"""


@query("sink_srt", f"""WITH {_FILM} SELECT video_id, md5(string_agg(n::VARCHAR || chr(10) || {_SRT_SPAN} || chr(10) || text || chr(10) || tr || chr(10), chr(10) ORDER BY n)) AS digest FROM film GROUP BY video_id""")
def sink_srt(spark, sf_dir):
    return subtitles.files_of(subtitles.srt_blocks(film_lines(spark, sf_dir))).select("video_id", F.md5("text").alias("digest"))


@query("sink_ass", f"""WITH {_FILM} SELECT video_id, md5(string_agg({_ASS_ROW}, chr(10) ORDER BY n)) AS digest FROM film GROUP BY video_id""")
def sink_ass(spark, sf_dir):
    return subtitles.files_of(subtitles.ass_events(film_lines(spark, sf_dir))).select("video_id", F.md5("text").alias("digest"))


@query("read_srt", f"""WITH {_FILM} SELECT video_id, (n - 1)::INT AS pos, round(start, 3) AS start, round("end", 3) AS "end", text || chr(10) || tr AS body FROM film""")
def read_srt(spark, sf_dir):
    files = subtitles.files_of(subtitles.srt_blocks(film_lines(spark, sf_dir)))
    return subtitles.parse_srt(files, "video_id").select("video_id", "pos", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "body")


def _read_back(unit: int) -> str:
    """The start as a reader takes it from the text, from a number of units."""
    n = f"round_even(greatest(start, 0.0) * {unit}, 0)::BIGINT"
    return f"(({n} // {3600 * unit} * 3600 + {n} // {60 * unit} % 60 * 60 + {n} // {unit} % 60)::DOUBLE + ({n} % {unit})::DOUBLE / {unit})"


_SIGNS = """signs AS (SELECT video_id, index, start + 0.5 AS start, "end" FROM film WHERE index % 5 = 0)"""


def _signs(film):
    return film.where("index % 5 = 0").select("video_id", (F.col("start") + 0.5).alias("start"), "end", F.lit("SIGN").alias("text"))


@query("sink_insert_srt", f"""WITH {_FILM}, {_SIGNS}, b AS (SELECT video_id, {_read_back(1000)} AS began, 0 AS src, n AS pos,
  {_SRT_SPAN} || chr(10) || text || chr(10) || tr AS body FROM film
  UNION ALL SELECT video_id, start, 1, row_number() OVER (PARTITION BY video_id ORDER BY start, "end"), {_SRT_SPAN} || chr(10) || '{{\\an7}}SIGN' FROM signs),
c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY began, src, pos) AS n FROM b) SELECT video_id,
  string_agg(n::VARCHAR || chr(10) || body || chr(10), chr(10) ORDER BY n) AS text FROM c GROUP BY video_id""")
def sink_insert_srt(spark, sf_dir):
    film = film_lines(spark, sf_dir)
    return subtitles.insert_srt(subtitles.files_of(subtitles.srt_blocks(film)), _signs(film))


_HEAD = subtitles.ass_head().rstrip("\n")


@query("sink_insert_ass", f"""WITH {_FILM}, {_SIGNS}, d AS (SELECT video_id, {_read_back(100)} AS began, n, {_ASS_ROW} AS line FROM film),
s AS (SELECT video_id, start, "end", {_ASS_SPAN} || '{{\\an7}}SIGN' AS line, row_number() OVER (PARTITION BY video_id ORDER BY start, "end") AS k FROM signs),
p AS (SELECT s.video_id, s.k, any_value(s.start) AS start, any_value(s.line) AS line, coalesce(min(d.n) FILTER (WHERE d.began > s.start),
  max(d.n) + 1) AS n FROM s JOIN d USING (video_id) GROUP BY s.video_id, s.k),
a AS (SELECT video_id, n, 1 AS src, 0.0 AS start, 0 AS k, line FROM d UNION ALL SELECT video_id, n, 0, start, k, line FROM p)
SELECT video_id, '{_HEAD}' || chr(10) || string_agg(line, chr(10) ORDER BY n, src, start, k) || chr(10) AS text FROM a GROUP BY video_id""")
def sink_insert_ass(spark, sf_dir):
    film = film_lines(spark, sf_dir)
    return subtitles.insert_ass(subtitles.files_of(subtitles.ass_events(film), head=subtitles.ass_head(), end="\n"), _signs(film))


def _events(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), (F.col("value") / 500).alias("progress"))


_STATUS = "SELECT user_id AS job_id, max(event_id) AS seq, arg_max(event_type, event_id) AS stage, arg_max(value / 500, event_id) AS progress, count(*) AS n_events FROM events GROUP BY user_id"


@query("job_status", _STATUS)
def job_status(spark, sf_dir):
    return jobs.status(_events(spark, sf_dir))


@query("stream_status", _STATUS)
def stream_status(spark, sf_dir):
    schema = read_table(spark, sf_dir, "events").schema
    e = jobs.replay_then_tail(spark, f"{sf_dir}/[e]vents.parquet", schema)  # a pattern: the table may be one file
    e = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), (F.col("value") / 500).alias("progress"))
    return jobs.run_once(jobs.status(e), "stream_status")


@query("job_overall", """SELECT event_id AS seq, round(CASE s WHEN 0 THEN 0.0 + 10.0 * p WHEN 1 THEN 10.0 + 50.0 * p WHEN 2 THEN 100.0 END,
  6) AS overall FROM (SELECT event_id, event_id % 4 AS s, least(greatest(value / 400, 0), 1) AS p FROM events)""")
def job_overall(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    stage = F.element_at(F.array(*map(F.lit, ("extracting", "transcribing", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("seq"), F.round(jobs.overall(stage, F.col("value") / 400), 6).alias("overall"))


@query("agg_batch_status", """WITH j AS (SELECT user_id % 7 AS batch_id, user_id AS job_id, max(event_id) AS seq, arg_max(CASE event_type
  WHEN 'click' THEN 'done' WHEN 'view' THEN 'failed' WHEN 'purchase' THEN 'pending' ELSE event_type END, event_id) AS stage FROM events GROUP BY ALL)
SELECT batch_id, count(*) FILTER (WHERE stage = 'done') AS done, count(*) FILTER (WHERE stage = 'failed') AS failed,
  count(*) FILTER (WHERE stage = 'cancelled') AS cancelled, count(*) FILTER (WHERE stage = 'pending') AS pending,
  count(*) FILTER (WHERE stage NOT IN ('done', 'failed', 'cancelled', 'pending')) AS running, arg_max(job_id,
    seq) FILTER (WHERE stage NOT IN ('done', 'failed', 'cancelled', 'pending')) AS current FROM j GROUP BY batch_id""")
def agg_batch_status(spark, sf_dir):
    s = jobs.status(_events(spark, sf_dir))
    stage = F.when(F.col("stage") == "click", "done").when(F.col("stage") == "view", "failed").when(F.col("stage") == "purchase", "pending").otherwise(F.col("stage"))
    return metrics.batch_status(s.select((F.col("job_id") % 7).alias("batch_id"), "job_id", "seq", stage.alias("stage")))


@query("agg_recovered_stats", f"""WITH {LINES} SELECT index % 3 = 0 AS recovered, count(*) AS n, round(sum("end" - start), 3) AS seconds,
  round(avg((index % 2)::DOUBLE), 9) AS song_share FROM lines GROUP BY 1""")
def agg_recovered_stats(spark, sf_dir):
    x = lines(spark, sf_dir).select("start", "end", (F.col("index") % 3 == 0).alias("recovered"), T.apply_marks(F.col("text"), F.col("index") % 2 == 1).alias("text"))
    return metrics.recovered_stats(x).select("recovered", "n", F.round("seconds", 3).alias("seconds"), F.round("song_share", 9).alias("song_share"))


@query("agg_blank_share", f"""WITH {LINES} SELECT lang, round(avg(CASE WHEN index % 4 = 0 OR NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 1.0
  ELSE 0.0 END), 9) AS blank_share, avg(CASE WHEN index % 4 = 0 OR NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 1.0
  ELSE 0.0 END) >= 0.3 AS warn FROM lines GROUP BY lang""")
def agg_blank_share(spark, sf_dir):
    x = lines(spark, sf_dir).select("lang", F.when(F.col("index") % 4 == 0, "...").otherwise(F.col("text")).alias("text"))
    return metrics.blank_share(x, "lang").select("lang", F.round("blank_share", 9).alias("blank_share"), "warn")
