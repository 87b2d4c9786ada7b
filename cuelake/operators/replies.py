"""Model replies (video_id, chunk_id, reply) to rows, and their application to lines.

A reply is exploded into its lines with their order; a regular expression takes a line apart, and a line
that does not match continues the entry before it (a running count of matches numbers the entries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake import constants as C
from cuelake.functions import text as T

# The line formats that replies are asked to keep to.
FENCE = r"^```[a-zA-Z]*\s*$"
UNIT_HEAD = r"^\s*\[(\d+)(?:\s*[-–~]\s*(\d+))?\]"
UNIT = rf"{UNIT_HEAD}\s*(.*\S)\s*$"
TRANSLATION = r"^\s*\[?(\d+)\]?[.、:：]?\s*(.*\S)\s*$"
VERDICT = r"(?i)^\s*[*\-•]?\s*\[?\s*R\s*(\d+)\s*\]?\s*[:：]?\s*(保留|丢弃|keep|drop)\s*[:：,，]?\s*(.*?)\s*$"
RANGE = r"^\s*[*\-•]?\s*\[\s*(\d+)\s*(?:[-–~]\s*(\d+)\s*)?\]\s*(.*?)\s*$"
BULLET = r"^(?:[-*+•·]|\d+[.)、])\s*"
ARROW = r"\s*(?:→|⇒|->|=>)\s*"
EDGE = r"""[ \t*`_“”"'（）()]"""
TEMPLATE_SOURCES = ("原文", "原词", "术语", "原文/术语", "source", "term")
TEMPLATE_TARGETS = ("译名", "译文", "翻译", "translation")


def reply_lines(replies: DataFrame) -> DataFrame:
    """video_id, chunk_id, line_no, line, without code fences."""
    plain = F.replace(F.replace("reply", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    each = replies.select("video_id", "chunk_id", F.posexplode(F.split(plain, "\n")).alias("line_no", "line"))
    return each.where(~(F.startswith("line", F.lit("```")) & F.col("line").rlike(FENCE)))


def _entries(replies: DataFrame, pattern: str, body_group: int, first_line: Column) -> DataFrame:
    """Matching lines with what continues them: video_id, chunk_id, entry, first_line (what is kept of it), body."""
    hit = F.col("_hit")
    run = Window.partitionBy("video_id", "chunk_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    matched = reply_lines(replies).withColumn("_hit", F.col("line").rlike(pattern))
    numbered = matched.withColumn("entry", F.sum(hit.cast("int")).over(run)).where((F.col("entry") > 0) & (hit | (T.strip(F.col("line")) != "")))
    part = F.when(hit, T.strip_given(F.regexp_extract("line", pattern, body_group))).otherwise(T.strip(F.col("line")))
    by = numbered.groupBy("video_id", "chunk_id", "entry").agg(F.sort_array(F.collect_list(F.struct("line_no", part.alias("part")))).alias("parts"), F.min_by(first_line, "line_no").alias("first_line"))
    return by.select("video_id", "chunk_id", "entry", "first_line", F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("body"))


def _number(column: str, pattern: str, group: int) -> Column:
    return F.regexp_extract(column, pattern, group).try_cast("int")


def parse_units(replies: DataFrame) -> DataFrame:
    """FOLD-10: video_id, chunk_id, unit_no, first, last, text."""
    e = _entries(replies, UNIT, 3, F.regexp_extract("line", UNIT_HEAD, 0))
    first = _number("first_line", UNIT_HEAD, 1)
    return e.select("video_id", "chunk_id", F.col("entry").alias("unit_no"), first.alias("first"), F.coalesce(_number("first_line", UNIT_HEAD, 2), first).alias("last"), F.col("body").alias("text"))


def parse_translations(replies: DataFrame) -> DataFrame:
    """FOLD-10/TOP-6: video_id, chunk_id, index, translation; the last entry of an index wins."""
    e = _entries(replies, TRANSLATION, 2, F.col("line")).withColumn("index", _number("first_line", TRANSLATION, 1))
    return e.groupBy("video_id", "chunk_id", "index").agg(F.max_by("body", "entry").alias("translation"))


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """TOP-6: video_id, chunk_id, n, keep, reason; the last line of a number wins."""
    hit = reply_lines(replies).where(F.col("line").rlike(VERDICT))
    keep = ~F.lower(F.regexp_extract("line", VERDICT, 2)).isin("丢弃", "drop")
    rows = hit.select("video_id", "chunk_id", "line_no", _number("line", VERDICT, 1).alias("n"), keep.alias("keep"), T.strip(F.regexp_extract("line", VERDICT, 3)).alias("reason"))
    return rows.groupBy("video_id", "chunk_id", "n").agg(F.max_by(F.struct("keep", "reason"), "line_no").alias("v")).select("video_id", "chunk_id", "n", "v.keep", "v.reason")


def parse_ranges(replies: DataFrame) -> DataFrame:
    """video_id, chunk_id, range_no, first, last, head, tail."""
    hit = reply_lines(replies).where(F.col("line").rlike(RANGE))
    first, body = _number("line", RANGE, 1), F.split(F.regexp_extract("line", RANGE, 3), r"\|", 2)
    order = Window.partitionBy("video_id", "chunk_id").orderBy("line_no")
    return hit.select("video_id", "chunk_id", F.row_number().over(order).alias("range_no"), first.alias("first"), F.coalesce(_number("line", RANGE, 2), first).alias("last"), T.strip(body[0]).alias("head"), T.strip(F.coalesce(F.get(body, F.lit(1)), F.lit(""))).alias("tail"))


def parse_terms(text: Column) -> Column:
    """VER-10: array of (source, target) of the lines that have an arrow."""

    def one(line: Column) -> Column:
        bare = F.regexp_replace(T.strip(F.regexp_replace(T.strip(line), r"^\|+|\|+\z", "")), BULLET, "")
        edge = lambda x: F.regexp_replace(x, rf"^{EDGE}+|{EDGE}+\z", "")
        sides = F.split(bare, ARROW, 2)
        return F.struct(edge(sides[0]).alias("source"), edge(F.regexp_replace(F.coalesce(F.get(sides, F.lit(1)), F.lit("")), r"^\|+|\|+\z", "")).alias("target"))

    def good(t: Column) -> Column:
        size = lambda x: F.length(x).between(1, C.MAX_TERM_CHARS)
        template = F.lower(t["source"]).isin(*TEMPLATE_SOURCES) & F.lower(t["target"]).isin(*TEMPLATE_TARGETS)
        return size(t["source"]) & size(t["target"]) & ~template

    rows = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: ~T.strip(x).startswith("```"))
    return F.filter(F.transform(rows, one), good)


def apply_verdicts(segments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """JOIN-5/SET-6: first-pass segments stay; a recovered one (number n) stays if its verdict says so."""
    v = verdicts.select(F.col("video_id").alias("_video"), F.col("n").alias("_n"), "keep")
    joined = segments.join(v, (F.col("video_id") == F.col("_video")) & (F.col("number") == F.col("_n")) & F.col("recovered"), "left").drop("_video", "_n")
    return joined.where(~F.col("recovered") | F.coalesce("keep", F.lit(False))).drop("keep")


def apply_translations(lines: DataFrame, parsed: DataFrame, first: bool = True) -> DataFrame:
    """JOIN-6: parsed translations take the place of the lines' own; on a retry only where there is none."""
    p = parsed.select("video_id", "index", F.col("translation").alias("_new"))
    new = F.coalesce("_new", "translation") if first else F.when(F.coalesce("translation", F.lit("")) == "", F.coalesce("_new", "translation")).otherwise(F.col("translation"))
    return lines.join(p, ["video_id", "index"], "left").withColumn("translation", new).drop("_new")


def lines_of(units: DataFrame, lines: DataFrame) -> DataFrame:
    """JOIN-7/JOIN-8: the lines of each range (first..last), by exploding the range and joining on index."""
    each = units.where(F.col("last") >= F.col("first")).withColumn("index", F.explode(F.sequence("first", "last")))
    return each.join(lines.withColumnRenamed("text", "line_text"), ["video_id", "index"])


#: Indexes of a block of lines.
BLOCK = 64


def with_lines(units: DataFrame, lines: DataFrame) -> DataFrame:
    """JOIN-7/JOIN-8 with a unit's lines on its own row: units with src, the lines of first..last in order of index, as structs
    of all columns but video_id, index first. A unit without lines has no row.

    Units meet their video's lines by video alone, and only blocks of lines that overlap them, so that what is partitioned by
    video is not moved again and no text is moved once for each of its lines."""
    line = F.struct("index", *(c for c in lines.columns if c not in ("video_id", "index")))
    by = lines.groupBy("video_id", F.floor(F.col("index") / BLOCK).alias("_block")).agg(F.min("index").alias("_from"), F.max("index").alias("_to"), F.collect_list(line).alias("_lines"))
    met = units.join(by.drop("_block"), "video_id").where((F.col("_from") <= F.col("last")) & (F.col("_to") >= F.col("first")))
    part = F.filter("_lines", lambda x: x["index"].between(F.col("first"), F.col("last")))
    parts = met.select(*units.columns, part.alias("_part")).where(F.size("_part") > 0)
    return parts.groupBy(*units.columns).agg(F.sort_array(F.flatten(F.collect_list("_part"))).alias("src"))
