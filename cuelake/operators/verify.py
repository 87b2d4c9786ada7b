"""Checks of model output, each with the direction in which it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake import constants as C
from cuelake.functions import text as T
from cuelake.functions.columns import let
from cuelake.operators import cues, replies


def covers_exactly(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """VER-1: video_id, chunk_id, covers: the units of a chunk (chunks: video_id, chunk_id, first_index,
    last_index) follow one another without gap from its first line to its last."""
    order = Window.partitionBy("video_id", "chunk_id").orderBy("unit_no")
    prev = F.lag("last").over(order)
    ok = (F.col("last") >= F.col("first")) & (prev.isNull() | (F.col("first") == prev + 1))
    by = units.withColumn("ok", ok).groupBy("video_id", "chunk_id").agg(F.bool_and("ok").alias("ok"), F.min_by("first", "unit_no").alias("f"), F.max_by("last", "unit_no").alias("l"))
    met = chunks.join(by, ["video_id", "chunk_id"], "left")
    return met.select("video_id", "chunk_id", F.coalesce(F.col("ok") & (F.col("f") == F.col("first_index")) & (F.col("l") == F.col("last_index")), F.lit(False)).alias("covers"))


def same_keys(got: DataFrame, expected: DataFrame, key: str = "n") -> DataFrame:
    """JOIN-12/SET-3/VER-6: video_id, chunk_id, covers: both have the same keys, and some."""
    a = got.select("video_id", "chunk_id", key).distinct().withColumn("_got", F.lit(1))
    b = expected.select("video_id", "chunk_id", key).distinct().withColumn("_want", F.lit(1))
    both = a.join(b, ["video_id", "chunk_id", key], "full_outer")
    return both.groupBy("video_id", "chunk_id").agg((F.count_if(F.col("_got").isNull() | F.col("_want").isNull()) == 0).alias("covers"))


def bag_kept(a: Column, b: Column) -> Column:
    """Size of the bag intersection of two word arrays of one row: each word of b takes one of a's that is still left.
    Repeats are numbered, so that it is the intersection of two sets."""

    def tagged(words: Column) -> Column:  # a word and how many like it come before: no two are equal
        return let(F.sort_array(words), lambda s: F.transform(s, lambda w, k: F.concat(w, F.lit(" "), (k + 1 - F.array_position(s, w)).cast("string"))))

    def kept(p: Column) -> Column:
        x, y = p["a"], p["b"]
        short = F.greatest(F.size(x), F.size(y)) <= TAGGED
        bags = F.when(short, F.size(F.array_intersect(tagged(x), tagged(y)))).otherwise(_kept_sorted(x, y))
        return F.when(x == y, F.size(x)).otherwise(bags)

    return let(F.struct(a.alias("a"), b.alias("b")), kept)


#: Words up to which a text's repeats are numbered by looking for the first of each.
TAGGED = 500


def _kept_sorted(a: Column, b: Column) -> Column:
    """bag_kept for long texts: both are sorted together and counted in one go."""
    side = lambda words, k: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(k).alias("side")))

    def step(acc: Column, x: Column) -> Column:
        same = acc["w"] == x["w"]
        left = F.when(same, acc["left"]).otherwise(0)
        taken = (x["side"] == 1) & (left > 0)
        return F.struct(x["w"].alias("w"), F.when(x["side"] == 0, left + 1).when(taken, left - 1).otherwise(left).alias("left"), (acc["kept"] + taken.cast("int")).alias("kept"))

    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("left"), F.lit(0).alias("kept"))
    return F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, step, lambda acc: acc["kept"])


def _fidelity(candidate: Column, source: Column) -> Column:
    """kept, total, added and faithful of a text and what it was made of, word by word."""

    def measured(w: Column) -> Column:
        def judged(kept: Column) -> Column:
            size, total = F.size(w["a"]).cast("long"), F.size(w["b"]).cast("long")
            added = size - kept
            enough = (kept >= C.MIN_KEPT * total) & (added <= F.greatest(F.lit(float(C.MAX_ADDED_FLOOR)), C.MAX_ADDED_RATIO * size))
            return F.struct(kept.alias("kept"), total.alias("total"), added.alias("added"), ((total == 0) | enough).alias("faithful"))

        return let(bag_kept(w["a"], w["b"]).cast("long"), judged)

    return let(F.struct(T.words(candidate).alias("a"), T.words(source).alias("b")), measured)


def faithful(pairs: DataFrame, *keys: str) -> DataFrame:
    """VER-2/VER-3/SET-4: keys, kept, total, added and faithful of pairs (keys, candidate, source). All of it is
    on the row: nothing is shuffled."""
    return pairs.withColumn("_f", F.explode(F.array(_fidelity(F.col("candidate"), F.col("source"))))).select(*keys, "_f.*")


def snippet_matches(snippet: Column, line: Column) -> Column:
    """FLT-10: at least 60 % of the snippet's words, and one, are in the line."""
    need = lambda own: F.greatest(F.lit(1), F.bround(F.size(own) * C.MIN_SNIPPET_OVERLAP).cast("int"))
    return let(T.words(snippet), lambda own: (F.size(own) > 0) & (bag_kept(own, T.words(line)) >= need(own)))


def apply_units(units: DataFrame, lines: DataFrame, limits: DataFrame, max_chars: int = C.MAX_CHARS_PER_LINE, max_duration: float = C.MAX_DURATION) -> DataFrame:
    """VER-4: video_id, first, start, end, text, accepted: accepted units, and the lines of rejected ones.

    units: video_id, chunk_id, unit_no, first, last, text. limits: video_id, gap_limit.
    """
    def row(first: Column, start: Column, end: Column, text: Column, ok: bool) -> Column:
        return F.struct(first.alias("first"), start.alias("start"), end.alias("end"), text.alias("text"), F.lit(ok).alias("accepted"))

    judged = judge_units(units, lines, limits, max_chars, max_duration)
    merged = F.array(row(F.col("first"), F.bround("start", 3), F.bround("end", 3), F.col("text"), True))
    kept = F.transform("src", lambda x: row(x["index"], x["start"], x["end"], x["line_text"], False))
    return judged.select("video_id", F.inline(F.when(F.col("accepted"), merged).otherwise(kept)))


def judge_units(units: DataFrame, lines: DataFrame, limits: DataFrame, max_chars: int = C.MAX_CHARS_PER_LINE, max_duration: float = C.MAX_DURATION) -> DataFrame:
    """video_id, chunk_id, unit_no, first, last, text, start, end, src, corrected, reason, accepted of each unit.

    src: its lines. reason: the first rule that it breaks (fidelity, pause, width, span), '' if it is accepted.
    The lines are joined once, in blocks by video; every rule is then worked out on the unit's own row.
    """
    longest, budget = max(max_duration, C.MERGE_MAX_DURATION), max(max_chars * C.CUE_CHAR_BUDGET_RATIO, 1)
    key = ["video_id", "chunk_id", "unit_no", "first", "last", "text"]
    own = lines.select("video_id", "index", "start", "end", F.col("text").alias("line_text"), T.is_fragment(F.col("text")).alias("fragment"))
    by = replies.with_lines(units.select(*key).join(limits, "video_id"), own)
    src = F.col("src")
    head, tail = src[0], F.element_at(src, -1)
    limit = F.when(T.is_single_sentence(F.col("text")), F.greatest("gap_limit", F.lit(max_duration))).otherwise(F.col("gap_limit"))

    def far(m: Column) -> Column:  # some neighbours are too far apart, and neither is a fragment
        apart = lambda a, b: (b["start"] - a["end"] > m) & ~a["fragment"] & ~b["fragment"]
        return F.exists(F.sequence(F.lit(0), F.size(src) - 2), lambda k: apart(F.get(src, k), F.get(src, k + 1)))

    # No limit is below gap_limit: only where that is passed is the text looked at for the other one.
    pause = F.when(far(F.col("gap_limit")), let(limit, far)).otherwise(False)
    many = F.size(src) > 1
    over = tail["end"] - head["start"] > longest
    width = F.when(F.exists(src, lambda x: x["fragment"]), int(budget * C.FRAGMENT_BUDGET_RATIO)).otherwise(budget)
    joined = F.aggregate(src, F.lit(""), lambda s, x: T.join_text(s, x["line_text"]))
    checked = by.select(*by.columns, F.explode(F.array(joined)).alias("source"))
    reason = (
        # What equals its source is faithful, whatever its words are.
        F.when((F.col("text") != F.col("source")) & ~_fidelity(F.col("text"), F.col("source"))["faithful"], "fidelity")
        .when(many & F.when(many, pause).otherwise(False), "pause")
        .when(many & (F.length("text") > width), "width")
        .when(many & over & ~head["fragment"] & ~tail["fragment"], "span")
        .otherwise("")
    )
    trim = over & many
    start = F.when(trim & head["fragment"], tail["end"] - longest).otherwise(head["start"])
    end = F.when(trim & ~head["fragment"], head["start"] + longest).otherwise(tail["end"])
    verdict = F.struct(start.alias("start"), end.alias("end"), (F.col("text") != F.col("source")).alias("corrected"), reason.alias("reason"))
    # A generated column is worked out once a row, however often it is used.
    return checked.select(*key, "src", F.explode(F.array(verdict)).alias("v")).select(*key, "src", "v.*", (F.col("v.reason") == "").alias("accepted"))


def refine_counters(judged: DataFrame) -> DataFrame:
    """AGG-17: video_id, merged (lines saved by accepted units), corrected (accepted units whose text differs
    from their lines), rejected, from judge_units."""
    ok = F.col("accepted")
    return judged.groupBy("video_id").agg(
        F.sum(F.when(ok, F.size("src") - 1).otherwise(0)).alias("merged"), F.count_if(ok & F.col("corrected")).alias("corrected"), F.count_if(~ok).alias("rejected")
    )


def rejections(judged: DataFrame) -> DataFrame:
    """AGG-17: video_id, first, last, reason, text of the units that were rejected."""
    return judged.where(~F.col("accepted")).select("video_id", "first", "last", "reason", "text")


def vetted(segments: DataFrame, verdicts: DataFrame, chunks: DataFrame) -> DataFrame:
    """VER-6: segments (with number, recovered) without the recovered ones that do not hold.

    chunks: video_id, chunk_id, n of every recovered segment. A chunk whose verdicts (video_id, chunk_id, n,
    keep) are not exactly one for each of its numbers loses all of its recovered segments; segments of the
    first pass always stay.
    """
    met = same_keys(verdicts, chunks).where("covers")
    good = verdicts.join(met, ["video_id", "chunk_id"], "left_semi")
    asked = chunks.select("video_id", "chunk_id", "n").distinct()  # a number is only asked for in its own chunk
    return replies.apply_verdicts(segments, good.join(asked, ["video_id", "chunk_id", "n"], "left_semi"))


def verify_ranges(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """VER-5: ranges with reason: the first of inverted, out of range, too long, head, tail, else ''."""
    text = lines.select("video_id", "index", "text")
    totals = lines.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"))
    at = lambda side: text.select("video_id", F.col("index").alias(side), F.col("text").alias(f"_{side}"))
    met = ranges.join(totals, "video_id", "left").join(at("first"), ["video_id", "first"], "left").join(at("last"), ["video_id", "last"], "left")
    longest = F.greatest(F.lit(C.MAX_RANGE_LINES), F.floor(F.col("total") * C.MAX_RANGE_SHARE))
    reason = (
        F.when(F.col("last") < F.col("first"), "inverted")
        .when(F.col("_first").isNull() | F.col("_last").isNull(), "out of range")
        .when(F.col("last") - F.col("first") + 1 > longest, "too long")
        .when(~snippet_matches(F.col("head"), F.col("_first")), "head")
        .when(~snippet_matches(F.col("tail"), F.col("_last")), "tail")
        .otherwise("")
    )
    return met.withColumn("reason", reason).select(*ranges.columns, "reason")


def accept_ranges(verified: DataFrame) -> DataFrame:
    """FOLD-11: verified ranges that start after the last accepted one of their chunk; rejected ones do not
    count. The state is one number per chunk, so the fold is a higher-order function."""
    by = verified.where("reason = ''").groupBy("video_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("range_no", "first", "last"))).alias("r"))
    kind = "array<struct<range_no:int,first:int,last:int>>"
    step = lambda acc, x: F.when(x["first"] > acc["last"], F.struct(x["last"].alias("last"), F.concat(acc["ok"], F.array(x)).alias("ok"))).otherwise(acc)
    rows = F.transform("r", lambda x: F.struct(x["range_no"].cast("int").alias("range_no"), x["first"].cast("int").alias("first"), x["last"].cast("int").alias("last")))
    taken = F.aggregate(rows, F.struct(F.lit(0).alias("last"), F.array().cast(kind).alias("ok")), step, lambda acc: acc["ok"])
    return by.select("video_id", "chunk_id", F.explode(taken).alias("x")).select("video_id", "chunk_id", "x.range_no", "x.first", "x.last")


def mark_lyrics(lines: DataFrame, accepted: DataFrame) -> DataFrame:
    """JOIN-8: lines with is_lyric for those in an accepted range. No line is added or dropped."""
    hit = accepted.select("video_id", F.explode(F.sequence("first", "last")).alias("index")).distinct().withColumn("is_lyric", F.lit(True))
    return lines.drop("is_lyric").join(hit, ["video_id", "index"], "left").withColumn("is_lyric", F.coalesce("is_lyric", F.lit(False)))


def missing_translations(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """VER-7: lines that no reply has translated."""
    return lines.join(parsed.select("video_id", "index"), ["video_id", "index"], "left_anti")


def give_up(chunks: DataFrame, after: int) -> DataFrame:
    """FOLD-13: chunks (video_id, chunk_id, failed) with skipped: all after ``after`` failures in a row."""
    order = Window.partitionBy("video_id").orderBy("chunk_id")
    run = F.sum((~F.col("failed")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    streak = F.sum(F.col("failed").cast("int")).over(Window.partitionBy("video_id", "run").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0))
    hit = F.max((F.col("streak") >= after).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return chunks.withColumn("run", run).withColumn("streak", streak).withColumn("skipped", F.coalesce(hit == 1, F.lit(False))).drop("run", "streak")


def time_valid(tasks: DataFrame, durations: DataFrame) -> DataFrame:
    """VER-9: frame tasks (video_id, time) with seconds and valid: a time, and within the video."""
    s = tasks.withColumn("seconds", T.parse_time(F.col("time"))).join(durations, "video_id", "left")
    return s.withColumn("valid", F.coalesce(F.col("seconds") <= F.col("duration"), F.lit(False))).drop("duration")


def refine(units: DataFrame, lines: DataFrame, chunks: DataFrame, max_chars: int = C.MAX_CHARS_PER_LINE, max_duration: float = C.MAX_DURATION) -> DataFrame:
    """The refine stage: chunks whose units do not cover them exactly keep their lines, units are judged
    one by one in the others, and the result is numbered anew."""
    covered = covers_exactly(units, chunks)
    good = units.join(covered.where("covers"), ["video_id", "chunk_id"], "left_semi")
    kept = chunks.join(covered.where(~F.col("covers")), ["video_id", "chunk_id"], "left_semi").select("video_id", F.explode(F.sequence("first_index", "last_index")).alias("index"))
    plain = lines.join(kept, ["video_id", "index"], "left_semi").select("video_id", F.col("index").alias("first"), "start", "end", "text")
    out = apply_units(good, lines, cues.gap_limit(lines), max_chars, max_duration).drop("accepted").unionByName(plain)
    return out.withColumn("index", F.row_number().over(Window.partitionBy("video_id").orderBy("first"))).select("video_id", "index", "start", "end", "text")
