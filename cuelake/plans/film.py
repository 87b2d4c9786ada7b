"""From words to subtitle files: the stages of one run over all videos of a batch at once.

Model calls are made by a Completer: it gets a table of requests and gives a table of replies. Those here look
replies up in a table or work them out by a column; one that calls a service would do so inside mapInPandas.

What waits for what is a round: the k-th translation batch of all films is asked for at once, with the end
of each film's batch k-1 as context. Episodes of a series that wait for each other's terms are in season.py.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake import constants as C
from cuelake.functions import text as T
from cuelake.operators import cues, metrics, replies, verify
from cuelake.plans.runs import write_whole
from cuelake.session import broadcast_if_small, cut
from cuelake.sources import subtitles


class Completer(Protocol):
    def complete(self, requests: DataFrame) -> DataFrame:
        """requests (video_id, stage, chunk_id, attempt, glossary, context, body, prompt) to replies (video_id, chunk_id,
        reply). prompt is the parts before it one after the other; glossary and context may be null."""


@dataclass
class TableCompleter:
    """Replies from a table (video_id, stage, chunk_id, attempt, reply); requests without a row get none."""

    table: DataFrame

    def complete(self, requests: DataFrame) -> DataFrame:
        keys = ["video_id", "stage", "chunk_id", "attempt"]
        return requests.select(*keys).join(self.table, keys).select("video_id", "chunk_id", "reply")


@dataclass
class ColumnCompleter:
    """Replies by a rule: a column over those of a request. Where it is null there is no reply."""

    rule: Column

    def complete(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("reply", self.rule).where("reply is not null").select("video_id", "chunk_id", "reply")


@dataclass
class Prepared:
    """What a film is before its translation: lines that are refined and marked, and what led there."""

    transcript: DataFrame
    refined: DataFrame
    judged: DataFrame
    lines: DataFrame


@dataclass
class Film:
    """lines in their final form, the lines that no reply translated, the files, refine's counters and
    rejections, and what each stage left, by name."""

    lines: DataFrame
    missing: DataFrame
    files: DataFrame
    counters: DataFrame
    rejected: DataFrame
    stages: dict[str, DataFrame]


def requests(
    lines: DataFrame,
    stage: str,
    attempt: int = 1,
    label: Column | None = None,
    glossary: DataFrame | None = None,
    context: DataFrame | None = None,
) -> DataFrame:
    """STR-13: the numbered lines of each chunk as one body; time stamps are not part of it. label: what stands
    in front of a line, its number in brackets if not given. glossary (video_id, glossary) and context (video_id,
    chunk_id, context) go in front of the lines."""
    mark = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] ")) if label is None else label
    row = F.struct(F.col("index").alias("at"), F.concat(mark, "text").alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["line"]), "\n")
    asked = lines.groupBy("video_id", "chunk_id").agg(joined.alias("body"))
    for table, keys, name in ((glossary, ["video_id"], "glossary"), (context, ["video_id", "chunk_id"], "context")):
        asked = asked.withColumn(name, F.lit(None).cast("string")) if table is None else asked.join(table, keys, "left")
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("glossary", "context", "body")]
    whole = F.concat_ws("\n\n", *parts).alias("prompt")
    return asked.select("video_id", F.lit(stage).alias("stage"), "chunk_id", F.lit(attempt).alias("attempt"), "glossary", "context", "body", whole)


def vet(segments: DataFrame, model: Completer, attempts: int = 2) -> DataFrame:
    """VER-6/FOLD-13: segments (video_id, pos, start, end, text, recovered) without the recovered ones that do not
    belong. A chunk is asked again if its verdicts are not one for each of its numbers; one that fails twice loses its
    recovered segments, and so do all chunks after two failures in a row. Segments of the first pass always stay."""
    budget = cues.token_budget(C.CONTEXT_LIMIT, C.REVIEW_FLOOR, C.REVIEW_CHUNK_TOKENS)
    numbered = cues.review_numbers(segments).withColumn("index", F.col("pos").cast("int"))
    chunked = cut(cues.chunks(numbered, budget, C.REVIEW_MARKER))
    asked = chunked.where("recovered").select("video_id", "chunk_id", F.col("number").cast("int").alias("n"))
    label = F.when(F.col("recovered"), F.concat(F.lit("*[R"), F.col("number").cast("string"), F.lit("] "))).otherwise(F.concat(F.lit("["), F.coalesce(F.col("number").cast("string"), F.lit("")), F.lit("] ")))
    open_, verdicts = asked, None
    for attempt in range(1, attempts + 1):
        wanted = chunked.join(open_.select("video_id", "chunk_id").distinct(), ["video_id", "chunk_id"], "left_semi")
        got = replies.parse_verdicts(model.complete(requests(wanted, "vet", attempt, label)))
        met = cut(verify.same_keys(got, open_).where("covers"))
        good = cut(got.join(met, ["video_id", "chunk_id"], "left_semi"))
        verdicts = good if verdicts is None else verdicts.unionByName(good)
        open_ = cut(open_.join(met, ["video_id", "chunk_id"], "left_anti"))
    failed = asked.select("video_id", "chunk_id").distinct().join(open_.select("video_id", "chunk_id").distinct().withColumn("_f", F.lit(True)), ["video_id", "chunk_id"], "left")
    skipped = verify.give_up(failed.select("video_id", "chunk_id", F.coalesce("_f", F.lit(False)).alias("failed")), C.REVIEW_GIVE_UP).where("skipped")
    held = verdicts.join(skipped, ["video_id", "chunk_id"], "left_anti")
    return verify.vetted(numbered, held, asked.join(skipped, ["video_id", "chunk_id"], "left_anti")).select(*segments.columns)


def refined(
    lines: DataFrame, model: Completer, max_chars: int = C.MAX_CHARS_PER_LINE, max_duration: float = C.MAX_DURATION, glossary: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Refined lines, and the judged units. Chunks that a reply does not cover exactly keep their lines; after three
    such chunks in a row, all further ones do."""
    budget = cues.token_budget(C.CONTEXT_LIMIT, C.REFINE_FLOOR, C.REFINE_CHUNK_TOKENS)
    chunked = cut(cues.chunks(lines, budget, C.REFINE_MARKER))
    bounds = chunked.groupBy("video_id", "chunk_id").agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"))
    units = cut(replies.parse_units(model.complete(requests(chunked, "refine", glossary=glossary))))
    covered = cut(verify.covers_exactly(units, bounds))
    skipped = verify.give_up(covered.select("video_id", "chunk_id", (~F.col("covers")).alias("failed")), C.REFINE_GIVE_UP).where("skipped")
    held = units.join(skipped, ["video_id", "chunk_id"], "left_anti")
    good = held.join(covered.where("covers"), ["video_id", "chunk_id"], "left_semi")
    judged = verify.judge_units(good, lines, cues.gap_limit(lines), max_chars, max_duration)
    return verify.refine(held, lines, bounds, max_chars, max_duration), judged


def marked(lines: DataFrame, model: Completer) -> DataFrame:
    """Lines in ranges that hold up to the text are marked as lyrics; a bad reply marks none. After two chunks in a
    row without a reply the others are left alone."""
    budget = cues.token_budget(C.CONTEXT_LIMIT, C.REVIEW_FLOOR, C.REVIEW_CHUNK_TOKENS)
    chunked = cut(cues.chunks(lines, budget, C.REVIEW_MARKER))
    got = cut(model.complete(requests(chunked, "lyrics")))
    said = got.select("video_id", "chunk_id").distinct().withColumn("_ok", F.lit(True))
    failed = chunked.select("video_id", "chunk_id").distinct().join(said, ["video_id", "chunk_id"], "left").select("video_id", "chunk_id", F.col("_ok").isNull().alias("failed"))
    skipped = verify.give_up(failed, C.REVIEW_GIVE_UP).where("skipped")
    ranges = replies.parse_ranges(got.join(skipped, ["video_id", "chunk_id"], "left_anti"))
    flagged = verify.mark_lyrics(lines, verify.accept_ranges(verify.verify_ranges(ranges, lines)))
    return flagged.withColumn("text", T.apply_marks(F.col("text"), F.col("is_lyric")))


def aligned(lines: DataFrame, model: Completer) -> DataFrame:
    """VER-8: lines (with chunk_id, translation): a batch whose translations do not go along with its texts in length
    is asked for once more, and what comes is taken only if it goes along better. Lines of other batches are not moved."""
    first = metrics.length_correlation(lines, "video_id", "chunk_id").withColumn("attempt", F.lit(1))
    odd = cut(metrics.better_attempt(first, "video_id", "chunk_id").where(~F.col("aligned")))
    if odd.isEmpty():
        return lines
    few = broadcast_if_small(odd)
    again = lines.join(few, ["video_id", "chunk_id"], "left_semi")
    got = replies.parse_translations(model.complete(requests(again, "align"))).select("video_id", "index", F.col("translation").alias("_new"))
    tried = cut(again.join(got, ["video_id", "index"], "left").withColumn("translation", F.coalesce("_new", "translation")).drop("_new"))
    second = metrics.length_correlation(tried, "video_id", "chunk_id").withColumn("attempt", F.lit(2))
    better = metrics.better_attempt(first.unionByName(second), "video_id", "chunk_id").where("attempt = 2")
    taken = tried.join(better, ["video_id", "chunk_id"], "left_semi").select("video_id", "index", F.col("translation").alias("_new"))
    renewed = again.join(taken, ["video_id", "index"], "left").withColumn("translation", F.coalesce("_new", "translation"))
    return cut(lines.join(few, ["video_id", "chunk_id"], "left_anti").unionByName(renewed.select(*lines.columns)).select(*lines.columns))


def own_terms(lines: DataFrame, model: Completer, glossary: DataFrame | None = None, context_limit: int = C.CONTEXT_LIMIT) -> DataFrame:
    """FOLD-9 in the chain: video_id, reply: the terms a model names on lines sampled from the whole film."""
    sampled = cues.sample(lines, context_limit).withColumn("chunk_id", F.lit(0))
    return model.complete(requests(sampled, "glossary", label=F.lit(""), glossary=glossary)).select("video_id", "reply")


def translated_batch(batch: DataFrame, model: Completer, attempts: int = 3, glossary: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """One batch of each film (with chunk_id): lines left out are asked for again, then batches that look shifted."""
    out = batch.withColumn("translation", F.lit(""))
    for attempt in range(1, attempts + 1):
        open_ = out.where("translation = ''")
        if attempt > 1 and open_.isEmpty():
            break
        asked = requests(open_, "translate", attempt, glossary=glossary, context=context)
        got = replies.parse_translations(model.complete(asked)).select("video_id", "index", "translation")
        out = cut(replies.apply_translations(out, got, first=attempt == 1))
    return aligned(out, model)


def translated(lines: DataFrame, model: Completer, attempts: int = 3, glossary: DataFrame | None = None, size: int = C.BATCH_SIZE) -> DataFrame:
    """Translations in rounds: the k-th batches of all films together, each with the end of its film's batch before
    as context (WIN-11). There are as many rounds as the longest film has batches; a film takes part in its own."""
    numbered = cues.batches(lines, size).withColumnRenamed("batch", "chunk_id")
    batches = cut(numbered.withColumn("_last", F.max("chunk_id").over(Window.partitionBy("video_id"))))
    last = batches.agg(F.max("chunk_id")).first()[0] or 0
    done, context = [], None
    for k in range(last + 1):
        done.append(translated_batch(batches.where(F.col("chunk_id") == k), model, attempts, glossary, context))
        context = batch_tail(done[-1].where(F.col("chunk_id") < F.col("_last")))  # nothing comes after a film's last batch
    out = reduce(DataFrame.unionByName, done)
    return out.drop("chunk_id", "_last").withColumn("translation", T.apply_marks(F.col("translation"), F.col("is_lyric")))


def batch_tail(lines: DataFrame, n: int = C.TAIL_LINES) -> DataFrame:
    """WIN-11: video_id, chunk_id, context: the last n lines of the batch before, as "[n] text → translation"."""
    place = F.row_number().over(Window.partitionBy("video_id", "chunk_id").orderBy(F.desc("index")))
    row = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), "text", F.lit(" → "), "translation")
    rows = F.sort_array(F.collect_list(F.struct("index", row.alias("t"))))
    last = lines.withColumn("_r", place).where(F.col("_r") <= n).groupBy("video_id", "chunk_id").agg(rows.alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    return last.select("video_id", (F.col("chunk_id") + 1).alias("chunk_id"), text.alias("context"))


def prepared(
    words: DataFrame, bare: DataFrame, model: Completer, max_chars: int = C.MAX_CHARS_PER_LINE, max_duration: float = C.MAX_DURATION, glossary: DataFrame | None = None
) -> Prepared:
    """Words and segments without words to lines that can be translated. glossary goes along with refine's requests."""
    if "recovered" in bare.columns:
        bare = cut(vet(bare, model))
    transcript = cut(cues.segment(words, bare, max_chars, max_duration))
    merged, judged = refined(transcript, model, max_chars, max_duration, glossary)
    merged, judged = cut(merged), cut(judged)
    return Prepared(transcript, merged, judged, cut(marked(merged, model)))


def finished(p: Prepared, done: DataFrame, mode: str, layout: str, max_chars: int, frames: DataFrame | None) -> Film:
    """The film of translated lines: its files, with frame texts among the cues, and what is missing."""
    shown = subtitles.with_frames(done, subtitles.frame_cues(frames)) if frames is not None else done
    files = subtitles.files_of(subtitles.srt_blocks(shown, mode, layout, max_chars))
    missing = done.where("translation = ''").select("video_id", "index")
    stages = {"transcript": p.transcript, "transcript_refined": p.refined, "translation": done}
    return Film(done, missing, files, verify.refine_counters(p.judged), verify.rejections(p.judged), stages)


def produce(
    words: DataFrame,
    bare: DataFrame,
    model: Completer,
    mode: str = "bilingual",
    layout: str = "original_top",
    max_chars: int = C.MAX_CHARS_PER_LINE,
    max_duration: float = C.MAX_DURATION,
    frames: DataFrame | None = None,
) -> Film:
    """Words and segments without words to SRT files. bare may have pos and recovered: its recovered segments are
    vetted first, against the others. frames: replies about frames (video_id, start, duration, reply).

    A film with missing translations is for the caller to fail or to ship with its original lines, which is
    what the files hold."""
    p = prepared(words, bare, model, max_chars, max_duration)
    terms = cut(own_terms(p.lines, model).withColumnRenamed("reply", "glossary"))
    return finished(p, cut(translated(p.lines, model, glossary=terms)), mode, layout, max_chars, frames)


def supplement(
    files: DataFrame, tasks: DataFrame, durations: DataFrame, model: Completer, shown: float = C.FRAME_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """The frame-only supplement of finished films: (files, refused). files (video_id, text, kind: srt or ass) get the texts of
    frames at the times of tasks (video_id, time as h:m:s, m:s or s, and duration in seconds or null for ``shown``).

    A time that is none, is negative or lies beyond the film (durations: video_id, duration) is refused with a reason
    (VER-9) and not asked for, as is one of a film without a file. A frame whose reply is empty or says that it has no text gives no
    cue (SRC-6); a task that is given twice is asked once. Cues are put in by start (SNK-3, SNK-4); a file without
    cues stays as it is.
    """
    given = tasks.select("video_id", "time", F.coalesce("duration", F.lit(shown)).alias("shown"))
    timed = verify.time_valid(given, durations)
    has_file = files.select("video_id").distinct().withColumn("_file", F.lit(True))
    reason = F.when(F.col("seconds").isNull(), "not a time").when(~F.col("valid"), "beyond the film").when(F.col("_file").isNull(), "no file")
    judged = cut(timed.join(has_file, "video_id", "left").withColumn("reason", reason))
    refused = judged.where("reason is not null").select("video_id", "time", "reason")
    by = Window.partitionBy("video_id").orderBy("seconds", "shown")
    once = judged.where("reason is null").select("video_id", "seconds", "shown").distinct()
    asked = cut(once.withColumn("chunk_id", F.row_number().over(by) - 1))
    frame = F.format_string("%.3f", F.col("seconds"))
    none = [F.lit(None).cast("string").alias(c) for c in ("glossary", "context")]
    got = model.complete(asked.select("video_id", F.lit("frame").alias("stage"), "chunk_id", F.lit(1).alias("attempt"), *none, frame.alias("body"), frame.alias("prompt")))
    replies_ = asked.join(got, ["video_id", "chunk_id"]).select("video_id", F.col("seconds").alias("start"), F.col("shown").alias("duration"), "reply")
    signs = cut(subtitles.frame_cues(replies_))
    put = files.join(signs.select("video_id").distinct(), "video_id", "left_semi")
    kept = files.join(signs.select("video_id").distinct(), "video_id", "left_anti")
    out = kept.select("video_id", "kind", "text")
    for kind, insert in (("srt", subtitles.insert_srt), ("ass", subtitles.insert_ass)):
        own = put.where(F.col("kind") == kind)
        cues_of = signs.join(own.select("video_id"), "video_id", "left_semi")
        out = out.unionByName(insert(own.select("video_id", "text"), cues_of).select("video_id", F.lit(kind).alias("kind"), "text"))
    return out, refused


def write_stages(film: Film, path: str) -> None:
    """SRC-10: what each stage left, as JSON rows in a folder of its own below path, each there as a whole or not at all."""
    for name, table in film.stages.items():
        write_whole(table, f"{path}/{name}")
