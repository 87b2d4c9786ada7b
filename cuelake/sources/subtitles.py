"""Subtitle files: SRT and ASS readers and writers over many videos at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake import constants as C
from cuelake.functions import text as T
from cuelake.functions.columns import let
from cuelake.sources.named_files import write_named

# The timing line of an SRT block, and the start of an ASS dialogue.
TIMING = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*$"
DIALOGUE = r"^Dialogue:\s*\d+\s*,\s*(\d+):(\d{2}):(\d{2})\.(\d{2})\s*,"
# The head of an ASS file; {size} and {color} are the style's.
ASS_HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: 1920
PlayResY: 1080
WrapStyle: 0
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Arial,{size},{color},&H000000FF,&H00000000,&H7F000000,0,0,0,0,100,100,0,0,1,2,1,2,60,60,40,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""
TOP_LEFT = r"{\an7}"
# Fixed value: the reply that says that a frame has no text.
NO_TEXT = "[无文字]"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _seconds(line: Column, pattern: str, first: int, unit: int) -> Column:
    g = lambda k: F.regexp_extract(line, pattern, first + k).cast("double")
    return g(0) * 3600 + g(1) * 60 + g(2) + g(3) / unit


def parse_srt(files: DataFrame, key: str = "path") -> DataFrame:
    """SRC-7: key, pos, start, end, timing, body of the blocks; a block without timing in its first two
    lines is dropped."""
    def read(rows: Column) -> Column:
        timed = lambda k: F.trim(F.get(rows, F.lit(k))).rlike(TIMING)
        at = F.when(timed(0), 0).when(timed(1), 1)
        return let(at, lambda k: F.struct(rows.alias("rows"), k.alias("at"), F.regexp_extract_all(F.get(rows, k), F.lit(r"\d+"), F.lit(0)).alias("t")))

    # Rows and times of a block are worked out once, where the text is cut.
    given = files.where(F.ltrim("text", F.lit(T.SPACES)) != "")
    blocks = F.transform(F.split(T.strip(F.col("text")), r"\n\s*\n"), lambda x: let(F.split(x, r"[\n\r](?:(?<=\r)\n)?"), read))
    cut = given.select(key, F.posexplode(blocks).alias("pos", "b")).where("b.at is not null").select(key, "pos", "b.*")
    g = lambda k: F.get("t", F.lit(k)).cast("double")
    seconds = lambda k: g(k) * 3600 + g(k + 1) * 60 + g(k + 2) + g(k + 3) / 1000
    rest = F.array_join(F.slice("rows", F.col("at") + 2, F.greatest(F.size("rows") - F.col("at") - 1, F.lit(0))), "\n")
    return cut.select(key, "pos", seconds(0).alias("start"), seconds(4).alias("end"), F.get("rows", F.col("at")).alias("timing"), rest.alias("body"))


def parse_ass(files: DataFrame, key: str = "path") -> DataFrame:
    """SRC-8: key, pos, start, line of all lines; start is null but for dialogues."""
    each = files.select(key, F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("pos", "line"))
    return each.withColumn("start", F.when(F.col("line").rlike(DIALOGUE), _seconds(F.col("line"), DIALOGUE, 1, 100)))


def _shown(lines: DataFrame, max_chars: int, joint: str, escape: bool) -> DataFrame:
    part = (lambda c: F.transform(T.wrap(c, max_chars), T.ass_escape)) if escape else (lambda c: T.wrap(c, max_chars))
    given = F.ltrim(F.coalesce("translation", F.lit("")), F.lit(T.SPACES)) != ""
    shown = lines.withColumn("_o", F.array_join(part(F.col("text")), joint))
    return shown.withColumn("_t", F.when(given, F.array_join(part(F.col("translation")), joint)).otherwise(F.col("_o")))


def _flag(lines: DataFrame) -> Column:
    return F.coalesce(F.col("is_frame"), F.lit(False)) if "is_frame" in lines.columns else F.lit(False)


def _shown_order(lines: DataFrame):
    """By start; of equal starts frame cues come last, then by index and text."""
    return Window.partitionBy("video_id").orderBy("start", _flag(lines), "index", "text", "translation")


def srt_blocks(lines: DataFrame, mode: str = "bilingual", layout: str = "original_top", max_chars: int = C.MAX_CHARS_PER_LINE) -> DataFrame:
    """SNK-1: video_id, n, block of each cue, numbered from 1 in order of start, index.

    mode: bilingual or translation_only; an empty translation falls back to the text.
    """
    both = F.concat_ws("\n", "_t", "_o") if layout == "translation_top" else F.concat_ws("\n", "_o", "_t")
    shown = F.when(_flag(lines), F.concat(F.lit(TOP_LEFT), "_t")).otherwise(F.col("_t") if mode == "translation_only" else both)
    n = F.row_number().over(_shown_order(lines))
    block = F.concat(n.cast("string"), F.lit("\n"), T.srt_time(F.col("start")), F.lit(" --> "), T.srt_time(F.col("end")), F.lit("\n"), shown, F.lit("\n"))
    return _shown(lines, max_chars, "\n", False).select("video_id", n.alias("n"), block.alias("block"))


def ass_events(lines: DataFrame, mode: str = "bilingual", layout: str = "original_top", max_chars: int = C.MAX_CHARS_PER_LINE, original_size: int = 40, original_color: str = "#C0C0C0") -> DataFrame:
    """SNK-2: video_id, n, block: a Dialogue row of each cue."""
    tag = F.concat(F.lit(rf"{{\fs{original_size}\c"), T.ass_color(F.lit(original_color)), F.lit("&}"))
    both = F.concat(F.col("_t"), F.lit(r"\N"), tag, F.col("_o")) if layout == "translation_top" else F.concat(tag, F.col("_o"), F.lit(r"{\r}\N"), F.col("_t"))
    shown = F.when(_flag(lines), F.concat(F.lit(TOP_LEFT), "_t")).otherwise(F.col("_t") if mode == "translation_only" else both)
    n = F.row_number().over(_shown_order(lines))
    block = F.concat(F.lit("Dialogue: 0,"), T.ass_time(F.col("start")), F.lit(","), T.ass_time(F.col("end")), F.lit(",Default,,0,0,0,,"), shown)
    return _shown(lines, max_chars, r"\N", True).select("video_id", n.alias("n"), block.alias("block"))


def ass_head(size: int = 52, color: str = "#FFFFFF") -> str:
    h = color.strip().lstrip("#")
    h = h if len(h) == 6 else "FFFFFF"
    return ASS_HEAD.format(size=size, color=f"&H00{h[4:]}{h[2:4]}{h[:2]}".upper())


def files_of(blocks: DataFrame, joint: str = "\n", head: str = "", end: str = "") -> DataFrame:
    """video_id, text: the blocks of a video as one file."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda b: b["block"])
    return blocks.groupBy("video_id").agg(F.concat(F.lit(head), F.array_join(ordered, joint), F.lit(end)).alias("text"))


def _given(cues: DataFrame) -> Column:
    """The order in which cues were given: their column pos, else by time and text."""
    by = ["pos"] if "pos" in cues.columns else ["start", "end", "text"]
    return F.row_number().over(Window.partitionBy("video_id").orderBy(*by)).alias("pos")


def insert_srt(files: DataFrame, cues: DataFrame) -> DataFrame:
    """SNK-3: files (video_id, text) with frame cues (video_id, start, end, text, and pos for their given order)
    put in by start, after the blocks that start at the same time; blocks are numbered anew, their text stays."""
    own = F.concat_ws("\n", "timing", F.when(F.col("body") != "", F.col("body")))
    old = parse_srt(files, "video_id").select("video_id", "start", F.lit(0).alias("src"), F.col("pos"), own.alias("body"))
    timing = F.concat(T.srt_time(F.col("start")), F.lit(" --> "), T.srt_time(F.col("end")))
    new = cues.select("video_id", "start", F.lit(1).alias("src"), _given(cues), F.concat(timing, F.lit("\n" + TOP_LEFT), "text").alias("body"))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "src", "pos"))
    return files_of(old.unionByName(new).select("video_id", n.alias("n"), F.concat(n.cast("string"), F.lit("\n"), "body", F.lit("\n")).alias("block")))


def insert_ass(files: DataFrame, cues: DataFrame) -> DataFrame:
    """SNK-4: as insert_srt: each cue before the first dialogue that starts later, else after the last one. In a
    file without dialogues the cues follow at the end as they were given."""
    film = Window.partitionBy("video_id")
    event = F.concat(F.lit("Dialogue: 0,"), T.ass_time(F.col("start")), F.lit(","), T.ass_time(F.col("end")), F.lit(",Default,,0,0,0,," + TOP_LEFT), T.ass_escape(F.col("text")))
    new = cues.select("video_id", F.col("start").alias("at"), F.lit(0).alias("src"), _given(cues), event.alias("line"))
    old = parse_ass(files, "video_id").select("video_id", F.col("start").alias("at"), F.lit(1).alias("src"), "pos", "line")
    both = old.unionByName(new)
    # From the latest start on, a cue before the dialogues of its own start: what came so far starts later.
    spoken = F.when((F.col("src") == 1) & F.col("at").isNotNull(), F.col("pos"))
    later = F.min(spoken).over(film.orderBy(F.desc_nulls_last("at"), "src", "pos").rowsBetween(Window.unboundedPreceding, -1))
    after = F.max(spoken).over(film) + 1
    placed = both.withColumns({"later": later, "after": after})
    own = F.col("src") == 0
    place = F.when(own, F.coalesce("later", "after", F.lit(2**31 - 1))).otherwise(F.col("pos"))
    when = F.when(own & F.col("after").isNotNull(), F.col("at"))
    n = F.row_number().over(film.orderBy("place", "src", "when", "pos"))
    ordered = placed.select("video_id", place.alias("place"), "src", when.alias("when"), "pos", "line")
    return files_of(ordered.select("video_id", n.alias("n"), F.col("line").alias("block")), end="\n")


def frame_cues(replies: DataFrame) -> DataFrame:
    """SRC-6: cues (video_id, start, end, text) of the replies (video_id, start, duration, reply) that hold text:
    neither empty nor with the mark for a frame without any."""
    text = T.strip(F.coalesce("reply", F.lit("")))
    kept = replies.withColumn("text", text).where((F.col("text") != "") & ~F.contains("text", F.lit(NO_TEXT)))
    return kept.select("video_id", F.bround("start", 3).alias("start"), F.bround(F.col("start") + F.col("duration"), 3).alias("end"), "text")


def with_frames(lines: DataFrame, cues: DataFrame) -> DataFrame:
    """SET-2: lines (with translation) and frame cues as one table, the cues as lines of index 0 that only have a
    translation; in order of start, lines first (srt_blocks and ass_events number them so)."""
    frame = cues.select("video_id", F.lit(0).alias("index"), "start", "end", F.lit("").alias("text"), F.col("text").alias("translation"), F.lit(True).alias("is_frame"))
    return lines.withColumn("is_frame", F.lit(False)).unionByName(frame, allowMissingColumns=True)


def write_files(files: DataFrame, path: str, ending: str = "srt") -> None:
    """SNK-6: each text of files (video_id, text, and name if there is one) as one file below path: ``name``, else the
    video's id and ``ending``. All files are there under their names or none is; old ones are replaced each in one step."""
    name = F.col("name") if "name" in files.columns else F.concat(F.col("video_id").cast("string"), F.lit(f".{ending}"))
    write_named(files.select(name.alias("name"), "text"), path)
