"""Video files, audio tracks and languages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake import constants as C
from cuelake.functions import text as T

# Language tags and the three-letter codes they stand for.
LANGUAGES = {
    "ja": "jpn", "jp": "jpn", "jap": "jpn",
    "en": "eng",
    "zh": "chi", "zho": "chi", "cmn": "chi",
    "ko": "kor",
    "fr": "fre", "fra": "fre",
    "de": "ger", "deu": "ger",
    "es": "spa",
    "ru": "rus",
    "it": "ita",
    "pt": "por",
    "th": "tha",
    "vi": "vie",
    "ar": "ara",
    "hi": "hin",
}
# What the codes are called, and what stands for no language at all.
LANGUAGE_NAMES = {
    "jpn": "日语", "eng": "英语", "chi": "中文", "kor": "韩语", "fre": "法语", "ger": "德语", "spa": "西班牙语", "rus": "俄语",
    "ita": "意大利语", "por": "葡萄牙语", "tha": "泰语", "vie": "越南语", "ara": "阿拉伯语", "hin": "印地语", "und": "未标注语言",
}
NO_LANGUAGE = "未标注语言"
# Target languages with the suffix of their files and the code of their tracks, and the rest's.
TARGETS = {
    "简体中文": ("zh", "chi"),
    "繁體中文": ("zh", "chi"),
    "English": ("en", "eng"),
    "日本語": ("ja", "jpn"),
    "한국어": ("ko", "kor"),
    "Français": ("fr", "fre"),
    "Deutsch": ("de", "ger"),
}
OTHER_TARGET = ("sub", "und")
# What channel counts are called.
CHANNEL_NAMES = {1: "单声道", 2: "立体声", 6: "5.1 声道", 8: "7.1 声道"}


def _looked_up(table: dict, key: Column) -> Column:
    """The value of a key in a small fixed table, null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path of every file below a folder, in any store that Spark reads; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def scan_videos(files: DataFrame, root: str = "", skip_existing: bool = True) -> DataFrame:
    """SRC-1/JOIN-11: path, has_subtitle of the video files, none in a hidden folder. Those without a .srt
    of the same stem are to do (all of them, if existing ones are not to be skipped)."""
    split = files.select("path", F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("ext"))
    below = F.expr(f"substring(path, {len(root) + 1})")
    videos = split.where(F.col("ext").isin(*("." + x for x in C.VIDEO_EXTENSIONS)) & ~below.rlike(r"(^|/)\.[^/]"))
    done = split.where("ext = '.srt'").select("stem").distinct().withColumn("has_subtitle", F.lit(True))
    out = videos.join(done, "stem", "left").select("path", F.coalesce("has_subtitle", F.lit(False)).alias("has_subtitle"))
    return out if skip_existing else out.withColumn("has_subtitle", F.lit(False))


def canon_language(c: Column) -> Column:
    """JOIN-10: the three-letter code of a language tag, unknown ones as they are in lower case."""
    low = F.lower(T.strip(F.coalesce(c, F.lit(""))))
    return F.coalesce(_looked_up(LANGUAGES, low), low)


def language_name(c: Column) -> Column:
    """JOIN-10: what a language tag is called; an unknown code is its own name."""
    code = canon_language(c)
    return F.when(code == "", NO_LANGUAGE).otherwise(F.coalesce(_looked_up(LANGUAGE_NAMES, code), code))


def target_track(c: Column) -> Column:
    """JOIN-10/STR-17: struct (suffix, code) of a target language."""
    name = T.strip(F.coalesce(c, F.lit("")))
    part = lambda k: F.coalesce(_looked_up({n: v[k] for n, v in TARGETS.items()}, name), F.lit(OTHER_TARGET[k]))
    return F.struct(part(0).alias("suffix"), part(1).alias("code"))


def pick_track(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """TOP-3: one track per video: the wanted index, else the wanted language, else the default, else the
    first; ties by language. wanted: video_id, want_index, want_language (null or '' for none)."""
    t = tracks.join(wanted, "video_id", "left")
    rank = F.when(F.col("index") == F.col("want_index"), 0).when((F.coalesce("want_language", F.lit("")) != "") & (canon_language(F.col("language")) == canon_language(F.col("want_language"))), 1).when(F.col("default"), 2).otherwise(3)
    best = F.row_number().over(Window.partitionBy("video_id").orderBy(rank, "index", "language"))
    return t.withColumn("_r", best).where("_r = 1").select(*tracks.columns)


def describe(tracks: DataFrame) -> DataFrame:
    """STR-16: one line about each track: number, language, title, codec with channels, default."""
    channels = F.coalesce(_looked_up(CHANNEL_NAMES, F.col("channels")), F.concat(F.col("channels").cast("string"), F.lit(" 声道")))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("「"), "title", F.lit("」")))
    tail = F.nullif(F.concat_ws(" ", F.nullif("codec", F.lit("")), channels), F.lit(""))
    parts = [F.concat(F.lit("音轨 #"), F.col("index").cast("string")), language_name(F.col("language")), title, tail, F.when(F.col("default"), "(默认)")]
    return tracks.withColumn("description", F.concat_ws(" ", *parts))


def yield_ok(produced: Column, duration: Column) -> Column:
    """SRC-3: decoding gave at least 1 % of the duration."""
    return produced >= duration * C.MIN_YIELD_RATIO


#: Names and files of one part of output_name.
PART = 500_000


def output_name(names: DataFrame, existing: DataFrame) -> DataFrame:
    """SNK-5/STR-17: stem, suffix, path: the first free of stem.suffix.mkv, stem.suffix.2.mkv, ...

    Numbers are read off the existing names; the first one that is missing follows the last of the sorted ones that
    stands at its own place, however many there are. Names and files meet in one shuffle by base, in as many parts as
    their number asks for, so that a part does not grow with the input.
    """
    base = F.regexp_extract("path", r"(?s)^(.*)\.mkv\z", 1)
    numbered = r"(?s)^(.*)\.([2-9]|[1-9][0-9]+)\z"
    files = existing.select(base.alias("b")).where("b <> ''")
    first = F.struct(F.col("b").alias("_base"), F.lit(1).cast("long").alias("n"))
    later = F.struct(F.regexp_extract("b", numbered, 1).alias("_base"), F.regexp_extract("b", numbered, 2).try_cast("long").alias("n"))
    taken = files.select(F.inline(F.array(first, later))).where("n is not null")
    wanted = names.select("stem", "suffix", F.concat_ws(".", "stem", "suffix").alias("_base"), F.lit(None).cast("long").alias("n"), F.lit(True).alias("_own"))
    parts = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), (names.count() + existing.count()) // PART + 1)
    both = wanted.unionByName(taken, allowMissingColumns=True).repartition(parts, "_base")
    order = Window.partitionBy("_base").orderBy(F.asc_nulls_last("n"))
    placed = both.withColumn("_r", F.dense_rank().over(order))
    last = F.max(F.when(F.col("n") == F.col("_r"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    free = placed.withColumn("_free", F.coalesce(last, F.lit(0)) + 1).where("_own").groupBy("_base", "stem", "suffix").agg(F.max("_free").alias("n"))
    number = F.when(F.col("n") > 1, F.col("n").cast("string"))
    return free.select("stem", "suffix", F.concat_ws(".", "_base", number, F.lit("mkv")).alias("path"))


def newest(logs: DataFrame, keep: int = C.KEEP_LOGS) -> DataFrame:
    """TOP-4: logs (job_id, name, mtime) without those beyond the newest ``keep`` of each job."""
    return logs.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("mtime"), F.desc("name")))).where(F.col("_r") <= keep).drop("_r")


def log_tail(lines: DataFrame, n: int) -> DataFrame:
    """TOP-5: the last n lines of a log (line_no, line), in order."""
    return lines.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def listing(files: DataFrame) -> DataFrame:
    """TOP-8: names in case-insensitive order, ties by the name itself."""
    return files.orderBy(F.lower("name"), "name")


def shift_timeline(packets: DataFrame) -> DataFrame:
    """SNK-5: packets (video_id, pts, dts, start_time) moved so that the earlier of the stream's start and
    its first decoding time is 0."""
    first = packets.groupBy("video_id").agg(F.least(F.min("start_time"), F.min("dts")).alias("_zero"))
    return packets.join(first, "video_id").withColumn("pts", F.col("pts") - F.col("_zero")).drop("_zero")
