"""All-blank retry, diagnostic logs, and the frame-only supplement of finished films."""

from pyspark.sql import functions as F

from cuelake.operators import segments
from cuelake.plans import film
from cuelake.sources import subtitles
from cuelake.streaming import logs


class Decoder:
    def __init__(self, spark, primed, unprimed):
        kind = "video_id long, start double, end double, text string"
        self.tables, self.asked = {True: spark.createDataFrame(primed, kind), False: spark.createDataFrame(unprimed, kind)}, []

    def decode(self, videos, primed):
        self.asked.append((primed, sorted(r["video_id"] for r in videos.collect())))
        return self.tables[primed].join(videos, "video_id", "left_semi")


def test_blank_films_are_decoded_once_more(spark):
    at = lambda v, *texts: [(v, float(k), k + 1.0, t) for k, t in enumerate(texts)]
    primed = at(1, " hello ", "…", "", None) + at(2, "-", " - ", "-") + at(3, "-") + at(4, "", " ") + at(5, "fine")
    decoder = Decoder(spark, primed, at(2, "now", "♪", "heard") + at(3, "…", "…") + at(1, "never asked"))
    videos = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 6, 2)], "video_id long")
    got, report = segments.transcribe(videos, decoder)
    assert decoder.asked == [(True, [1, 2, 3, 4, 5, 6]), (False, [2, 3])]
    assert sorted((r["video_id"], r["text"]) for r in got.collect()) == [(1, "hello"), (2, "heard"), (2, "now"), (5, "fine")]
    rows = {r["video_id"]: (r["kept"], r["blank"], r["share"], r["warn"], r["retried"]) for r in report.collect()}
    assert rows == {1: (1, 1, 0.5, True, False), 2: (2, 1, 1 / 3, True, True), 3: (0, 2, 1.0, True, True), 4: (0, 0, None, False, False), 5: (1, 0, 0.0, False, False), 6: (0, 0, None, False, False)}


def test_debug_log(spark):
    rows = [(1, 3, "block", "reply", "x" * 12, None), (1, 1, "section", "ASR", None, 90.0), (1, 2, "kv", "language", "ja (98%)", None), (1, 4, "line", None, "done", None), (2, 1, "block", "b", "y" * 9, 0.0)]
    got = {r["job_id"]: r["text"] for r in logs.debug_logs(spark.createDataFrame(rows, "job_id long, seq long, kind string, title string, body string, elapsed double"), "=== log ===\n", 9).collect()}
    rule = "=" * 78
    assert got[1] == f"=== log ===\n\n\n{rule}\n== ASR    [任务开始后 1.5 分钟]\n{rule}\nlanguage{' ' * 20}: ja (98%)\n\n--- reply ---\n{'x' * 9}\n…（已截断，原长度 12 字符）\n--- /reply ---\ndone\n"
    assert got[2] == "=== log ===\n\n--- b ---\nyyyyyyyyy\n--- /b ---\n"
    assert logs.MOST == 200_000


def test_supplement(spark):
    srt = "1\n00:00:05,000 --> 00:00:06,000\nHello.\n"
    ass = subtitles.ass_head() + "Dialogue: 0,0:00:05.00,0:00:06.00,Default,,0,0,0,,Hello.\n"
    files = spark.createDataFrame([(1, srt, "srt"), (2, ass, "ass"), (3, srt, "srt")], "video_id long, text string, kind string")
    tasks = [(1, "0:02", 1.5), (1, "1:10", None), (1, "2", 1.5), (1, "3:20", None), (1, "x:1", None), (1, "-3", None), (2, "7.25", 2.0), (3, "1", None), (9, "1", None)]
    durations = spark.createDataFrame([(1, 100.0), (2, 60.0), (3, 60.0), (9, 60.0)], "video_id long, duration double")
    said = F.create_map(*(F.lit(x) for x in ("2.000", "HARBOUR", "70.000", " ", "7.250", "EXIT {1}", "1.000", "[无文字]")))
    model = film.ColumnCompleter(F.when(F.col("stage") == "frame", said[F.col("body")]))
    out, refused = film.supplement(files, spark.createDataFrame(tasks, "video_id long, time string, duration double"), durations, model)
    got = {r["video_id"]: (r["kind"], r["text"]) for r in out.collect()}
    assert got[1] == ("srt", "1\n00:00:02,000 --> 00:00:03,500\n{\\an7}HARBOUR\n\n2\n00:00:05,000 --> 00:00:06,000\nHello.\n")
    assert got[2][1] == ass + "Dialogue: 0,0:00:07.25,0:00:09.25,Default,,0,0,0,,{\\an7}EXIT （1）\n" and got[3] == ("srt", srt) and len(got) == 3
    assert sorted(map(tuple, refused.collect())) == [(1, "-3", "not a time"), (1, "3:20", "beyond the film"), (1, "x:1", "not a time"), (9, "1", "no file")]
