"""Subtitle files, media tables and job events."""

from pyspark.sql import functions as F

from cuelake.operators import glossary
from cuelake.sources import media, subtitles
from cuelake.streaming import jobs

CUE = "video_id long, index int, start double, end double, text string, translation string"


def test_srt_round_trip(spark):
    ls = spark.createDataFrame([(1, 1, 0.0, 1.5, "good day", "日安"), (1, 2, 2.0, 3.0, "so long", "")], CUE)
    text = subtitles.files_of(subtitles.srt_blocks(ls)).first()["text"]
    assert text == "1\n00:00:00,000 --> 00:00:01,500\ngood day\n日安\n\n2\n00:00:02,000 --> 00:00:03,000\nso long\nso long\n"
    back = subtitles.parse_srt(spark.createDataFrame([("a", text + "\nbroken block")], "path string, text string")).orderBy("pos").collect()
    assert [(r["start"], r["end"], r["body"]) for r in back] == [(0.0, 1.5, "good day\n日安"), (2.0, 3.0, "so long\nso long")]


def test_blocks_are_read_once(spark):
    """Each block is cut into rows once and its timing taken apart once, whatever its line ends are."""
    t1, t2 = "00:00:01,000 --> 00:00:02,500", " 01:02:03.004-->\t01:02:04,005 \t"
    text = f" \n1\r\n{t1}\r\na\r\rb\n\n{t2}\rc\n \t\n2\nno time\n{t1}\n\n\n3\n{t1}\n\n4\r{t1}\r \r\nd \n\u3000\n"
    got = subtitles.parse_srt(spark.createDataFrame([("a", text), ("b", " \n\u3000"), ("c", None)], "path string, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("regexp_extract(") == 2 and plan.count(", split(") + plan.count("(split(") == 2
    rows = [tuple(r) for r in got.orderBy("pos").collect()]
    assert rows == [("a", 0, 1.0, 2.5, t1, "a\n\nb"), ("a", 1, 3723.004, 3724.005, t2, "c"), ("a", 3, 1.0, 2.5, t1, ""), ("a", 4, 1.0, 2.5, t1, " \nd")]


def test_layouts(spark):
    ls = spark.createDataFrame([(1, 1, 0.0, 1.5, "good day", "日安")], CUE)
    shown = lambda **k: subtitles.srt_blocks(ls, **k).first()["block"].split("\n")[2:-1]
    assert shown(layout="translation_top") == ["日安", "good day"] and shown(mode="translation_only") == ["日安"]
    event = subtitles.ass_events(ls).first()["block"]
    assert event == r"Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,{\fs40\c&H00C0C0C0&}good day{\r}\N日安"


def test_insert(spark):
    f = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,000\na\n\n2\n00:00:05,000 --> 00:00:06,000\nb\n")], "video_id long, text string")
    cue = spark.createDataFrame([(1, 3.0, 4.0, "SIGN")], "video_id long, start double, end double, text string")
    assert subtitles.insert_srt(f, cue).first()["text"].split("\n\n")[1] == "2\n00:00:03,000 --> 00:00:04,000\n{\\an7}SIGN"
    head = subtitles.ass_head()
    rows = ["Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,a", "Dialogue: 0,0:00:05.00,0:00:06.00,Default,,0,0,0,,b"]
    a = spark.createDataFrame([(1, head + "\n".join(rows) + "\n")], "video_id long, text string")
    got = subtitles.insert_ass(a, cue).first()["text"]
    assert got.startswith(head) and got.splitlines()[-2].endswith(r"{\an7}SIGN")
    late = spark.createDataFrame([(1, 9.0, 10.0, "END")], "video_id long, start double, end double, text string")
    assert subtitles.insert_ass(a, late).first()["text"].splitlines()[-1].endswith("END")
    plain = spark.createDataFrame([(1, "no dialogue\n")], "video_id long, text string")
    assert subtitles.insert_ass(plain, late).first()["text"].splitlines()[0] == "no dialogue"


def test_read_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    got = subtitles.parse_srt(subtitles.read_files(spark, str(tmp_path))).first()
    assert (got["start"], got["end"], got["body"]) == (1.0, 2.0, "x")


def test_scan(spark, tmp_path):
    for name in ("a.mkv", "b.mp4", "b.srt", "notes.txt", "sub/c.avi", ".hidden/d.mkv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    df = spark.createDataFrame([(str(p),) for p in tmp_path.rglob("*") if p.is_file()], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r["has_subtitle"] for r in media.scan_videos(df, str(tmp_path)).collect()}
    assert got == {"a.mkv": False, "b.mp4": True, "c.avi": False}


def test_tracks(spark):
    t = spark.createDataFrame([(1, 1, "kor", True), (1, 2, "ger", False), (2, 4, "ger", True), (3, 5, "ita", False), (4, 1, "ger", False), (4, 2, "th", False)], "video_id long, index int, language string, default boolean")
    w = spark.createDataFrame([(1, 2, "ko"), (2, 7, "ko"), (3, None, ""), (4, None, "tha")], "video_id long, want_index int, want_language string")
    assert [r["index"] for r in media.pick_track(t, w).orderBy("video_id").collect()] == [2, 4, 5, 2]


CODES = {"ja": "jpn", "jp": "jpn", "jap": "jpn", "en": "eng", "zh": "chi", "zho": "chi", "cmn": "chi", "ko": "kor", "fr": "fre", "fra": "fre", "de": "ger", "deu": "ger", "es": "spa", "ru": "rus", "it": "ita", "pt": "por", "th": "tha", "vi": "vie", "ar": "ara", "hi": "hin"}


def test_languages(spark):
    cases = CODES | {v: v for v in CODES.values()} | {" ZH ": "chi", "tlh": "tlh", "": "", None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    got = {r["l"]: (r["c"], r["n"]) for r in df.select("l", media.canon_language(F.col("l")).alias("c"), media.language_name(F.col("l")).alias("n")).collect()}
    assert {k: c for k, (c, _) in got.items()} == cases
    assert got["cmn"][1] == "中文" and got["vi"][1] == "越南语" and got["tlh"][1] == "tlh" and got[None][1] == "未标注语言"


def test_targets(spark):
    cases = {"简体中文": ("zh", "chi"), "繁體中文": ("zh", "chi"), "English": ("en", "eng"), "日本語": ("ja", "jpn"), "한국어": ("ko", "kor"), " Français": ("fr", "fre"), "Deutsch": ("de", "ger"), "Suomi": ("sub", "und"), None: ("sub", "und")}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r["l"]: tuple(r["t"]) for r in df.select("l", media.target_track(F.col("l")).alias("t")).collect()} == cases


def test_output_name(spark):
    n = spark.createDataFrame([("reel", "zh"), ("reel", "en"), ("full", "ko"), ("gap", "de"), ("late", "fr"), ("a.2", "zh")], "stem string, suffix string")
    taken = ["reel.zh.mkv", "full.ko.mkv", *(f"full.ko.{k}.mkv" for k in range(2, 102)), "gap.de.mkv", "gap.de.2.mkv", "gap.de.4.mkv", "late.fr.2.mkv", "late.fr.03.mkv", "a.2.zh.mkv", "a.zh.2.mkv", "full.ko.99999999999999999999.mkv"]
    e = spark.createDataFrame([(p,) for p in taken], "path string")
    assert sorted(r["path"] for r in media.output_name(n, e).collect()) == ["a.2.zh.2.mkv", "full.ko.102.mkv", "gap.de.3.mkv", "late.fr.mkv", "reel.en.mkv", "reel.zh.2.mkv"]


def test_yield(spark):
    df = spark.createDataFrame([(0.9, 100.0), (1.0, 100.0), (50.0, 100.0)], "p double, d double")
    assert [r["x"] for r in df.select(media.yield_ok(F.col("p"), F.col("d")).alias("x")).collect()] == [False, True, True]


def test_write_and_list_files(spark, tmp_path):
    files = spark.createDataFrame([(1, "a\nb\n"), (2, "c")], "video_id long, text string")
    subtitles.write_files(files, str(tmp_path / "out"))
    got = {r["path"].rsplit("/", 1)[1] for r in media.list_files(spark, str(tmp_path / "out")).collect()}
    assert got == {"1.srt", "2.srt"}
    back = subtitles.read_files(spark, str(tmp_path / "out")).collect()
    assert {r["text"] for r in back} == {"a\nb\n", "c"}


def test_read_ass(spark):
    f = spark.createDataFrame([("x", "[Events]\nDialogue: 0,1:00:02.50,1:00:03.00,Default,,0,0,0,,hi\nComment: 0\n")], "path string, text string")
    assert [(r["pos"], r["start"]) for r in subtitles.parse_ass(f).orderBy("pos").collect()] == [(0, None), (1, 3602.5), (2, None)]


def test_insert_keeps_the_given_order(spark):
    """Cues of equal start stay as given; dialogues need not be sorted; a file without dialogues gets cues as given."""
    rows = [f"Dialogue: 0,0:00:0{s}.00,0:00:09.00,Default,,0,0,0,,d{s}" for s in (5, 2, 7)]
    f = spark.createDataFrame([(1, "\n".join(rows) + "\n"), (2, "none\n")], "video_id long, text string")
    given = [(5.0, "b"), (5.0, "a"), (1.0, "z"), (8.0, "q")]
    c = spark.createDataFrame([(v, k, s, s + 1, t) for v in (1, 2) for k, (s, t) in enumerate(given)], "video_id long, pos long, start double, end double, text string")
    got = {r["video_id"]: [x[-1] if "an7" in x else x[-2:] for x in r["text"].splitlines()] for r in subtitles.insert_ass(f, c).collect()}
    assert got == {1: ["z", "d5", "d2", "b", "a", "d7", "q"], 2: ["ne", "b", "a", "z", "q"]}
    srt = spark.createDataFrame([(1, "1\n00:00:05,000 --> 00:00:06,000\nold\n")], "video_id long, text string")
    texts = [b.split("\n")[2] for b in subtitles.insert_srt(srt, c.where("video_id = 1")).first()["text"].split("\n\n")]
    assert texts == ["{\\an7}z", "old", "{\\an7}b", "{\\an7}a", "{\\an7}q"]


def test_frames(spark):
    r = spark.createDataFrame([(1, 2.0004, 3.0, " EXIT "), (1, 4.0, 3.0, "[无文字]"), (1, 5.0, 3.0, ""), (1, 6.0, 3.0, None)], "video_id long, start double, duration double, reply string")
    cues = subtitles.frame_cues(r)
    assert [tuple(x) for x in cues.collect()] == [(1, 2.0, 5.0, "EXIT")]
    ls = spark.createDataFrame([(1, 1, 2.0, 3.0, "one", "eins"), (1, 2, 4.0, 5.0, "two", "zwei")], CUE)
    shown = [b.split("\n")[2] for b in subtitles.files_of(subtitles.srt_blocks(subtitles.with_frames(ls, cues))).first()["text"].split("\n\n")]
    assert shown == ["one", "{\\an7}EXIT", "two"]


def test_frame_times(spark):
    from cuelake.operators import verify

    t = spark.createDataFrame([(1, "0:30"), (1, "2:00"), (1, "soon"), (2, "5")], "video_id long, time string")
    d = spark.createDataFrame([(1, 60.0)], "video_id long, duration double")
    assert {(r["time"], r["valid"]) for r in verify.time_valid(t, d).collect()} == {("0:30", True), ("2:00", False), ("soon", False), ("5", False)}


def test_glossary(spark):
    r = spark.createDataFrame([(1, 1, "Mira → 米拉\nOslo → 奥斯陆"), (1, 2, "Mira → 蜜拉\nTor → 托尔")], "batch_id long, episode_no long, reply string")
    t = glossary.terms_of(r)
    learned = glossary.learn(t, 2)
    assert [(x["source"], x["target"]) for x in learned.orderBy("n").collect()] == [("Mira", "米拉"), ("Oslo", "奥斯陆")]
    assert [(x["source"], x["target"]) for x in glossary.clashes(t, learned).collect()] == [("Mira", "蜜拉")]
    own = spark.createDataFrame([("Mira",)], "source string")
    assert "Mira" not in {x["source"] for x in glossary.unprotected(t, own).collect()}


def test_logs_and_json(spark):
    e = spark.sql("select 'j' job_id, 1L seq, timestamp'2024-01-02 03:04:05' ts, 'refining' stage, 61.5d progress, 'half' message, 'a\\nb' log")
    assert [r["line"] for r in jobs.log_lines(e).orderBy("line_no").collect()] == [f"[03:04:05] [refining      61.5%] {x}" for x in ("half", "a", "b")]
    table = spark.createDataFrame([(1, None, 2.5), (2, "x", None)], "a long, b string, c double")
    text = jobs.as_json(table)
    assert text.first()["json"] == '{"a":1,"b":null,"c":2.5}'
    assert sorted(jobs.from_json(text, table.schema).collect()) == sorted(table.collect())


def test_sessions_merge_like_windows(spark):
    e = spark.sql("select 1L video_id, timestamp_seconds(s) ts, d seconds from values (0, 10d), (20, 5d), (100, 1d) t(s, d)")
    got = sorted((r["start"].timestamp(), r["n"]) for r in jobs.sessions(e, 15.0).collect())
    assert [n for _, n in got] == [2, 1]
