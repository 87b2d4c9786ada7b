"""The stages chained, with replies from a table; the glossary as a stream."""

import random

from pyspark.sql import functions as F

from cuelake.operators import cues, glossary, metrics
from cuelake.plans import film
from cuelake.sources import media
from cuelake.streaming import jobs, series

WORD = "video_id long, seg_no long, word_no long, start double, end double, text string"
SEG = "video_id long, seg_no long, start double, end double, text string"
REPLY = "video_id long, stage string, chunk_id int, attempt int, reply string"


def test_chain(spark):
    bare = spark.createDataFrame([(1, 1, 0.0, 2.0, "I went to the old river"), (1, 2, 4.0, 6.0, "It was very cold."), (1, 3, 8.0, 10.0, "la la love"), (1, 4, 12.0, 14.0, "good bye")], SEG)
    table = spark.createDataFrame(
        [(1, "refine", 0, 1, "[1] I went to the old river.\n[2] It was very cold.\n[3] la la love\n[4] good bye"), (1, "lyrics", 0, 1, "[3-3] la la | love"), (1, "translate", 0, 1, "[1] eins\n[2] zwei"), (1, "translate", 0, 2, "[3] drei")],
        REPLY,
    )
    got = film.produce(spark.createDataFrame([], WORD), bare, film.TableCompleter(table))
    rows = got.lines.orderBy("index").collect()
    assert [(r["text"], r["translation"], r["is_lyric"]) for r in rows] == [("I went to the old river.", "eins", False), ("It was very cold.", "zwei", False), ("♪ la la love ♪", "♪ drei ♪", True), ("good bye", "", False)]
    assert [r["index"] for r in got.missing.collect()] == [4]
    text = got.files.first()["text"]
    assert text.startswith("1\n00:00:00,000 --> 00:00:02,000\nI went to the old river.\neins\n") and text.endswith("good bye\ngood bye\n")


def test_no_replies_keep_lines(spark):
    bare = spark.createDataFrame([(1, 1, 0.0, 2.0, "I went to the old river")], SEG)
    got = film.produce(spark.createDataFrame([], WORD), bare, film.TableCompleter(spark.createDataFrame([], REPLY)))
    assert [(r["text"], r["translation"]) for r in got.lines.collect()] == [("I went to the old river", "")]


def test_glossary_stream(spark, tmp_path):
    r = spark.createDataFrame([(1, 1, "a → x\nb → y"), (1, 2, "a → z\nc → w\nd → v"), (2, 1, "a → q")], "batch_id long, episode_no long, reply string")
    terms = glossary.terms_of(r)
    terms.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(terms.schema).parquet(str(tmp_path / "t"))
    got = series.settled_now(jobs.run_once(series.learn_stream(stream, 3), "glossary_stream", "update")).collect()
    want = glossary.learn(terms, 3).collect()
    assert {tuple(x)[:3] for x in got} == {(x["batch_id"], x["source"], x["target"]) for x in want}


def test_describe(spark):
    t = spark.createDataFrame([(1, "jpn", "", "aac", 2, 48000, True), (2, "", "Comment", "ac3", 6, 44100, False)], "index int, language string, title string, codec string, channels int, sample_rate int, default boolean")
    assert [r["description"] for r in media.describe(t).collect()] == ["音轨 #1 日语 aac 立体声 (默认)", "音轨 #2 未标注语言 「Comment」 ac3 5.1 声道"]


def test_lists(spark):
    lines = spark.createDataFrame([(k, f"l{k}") for k in range(9)], "line_no long, line string")
    assert [r["line_no"] for r in media.log_tail(lines, 2).collect()] == [7, 8]
    names = spark.createDataFrame([("b",), ("A",), ("C",)], "name string")
    assert [r["name"] for r in media.listing(names).collect()] == ["A", "b", "C"]
    p = spark.createDataFrame([(1, 10.0, 8.0, 9.0), (1, 12.0, 11.0, 9.0)], "video_id long, pts double, dts double, start_time double")
    assert sorted(r["pts"] for r in media.shift_timeline(p).collect()) == [2.0, 4.0]


SEGS = "video_id long, seg_no long, pos long, start double, end double, text string, recovered boolean"


def test_vet(spark):
    """A bad reply is asked for again; what fails twice loses its recovered segments, the first pass stays."""
    rows = [(v, k, k, k * 4.0, k * 4.0 + 2, f"segment {k} of film {v}.", k % 2 == 0) for v in (1, 2, 3) for k in range(1, 7)]
    table = [(1, "vet", 0, 1, "[R1] keep\n[R2] drop: hum\n[R3] keep"), (2, "vet", 0, 1, "[R1] keep"), (2, "vet", 0, 2, "R1 drop\nR2 keep\nR3 drop"), (3, "vet", 0, 1, "[R9] keep"), (3, "vet", 0, 2, "nothing")]
    got = film.vet(spark.createDataFrame(rows, SEGS), film.TableCompleter(spark.createDataFrame(table, REPLY))).collect()
    assert {v: sorted(r["pos"] for r in got if r["video_id"] == v) for v in (1, 2, 3)} == {1: [1, 2, 3, 5, 6], 2: [1, 3, 4, 5], 3: [1, 3, 5]}


def test_vet_gives_up(spark):
    """After two failed chunks in a row the rest loses its recovered segments even with good replies."""
    rows = [(1, k, k, k * 4.0, k * 4.0 + 2, "字" * 6000, True) for k in range(1, 9)]
    table = [(1, "vet", c, a, "\n".join(f"[R{n}] keep" for n in (2 * c + 1, 2 * c + 2)) if c in (0, 3) else "?") for c in range(4) for a in (1, 2)]
    got = film.vet(spark.createDataFrame(rows, SEGS).withColumn("text", F.substring("text", 1, 5900)), film.TableCompleter(spark.createDataFrame(table, REPLY))).collect()
    assert sorted(r["pos"] for r in got) == [1, 2]


def test_realigned(spark):
    rnd = random.Random(8)
    bare = spark.createDataFrame([(1, k, k * 5.0, k * 5.0 + 3, f"{'word ' * rnd.randrange(1, 8)}number {k} ends here.") for k in range(1, 31)], SEG)
    lines = cues.segment(spark.createDataFrame([], WORD), bare).withColumn("is_lyric", F.lit(False))
    t = {r["index"]: r["text"] for r in lines.collect()}
    n = len(t)
    shifted, right = ("\n".join(f"[{k}] {t[(k + s - 1) % n + 1].upper()}" for k in t) for s in (5, 0))
    for again, want in ((right, {k: x.upper() for k, x in t.items()}), (shifted, {k: t[(k + 4) % n + 1].upper() for k in t})):
        model = film.TableCompleter(spark.createDataFrame([(1, "translate", 0, 1, shifted), (1, "align", 0, 1, again)], REPLY))
        assert {r["index"]: r["translation"] for r in film.translated(lines, model).collect()} == want


def test_batches_that_go_along_are_not_moved(spark):
    """Without an odd batch the lines stay the table they are; with one, the lines of all others are kept and none is lost."""
    model = film.TableCompleter(spark.createDataFrame([(2, "align", 0, 1, "\n".join(f"[{k}] {'x' * k}" for k in range(1, 31)))], REPLY))
    rows = [(v, k, "t" * k, False, 0, "x" * (k if v == 1 else 31 - k)) for v in (1, 2) for k in range(1, 31)]
    lines = spark.createDataFrame(rows, "video_id long, index int, text string, is_lyric boolean, chunk_id int, translation string")
    even = lines.where("video_id = 1")
    assert film.aligned(even, model) is even
    got = film.aligned(lines, model)
    assert got.columns == lines.columns and sorted((r["video_id"], r["index"], r["translation"]) for r in got.collect()) == [(v, k, "x" * k) for v in (1, 2) for k in range(1, 31)]


def test_whole_film(spark, tmp_path):
    bare = spark.createDataFrame([(1, 1, 1, 0.0, 2.0, "The tide came in.", False), (1, 2, 2, 3.0, 5.0, "static noise", True), (1, 3, 3, 6.0, 8.0, "We went home", False), (1, 4, 4, 8.5, 10.0, "before dark.", False)], SEGS)
    table = [(1, "vet", 0, 1, "[R1] drop"), (1, "refine", 0, 1, "[1] The tide came in.\n[2] We went home before dark."), (1, "translate", 0, 1, "[1] A\n[2] B")]
    frames = spark.createDataFrame([(1, 4.0, 2.0, "HARBOUR")], "video_id long, start double, duration double, reply string")
    got = film.produce(spark.createDataFrame([], WORD), bare, film.TableCompleter(spark.createDataFrame(table, REPLY)), frames=frames)
    assert [b.split("\n")[2:] for b in got.files.first()["text"].strip().split("\n\n")] == [["The tide came in.", "A"], ["{\\an7}HARBOUR"], ["We went home before dark.", "B"]]
    assert tuple(got.counters.first()) == (1, 0, 0, 0) and got.rejected.count() == 0 and got.missing.count() == 0
    film.write_stages(got, str(tmp_path))
    assert spark.read.json(str(tmp_path / "translation")).count() == 2
    assert film.batch_tail(got.lines.withColumn("chunk_id", F.lit(0)), 1).first()["context"] == "[2] We went home before dark. → B"


def test_usage_line(spark):
    t = spark.createDataFrame([("k", 1200, 5, 7)], "k string, prompt_tokens long, completion_tokens long, cached_tokens long")
    got = metrics.tally(t, "k").select(metrics.usage_line("refine").alias("x")).first()["x"]
    assert got == "refine: 1 calls, 1,200 tokens in (7 cached), 5 out"
