"""Scalar functions on scripts that the driver's tables do not have."""

import re

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [("--", False), ("……", False), ("、、", False), ("?!", False), ("♫♪", False), ("__", False), ("　", False), ("山", True), ("ん。", True), ("7", True), ("（笑）", True), ("é", True)])
def test_has_content(spark, text, expected):
    assert one(spark, text, T.has_content) is expected


@pytest.mark.parametrize("text, n", [("雨が止んだ", 5), ("the rain has stopped", 4), ("　\t", 0), ("", 0), ("비가 그쳤다", 6)])
def test_units(spark, text, n):
    assert one(spark, text, T.units) == n


@pytest.mark.parametrize("text", ["uphill", "two rivers", "山", "海へ", "the lighthouse"])
def test_fragments(spark, text):
    assert one(spark, text, T.is_fragment)


@pytest.mark.parametrize("text", ["Stop.", "Who?", "Not now!", "山。", "海へ行く", "one two three", "unmistakably-overlong-word"])
def test_no_fragments(spark, text):
    assert not one(spark, text, T.is_fragment)


@pytest.mark.parametrize("text, run", [("海へ行く道", True), ("海へ 行く道", False), ("abc海へ", False), ("a海へ行く", True)])
def test_unspaced_runs(spark, text, run):
    assert one(spark, text, T.is_unspaced_run) is run


@pytest.mark.parametrize("seconds, shown", [(0.0, "00:00:00,000"), (7322.25, "02:02:02,250"), (-3.0, "00:00:00,000"), (59.9997, "00:01:00,000")])
def test_srt_time(spark, seconds, shown):
    assert spark.range(1).select(T.srt_time(F.lit(seconds)).alias("x")).first()["x"] == shown


def test_other_clocks(spark):
    got = spark.range(1).select(T.ass_time(F.lit(3725.678)).alias("a"), T.log_time(F.lit(3725.6784)).alias("l"), T.log_time(F.lit(-2.0)).alias("n")).first()
    assert tuple(got) == ("1:02:05.68", "1:02:05.678", "0:00:00.000")


@pytest.mark.parametrize("text, s", [("90", 90.0), ("2:05.5", 125.5), ("2:00:10", 7210.0), (" 1:07 ", 67.0), ("", None), ("x:1", None), ("0:1:2:3", None), ("-9", None), ("4::1", None)])
def test_parse_time(spark, text, s):
    assert one(spark, text, T.parse_time) == s


@pytest.mark.parametrize("a, b, joined", [("雨が", "降る", "雨が降る"), ("we", "go", "we go"), ("", "y", "y"), ("y", "", "y"), ("비가", "와", "비가 와"), ("ok", "、はい", "ok、はい")])
def test_join(spark, a, b, joined):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.join_text(F.col("a"), F.col("b")).alias("x")).first()["x"] == joined


def test_wrap(spark):
    assert one(spark, "tiny", lambda c: T.wrap(c, 42)) == ["tiny"]
    assert one(spark, "海" * 60, lambda c: T.wrap(c, 42)) == ["海" * 30] * 2
    assert one(spark, "z" * 70, lambda c: T.wrap(c, 42)) == ["z" * 70]
    assert one(spark, "red green blue black white", lambda c: T.wrap(c, 16)) == ["red green blue", "black white"]


def test_colors_and_marks(spark):
    assert one(spark, "#a1b2c3", T.ass_color) == "&H00C3B2A1"
    assert one(spark, "#ab", T.ass_color) == "&H00FFFFFF"
    marked = one(spark, "♪ row  row ♪", lambda c: T.apply_marks(c, F.lit(True)))
    assert marked == "♪ row row ♪" == one(spark, marked, lambda c: T.apply_marks(c, F.lit(True)))
    assert one(spark, "♪", lambda c: T.apply_marks(c, F.lit(True))) == ""


def test_tokens(spark):
    assert one(spark, "海辺の abcd", T.estimate_tokens) == 5


@pytest.mark.parametrize("text, single", [("We left early.", True), ("Go. Now.", False), ("!!", False), ("『雨だ。』", True), ("open end", True)])
def test_single_sentence(spark, text, single):
    assert one(spark, text, T.is_single_sentence) is single


def test_rejects_thinking(spark):
    hints = ["unknown parameter", "not supported"]
    assert one(spark, "Error: UNKNOWN parameter 'x'", lambda c: T.rejects_thinking(c, hints)) is True
    assert one(spark, "timeout", lambda c: T.rejects_thinking(c, hints)) is False


def test_long_texts_are_cut_at_the_nearest_break(spark):
    """Against a search over every place; texts of over twice the limit."""
    import random

    rnd = random.Random(4)
    texts = ["a" + "".join(rnd.choice("abc ,.。é😀") if rnd.random() < 0.3 else "x" for _ in range(rnd.randrange(20, 60))) + "b" for _ in range(300)]
    texts = [t for t in texts if len(re.sub(" {2,}", " ", t)) - 1 > 10]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.wrap(F.col("t"), 5).alias("w")).collect()
    for r in got:
        t = r["t"]
        places = [i if t[i] == " " else i + 1 for i in range(1, len(t) - 1) if t[i] in T.BREAKS]
        k = min(places, key=lambda k: (abs(k - len(t) / 2), k), default=None)
        assert r["w"] == ([t] if k is None else [t[:k].strip(), t[k:].strip()])


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wrap_does_not_go_over_every_place(spark):
    """Neither an array of characters nor one of places, each trimmed twice; and the same places as a search over all of them,
    with runs of blanks that decide what fits."""
    import random

    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab ,.。é😀") if rnd.random() < 0.4 else "x" for _ in range(rnd.randrange(1, 40))) for _ in range(200)]
    texts += [t[: len(t) // 2] + rnd.choice([" ", "\t ", "　"]) * rnd.randrange(1, 20) + t[len(t) // 2 :] for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.wrap(F.col("t"), 9).alias("w"))
    assert "sequence(" not in plan(df) and "split(" not in plan(df)
    for r in df.collect():
        t = r["t"].strip()
        halves = lambda k: [t[:k].strip(), t[k:].strip()]
        places = [i if t[i] == " " else i + 1 for i in range(1, len(t) - 1) if t[i] in T.BREAKS]
        k = min(places, key=lambda k: (max(map(len, halves(k))) > 9, abs(k - len(t) / 2), k), default=None)
        assert r["w"] == ([t] if len(t) <= 9 or k is None else halves(k))
