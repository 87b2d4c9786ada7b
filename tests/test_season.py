"""Series: what each request holds, and that order decides only who is first."""

from pyspark.sql import functions as F

from cuelake import constants as C
from cuelake.operators import glossary
from cuelake.plans import film, season, season_queries

WORD = "video_id long, seg_no long, word_no long, start double, end double, text string"
SEG = "video_id long, seg_no long, start double, end double, text string"
EPISODE = "batch_id long, episode_no long, video_id long"


class Recorder:
    """Asks another model and keeps what was asked."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def complete(self, requests):
        self.asked += requests.collect()
        return self.model.complete(requests)

    def of(self, video, stage, chunk=0):
        return next(r for r in self.asked if (r["video_id"], r["stage"], r["chunk_id"]) == (video, stage, chunk))


def rule(replies):
    """Glossaries by film; translations are the text in capitals."""
    named = F.create_map(*(F.lit(x) for pair in replies.items() for x in pair))[F.col("video_id")]
    lines = F.transform(F.split("body", "\n"), F.upper)
    return film.ColumnCompleter(F.when(F.col("stage") == "glossary", named).when(F.col("stage") == "translate", F.array_join(lines, "\n")))


def bare_of(spark, films, n=2):
    rows = [(v, k, 4.0 * k, 4.0 * k + 2, f"Line {k} of film {v} ends here.") for v in films for k in range(1, n + 1)]
    return spark.createDataFrame(rows, SEG)


def test_terms_reach_later_episodes(spark):
    episodes = spark.createDataFrame([(1, 1, 11), (1, 2, 12), (1, 3, 13), (2, 5, 21), (2, 7, 22)], EPISODE)
    replies = {11: "Ann → A1\nBob → B1\nHall → mine", 12: "Ann → A2\nCyd → C2\nCyd → C3", 13: "Bob → B3", 21: "Ann → X", 22: "Ann → X\nDee → D"}
    model = Recorder(rule(replies))
    got = season.produce(episodes, spark.createDataFrame([], WORD), bare_of(spark, (11, 12, 13, 21, 22)), model, user=" Hall → Saal \n")
    assert sorted(map(tuple, got.terms.collect())) == [(1, "Ann", "A1", 1), (1, "Bob", "B1", 2), (1, "Cyd", "C2", 3), (2, "Ann", "X", 1), (2, "Dee", "D", 2)]
    assert sorted((r["batch_id"], r["episode_no"], r["source"], r["settled"], r["target"]) for r in got.clashes.collect()) == [(1, 2, "Ann", "A1", "A2"), (1, 2, "Cyd", "C2", "C3"), (1, 3, "Bob", "B1", "B3")]
    before = {11: "Hall → Saal", 12: "Hall → Saal\nAnn → A1\nBob → B1", 13: "Hall → Saal\nAnn → A1\nBob → B1\nCyd → C2", 21: "Hall → Saal", 22: "Hall → Saal\nAnn → X"}
    for video, text in before.items():
        for stage in ("refine", "glossary"):
            r = model.of(video, stage)
            assert r["glossary"] == text and r["prompt"] == f"{text}\n\n{r['body']}"
        assert model.of(video, "translate")["glossary"] == f"{text}\n{replies[video]}"
    assert got.film.lines.where("translation = upper(text)").count() == 10 and got.film.missing.count() == 0
    assert got.film.files.count() == 5 and got.film.stages["transcript"].count() == 10


def test_context_is_the_end_of_the_batch_before(spark):
    bare = bare_of(spark, (1,), 25).unionByName(bare_of(spark, (2,), 3))
    lines = film.prepared(spark.createDataFrame([], WORD), bare, film.ColumnCompleter(F.lit(None).cast("string"))).lines
    model = Recorder(rule({0: ""}))
    out = film.translated(lines, model, size=12)
    assert out.where("translation = upper(text)").count() == out.count() == 28
    assert [model.of(1, "translate", k)["context"] is None for k in range(3)] == [True, False, False]
    assert model.of(2, "translate")["context"] is None and len([r for r in model.asked if r["video_id"] == 2]) == 1
    for k in (1, 2):
        r = model.of(1, "translate", k)
        rows = [(n, f"Line {n} of film 1 ends here.") for n in range(12 * k - C.TAIL_LINES + 1, 12 * k + 1)]
        assert r["context"] == "\n".join(f"[{n}] {t} → {t.upper()}" for n, t in rows)
        assert r["prompt"] == f"{r['context']}\n\n{r['body']}" and r["body"].startswith(f"[{12 * k + 1}] ")


def test_a_retry_is_in_the_next_context(spark):
    """Lines that a second request brought are in the tail that the next batch sees."""
    lines = film.prepared(spark.createDataFrame([], WORD), bare_of(spark, (1,), 4), film.ColumnCompleter(F.lit(None).cast("string"))).lines
    table = [(1, "translate", 0, 1, "[1] one"), (1, "translate", 0, 2, "[2] two"), (1, "translate", 1, 1, "[3] three\n[4] four")]
    model = Recorder(film.TableCompleter(spark.createDataFrame(table, "video_id long, stage string, chunk_id int, attempt int, reply string")))
    got = film.translated(lines, model, size=2)
    assert {r["index"]: r["translation"] for r in got.collect()} == {1: "one", 2: "two", 3: "three", 4: "four"}
    assert model.of(1, "translate", 1)["context"].endswith("ends here. → two")


def test_order_only_decides_who_is_first(spark):
    """Whatever order episodes have, the settled terms are those of FOLD-12 in that order, and each source is settled."""
    own = spark.createDataFrame([(v, k, f"{w} says {v}") for v in range(1, 5) for k, w in enumerate(["Anna", "Bert", f"Only{'abcd'[v - 1]}"][: 1 + v % 3], 1)], "video_id long, index int, text string")
    sources = None
    for order in ((1, 2, 3, 4), (4, 3, 2, 1), (2, 4, 1, 3)):
        plan = season.rounds(spark.createDataFrame([(1, e, v) for e, v in enumerate(order)], EPISODE))
        terms, clashes, _ = season.settled_terms(plan, lambda k, now: own.join(now.select("video_id"), "video_id"), season_queries.stand_in())
        named = {v: [r["text"].split()[0] for r in own.where(F.col("video_id") == v).orderBy("index").collect()] for v in order}
        asked = [(1, e, n, w, f"{w.lower()}{len(named[v])}") for e, v in enumerate(order) for n, w in enumerate(named[v])]
        all_terms = spark.createDataFrame(asked, "batch_id long, episode_no long, line_no int, source string, target string")
        assert sorted(map(tuple, terms.collect())) == sorted(map(tuple, glossary.learn(all_terms).collect()))
        assert sorted(map(tuple, clashes.collect())) == sorted(map(tuple, glossary.clashes(all_terms, glossary.learn(all_terms)).collect()))
        seen = {r["source"] for r in terms.collect()}
        assert sources is None or sources == seen
        sources = seen


def test_no_episodes(spark):
    none = spark.createDataFrame([], EPISODE)
    got = season.produce(none, spark.createDataFrame([], WORD), spark.createDataFrame([], SEG), film.ColumnCompleter(F.lit(None).cast("string")))
    assert got.terms.count() == got.clashes.count() == got.film.lines.count() == got.film.files.count() == 0


def test_sampling_counts_a_line_once(spark):
    """The characters of a line are counted by one pattern; episodes are told without cutting documents into lines."""
    from cuelake.operators import cues

    lines = spark.createDataFrame([(1, k, "海 abc" * (k % 7)) for k in range(1, 200)], "video_id long, index int, text string")
    assert cues.sample(lines)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    docs = spark.createDataFrame([(5, " \n\u3000\n"), (6, "\n a"), (7, None), (8, ""), (9, "\u00a0\u6d77")], "doc_id long, text string")
    episodes = season_queries._episodes(docs)
    assert sorted(r["video_id"] for r in episodes.collect()) == [6, 9]
    assert "explode" not in episodes._jdf.queryExecution().optimizedPlan().toString()
