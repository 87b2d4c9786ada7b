"""A batch of series: episodes that share the terms settled by the episodes before them.

Episode 5 must call people what episode 1 called them, so episodes of one series wait for each other, while
series do not. The work goes in rounds: round k takes the k-th episode of every series at once, with the terms that
rounds 0 to k-1 settled joined to its requests, and settles what its own sample of lines names anew. Terms of an
episode do not depend on its translation, so no round waits for one: all films are translated together afterwards,
batch by batch (see film.translated). There are as many rounds as the longest series has episodes; the work of all
series in a round is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake import constants as C
from cuelake.operators import glossary
from cuelake.operators.replies import parse_terms
from cuelake.plans import film
from cuelake.session import cut, written


@dataclass
class Season:
    """The films together, the settled terms of each series (batch_id, source, target, n), the renderings that
    came too late (batch_id, episode_no, line_no, source, settled, target), and what each film was given as glossary."""

    film: film.Film
    terms: DataFrame
    clashes: DataFrame
    glossaries: DataFrame


def rounds(episodes: DataFrame) -> DataFrame:
    """episodes (batch_id, episode_no, video_id) with round, from 0 within each series."""
    order = Window.partitionBy("batch_id").orderBy("episode_no", "video_id")
    return episodes.withColumn("round", F.row_number().over(order) - 1)


def settled_terms(
    plan: DataFrame,
    prepare: Callable[[int, DataFrame], DataFrame],
    model: film.Completer,
    user: str = "",
    cap: int = C.MAX_TERMS,
    context_limit: int = C.CONTEXT_LIMIT,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, clashes, glossaries) of a plan from rounds(). prepare gives the lines of a round's films, from its
    number and their glossaries (video_id, glossary). user: the user's own glossary; its terms are never settled.

    glossaries (video_id, glossary) is what a film is translated with: the user's text, the terms settled before
    its episode, then what the model named for the film itself.
    """
    spark = plan.sparkSession
    last = plan.agg(F.max("round")).first()[0]
    own = spark.range(1).select(F.explode(parse_terms(F.lit(user))).alias("t")).select("t.source")
    none = spark.createDataFrame([], "batch_id long, episode_no long, line_no int, source string, target string")
    settled, clashes, glossaries = glossary.learn(none), [], []
    for k in range(-1 if last is None else last + 1):
        now = plan.where(F.col("round") == k)
        before = glossary.merged(settled, user)
        given = now.join(before, "batch_id", "left").withColumn("glossary", F.coalesce("glossary", F.lit(user.strip())))
        given = cut(given.select("batch_id", F.col("episode_no").cast("long").alias("episode_no"), "video_id", "glossary"))
        shared = given.select("video_id", "glossary")
        replies = cut(film.own_terms(prepare(k, shared), model, shared, context_limit))
        new = cut(glossary.unprotected(glossary.terms_of(given.join(replies, "video_id")), own))
        settled = cut(glossary.learn_more(settled, new, cap))
        clashes.append(cut(glossary.clashes(new, settled)))
        both = F.concat_ws("\n", *(F.when(F.col(c) != "", F.col(c)) for c in ("glossary", "reply")))
        glossaries.append(cut(shared.join(replies, "video_id", "left").select("video_id", both.alias("glossary"))))
    if not glossaries:
        return settled, glossary.clashes(none, settled), spark.createDataFrame([], "video_id long, glossary string")
    return settled, reduce(DataFrame.unionByName, clashes), reduce(DataFrame.unionByName, glossaries)


def produce(
    episodes: DataFrame,
    words: DataFrame,
    bare: DataFrame,
    model: film.Completer,
    user: str = "",
    mode: str = "bilingual",
    layout: str = "original_top",
    max_chars: int = C.MAX_CHARS_PER_LINE,
    max_duration: float = C.MAX_DURATION,
    frames: DataFrame | None = None,
) -> Season:
    """film.produce for all episodes (batch_id, episode_no, video_id) of many series, each with the terms that the
    episodes before it settled. Words and segments are written once by round, so a round reads its own films."""
    plan = cut(rounds(episodes))
    own = plan.select("video_id", "round")
    done: list[film.Prepared] = []
    with written(words.join(own, "video_id"), "round") as w, written(bare.join(own, "video_id"), "round") as b:

        def prepare(k: int, shared: DataFrame) -> DataFrame:
            now_words, now_bare = (t.where(F.col("round") == k).drop("round") for t in (w, b))
            done.append(film.prepared(now_words, now_bare, model, max_chars, max_duration, shared))
            return done[-1].lines

        terms, clashes, glossaries = settled_terms(plan, prepare, model, user)
    if not done:
        done.append(film.prepared(words.limit(0), bare.limit(0), model, max_chars, max_duration))
    names = ("transcript", "refined", "judged", "lines")
    whole = film.Prepared(*(reduce(DataFrame.unionByName, (getattr(p, n) for p in done)) for n in names))
    lines = cut(film.translated(whole.lines, model, glossary=glossaries))
    return Season(film.finished(whole, lines, mode, layout, max_chars, frames), terms, clashes, glossaries)
