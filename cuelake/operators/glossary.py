"""Series glossary: first-wins terms over ordered episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake import constants as C
from cuelake.operators.replies import parse_terms


def terms_of(replies: DataFrame) -> DataFrame:
    """batch_id, episode_no, line_no, source, target of episodes' replies."""
    return replies.select("batch_id", "episode_no", F.posexplode(parse_terms(F.col("reply"))).alias("line_no", "t")).select("batch_id", "episode_no", "line_no", "t.source", "t.target")


def unprotected(terms: DataFrame, own: DataFrame) -> DataFrame:
    """JOIN-9/SET-5: terms whose source is not in the user's own glossary."""
    return terms.join(own.select("source").distinct(), "source", "left_anti")


def learn(terms: DataFrame, cap: int = C.MAX_TERMS) -> DataFrame:
    """FOLD-12: batch_id, source, target, n: the first target of each source, the first ``cap`` sources.

    Ranked within a batch after one row per source is left; a batch is a season, not the corpus.
    """
    first = terms.groupBy("batch_id", "source").agg(F.min(F.struct("episode_no", "line_no", "target")).alias("f"))
    order = Window.partitionBy("batch_id").orderBy("f.episode_no", "f.line_no", "source")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("batch_id", "source", F.col("f.target").alias("target"), "n")


def learn_more(settled: DataFrame, new: DataFrame, cap: int = C.MAX_TERMS) -> DataFrame:
    """The settled terms (as learn() gives them) and after them what new ones add: FOLD-12 taken further by an
    episode, without the terms of all earlier ones."""
    kept = settled.select("batch_id", F.lit(-1).cast("long").alias("episode_no"), F.col("n").alias("line_no"), "source", "target")
    return learn(kept.unionByName(new.select(kept.columns)), cap)


def merged(settled: DataFrame, user: str = "") -> DataFrame:
    """batch_id, glossary: the user's own text first, then a series' settled terms, one ``source → target`` a line."""
    line = F.concat("source", F.lit(" → "), "target")
    rows = F.sort_array(F.collect_list(F.struct("n", line.alias("t"))))
    text = F.array_join(F.transform(rows, lambda x: x["t"]), "\n")
    head = f"{user.strip()}\n" if user.strip() else ""
    return settled.groupBy("batch_id").agg(F.concat(F.lit(head), text).alias("glossary"))


def clashes(terms: DataFrame, learned: DataFrame) -> DataFrame:
    """Later renderings that differ from the settled one."""
    settled = learned.select("batch_id", "source", F.col("target").alias("settled"))
    return terms.join(settled, ["batch_id", "source"]).where("target <> settled").select("batch_id", "episode_no", "line_no", "source", "settled", "target")
