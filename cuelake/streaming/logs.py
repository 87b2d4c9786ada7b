"""Diagnostic logs as text: sections, named values, lines and verbatim blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a block that are written; its feature is to keep a log readable, and it says how long the block was.
MOST = 200_000
# How the parts of a log look.
RULE = "=" * 78
CLIPPED = "\n…（已截断，原长度 %d 字符）"
MINUTES = "    [任务开始后 %s 分钟]"


def clipped(body: Column, most: int = MOST) -> Column:
    """A text of over ``most`` characters cut there, with its length."""
    return F.when(F.length(body) > most, F.concat(F.left(body, F.lit(most)), F.format_string(CLIPPED, F.length(body)))).otherwise(body)


def entry_text(most: int = MOST) -> Column:
    """The text of an entry (kind, title, body, elapsed in seconds): section, kv, block, or else a line. Null titles and
    bodies are empty."""
    title, body = (F.coalesce(c, F.lit("")) for c in ("title", "body"))
    minutes = F.format_string(MINUTES, F.format_string("%.1f", F.bround(F.coalesce("elapsed", F.lit(0.0)) / 60, 1)))
    section = F.concat(F.lit(f"\n\n{RULE}\n== "), title, minutes, F.lit(f"\n{RULE}\n"))
    # A name takes 28 places, or as many as it has.
    pair = F.concat(title, F.repeat(F.lit(" "), F.greatest(F.lit(28) - F.length(title), F.lit(0))), F.lit(": "), body, F.lit("\n"))
    block = F.concat(F.lit("\n--- "), title, F.lit(" ---\n"), clipped(body, most), F.lit("\n--- /"), title, F.lit(" ---\n"))
    kind = F.col("kind")
    return F.when(kind == "section", section).when(kind == "kv", pair).when(kind == "block", block).otherwise(F.concat(body, F.lit("\n")))


def debug_logs(entries: DataFrame, head: str = "", most: int = MOST) -> DataFrame:
    """SNK-7: job_id, text: the log of each job from entries (job_id, seq, kind, title, body, elapsed), in order of seq.
    A log is one job's; files are written with sources.named_files."""
    rows = F.sort_array(F.collect_list(F.struct("seq", entry_text(most).alias("t"))))
    text = F.array_join(F.transform(rows, lambda x: x["t"]), "")
    return entries.groupBy("job_id").agg(F.concat(F.lit(head), text).alias("text"))
