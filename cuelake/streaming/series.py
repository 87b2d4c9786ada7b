"""Series glossary as a stream that does not depend on the order of arrival.

The table of a series is what FOLD-12 gives on all terms seen so far: of each source the rendering of the earliest
(episode, line), and of the sources the first ``cap``. State is a map from source to the place and the rendering that
settled it, at most ``cap`` entries a series; only entries that change are written. A term of an earlier episode that
comes late corrects what a later one settled, and may push the last source out. A source that was pushed out never
comes back by itself: places only get earlier, so what stands before it stays before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuelake import constants as C
from cuelake.streaming.live import use_state

CHANGE = ["batch_id", "source", "target", "episode_no", "line_no", "settled", "version"]


class _FirstWins(StatefulProcessor):
    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.terms = handle.getMapState("terms", "source string", "episode_no long, line_no long, target string")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.terms.iterator()}
        before = dict(held)
        for t in pd.concat(list(rows)).itertuples():
            new = (int(t.episode_no), int(t.line_no), t.target)
            if t.source not in held or new < held[t.source]:
                held[t.source] = new
                if len(held) > self.cap:
                    del held[max(held, key=lambda s: (*held[s][:2], s))]
        gone, changed = before.keys() - held.keys(), [s for s, v in held.items() if before.get(s) != v]
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        for s in gone:
            self.terms.removeKey((s,))
        for s in changed:
            self.terms.updateValue((s,), held[s])
        self.version.update((version,))
        out = [(key[0], s, held[s][2], held[s][0], held[s][1], True, version) for s in changed]
        out += [(key[0], s, before[s][2], before[s][0], before[s][1], False, version) for s in gone]
        yield pd.DataFrame(out, columns=CHANGE)

    def close(self) -> None:
        pass


def learn_stream(terms: DataFrame, cap: int = C.MAX_TERMS) -> DataFrame:
    """STM-5: a stream of terms (batch_id, episode_no, line_no, source, target) to changes of the settled table:
    batch_id, source, target, the episode_no and line_no that settle it, settled (false when a source is pushed out), and a version that
    counts the changes of a series."""
    use_state(terms.sparkSession)
    schema = "batch_id long, source string, target string, episode_no long, line_no long, settled boolean, version long"
    own = terms.select("batch_id", F.col("episode_no").cast("long"), F.col("line_no").cast("long"), "source", "target")
    return own.groupBy("batch_id").transformWithStateInPandas(_FirstWins(cap), schema, "update", "none")


def settled_now(changes: DataFrame) -> DataFrame:
    """batch_id, source, target, episode_no, line_no of the table that changes (as learn_stream gives them, all of them or
    any later ones upserted by key) have led to."""
    last = F.max_by(F.struct("target", "episode_no", "line_no", "settled"), "version").alias("t")
    by = changes.groupBy("batch_id", "source").agg(last)
    return by.where("t.settled").select("batch_id", "source", "t.target", "t.episode_no", "t.line_no")
