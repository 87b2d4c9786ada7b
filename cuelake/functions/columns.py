"""Column helpers for folds over arrays that stay inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a computed column once: a lambda argument is evaluated a single time, while an expression that a
    lambda merely mentions is evaluated again for every element."""
    return F.transform(F.array(value), body)[0]


def runs(rows: Column, opens: Column) -> Column:
    """An array cut into runs: opens holds the places (from 0) where a run begins, without the first."""
    upto = lambda k: F.coalesce(F.get(opens, k), F.size(rows))
    return F.transform(F.concat(F.array(F.lit(0)), opens), lambda at, k: F.slice(rows, at + 1, upto(k) - at))
