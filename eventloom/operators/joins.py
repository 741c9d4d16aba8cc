"""A lookup join that stays safe when the lookup side grows or one key holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 10_000


def lookup_join(left: DataFrame, small: DataFrame, on: list[str], how: str = "left",
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins ``small`` to ``left``.

    ``small`` is counted up to the bound and broadcast only below it, as the driver holds a broadcast several times over.  Beyond
    it, both sides are shuffled once, and the session's skew join splits the rows of ``left`` with a key that holds much of them.
    """
    if small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return left.join(F.broadcast(small), on, how)
    return left.join(small, on, how)
