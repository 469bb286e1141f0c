"""Which intervals hold which points, through a hierarchical grid.

An interval of length n is filed at the level whose cells are the smallest power of ``STEP`` not below n, so that it
touches at most two cells there; a point looks into its one cell of each level in use. Both sides then meet in a plain
equality join. An open interval (null end) has a level of its own. No interval is filed more than twice, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 8
#: Levels of closed intervals: STEP**20 is the last power that a bigint cell count holds safely.
LEVELS = 21
OPEN = LEVELS


def _width(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(STEP**k) for k in range(LEVELS)]), level + 1)


def _level(length: Column) -> Column:
    """The level of a length; the highest for null, a length that no number holds."""
    found = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        found = F.when(length <= F.lit(STEP**k), F.lit(k)).otherwise(found)
    return found


def _names(axis: str) -> tuple[str, str]:
    return (f"{axis}_level", f"{axis}_cell") if axis else ("level", "cell")


def filed(intervals: DataFrame, lo: str, hi: str, axis: str = "") -> DataFrame:
    """The intervals with ``level`` and ``cell``, in one or two rows each; empty intervals (hi <= lo) are left out.

    With a name for the axis the columns are ``<axis>_level`` and ``<axis>_cell``, so that rectangles can be filed by two.
    """
    to_level, to_cell = _names(axis)
    leveled = intervals.filter(F.col(lo).isNotNull() & (F.col(hi).isNull() | (F.col(hi) > F.col(lo))))
    level = F.when(F.col(hi).isNull(), F.lit(OPEN)).otherwise(_level(F.try_subtract(F.col(hi), F.col(lo))))
    leveled = leveled.withColumn(to_level, level.cast("int"))
    first = F.floor(F.col(lo) / _width(F.col(to_level)))
    last = F.floor((F.col(hi) - 1) / _width(F.col(to_level)))
    cells = F.when(F.col(to_level) == OPEN, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(first, last))
    return leveled.withColumn(to_cell, F.explode(cells))


def looked_up(points: DataFrame, at: str, axis: str = "") -> DataFrame:
    """The points with the ``cell`` that holds them at the level they have."""
    level, cell = _names(axis)
    return points.withColumn(cell, F.when(F.col(level) == OPEN, F.lit(0).cast("bigint")).otherwise(F.floor(F.col(at) / _width(F.col(level)))))


def levels_in_use(intervals: DataFrame, lo: str, hi: str) -> Column:
    """Aggregate: the set of levels of a group's intervals, as bits."""
    level = F.when(F.col(hi).isNull(), F.lit(OPEN)).otherwise(_level(F.try_subtract(F.col(hi), F.col(lo))))
    return F.bit_or(F.call_function("shiftleft", F.lit(1), level.cast("int")))


def probes(points: DataFrame, at: str, levels: str) -> DataFrame:
    """The points with ``level`` and ``cell``, one row per level set in the bits of column ``levels``."""
    every = F.array(*[F.lit(k) for k in range(LEVELS + 1)])
    used = F.filter(every, lambda k: F.getbit(F.col(levels), k) == 1)
    return looked_up(points.withColumn("level", F.explode(used)), at)
