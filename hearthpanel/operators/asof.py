"""As-of and validity-interval joins: each row meets the last state known at its time.

Both sides are stacked and sorted once per key; the last state seen so far is
carried along. No pair of rows is ever formed, so the work is that of one sort,
however many states a key has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("backward", "forward")


def _last(column: str, window: Window) -> Column:
    return F.last(column, ignorenulls=True).over(window)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: list[str],
    on: str,
    columns: list[str],
    direction: str = "backward",
    strict: bool = False,
    block: Callable[[Column], Column] | None = None,
    stamp: str | None = None,
) -> DataFrame:
    """Every left row with ``columns`` of the right row of its key that is nearest in time.

    ``backward`` takes the last right row at or before the left row's ``on``,
    ``forward`` the first at or after it; ``strict`` leaves out the same time.
    Of right rows of one key and time the one with the largest ``columns``
    counts. A left row without such a row, or with a null in ``by`` or ``on``,
    gets nulls; right rows with a null there count for nothing. Repeated left
    rows all stay. ``stamp`` names a column for the time of the right row.

    A key's rows are sorted in one task. Where a key may hold a large share of
    them, ``block`` cuts its time into blocks, such as ``lambda t:
    F.date_trunc("month", t)``; it must not decrease with time. Blocks are
    sorted apart, and each starts from the last state of the blocks before it.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}; expected one of {DIRECTIONS}")
    new = [*columns, *([stamp] if stamp else [])]
    if clash := [c for c in new if c in left.columns]:
        raise ValueError(f"the left side already has {', '.join(clash)}")
    forward = direction == "forward"
    time = "_at"
    known = F.struct(F.col(on).alias(time), *columns)
    states = right.dropna(subset=[*by, on]).select(*by, F.col(on).alias(time), known.alias("_state"))
    rows = left.select(*by, F.col(on).alias(time), F.struct(*left.columns).alias("_row"))
    # Position among rows of one time: carried state, then states, then rows; rows come first where the same time does not count.
    sides = [rows.withColumn("_side", F.lit(0 if strict else 2)), states.withColumn("_side", F.lit(1))]
    keys = list(by)
    if block is not None:
        keys.append("_block")
        sides = [s.withColumn("_block", block(F.col(time))) for s in sides]
        sides.append(_carried(*sides, by, forward))
    stacked = sides[0]
    for side in sides[1:]:
        stacked = stacked.unionByName(side, allowMissingColumns=True)
    first = F.col("_side") != -1  # a carried state comes before all rows of its block
    if forward:
        # Equal times end with the largest columns in either direction.
        order = [first, F.col(time).desc(), F.col("_side"), F.col("_state")]
    else:
        order = [first, F.col(time), F.col("_side"), F.col("_state")]
    found = stacked.withColumn("_found", _last("_state", Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    found = found.filter(F.col("_row").isNotNull())
    matched = F.when(F.col(time).isNotNull(), F.col("_found"))
    picked = [matched[c].alias(c) for c in columns] + ([matched[time].alias(stamp)] if stamp else [])
    return found.select(*(F.col("_row")[c].alias(c) for c in left.columns), *picked)


def _carried(rows: DataFrame, states: DataFrame, by: list[str], forward: bool) -> DataFrame:
    """For each block of a key that has rows, the state its rows start from.

    One row per key and block enters the window, not one per state.
    """
    if forward:
        by_time = states.groupBy(*by, "_block", "_at").agg(F.max("_state").alias("_state"))
        ends = by_time.groupBy(*by, "_block").agg(F.min_by("_state", "_at").alias("_state"))
    else:  # a state starts with its time
        ends = states.groupBy(*by, "_block").agg(F.max("_state").alias("_state"))
    starts = rows.dropna(subset=[*by, "_block"]).select(*by, "_block").distinct()
    blocks = ends.unionByName(starts, allowMissingColumns=True).groupBy(*by, "_block").agg(F.max("_state").alias("_state"))
    order = F.col("_block").desc() if forward else F.col("_block")
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*by, "_block", _last("_state", before).alias("_state")).filter(F.col("_state").isNotNull())
    return carried.select(*by, "_block", F.col("_state._at").alias("_at"), "_state", F.lit(-1).alias("_side"))


def validity_intervals(changes: DataFrame, *, by: list[str], at: str, until: str = "until") -> DataFrame:
    """Dated changes as intervals: each holds from ``at`` to the next change of its key, the last without end.

    Changes without a key or date are left out. Of changes of one key and date
    the one with the largest other values holds.
    """
    rest = [c for c in changes.columns if c not in (*by, at)]
    dated = changes.dropna(subset=[*by, at])
    single = dated.groupBy(*by, at).agg(*([F.max(F.struct(*rest)).alias("_rest")] if rest else []))
    ends = single.withColumn(until, F.lead(at).over(Window.partitionBy(*by).orderBy(at)))
    return ends.select(*by, at, *(F.col("_rest")[c].alias(c) for c in rest), until)


def interval_join(
    left: DataFrame,
    intervals: DataFrame,
    *,
    by: list[str],
    on: str,
    start: str,
    until: str,
    columns: list[str],
    block: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Every left row with ``columns`` of the interval ``start <= on < until`` that holds it; an open end is null.

    Intervals of a key must not overlap, as those of ``validity_intervals`` do
    not. A row that lies in no interval gets nulls.
    """
    held = intervals.withColumnsRenamed({start: on} if start != on else {})
    found = asof_join(left, held, by=by, on=on, columns=[*columns, until] if until not in columns else columns, block=block, stamp="_from")
    inside = F.col("_from").isNotNull() & (F.col(until).isNull() | (F.col(on) < F.col(until)))
    return found.select(*left.columns, *(F.when(inside, F.col(c)).alias(c) for c in columns))
