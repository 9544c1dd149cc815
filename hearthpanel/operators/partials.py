"""Partial aggregates that merge: what a rollup keeps so that new contracts can be added to it.

A state of a key is a sum, a smallest or largest value, or a sketch. States of
any keys merge into the state of their union, so a rollup over months gives the
figures of any region and period without the contracts. Sums also take rows
back: a replaced contract counts once more with a negative sign.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("sum", "min", "max", "quantiles", "distinct")
#: Size of quantile sketches. A quantile's rank is off by about 2.3 / SIZE ** 0.9 (0.2 % for 2048, at 99 % confidence); up
#: to SIZE values are kept as they are and give exact order statistics.
SIZE = 2048
#: Binary logarithm of the size of distinct-value sketches: a count is off by about 1.04 / 2 ** (LOG / 2), 1.6 % for 12.
LOG = 12


@dataclass(frozen=True)
class State:
    """One column of a partial aggregate: an SQL expression over contract rows and how it is kept.

    Nulls are left out of every kind. ``distinct`` takes integers and strings.
    """

    name: str
    value: str
    kind: str = "sum"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}; expected one of {KINDS}")

    def start(self, sign: Column | None = None) -> Column:
        value = F.expr(self.value)
        if self.kind == "sum":
            found = F.sum(value if sign is None else value * sign)
        elif self.kind == "quantiles":
            found = F.kll_sketch_agg_double(value.cast("double"), SIZE)
        elif self.kind == "distinct":
            found = F.hll_sketch_agg(value, LOG)
        else:
            found = (F.min if self.kind == "min" else F.max)(value)
        return found.alias(self.name)

    def merge(self) -> Column:
        by = {"sum": F.sum, "min": F.min, "max": F.max, "quantiles": F.kll_merge_agg_double, "distinct": F.hll_union_agg}
        return by[self.kind](self.name).alias(self.name)


def partial(rows: DataFrame, keys: list[str], states: tuple[State, ...]) -> DataFrame:
    """States of contract rows by key; Spark combines rows of a key before the shuffle."""
    return rows.groupBy(*keys).agg(*(s.start() for s in states))


def merged(parts: DataFrame, keys: list[str], states: tuple[State, ...]) -> DataFrame:
    """States of coarser keys, or of keys that several parts hold."""
    return parts.groupBy(*keys).agg(*(s.merge() for s in states))


def quantile(state: str, p: float) -> Column:
    """The smallest value that at least a share ``p`` of a sketch's values do not exceed (see SIZE for its error); null without values."""
    held = F.col(state).isNotNull() & (F.kll_sketch_get_n_double(state) > 0)
    return F.when(held, F.kll_sketch_get_quantile_double(F.col(state), F.lit(float(p))))


def distinct(state: str) -> Column:
    """How many distinct values a sketch has seen (see LOG for its error)."""
    return F.hll_sketch_estimate(state)


def signed_partial(added: DataFrame, removed: DataFrame, keys: list[str], states: tuple[State, ...]) -> DataFrame:
    """What added and removed contract rows change of each key.

    ``took_back`` marks keys that lost a row. Their sums are right; their other
    states are those of the added rows alone and have to be made again.
    """
    rows = added.withColumn("_sign", F.lit(1)).unionByName(removed.withColumn("_sign", F.lit(-1)))
    fresh = F.col("_sign") > 0
    columns = [
        s.start(F.col("_sign")) if s.kind == "sum" else State(s.name, f"if(_sign > 0, {s.value}, null)", s.kind).start() for s in states
    ]
    return rows.groupBy(*keys).agg(*columns, F.max(~fresh).alias("took_back"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition on keys of which any may be null."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def applied(stored: DataFrame, change: DataFrame, keys: list[str], states: tuple[State, ...], *, count: str, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored states with a change of ``signed_partial`` merged in; a key that loses its last row stays with a ``count`` of 0.

    ``again`` gives states anew for a table of keys. It is asked for keys that
    lost a row, and only where some state is no sum.
    """
    if all(s.kind == "sum" for s in states):
        return merged(stored.unionByName(change.drop("took_back")), keys, states)
    lost = change.filter("took_back").select(*keys)
    kept = stored.join(lost, same_keys(stored, lost, keys), "left_anti")
    clean = change.filter("NOT took_back").drop("took_back")
    emptied = lost.withColumn(count, F.lit(0).cast(stored.schema[count].dataType))
    parts = [kept, clean, again(lost), emptied]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return merged(whole, keys, states)
