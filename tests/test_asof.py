"""As-of and interval joins against a plain loop."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthpanel.operators.asof import asof_join, interval_join, validity_intervals

LEFT, RIGHT = "k string, at int, n int", "k string, at int, a int, b string"


def nearest(rows, states, direction, strict):
    out = []
    for k, at, n in rows:
        sign = 1 if direction == "backward" else -1
        fits = [
            s for s in states
            if None not in (k, at, s[0], s[1]) and s[0] == k and (s[1] * sign < at * sign or (not strict and s[1] == at))
        ]
        best = max(fits, key=lambda s: (s[1] * sign, s[2] is not None, s[2] or 0, s[3] is not None, s[3] or "")) if fits else (None,) * 4
        out.append((k, at, n, best[2], best[3], best[1]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v if v is not None else 0) if not isinstance(v, str) else (False, v) for v in r))


KEY, AT = st.sampled_from(["x", "y", None]), st.one_of(st.none(), st.integers(0, 12))
ROWS = st.lists(st.tuples(KEY, AT, st.integers(0, 3)), max_size=12)
STATES = st.lists(st.tuples(KEY, AT, st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["p", "q", None])), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ROWS, STATES)
def test_every_way_agrees_with_a_loop(spark, rows, states):
    left, right = spark.createDataFrame(rows, LEFT), spark.createDataFrame(states, RIGHT)
    for direction, strict, block in [("backward", False, 5), ("backward", True, None), ("forward", False, None), ("forward", True, 3)]:
        cut = (lambda at, block=block: F.floor(at / block)) if block else None
        got = asof_join(left, right, by=["k"], on="at", columns=["a", "b"], direction=direction, strict=strict, block=cut, stamp="found")
        assert got.columns == ["k", "at", "n", "a", "b", "found"]
        assert ordered(got.collect()) == ordered(nearest(rows, states, direction, strict))


def test_hot_key_is_sorted_in_blocks_without_pairs(spark):
    left = spark.range(4000).selectExpr("'hot' AS k", "int(id) AS at", "int(id) AS n")
    right = spark.range(1, 4000, 1000).selectExpr("'hot' AS k", "int(id) AS at", "int(id) AS a")
    got = asof_join(left, right, by=["k"], on="at", columns=["a"], block=lambda at: F.floor(at / 100))
    assert [(r.n, r.a) for r in got.filter("n IN (0, 1, 1000, 1001, 2950, 3999)").orderBy("n").collect()] == [
        (0, None), (1, 1), (1000, 1), (1001, 1001), (2950, 2001), (3999, 3001),
    ]
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text.replace("AdaptiveSparkPlan", "") and "hashpartitioning(k" in text and "_block" in text


def test_intervals(spark):
    changes = spark.createDataFrame([("x", 1, 10), ("x", 5, 20), ("x", 5, 15), (None, 2, 1), ("y", None, 1)], "k string, at int, v int")
    held = validity_intervals(changes, by=["k"], at="at")
    assert sorted(map(tuple, held.collect()), key=str) == [("x", 1, 10, 5), ("x", 5, 20, None)]
    closed = spark.createDataFrame([("x", 2, 4, 7), ("x", 6, None, 8)], "k string, since int, till int, v int")
    left = spark.createDataFrame([("x", i, i) for i in range(8)] + [("z", 3, 99)], LEFT)
    got = interval_join(left, closed, by=["k"], on="at", start="since", until="till", columns=["v"])
    assert {r.n: r.v for r in got.collect()} == {0: None, 1: None, 2: 7, 3: 7, 4: None, 5: None, 6: 8, 7: 8, 99: None}


def test_bad_arguments(spark):
    frame = spark.createDataFrame([], LEFT)
    with pytest.raises(ValueError, match="already has n"):
        asof_join(frame, frame, by=["k"], on="at", columns=["n"])
    with pytest.raises(ValueError, match="unknown direction"):
        asof_join(frame, frame, by=["k"], on="at", columns=[], direction="both")
