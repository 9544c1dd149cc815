"""Statistics against plain NumPy and the JVM's own distributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthpanel.functions.tails import f_tail, t_tail
from hearthpanel.operators import formulas, models, scores, stats


def test_tails_agree_with_the_jvm(spark):
    math3 = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for t, df in [(0.0, 3), (1.2, 1), (2.5, 7), (-3.3, 40), (12.0, 200)]:
        expected = 2 * math3.TDistribution(float(df)).cumulativeProbability(-abs(t))
        assert float(t_tail(t, df)) == pytest.approx(expected, abs=1e-12)
    for f, a, b in [(0.5, 1, 10), (3.2, 4, 60), (9.0, 2, 5), (40.0, 3, 300)]:
        expected = 1 - math3.FDistribution(float(a), float(b)).cumulativeProbability(f)
        assert float(f_tail(f, a, b)) == pytest.approx(expected, abs=1e-12)
    assert np.isnan(t_tail(np.nan, 3)) and float(t_tail(np.inf, 3)) == 0.0


def test_correlation_guards(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 7.0, None if i == 3 else 1.0 * i * i) for i in range(6)], "a double, b double, c double, d double")
    out = {(r["var_x"], r["var_y"]): r for r in stats.correlation_matrix(df, ["a", "b", "c", "d", "missing"]).collect()}
    assert len(out) == 16 and out[("a", "b")]["r"] == pytest.approx(1.0) and out[("a", "b")]["p"] == pytest.approx(0.0, abs=1e-6)
    assert out[("a", "c")]["r"] is None and out[("a", "a")]["n"] == 5
    x = np.array([0.0, 1, 2, 4, 5])
    assert out[("a", "d")]["r"] == pytest.approx(np.corrcoef(x, x * x)[0, 1])
    assert stats.correlation_matrix(df.limit(2), ["a", "b"]).count() == 0


def test_correlation_by_needs_three_pairs(spark):
    rows = [("A", 1.0, 2.0), ("A", 2.0, 1.0), ("A", 3.0, 5.0), ("B", 1.0, 2.0), ("B", 2.0, 3.0), ("B", 2.0, None)]
    df = spark.createDataFrame(rows, "province string, x double, y double")
    only = stats.correlation_by(df, "x", "y", key="province").collect()
    assert [(r["province"], r["n"]) for r in only] == [("A", 3)]
    assert only[0]["r"] == round(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1], 4)


def test_group_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(stats, "SKETCH_ACCURACY", 1000)
    monkeypatch.setattr(stats, "BRACKET", 4 / 1000)
    rng = np.random.default_rng(3)
    data = {"hot": rng.normal(size=30_000), "ties": rng.integers(0, 40, size=9_000).astype(float), "wide": np.exp(rng.normal(size=6_000) * 4)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r["g"]: r for r in stats.group_quantiles(df, "v", group=["g"], probs=probs).collect()}
    for key, values in data.items():
        assert [got[key][f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_quantiles_of_tiny_groups(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 2.0), ("c", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["q0"]) for r in stats.group_quantiles(df, "v", group=["g"], probs=[0.25]).collect()}
    assert got == {"a": (1, 5.0), "b": (2, 1.25)}
    assert stats.quantiles(df, "v", [0.5]).first()["q0"] == 2.0


def _regression_data(n=60):
    rng = np.random.default_rng(1)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    return x1, x2, 3 + 2 * x1 - x2 + rng.normal(size=n)


def test_ols_against_numpy(spark):
    x1, x2, y = _regression_data()
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)], "x1 double, x2 double, y double")
    table = {r["variable"]: r for r in models.ols_table(df, "y", ["x1", "x2"]).collect()}
    design = np.column_stack([np.ones_like(x1), x1, x2])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    resid = y - design @ beta
    s2 = resid @ resid / (len(y) - 3)
    errors = np.sqrt(np.diag(s2 * np.linalg.inv(design.T @ design)))
    for i, name in enumerate(["intercept", "x1", "x2"]):
        assert table[name]["coefficient"] == pytest.approx(beta[i])
        assert table[name]["std_error"] == pytest.approx(errors[i])
        assert table[name]["p"] == pytest.approx(float(t_tail(beta[i] / errors[i], len(y) - 3)), abs=1e-9)
    coefficients, importance, fit = models.ols(df, "y", ["x1", "x2"])
    assert [r["variable"] for r in coefficients.collect()] == ["intercept", "x1", "x2"]
    assert [r["variable"] for r in importance.collect()] == ["x1", "x2"]
    assert fit.first()["r_squared"] == round(1 - resid @ resid / np.sum((y - y.mean()) ** 2), 4)
    with pytest.raises(Exception, match="10 complete rows"):
        models.ols_table(df.limit(9), "y", ["x1"]).collect()


def test_granger_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=50)
    y = np.concatenate([[0.0], 0.8 * x[:-1]]) + rng.normal(size=50) * 0.3
    rows = [("A", i, float(y[i]), float(x[i])) for i in range(50)] + [("short", i, 1.0 * i, 2.0) for i in range(6)]
    df = spark.createDataFrame(rows, "province string, ym int, y double, x double").repartition(3)
    got = {r["lag"]: r for r in models.granger(df, "y", "x", max_lag=2).collect()}
    assert set(got) == {1, 2} and {r["province"] for r in got.values()} == {"A"}
    for lag in (1, 2):
        t = y[lag:]
        own = np.column_stack([np.ones(50 - lag)] + [y[lag - i : 50 - i] for i in range(1, lag + 1)])
        both = np.column_stack([own] + [x[lag - i : 50 - i] for i in range(1, lag + 1)])
        ssr = [np.sum((t - d @ np.linalg.lstsq(d, t, rcond=None)[0]) ** 2) for d in (own, both)]
        f = (ssr[0] - ssr[1]) / lag / (ssr[1] / (50 - lag - 2 * lag - 1))
        assert got[lag]["f"] == pytest.approx(f, abs=1e-4) and got[lag]["causal"]


def test_clusters_find_separated_regions(spark):
    rows = [(f"r{i}", float(i // 3 * 100 + i % 3), float(i // 3 * 10)) for i in range(9)]
    df = spark.createDataFrame(rows, "province string, a double, b double")
    assigned, centres = models.cluster_regions(df, ["a", "b"], k=3, restarts=3)
    assert {r["province"]: r["cluster"] for r in assigned.collect()} == {f"r{i}": i // 3 for i in range(9)}
    assert [round(r["a"]) for r in centres.orderBy("cluster").collect()] == [1, 101, 201]
    assert {r["a"] for r in models.radar_profile(centres, ["a", "b"]).collect()} >= {0.0, 1.0}
    with pytest.raises(ValueError):
        models.cluster_regions(df, ["a"], k=10)


def test_forecast_follows_trend_and_season(spark):
    months = [(2010 + i // 12, i % 12 + 1) for i in range(72)]
    value = lambda i: 100 + 2.0 * i + 15 * np.sin(2 * np.pi * (i % 12 + 1) / 12)
    rows = [("A", y, m, float(value(i))) for i, (y, m) in enumerate(months)] + [("B", 2010, m, 1.0) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "province string, year int, month int, avg_price double")
    series, metrics, components = models.forecast(df, periods=6)
    future = series.filter("part = 'future'").orderBy("ds").collect()
    assert len(future) == 6 and str(future[0]["ds"]) == "2016-01-01"
    for i, row in enumerate(future):
        assert row["yhat"] == pytest.approx(value(72 + i), rel=0.05) and row["actual"] is None
        assert row["yhat_lower"] <= row["yhat"] <= row["yhat_upper"]
    assert {r["province"] for r in metrics.collect()} == {"A"} and metrics.first()["mape"] < 5
    assert components.count() == 78


def _pchip(x, y, at):
    """Plain scalar version of the published interpolation rule."""
    h, m = np.diff(x), np.diff(y) / np.diff(x)
    d = np.zeros(len(x))
    for k in range(1, len(x) - 1):
        if m[k - 1] * m[k] > 0:
            w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            d[k] = (w1 + w2) / (w1 / m[k - 1] + w2 / m[k])

    def end(h0, h1, m0, m1):
        v = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        if np.sign(v) != np.sign(m0):
            return 0.0
        return 3 * m0 if np.sign(m0) != np.sign(m1) and abs(v) > 3 * abs(m0) else v

    d[0], d[-1] = end(h[0], h[1], m[0], m[1]), end(h[-1], h[-2], m[-1], m[-2])
    out = []
    for p in at:
        k = min(max(np.searchsorted(x, p, side="right") - 1, 0), len(x) - 2)
        s = (p - x[k]) / h[k]
        v = y[k] * (1 + 2 * s) * (1 - s) ** 2 + h[k] * d[k] * s * (1 - s) ** 2
        out.append(max(v + y[k + 1] * s * s * (3 - 2 * s) + h[k] * d[k + 1] * s * s * (s - 1), 0.0))
    return out


@pytest.mark.parametrize("values", [[1.0, 4.0, 9.0, 30.0, 90.0], [5.0, 1.0, 7.0, 7.0, 2.0], [0.0, 50.0, 51.0, 52.0, 200.0]])
def test_percentiles(spark, values):
    rows = [(2020, f"소득 {i + 1}분위", v) for i, v in enumerate(values)] + [(2020, "전체", 999.0), (2019, "1분위", 1.0)]
    df = spark.createDataFrame(rows, "year int, quintile string, v double")
    out = scores.quintile_to_percentile(df, year=2020, columns=["v"]).orderBy("percentile").collect()
    expected = _pchip(np.array([10.0, 30, 50, 70, 90]), np.array(values), range(1, 100))
    assert [r["v"] for r in out] == pytest.approx(expected)
    assert [out[p - 1]["v"] for p in (10, 30, 50, 70, 90)] == pytest.approx(values)
    assert scores.quintile_to_percentile(df, year=2019, columns=["v"]).count() == 0


def test_percentiles_skip_missing_knots(spark):
    rows = [(2020, f"{i}분위", v, w) for i, v, w in ((1, 1.0, 1.0), (2, None, None), (3, 3.0, None), (4, 9.0, None), (5, 12.0, 4.0))]
    df = spark.createDataFrame(rows, "year int, quintile string, v double, w double")
    out = scores.quintile_to_percentile(df, year=2020, columns=["v", "w"]).orderBy("percentile").collect()
    assert [r["v"] for r in out] == pytest.approx(_pchip(np.array([10.0, 50, 70, 90]), np.array([1.0, 3, 9, 12]), range(1, 100)))
    assert {r["w"] for r in out} == {None}


def test_purchasing_power(spark):
    df = spark.createDataFrame([(50, 1000.0, 200.0, 600.0, 10.0), (1, 10.0, 900.0, 0.0, 90.0)], "percentile int, household_assets double, household_debt double, household_income double, debt_to_income double")
    rows = {r["percentile"]: r for r in scores.purchasing_power(df, rate=3.5).collect()}
    r, n = 3.5 / 1200, 360
    loan = 600 * 0.3 / 12 * (1 - (1 + r) ** -n) / r
    assert rows[50]["purchasing_power"] == pytest.approx(800 + loan)
    assert rows[1]["purchasing_power"] == 0.0
    free = scores.purchasing_power(df, rate=0, years=10).filter("percentile = 50").first()
    assert free["loan_capacity"] == pytest.approx(600 * 0.3 * 10)


def test_match_income(spark):
    power = spark.createDataFrame([(p, float(p * 10)) for p in range(1, 100)], "percentile int, purchasing_power double")
    grades = spark.createDataFrame([("가", 1, 700.0), ("나", 2, 300.0), ("다", 3, 120.0)], "district_name string, grade int, avg_price double")
    out = scores.match_income(power, grades).collect()
    assert [r["percentile_group"] for r in out][:2] + [out[-1]["percentile_group"]] == ["1~10%", "11~20%", "91~99%"]
    assert [r["districts"] for r in out] == ["구매불가", "다", "다", "나", "나", "나", "나", "가", "가", "가"]
    assert (out[-1]["purchasing_power"], out[-1]["market_price"], out[-1]["gap"]) == (950.0, 700.0, 250.0)
    assert out[0]["grade"] is None and out[0]["gap"] is None


def test_temperature_redistributes_weights(spark):
    df = spark.createDataFrame([(2000, 50.0, None), (2001, 150.0, 10.0), (2003, None, None)], "year int, buyer_superiority double, price_yoy double")
    rows = {r["year"]: r for r in scores.market_temperature(df).collect()}
    assert rows[2000]["score"] == 75.0 and rows[2000]["delta"] == 0.0
    assert rows[2001]["score"] == 50.0 and rows[2001]["delta"] == -25.0
    assert rows[2003]["score"] == 50.0 and rows[2003]["delta"] == 0.0


def test_rank_districts_without_income(spark):
    rows = [("1", "A", y, 10.0 * (y - 1999), 5.0, 3) for y in (2000, 2003)] + [("2", "A", 2003, 5.0, 9.0, 1)]
    df = spark.createDataFrame(rows, "district_code string, province string, year int, avg_price double, avg_unit_price double, deal_count int")
    out = scores.rank_districts(df).collect()
    assert [r["grade"] for r in out] == [1, 2] and out[0]["income_level"] is None


def test_value_score_degenerate_province(spark):
    sale = "district_code string, province string, year int, avg_price double, avg_unit_price double, deal_count int"
    sales = spark.createDataFrame([("1", "A", 2003, 100.0, 1.0, 7)], sale)
    deposits = spark.createDataFrame([("1", 2003, 50.0)], "district_code string, year int, avg_deposit double")
    raw = scores.value_score(sales, deposits).first()
    assert raw["value_score"] == pytest.approx(0.35 * 50 + 0.15 * 7)
    assert scores.value_score(sales, deposits, degenerate="null").first()["value_score"] == 0.0


def test_formulas(spark):
    df = spark.createDataFrame([("A", 2000, 100.0, 0), ("A", 2001, -4.0, 2)], "province string, year int, avg_price double, permits int")
    wanted = {"ratio": "avg_price / permits", "blank": " ", "bad": "__import__('os')", "root": "sqrt(avg_price) + 2 * (1 - 0.5)"}
    rows = formulas.with_formulas(df, wanted).orderBy("year").collect()
    assert [r["ratio"] for r in rows] == [None, -2.0]
    assert {r["blank"] for r in rows} | {r["bad"] for r in rows} == {None}
    assert [r["root"] for r in rows] == [11.0, None]
    with pytest.raises(ValueError):
        formulas.with_formulas(df, {str(i): "1" for i in range(5)})
    for bad in ("avg_price.real", "max(avg_price)", "avg_price if 1 else 2", "unknown + 1", "True + 1", "sqrt(1, 2)"):
        with pytest.raises(formulas.FormulaError):
            formulas.formula_column(bad, ["avg_price"])
    checked = formulas.check_formula(df, "1 / permits").first()
    assert tuple(checked) == (1, 0.5, "permits")
    korean = df.withColumn("가격", F.col("avg_price"))
    assert formulas.with_formulas(korean, {"x": "가격 * 2"}).orderBy("year").first()["x"] == 200.0


def test_regressors_of_unlike_scale(spark):
    """A rate beside a product that is ten orders larger keeps its coefficient."""
    import numpy as np

    rnd = np.random.default_rng(1)
    grdp, rate, people = rnd.uniform(1e8, 9e8, 200), rnd.uniform(0.5, 5, 200), rnd.uniform(1e5, 1e7, 200)
    y = 1e4 + 1e-5 * grdp + 2000 * rate + 1e-3 * people + rnd.normal(0, 1, 200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, grdp, rate, people)], "y double, grdp double, rate double, people double")
    table = {r["variable"]: r for r in models.ols_table(df, "y", ["grdp", "rate", "people"]).collect()}
    exact = np.linalg.lstsq(np.column_stack([np.ones(200), grdp, rate, people]), y, rcond=None)[0]
    for name, value in zip(["intercept", "grdp", "rate", "people"], exact):
        assert abs(table[name]["coefficient"] / value - 1) < 1e-6
    assert table["rate"]["r_squared"] > 0.9999


def test_a_perfect_lead_lag_fit_is_skipped(spark):
    rows = [("a", i, float(i % 2), float((i * 7) % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "province string, ym int, y double, x double")
    assert models.granger(df, "y", "x").count() == 0


def test_quantiles_of_small_and_tied_groups(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    groups = {n: rnd.choice([1.0, 2.0, 2.5, 7.0, 9.0], n) if n % 2 else rnd.normal(size=n) for n in (1, 2, 3, 4, 7, 10, 101, 3000)}
    df = spark.createDataFrame([(int(g), float(v)) for g, values in groups.items() for v in values], "g int, v double")
    for r in stats.group_quantiles(df, "v", group=["g"], probs=[0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(groups[r["g"]], [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_regressions_by_group_against_least_squares(spark):
    from hearthpanel.operators import moments

    rng = np.random.default_rng(11)
    rows = []
    for g, n in (("a", 40), ("b", 12), ("few", 6), ("flat", 15), (None, 20)):
        for _ in range(n):
            x1, x2 = rng.normal() * 1e6, rng.normal() * 1e-3
            rows.append((g, 3.0 if g == "flat" else 5 + 2e-6 * x1 - 4e3 * x2 + rng.normal(), x1, x2, 2 * x1 + 1))
    rows += [("a", None, 1.0, 2.0, 3.0), ("a", float("nan"), 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, y double, x1 double, x2 double, twin double").repartition(5)
    got = {(r.g, r.variable): r for r in moments.ols_by(df, "y", ["x1", "x2"], by=["g"]).collect()}
    assert {g for g, _ in got} == {"a", "b", "flat"}
    for g in ("a", "b"):
        mine = np.array([r[1:4] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]])
        design = np.column_stack([np.ones(len(mine)), mine[:, 1:]])
        beta = np.linalg.lstsq(design / [1, 1e6, 1e-3], mine[:, 0], rcond=None)[0] / [1, 1e6, 1e-3]
        off = mine[:, 0] - design @ beta
        errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * (off @ off) / (len(mine) - 3))
        for i, name in enumerate(("intercept", "x1", "x2")):
            r = got[g, name]
            assert r.coefficient == pytest.approx(beta[i], rel=1e-6) and r.std_error == pytest.approx(errors[i], rel=1e-6) and r.n == len(mine)
            assert 0 <= r.p <= 1 and r.t == pytest.approx(beta[i] / errors[i], rel=1e-6)
    assert got["flat", "intercept"].coefficient == pytest.approx(3.0) and got["flat", "x1"].coefficient == 0 and got["flat", "x1"].r_squared is None
    twin = {r.variable: r for r in moments.ols_by(df.filter("g = 'a'"), "y", ["x1", "twin", "x2"], by=["g"]).collect()}
    assert twin["twin"].coefficient == 0 and twin["twin"].std_error is None and twin["x2"].coefficient == pytest.approx(got["a", "x2"].coefficient)
    assert moments.ols_by(df.limit(0), "y", ["x1"], by=["g"]).count() == 0


def test_forecast_is_the_ridge_regression(spark):
    rng = np.random.default_rng(2)
    months = [m for m in range(60) if m not in (7, 8, 31)]  # with gaps
    value = {m: 50 + 0.7 * m + (m > 30) * 2.0 * (m - 30) + 9 * np.cos(m) + rng.normal() for m in months}
    rows = [("A", 2001 + m // 12, m % 12 + 1, float(v)) for m, v in value.items()]
    series, metrics, _ = models.forecast(spark.createDataFrame(rows, "province string, year int, month int, avg_price double"), periods=5)

    def fit(known, at):
        last = float(max(known))
        knots = np.linspace(0, 0.8 * last, models.HINGES + 2)[1:-1]

        def design(ms):
            ms = np.asarray(ms, float)
            angle = 2 * np.pi * (ms % 12 + 1) / 12
            waves = [w(k * angle) for k in range(1, models.SEASON_TERMS + 1) for w in (np.sin, np.cos)]
            return np.column_stack([np.ones_like(ms), ms, *(np.maximum(ms - k, 0) for k in knots), *waves])

        d, y = design(known), np.array([value[m] for m in known])
        ridge = np.full(d.shape[1], models.LEAST_RIDGE)
        ridge[2 : 2 + models.HINGES] = models.HINGE_RIDGE * last
        beta = np.linalg.solve(d.T @ d + np.diag(ridge), d.T @ y)
        return design(at) @ beta, np.std(y - d @ beta, ddof=1)

    yhat, sigma = fit(months, [*months, *range(60, 65)])
    got = series.orderBy("ds").collect()
    assert [r.part for r in got] == ["history"] * 57 + ["future"] * 5
    assert np.allclose([r.yhat for r in got], yhat) and np.allclose([r.yhat_upper - r.yhat for r in got], models.BAND * sigma)
    held, _ = fit(months[:-12], months[-12:])
    assert metrics.first().mae == pytest.approx(np.mean(np.abs(held - [value[m] for m in months[-12:]])), abs=0.06)
    none, _, _ = models.forecast(spark.createDataFrame(rows[:20], "province string, year int, month int, avg_price double"))
    assert none.count() == 0


def test_clusters_of_one_all_and_equal_regions(spark):
    rows = [("a", 1.0, 5.0), ("b", 1.0, 5.0), ("c", 9.0, 5.0), (None, 3.0, 3.0), ("d", None, 1.0)]
    df = spark.createDataFrame(rows, "province string, x double, flat double")
    one, centre = models.cluster_regions(df, ["x", "flat"], k=1)
    assert {(r.province, r.cluster) for r in one.collect()} == {("a", 0), ("b", 0), ("c", 0)}
    assert centre.first().x == pytest.approx(11 / 3) and centre.first().flat == 5.0
    two, centres = models.cluster_regions(df, ["x", "flat"], k=2)
    assert {(r.province, r.cluster) for r in two.collect()} == {("a", 0), ("b", 0), ("c", 1)}
    assert [r.x for r in centres.orderBy("cluster").collect()] == pytest.approx([1.0, 9.0])
    three, _ = models.cluster_regions(df, ["x", "flat"], k=3, restarts=2)  # more clusters than different regions
    assert {r.province: r.cluster for r in three.collect()}["a"] == {r.province: r.cluster for r in three.collect()}["b"]


def test_models_run_without_python_workers(spark):
    df = spark.createDataFrame([("A", 2001, 1, "2001-01", 1.0, 2.0)], "province string, year int, month int, ym string, avg_price double, x double")
    series, metrics, _ = models.forecast(df)
    for found in (series, metrics):
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in models.granger(df, "avg_price", "x")._jdf.queryExecution().executedPlan().toString()
