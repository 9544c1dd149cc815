"""Golden scenarios for the tax tables: boundaries, exemptions, surcharges."""

import pytest
from pyspark.sql import functions as F

from hearthpanel.operators import tax


@pytest.mark.parametrize(
    "price, homes, area, first, zone, rate, total",
    [
        (60000.0, 1, 84.0, False, True, 1.0, 660.0),
        (75000.0, 1, 84.0, False, True, 2.0, 1650.0),
        (90000.0, 1, 84.0, False, True, 3.0, 2970.0),
        (90001.0, 1, 84.0, False, True, 3.0, 2970.0),
        (90000.0, 1, 85.1, False, True, 3.0, 3240.0),
        (50000.0, 2, 84.0, False, True, 8.0, 4400.0),
        (50000.0, 2, 84.0, False, False, 1.0, 550.0),
        (50000.0, 3, 84.0, False, True, 12.0, 6600.0),
        (50000.0, 3, 84.0, False, False, 8.0, 4400.0),
        (15000.0, 1, 84.0, True, True, 1.0, 0.0),
        (50000.0, 1, 84.0, True, True, 1.0, 330.0),
        (120000.0, 1, 84.0, True, True, 3.0, 3740.0),
        (120001.0, 1, 84.0, True, True, 3.0, 3960.0),
        (50000.0, 2, 84.0, True, True, 8.0, 4400.0),
    ],
)
def test_acquisition_tax(spark, price, homes, area, first, zone, rate, total):
    df = spark.createDataFrame([(price, homes, area, first, zone)], "p double, h int, a double, f boolean, z boolean")
    row = tax.with_acquisition_tax(df, price="p", homes="h", area="a", first_home="f", adjusted="z").first()
    assert row["acquisition_rate_pct"] == rate
    assert row["acquisition_total"] == pytest.approx(total, abs=0.2)
    assert row["acquisition_effective_pct"] == pytest.approx(total / price * 100, abs=1e-3)


def gains(spark, **case):
    case = {"buy": 0.0, "sell": 0.0, "held": 1.0, "lived": 0.0, "one": False, "homes": 1, "costs": 0.0, **case}
    df = spark.createDataFrame([tuple(case.values())], "buy double, sell double, held double, lived double, one boolean, homes int, costs double")
    return tax.with_capital_gains_tax(
        df, buy="buy", sell="sell", holding_years="held", residence_years="lived", one_home="one", homes="homes", costs="costs"
    ).first()


@pytest.mark.parametrize(
    "base, due", [(1400, 84), (5000, 624), (8800, 1590), (15000, 3760), (30000, 9460), (50000, 17460), (100000, 38460), (200000, 83460)]
)
def test_gain_brackets(spark, base, due):
    row = gains(spark, buy=0.0, sell=float(base + 250))
    assert (row["tax_base"], row["gains_tax"]) == (float(base), float(due))
    assert row["gains_total"] == pytest.approx(due * 1.1, abs=0.1)


def test_no_gain_and_exemption(spark):
    loss = gains(spark, buy=100.0, sell=90.0)
    assert (loss["gain"], loss["gains_total"], loss["is_exempt"], loss["gains_reason"]) == (-10.0, 0.0, False, "no gain")
    free = gains(spark, buy=60000.0, sell=120000.0, held=2.0, lived=2.0, one=True)
    assert (free["is_exempt"], free["gains_total"], free["tax_base"], free["gain"]) == (True, 0.0, 0.0, 60000.0)
    unlived = gains(spark, buy=60000.0, sell=120000.0, held=2.0, lived=1.0, one=True)
    assert not unlived["is_exempt"] and unlived["gains_tax"] > 0


def test_taxed_above_the_limit(spark):
    row = gains(spark, buy=100000.0, sell=200000.0, held=10.9, lived=10.0, one=True)
    assert row["taxable_gain"] == 40000.0 and row["long_holding_rate_pct"] == 60.0
    assert row["tax_base"] == pytest.approx(40000 * 0.4 - 250)
    assert row["gains_reason"] == "one home, taxed above 1.2 billion"
    most = gains(spark, buy=100000.0, sell=200000.0, held=30.0, lived=30.0, one=True)
    assert most["long_holding_rate_pct"] == 80.0


@pytest.mark.parametrize("years, pct", [(2.9, 0.0), (3.0, 2.0), (10.0, 16.0), (17.0, 30.0), (40.0, 30.0)])
def test_general_long_holding(spark, years, pct):
    assert gains(spark, buy=0.0, sell=50000.0, held=years, homes=2)["long_holding_rate_pct"] == pct


@pytest.mark.parametrize("homes, rate", [(1, 38.0), (2, 58.0), (3, 68.0), (5, 68.0)])
def test_surcharges(spark, homes, rate):
    row = gains(spark, buy=0.0, sell=20250.0, homes=homes)
    assert row["gains_rate_pct"] == rate
    assert row["gains_tax"] == pytest.approx(20000 * rate / 100 - 1940)


def test_investment_return(spark):
    df = spark.createDataFrame([(50000.0, 70000.0, 4.0), (50000.0, 1000.0, 4.0), (50000.0, 70000.0, 0.0)], "b double, s double, y double")
    out = tax.with_investment_return(
        df, buy="b", sell="s", holding_years="y", loan=20000, loan_rate_pct=5.0, monthly_income=50, annual_expenses=100, acquisition_tax=550, gains_tax=3000
    ).collect()
    first = out[0]
    assert (first["equity"], first["interest_cost"], first["rental_income"]) == (30550.0, 4000.0, 2400.0)
    assert first["total_cost"] == 550 + 4000 + 400 + 3000 and first["net_profit"] == 20000 + 2400 - 7950
    assert first["annual_return_pct"] == pytest.approx(((45000 / 30550) ** 0.25 - 1) * 100, abs=0.01)
    assert first["break_even_price"] == 50000 + 550 + 4000 + 400 - 2400
    assert out[1]["annual_return_pct"] == -100.0 and out[2]["annual_return_pct"] == 0.0


def test_all_rules_stay_in_the_jvm(spark):
    df = spark.range(10).select((F.col("id") * 10000.0).alias("p"))
    plan = tax.with_capital_gains_tax(tax.with_acquisition_tax(df, price="p"), buy="p", sell=F.col("p") * 2, holding_years=3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text
