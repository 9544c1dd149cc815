"""Housing taxes and investment returns as columns over contract tables.

Amounts are in 10,000 KRW. Every rule is a column expression, so a table of any
size is one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import _col, half_even, ratio

# Acquisition tax.
LOW_PRICE, HIGH_PRICE = 6.0, 9.0  # 100 million KRW
LOW_RATE, HIGH_RATE = 0.01, 0.03
SECOND_HOME_RATE, THIRD_HOME_RATE = 0.08, 0.12
FIRST_HOME_FREE, FIRST_HOME_LIMIT, FIRST_HOME_RELIEF = 1.5, 12.0, 200.0
EDUCATION_SHARE, RURAL_SHARE, RURAL_FREE_AREA = 0.10, 0.10, 85.0

# Capital gains tax brackets (upper limit, rate, deduction).
GAIN_BRACKETS = [
    (1400.0, 0.06, 0.0),
    (5000.0, 0.15, 126.0),
    (8800.0, 0.24, 522.0),
    (15000.0, 0.35, 1490.0),
    (30000.0, 0.38, 1940.0),
    (50000.0, 0.40, 2540.0),
    (100000.0, 0.42, 3540.0),
    (None, 0.45, 6540.0),
]
EXEMPT_SALE = 120000.0
BASIC_DEDUCTION = 250.0
SURCHARGES = {2: 0.20, 3: 0.30}
LOCAL_SHARE = 0.10


def _value(arg) -> Column:
    """A column name, a column, or a constant."""
    if isinstance(arg, (str, Column)):
        return _col(arg)
    return F.lit(arg)


def _number(arg) -> Column:
    return _value(arg).cast("double")


def with_acquisition_tax(
    df: DataFrame, *, price, homes=1, area=85.0, first_home=False, adjusted=True, digits: bool = True
) -> DataFrame:
    """Acquisition tax with education and rural surtax for each purchase.

    ``homes`` counts the homes owned after the purchase. ``digits=False`` leaves
    the amounts unrounded.
    """
    amount, owned = _number(price), _value(homes).cast("int")
    size, first, zone = _number(area), _value(first_home), _value(adjusted)
    hundred_million = amount / F.lit(10000.0)
    sliding = (
        F.when(hundred_million <= LOW_PRICE, F.lit(LOW_RATE))
        .when(hundred_million <= HIGH_PRICE, F.lit(LOW_RATE) + (hundred_million - LOW_PRICE) / 3.0 * 0.02)
        .otherwise(F.lit(HIGH_RATE))
    )
    rate = (
        F.when((owned >= 3) & zone, F.lit(THIRD_HOME_RATE))
        .when((owned >= 3) | ((owned == 2) & zone), F.lit(SECOND_HOME_RATE))
        .otherwise(sliding)
    )
    full = amount * rate
    relief = F.when(
        first & (owned == 1),
        F.when(hundred_million <= FIRST_HOME_FREE, full)
        .when(hundred_million <= FIRST_HOME_LIMIT, F.least(full, F.lit(FIRST_HOME_RELIEF)))
        .otherwise(0.0),
    ).otherwise(0.0)
    rule = (
        F.when(owned >= 3, F.when(zone, "three homes, adjusted zone").otherwise("three homes"))
        .when((owned == 2) & zone, "two homes, adjusted zone")
        .when(hundred_million <= LOW_PRICE, "up to 600 million")
        .when(hundred_million <= HIGH_PRICE, "600 to 900 million")
        .otherwise("over 900 million")
    )
    df = df.withColumns({"_rate": rate, "_paid": F.greatest(F.lit(0.0), full - relief)})
    paid = F.col("_paid")
    df = df.withColumns(
        {"_education": paid * EDUCATION_SHARE, "_rural": F.when(size <= RURAL_FREE_AREA, F.lit(0.0)).otherwise(paid * RURAL_SHARE)}
    )
    total = paid + F.col("_education") + F.col("_rural")
    one, four = (1, 4) if digits else (None, None)
    return df.withColumns(
        {
            "acquisition_rate_pct": half_even(F.col("_rate") * 100, four),
            "acquisition_tax": half_even(paid, one),
            "education_tax": half_even("_education", one),
            "rural_tax": half_even("_rural", one),
            "acquisition_total": half_even(total, one),
            "acquisition_effective_pct": half_even(F.when(amount > 0, ratio(total, amount) * 100).otherwise(0.0), four),
            "acquisition_rule": rule,
        }
    ).drop("_rate", "_paid", "_education", "_rural")


def _bracket(base: Column, pick: int) -> Column:
    chain = None
    for limit, *terms in GAIN_BRACKETS:
        value = F.lit(terms[pick])
        if limit is None:
            return chain.otherwise(value)
        hit = base <= limit
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    raise AssertionError("the last bracket is open")


def with_capital_gains_tax(
    df: DataFrame,
    *,
    buy,
    sell,
    holding_years,
    residence_years=0,
    one_home=True,
    homes=1,
    costs=0,
    digits: bool = True,
) -> DataFrame:
    """Capital gains tax for each sale.

    One-home sellers who held and lived two years are exempt up to 1.2 billion
    KRW and pay on the share above it. The long-holding deduction is 2 % a year
    held plus 4 % a year lived in (each up to 40 %) for them, else 2 % a year
    beyond two, up to 30 %. Two homes add 20 points, three or more 30.
    """
    bought, sold = _number(buy), _number(sell)
    held, lived = _number(holding_years), _number(residence_years)
    single = _value(one_home) & (_value(homes) == 1)
    count = _value(homes).cast("int")

    gain = sold - bought - _number(costs)
    profit = gain > 0
    qualified = single & (held >= 2) & (lived >= 2)
    exempt = profit & qualified & (sold / 10000.0 <= 12)
    taxed = profit & ~exempt
    df = df.withColumns({"_gain": gain, "_taxed": taxed, "_exempt": exempt})
    over_limit = qualified & (sold / 10000.0 > 12)
    share = F.when(over_limit, gain * ((sold - EXEMPT_SALE) / F.when(sold != 0, sold))).otherwise(gain)
    whole_held, whole_lived = F.floor(held), F.floor(lived)
    resident = F.least(
        F.least(whole_held * 0.02, F.lit(0.40)) + F.least(whole_lived * 0.04, F.lit(0.40)), F.lit(0.80)
    )
    general = F.when(whole_held >= 3, F.least((whole_held - 2) * 0.02, F.lit(0.30))).otherwise(0.0)
    df = df.withColumns({"_share": share, "_ltg_rate": F.when(single & (lived >= 2), resident).otherwise(general)})
    df = df.withColumn("_ltg", F.col("_share") * F.col("_ltg_rate"))
    df = df.withColumn(
        "_base",
        F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), F.col("_share") - F.col("_ltg")) - BASIC_DEDUCTION),
    )
    base = F.col("_base")
    surcharge = F.when(count == 2, F.lit(SURCHARGES[2])).when(count >= 3, F.lit(SURCHARGES[3])).otherwise(0.0)
    df = df.withColumns({"_rate": _bracket(base, 0), "_deduction": _bracket(base, 1), "_surcharge": surcharge})
    df = df.withColumn(
        "_tax", F.greatest(F.lit(0.0), base * F.col("_rate") - F.col("_deduction") + base * F.col("_surcharge"))
    )
    local = F.col("_tax") * LOCAL_SHARE
    total = F.col("_tax") + local

    def when_taxed(value: Column, places: int) -> Column:
        return half_even(F.when(F.col("_taxed"), value).otherwise(0.0), places if digits else None)

    reason = (
        F.when(F.col("_gain") <= 0, "no gain")
        .when(F.col("_exempt"), "one home, exempt up to 1.2 billion")
        .when(over_limit, "one home, taxed above 1.2 billion")
        .when(single & (held >= 2), "lived under two years")
        .when(single, "held under two years")
        .otherwise("")
    )
    out = df.withColumns(
        {
            "gain": half_even("_gain", 1 if digits else None),
            "taxable_gain": when_taxed(F.col("_share"), 1),
            "long_holding_deduction": when_taxed(F.col("_ltg"), 1),
            "long_holding_rate_pct": when_taxed(F.col("_ltg_rate") * 100, 1),
            "tax_base": when_taxed(base, 1),
            "gains_rate_pct": when_taxed((F.col("_rate") + F.col("_surcharge")) * 100, 1),
            "gains_tax": when_taxed(F.col("_tax"), 1),
            "local_income_tax": when_taxed(local, 1),
            "gains_total": when_taxed(total, 1),
            "gains_effective_pct": when_taxed(ratio(total, "_gain") * 100, 2),
            "is_exempt": F.col("_exempt"),
            "gains_reason": reason,
        }
    )
    return out.drop("_gain", "_taxed", "_exempt", "_share", "_ltg_rate", "_ltg", "_base", "_rate", "_deduction", "_surcharge", "_tax")


def with_investment_return(
    df: DataFrame,
    *,
    buy,
    sell,
    holding_years,
    loan=0,
    loan_rate_pct=3.5,
    monthly_income=0,
    annual_expenses=0,
    acquisition_tax=0,
    gains_tax=0,
    digits: bool = True,
) -> DataFrame:
    """Leveraged return of each purchase-and-sale scenario.

    Equity is at least 1, interest is simple, and a wiped-out position has an
    annual return of -100 %.
    """
    bought, sold, years, borrowed = _number(buy), _number(sell), _number(holding_years), _number(loan)
    entry_tax, exit_tax = _number(acquisition_tax), _number(gains_tax)
    equity = F.greatest(bought + entry_tax - borrowed, F.lit(1.0))
    interest = borrowed * (_number(loan_rate_pct) / 100.0) * years
    rent = _number(monthly_income) * 12.0 * years
    upkeep = _number(annual_expenses) * years
    df = df.withColumns({"_equity": equity, "_interest": interest, "_rent": rent, "_upkeep": upkeep})
    df = df.withColumns(
        {
            "_cost": entry_tax + F.col("_interest") + F.col("_upkeep") + exit_tax,
            "_gross": sold - bought + F.col("_rent"),
        }
    )
    df = df.withColumn("_net", F.col("_gross") - F.col("_cost"))
    final = F.col("_equity") + F.col("_net")
    annual = (
        F.when(years <= 0, 0.0)
        .when(final > 0, (F.pow(final / F.col("_equity"), F.lit(1.0) / F.when(years > 0, years)) - 1) * 100)
        .otherwise(-100.0)
    )
    whole, one, two = (0, 1, 2) if digits else (None, None, None)
    return df.withColumns(
        {
            "equity": half_even("_equity", whole),
            "gross_profit": half_even("_gross", one),
            "net_profit": half_even("_net", one),
            "roe_pct": half_even(F.col("_net") / F.col("_equity") * 100, two),
            "annual_return_pct": half_even(annual, two),
            "total_cost": half_even("_cost", one),
            "interest_cost": half_even("_interest", one),
            "rental_income": half_even("_rent", one),
            "upkeep_cost": half_even("_upkeep", one),
            "break_even_price": half_even(
                bought + entry_tax + F.col("_interest") + F.col("_upkeep") - F.col("_rent"), whole
            ),
        }
    ).drop("_equity", "_interest", "_rent", "_upkeep", "_cost", "_gross", "_net")
