from hearthpanel.functions.numeric import (
    annuity_present_value,
    clamp,
    clean_amount,
    clean_double,
    finite_or_null,
    half_even,
    nan_to_null,
    ratio,
)
from hearthpanel.functions.periods import month_of, pad_code, year_month, year_of, ym_from_compact
from hearthpanel.functions.regions import (
    exact_province,
    province_from_code,
    short_province,
    with_district_name,
)

__all__ = [
    "annuity_present_value",
    "clamp",
    "clean_amount",
    "clean_double",
    "exact_province",
    "finite_or_null",
    "half_even",
    "month_of",
    "nan_to_null",
    "pad_code",
    "province_from_code",
    "ratio",
    "short_province",
    "with_district_name",
    "year_month",
    "year_of",
    "ym_from_compact",
]
