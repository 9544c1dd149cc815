"""Province names and district names.

Provinces are a closed list, so the lookups are plain column expressions and
never a join. District names grow with the administrative register and are
passed in as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import _col
from hearthpanel.functions.periods import pad_code

# First two digits of a district code -> province.
PROVINCE_BY_CODE = {
    "11": "서울특별시",
    "26": "부산광역시",
    "27": "대구광역시",
    "28": "인천광역시",
    "29": "광주광역시",
    "30": "대전광역시",
    "31": "울산광역시",
    "36": "세종특별자치시",
    "41": "경기도",
    "42": "강원도",
    "43": "충청북도",
    "44": "충청남도",
    "45": "전라북도",
    "46": "전라남도",
    "47": "경상북도",
    "48": "경상남도",
    "50": "제주특별자치도",
    "51": "강원특별자치도",
    "52": "전북특별자치도",
}

# Full province name -> short name; the order decides ties of the
# containment match.
PROVINCE_SHORT = {
    "서울특별시": "서울",
    "부산광역시": "부산",
    "대구광역시": "대구",
    "인천광역시": "인천",
    "광주광역시": "광주",
    "대전광역시": "대전",
    "울산광역시": "울산",
    "세종특별자치시": "세종",
    "경기도": "경기",
    "강원도": "강원",
    "충청북도": "충북",
    "충청남도": "충남",
    "전라북도": "전북",
    "전라남도": "전남",
    "경상북도": "경북",
    "경상남도": "경남",
    "제주특별자치도": "제주",
    "강원특별자치도": "강원",
    "전북특별자치도": "전북",
}

# Province codes of the population survey (not the district prefix).
SURVEY_PROVINCE = {
    "11": "서울", "21": "부산", "22": "대구", "23": "인천", "24": "광주", "25": "대전",
    "26": "울산", "29": "세종", "31": "경기", "32": "강원", "33": "충북", "34": "충남",
    "35": "전북", "36": "전남", "37": "경북", "38": "경남", "39": "제주",
}

# Province codes of the labour-income survey.
INCOME_PROVINCE = {
    "A00": "전국", "A01": "서울", "A02": "인천", "A03": "경기", "A04": "강원",
    "A05": "대전", "A06": "충북", "A07": "충남", "A08": "세종", "A09": "광주",
    "A10": "전북", "A11": "전남", "A12": "대구", "A13": "경북", "A14": "부산",
    "A15": "울산", "A16": "경남", "A17": "제주", "A18": "기타",
}

NATIONWIDE = "전국"


def lookup(values: dict[str, str], key) -> Column:
    """Value of a small literal map, null where the key is unknown."""
    pairs = [F.lit(part) for item in values.items() for part in item]
    return F.create_map(*pairs)[_col(key)]


def province_from_code(code) -> Column:
    """Full province name of a five-digit district code."""
    return lookup(PROVINCE_BY_CODE, F.substring(pad_code(code), 1, 2))


def short_province(name, names: dict[str, str] | None = None) -> Column:
    """Short province name: exact, already short, then first containment match.

    A name that matches nothing is kept, so national totals stay recognisable.
    """
    names = names or PROVINCE_SHORT
    text = F.trim(_col(name))
    shorts = sorted(set(names.values()))
    contained = None
    for full, short in names.items():
        hit = text.contains(F.lit(short)) | F.lit(full).contains(text)
        contained = F.when(hit, F.lit(short)) if contained is None else contained.when(hit, F.lit(short))
    return F.coalesce(lookup(names, text), F.when(text.isin(shorts), text), contained, text)


def exact_province(name, names: dict[str, str] | None = None, *, keep_unknown: bool = False) -> Column:
    """Short name by exact match only, as the collectors of landed files use it."""
    names = names or PROVINCE_SHORT
    text = F.trim(_col(name))
    known = F.coalesce(lookup(names, text), F.when(text.isin(sorted(set(names.values()) | {NATIONWIDE})), text))
    return F.coalesce(known, text) if keep_unknown else known


def with_province(df: DataFrame, code: str = "district_code", *, name: str = "province") -> DataFrame:
    return df.withColumn(name, short_province(province_from_code(F.col(code))))


def with_district_name(df: DataFrame, names: DataFrame, *, code: str = "district_code", name: str = "district_name") -> DataFrame:
    """Attach the district name; a code missing from the register shows itself.

    ``names`` has one row per code. Its join type is left to the size check of
    the optimizer and AQE.
    """
    register = names.select(F.trim(F.col(code)).alias("_code"), F.col(name).alias("_name")).dropDuplicates(["_code"])
    return (
        df.join(register, F.trim(F.col(code)) == F.col("_code"), "left")
        .withColumn(name, F.coalesce("_name", F.col(code)))
        .drop("_code", "_name")
    )
