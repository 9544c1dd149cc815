"""Period keys and district codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import _col


def pad_code(code, width: int = 5) -> Column:
    """Zero-padded code; a longer code keeps its full length, null stays null."""
    text = F.trim(_col(code).cast("string"))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def year_month(year, month) -> Column:
    return F.concat(_col(year).cast("string"), F.lit("-"), F.lpad(_col(month).cast("string"), 2, "0"))


def ym_from_compact(period) -> Column:
    """``YYYYMM…`` and ``YYYY-MM`` become ``YYYY-MM``; other shapes become null."""
    text = F.trim(_col(period).cast("string"))
    dashed = F.when(text.rlike(r"^\d{4}-\d{2}$"), text)
    compact = F.when(text.rlike(r"^\d{6}"), F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2)))
    return F.coalesce(dashed, compact)


def year_of(ym) -> Column:
    return F.substring(_col(ym), 1, 4).try_cast("int")


def month_of(ym) -> Column:
    return F.substring(_col(ym), 6, 2).try_cast("int")


def month_start(year, month) -> Column:
    return F.make_date(_col(year).cast("int"), _col(month).cast("int"), F.lit(1))
