"""Column functions: parsing, flags, keys, prices. NULL is missing; conditions with NULL give flag 0."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import AREA_BINS, JEONSE, MISSING_TOKENS, MONTHLY, PYEONG_M2

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+\z"


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is NULL."""
    return F.coalesce(condition, F.lit(False)).cast("int")


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def missing_to_null(text: Column) -> Column:
    """Outer white space (any kind) off; a missing token becomes NULL."""
    bare = F.regexp_replace(text, EDGES, "")
    return F.when(~bare.isin(*MISSING_TOKENS), bare)


def parse_number(text: Column) -> Column:
    """Commas out, then a double; what isn't a plain number is NULL."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def zero_filled(text: Column, width: int) -> Column:
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def parse_day(ym: Column, day: Column) -> Column:
    """YYYYMM and day of month to a date, or NULL."""
    joined = F.concat(F.coalesce(ym, F.lit("")), zero_filled(F.coalesce(day, F.lit("")), 2))
    return F.when(joined.rlike(r"^[0-9]{8}\z"), F.try_to_timestamp(joined, F.lit("yyyyMMdd")).cast("date"))


def location_part(sigungu: Column, i: int) -> Column:
    return F.get(F.split(sigungu, r"\s+", 3), F.lit(i))


def contract_kind(kind: Column) -> Column:
    return F.when(kind == "신규", "new").when(kind == "갱신", "renewal").otherwise("unknown")


def area_bin(area: Column, bins=AREA_BINS) -> Column:
    """Label of the left-closed bin of `area`; NULL outside all bins."""
    out = None
    for low, high in bins:
        inside = (area >= low) & (area < high) if high is not None else area >= low
        label = f"{low}-{high}" if high is not None else f"{low}+"
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def pyeong(area: Column) -> Column:
    return area / PYEONG_M2


def keyed(*parts: Column) -> Column:
    """Parts joined by a bar; NULL counts as empty and keeps its place."""
    empty = [F.coalesce(p, F.lit("")) for p in parts]
    out = empty[0]
    for p in empty[1:]:
        out = F.concat(out, F.lit("|"), p)
    return out


def is_address_name(name: Column) -> Column:
    return flag(name.rlike(r"^\([0-9]+(-[0-9]+)?\)\z"))


def period_month(period: Column, which: int) -> Column:
    """First day of the first (1) or second (2) month of 'YYYYMM~YYYYMM'; NULL if it isn't one."""
    found = F.nullif(F.regexp_extract(period, r"^(\d{6})\s*~\s*(\d{6})$", which), F.lit(""))
    return F.try_to_timestamp(found, F.lit("yyyyMM")).cast("date")


def months_between_firsts(start: Column, end: Column) -> Column:
    return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("double")


def price(rent_type: Column, deposit: Column, rent: Column) -> Column:
    return F.when(rent_type == JEONSE, deposit).when(rent_type == MONTHLY, rent)


def ratio(a: Column, b: Column) -> Column:
    """a / b - 1 where b is positive."""
    return a / F.when(b > 0, b) - 1


def building_age(contract_year: Column, built: Column) -> Column:
    return F.when((built <= contract_year) & (built >= 1900), contract_year - built)


def labelled_period(date: Column, splits: dict) -> Column:
    """Name of the inclusive date range that holds `date`."""
    out = None
    for name, (start, end) in splits.items():
        inside = date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def won(v: Column) -> Column:
    """Units of 10,000 won as text with hundred-millions and thousands separators, rounded half to even."""
    n = F.bround(v, 0).cast("long")
    big, small = F.floor(n / 10_000).cast("long"), n % 10_000
    rest = F.when(small != 0, F.concat(F.lit(" "), F.format_number(small, 0), F.lit("만원"))).otherwise("원")
    return F.when(n >= 10_000, F.concat(big.cast("string"), F.lit("억"), rest)).otherwise(F.concat(F.format_number(n, 0), F.lit("만원")))
