"""The dialect's functions as DataFrame columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronbase.plans.rewrite import PARTS, SECONDS


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def iff(condition: Column, then, otherwise) -> Column:
    """``then`` where the condition holds, else (null included) ``otherwise``."""
    return F.when(condition, then).otherwise(otherwise)


def nvl(x, default) -> Column:
    return F.coalesce(_col(x), default if isinstance(default, Column) else F.lit(default))


ifnull = nvl


def nvl2(x, then, otherwise) -> Column:
    return F.when(_col(x).isNotNull(), then).otherwise(otherwise)


def dateadd(part: str, n, date) -> Column:
    """``n`` parts after the date; time of day is cut first, the end of a month holds."""
    part, day = PARTS.get(part.lower(), part.lower()), _col(date).cast("date")
    n = n if isinstance(n, Column) else F.lit(n)
    if part in ("year", "quarter", "month"):
        return F.add_months(day, n * {"year": 12, "quarter": 3, "month": 1}[part]).cast("timestamp_ntz")
    if part in ("week", "day"):
        return F.date_add(day, (n * (7 if part == "week" else 1)).cast("int")).cast("timestamp_ntz")
    seconds = n * (SECONDS[part] if part != "millisecond" else 0.001)
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def datediff(part: str, start, end) -> Column:
    """Boundaries of ``part`` between two dates, times of day aside."""
    part, s, e = PARTS.get(part.lower(), part.lower()), _col(start).cast("date"), _col(end).cast("date")
    days, years = F.date_diff(e, s).cast("long"), F.year(e) - F.year(s)
    if part in SECONDS:
        return days * (86_400_000 if part == "millisecond" else 86400 // SECONDS[part])
    forms = {"day": days, "year": years, "month": years * 12 + F.month(e) - F.month(s), "quarter": years * 4 + F.quarter(e) - F.quarter(s)}
    if part == "week":
        return (days / 7).cast("long")
    return forms[part].cast("long")


def to_variant(x) -> Column:
    return _col(x).cast("variant")


def parse_json(x) -> Column:
    return F.parse_json(_col(x))


def object_construct(*pairs) -> Column:
    """JSON text of keys and values in turn; null values stay."""
    if len(pairs) % 2:
        raise ValueError("keys and values in turn are needed")
    if not pairs:
        return F.lit("{}")
    return F.to_json(F.struct(*[_col(v).alias(k) for k, v in zip(pairs[::2], pairs[1::2], strict=True)]), {"ignoreNullFields": "false"})


def listagg(x, separator: str = "", distinct: bool = False) -> Column:
    """Values joined in their own order; nulls are left out, an empty group is null."""
    values = (F.collect_set if distinct else F.collect_list)(_col(x).cast("string"))
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), separator))


def flatten(x) -> Column:
    """A row for each element; none for a null or empty array."""
    return F.explode(_col(x))


def concat(*parts) -> Column:
    """Joined text; nulls are left out."""
    return F.concat_ws("", *[_col(p).cast("string") for p in parts])
