"""Scalar functions of the risk model, as columns. Dates are compared with an as_of argument, never with the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what fold_key makes of them.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def comma_decimal(c: str | Column) -> Column:
    """A number written with a decimal comma; null if it isn't one."""
    return F.regexp_replace(F.trim(col(c)), ",", ".").try_cast("double")


def year_of(c: str | Column) -> Column:
    """The year of YYYYMM."""
    return F.substring(F.trim(col(c)), 1, 4).try_cast("int")


def month_of(c: str | Column) -> Column:
    return F.substring(F.trim(col(c)), 5, 2).try_cast("int")


def title_case(c: str | Column) -> Column:
    """A capital after everything that isn't a letter, the rest in lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def fold_key(c: str | Column) -> Column:
    """Lower case without accents, however these are written: the key by which names are joined."""
    return F.regexp_replace(F.translate(F.lower(col(c)), ACCENTED, PLAIN), r"\p{M}+", "")


def completed_years(since: str | Column, as_of: str | Column) -> Column:
    """Whole years from a date to as_of; null without a date."""
    since, as_of = col(since), col(as_of)
    day = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    return F.year(as_of) - F.year(since) - F.when(day(since) > day(as_of), 1).otherwise(0)


def half_up(c: str | Column, digits: int) -> Column:
    """Rounded half away from zero, in decimals, so that engines agree; a double again afterwards."""
    x = col(c)
    large = F.round(x.try_cast("decimal(38,8)"), digits).cast("double")
    return F.when(F.abs(x) < 1e9, F.round(x.cast("decimal(18,8)"), digits).cast("double")).otherwise(large)


def exact_mean(c: str | Column) -> Column:
    """Aggregate: the mean of a decimal column; its sum has no rounding, so the order of rows doesn't matter."""
    return F.sum(col(c)).cast("double") / F.count(col(c))


def month_index(year: str | Column = "ano", month: str | Column = "mes") -> Column:
    return col(year) * 12 + col(month)


def equipment_status(age: str | Column) -> Column:
    return F.when(col(age) > 25, "critico").when(col(age) > 20, "atencao").otherwise("ok")


def trend_label(recent: str | Column, before: str | Column, margin: float = 2) -> Column:
    return F.when(col(recent) > col(before) + margin, "piorando").when(col(recent) < col(before) - margin, "melhorando").otherwise("estavel")


def risk_band(score: str | Column) -> Column:
    s = col(score)
    return F.when(s >= 80, "critico").when(s >= 60, "alto").when(s >= 40, "medio").when(s.isNotNull(), "baixo")


def remaining_life(age: str | Column, life: int = 30) -> Column:
    """Years left of a transformer's life; 0 if its age is unknown."""
    return F.greatest(F.lit(0), F.lit(life) - col(age))


def households(people: str | Column, factor: float = 0.35) -> Column:
    return F.floor(col(people) * factor).cast("int")


def density(people: str | Column, area_km2: str | Column) -> Column:
    return F.when(col(area_km2) > 0, F.floor(col(people) / col(area_km2) + 0.5).cast("long"))


def coverage_pct(gap_km: str | Column, line_km: str | Column) -> Column:
    return F.when(col(line_km) > 0, F.greatest(F.lit(0), F.floor((1 - col(gap_km) / col(line_km)) * 100 + 0.5).cast("long")))


def contains_ci(c: str | Column, text: str) -> Column:
    """Contains text, in any case; % and _ in it are wildcards."""
    return col(c).ilike(f"%{text}%")
