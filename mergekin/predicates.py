"""Temporal and link constraints of two records as boolean Columns.

What is not known satisfies: a null, or a year 0, makes every predicate true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERATION = 15
YEAR_GAP = 2
MARRIAGE_YEAR_GAP = 20


def known_year(c: Column) -> Column:
    return F.when(c != 0, c)


def _or_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(True))


def one_generation(year1: Column, year2: Column) -> Column:
    """The second event is at least a generation after the first."""
    return _or_true(known_year(year2) - known_year(year1) >= GENERATION)


def two_generations(year1: Column, year2: Column) -> Column:
    return _or_true(known_year(year2) - known_year(year1) >= 2 * GENERATION)


def one_generation_dates(date1: Column, date2: Column) -> Column:
    return one_generation(F.year(date1), F.year(date2))


def two_generations_dates(date1: Column, date2: Column) -> Column:
    return two_generations(F.year(date1), F.year(date2))


def years_close(year1: Column, year2: Column, gap: int = YEAR_GAP) -> Column:
    return _or_true(F.abs(known_year(year1) - known_year(year2)) <= gap)


def marriage_years_close(year1: Column, year2: Column) -> Column:
    return years_close(year1, year2, MARRIAGE_YEAR_GAP)


def is_after(date1: Column, date2: Column) -> Column:
    """The second date is not more than two days before the first."""
    return _or_true(F.datediff(date1, date2) <= 2)


def _months(date1: Column, date2: Column) -> Column:
    return (F.year(date2) - F.year(date1)) * 12 + F.month(date2) - F.month(date1)


def nine_months_apart(date1: Column, date2: Column) -> Column:
    return _or_true(F.abs(_months(date1, date2)) >= 9)


def at_most_nine_months_before(date1: Column, date2: Column) -> Column:
    return _or_true(_months(date1, date2) >= -9)


def sexes_agree(sex1: Column, sex2: Column) -> Column:
    return _or_true(F.nullif(sex1, F.lit("")) == F.nullif(sex2, F.lit("")))


def common_sex(sex1: Column, sex2: Column) -> Column:
    """The sex of a merged pair: either known one; null if none is known or they differ."""
    a, b = F.nullif(sex1, F.lit("")), F.nullif(sex2, F.lit(""))
    return F.when(sexes_agree(sex1, sex2), F.coalesce(a, b))


def earliest_year(*years: Column) -> Column:
    return F.coalesce(F.least(*years) if len(years) > 1 else years[0], F.lit(0))


def latest_year(*years: Column) -> Column:
    return F.coalesce(F.greatest(*years) if len(years) > 1 else years[0], F.lit(3000))


#: Roles on certificates. Bb baby, Bp its parent, Mm bride or groom, Mbp and Mgp their parents, Dd deceased, Ds spouse, Dp parent.
CIVIL_ROLES = ["Bb", "Bp", "Mm", "Mbp", "Mgp", "Dd", "Ds", "Dp"]
#: Links of two roles that the civil pipeline knows.
CIVIL_LINKS = [
    "Bb-Bp", "Bb-Mm", "Bb-Mbp", "Bb-Mgp", "Bb-Dd", "Bb-Ds", "Bb-Dp", "Bp-Bp", "Bp-Mm", "Bp-Mbp", "Bp-Mgp", "Bp-Dd", "Bp-Ds", "Bp-Dp", "Mm-Mm", "Mm-Mbp", "Mm-Mgp",
    "Mm-Dd", "Mm-Ds", "Mm-Dp", "Mbp-Mbp", "Mbp-Mgp", "Mbp-Dd", "Mbp-Ds", "Mbp-Dp", "Mgp-Mgp", "Mgp-Dd", "Mgp-Ds", "Mgp-Dp", "Dd-Ds", "Dd-Dp", "Ds-Ds", "Ds-Dp", "Dp-Dp",
]


def civil_link_valid(link: Column, p1: str, p2: str) -> Column:
    """Whether two people (struct columns with event_date, birth_year, marriage_year, sex) may be linked in these roles."""
    a, b = lambda f: F.col(f"{p1}.{f}"), lambda f: F.col(f"{p2}.{f}")
    one, two = one_generation_dates(a("event_date"), b("event_date")), two_generations_dates(a("event_date"), b("event_date"))
    after, births, weddings = is_after(a("event_date"), b("event_date")), years_close(a("birth_year"), b("birth_year")), marriage_years_close(a("marriage_year"), b("marriage_year"))
    female = F.coalesce(a("sex") == "F", F.lit(False)) | F.coalesce(b("sex") == "F", F.lit(False))
    return (
        F.when(link.isin("Bb-Ds", "Bb-Dp", "Mm-Mbp", "Mm-Mgp"), one)
        .when(link.isin("Bb-Mbp", "Bb-Mgp"), two)
        .when(link.isin("Bb-Dd", "Mm-Dd"), after & births)
        .when(link == "Bb-Bp", one & (b("marriage_year").isNull() | one_generation(a("birth_year"), b("marriage_year"))))
        .when(link == "Bb-Mm", one & births)
        .when(link == "Bp-Bp", nine_months_apart(a("event_date"), b("event_date")) & weddings)
        .when(link == "Bp-Mm", weddings)
        .when(link == "Bp-Dd", F.when(female, after).otherwise(at_most_nine_months_before(a("event_date"), b("event_date"))))
        .when(link == "Mm-Mm", births)
        .otherwise(F.lit(True))
    )
