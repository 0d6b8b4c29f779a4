"""Dates, durations and the arithmetic of movable days, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Days from Easter.
MOVABLE_OFFSETS = {"septuagesima": -63, "ash_wednesday": -46, "palm_sunday": -7, "easter": 0, "ascension": 39, "pentecost": 49, "trinity_sunday": 56}
# Dates that hold even against a Sunday.
SUNDAY_OVERRIDES = ["01-01", "02-02", "08-06"]
# Seconds between 1970 and 2001.
CORE_DATA_EPOCH = 978307200
# Last psalm of each book.
PSALM_BOOKS = {1: 41, 2: 72, 3: 89, 4: 106, 5: 150}


def _int(c: Column) -> Column:
    return F.floor(c).cast("int")


def _after_march(days: Column, year: Column) -> Column:
    """The date so many days after the 28th of March."""
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), days)


def western_easter(year: Column) -> Column:
    """Easter of the Gregorian calendar, from the golden number, the century and the epact. Each is worked out once."""

    def of(golden: Column, century: Column) -> Column:
        leap = century - _int(century / 4)
        epact = (leap - _int((8 * century + 13) / 25) + 19 * golden + 15) % 30
        moon = lambda e: e - _int(e / 28) * (1 - _int(e / 28) * _int(F.lit(29) / (e + 1)) * _int((21 - golden) / 11))
        days = lambda m: m - (year + _int(year / 4) + m + 2 - leap) % 7
        return let(let(let(epact, moon), days), lambda d: _after_march(d.cast("int"), year))

    return of(year % 19, _int(year / 100))


def orthodox_easter(year: Column) -> Column:
    """Easter of the Julian calendar, as a Gregorian date."""
    days = let((19 * (year % 19) + 15) % 30, lambda m: m - (year + _int(year / 4) + m) % 7)
    century = _int(year / 100)
    shift = F.when(year > 1582, 10 + F.when(year > 1600, century - 16 - _int((century - 16) / 4)).otherwise(0)).otherwise(0)
    return _after_march((days + shift).cast("int"), year)


def easter(year: Column, tradition: Column) -> Column:
    return F.when(tradition == "byzantine", orthodox_easter(year)).otherwise(western_easter(year))


def season(easter_day: Column) -> Column:
    """struct of the dates around Easter that transfers go by."""
    day = lambda n: F.date_add(easter_day, n)
    return F.struct(easter_day.alias("easter"), day(-46).alias("ash_wednesday"), day(-7).alias("palm_sunday"), day(-1).alias("holy_saturday"), day(6).alias("easter_saturday"), day(7).alias("second_sunday"), day(8).alias("week_after_second_sunday"))


def weekday_on_or_after(day: Column, name: Column) -> Column:
    """Names are SUN, MON, ... or in full; another name gives null."""
    return _next(F.date_sub(day, 1), name)


def weekday_after(day: Column, name: Column) -> Column:
    return _next(day, name)


_WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def _next(day: Column, name: Column) -> Column:
    """The next such weekday after day, by the distance of their numbers."""
    away = lambda d: F.date_add(d, (F.pmod(_number(F.lower(name), _WEEKDAYS) - 1 - F.dayofweek(d), F.lit(7)) + 1).cast("int"))
    return let(day, away)


def nth_weekday(year: Column, month: Column, n: Column, name: Column) -> Column:
    """The n-th such weekday of a month, counted on into the next month if there are fewer."""
    return F.date_add(weekday_on_or_after(F.make_date(year, month, F.lit(1)), name), (7 * (n - 1)).cast("int"))


def month_day(year: Column, rule: Column) -> Column:
    """The date of MM-DD in a year; null if there is none."""
    return F.try_to_date(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), rule), "yyyy-MM-dd")


def fixed_or_easter_rule(rule: Column, year: Column, tradition: Column) -> Column:
    """The date of a rule MM-DD or easter+N / easter-N; other rules give null."""
    offset = F.nullif(F.regexp_extract(rule, r"^easter([+-]\d+)$", 1), F.lit("")).cast("int")
    return F.when(F.regexp_like(rule, F.lit(r"^\d{2}-\d{2}$")), month_day(year, rule)).when(offset.isNotNull(), F.date_add(easter(year, tradition), offset))


_ORDINALS = ("first", "second", "third", "fourth", "fifth")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Patterns of movable rules, the first that fits counts.
MOVABLE_PATTERNS = {"easter": r"^easter([+-]\d+)$", "advent": r"^advent_1([+-]\d+)$", "first_sunday": r"^first_sunday_after_(\d{2}-\d{2})$", "on_or_after": r"^([a-z]+)_on_or_after_(\d{2}-\d{2})$", "after": r"^([a-z]+)_after_(\d{2}-\d{2})$", "ordinal": r"^(first|second|third|fourth|fifth)_(\w+)_of_(\w+)$"}


def _part(rule: Column, form: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(rule, MOVABLE_PATTERNS[form], group), F.lit(""))


def _number(word: Column, words: tuple[str, ...]) -> Column:
    """The word's place in the list, from 1; null for another one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, words)), word), F.lit(0)).cast("int")


def _ordinal_day(rule: Column, year: Column, easter_day: Column) -> Column:
    told = F.struct(_number(_part(rule, "ordinal", 1), _ORDINALS).alias("n"), _number(_part(rule, "ordinal", 3), _MONTHS).alias("month"))
    return let(told, lambda t: F.when(t["n"].isNotNull() & t["month"].isNotNull(), nth_weekday(year, F.coalesce(t["month"], F.lit(1)), F.coalesce(t["n"], F.lit(1)), _part(rule, "ordinal", 2))))


#: The date of a rule of each form, from the rule, the year and its Easter.
MOVABLE_FORMS = {
    "easter": lambda rule, year, easter_day: F.date_add(easter_day, _part(rule, "easter", 1).cast("int")),
    "advent": lambda rule, year, easter_day: F.date_add(weekday_on_or_after(month_day(year, F.lit("11-27")), F.lit("sunday")), _part(rule, "advent", 1).cast("int")),
    "first_sunday": lambda rule, year, easter_day: weekday_after(month_day(year, _part(rule, "first_sunday", 1)), F.lit("sunday")),
    "on_or_after": lambda rule, year, easter_day: weekday_on_or_after(month_day(year, _part(rule, "on_or_after", 2)), _part(rule, "on_or_after", 1)),
    "after": lambda rule, year, easter_day: weekday_after(month_day(year, _part(rule, "after", 2)), _part(rule, "after", 1)),
    "ordinal": _ordinal_day,
}


def movable_form(rule: Column) -> Column:
    """Which form a movable rule has; null for none."""
    return F.coalesce(*(F.when(F.regexp_like(rule, F.lit(pattern)), name) for name, pattern in MOVABLE_PATTERNS.items()))


def movable_rule(rule: Column, year: Column, easter_day: Column) -> Column:
    """The date of a movable rule in its whole grammar; a rule that isn't known, or a day that doesn't exist, gives null. For
    many rules at once see calendar.resolved."""
    form = movable_form(rule)
    return F.coalesce(*(F.when(form == name, day(rule, year, easter_day)) for name, day in MOVABLE_FORMS.items()))


def is_sunday(day: Column) -> Column:
    return F.dayofweek(day) == 1


def sunday_of_seasons(day: Column, easter_day: Column) -> Column:
    """Whether the day is a Sunday in Lent, in the Easter season or in Advent."""
    year = F.year(day)
    advent = weekday_on_or_after(month_day(year, F.lit("11-27")), F.lit("sunday"))
    return is_sunday(day) & (day.between(F.date_add(easter_day, -46), F.date_add(easter_day, 49)) | day.between(advent, month_day(year, F.lit("12-24"))))


def precedence_rank(precedence: Column, calendar_type: Column, rule: Column, day: Column) -> Column:
    """1 principal feast, 2 holy day that holds against a Sunday, 4 holy day, 5 lesser commemoration, 6 the rest."""
    holds = (calendar_type == "fixed") & rule.isin(SUNDAY_OVERRIDES) & is_sunday(day)
    return F.when(precedence == "principal_feast", 1).when((precedence == "holy_day") & holds, 2).when(precedence == "holy_day", 4).when(precedence == "lesser_commemoration", 5).otherwise(6)


def days_since(stamp: Column, now: Column) -> Column:
    """Whole days between dates, 0 at least; a stamp that is no date gives null."""
    days = F.datediff(F.to_date(now), F.try_to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd"))
    return F.when(days < 0, 0).otherwise(days)


def iso_time(stamp: Column) -> Column:
    """ISO text, with or without fractions and Z; null if it is none."""
    return F.try_to_timestamp(stamp)


def age_seconds(stamp: Column, now: Column) -> Column:
    """Only of text in the form yyyy-MM-ddTHH:mm:ssZ."""
    strict = F.when(F.regexp_like(stamp, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")), F.try_to_timestamp(stamp))
    return F.unix_timestamp(now) - F.unix_timestamp(strict)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds as a fraction, to one decimal."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 1)


def core_data_to_unix(seconds: Column) -> Column:
    return seconds + CORE_DATA_EPOCH


def iso_to_core_data(stamp: Column) -> Column:
    return (F.unix_micros(F.try_to_timestamp(stamp)) / 1e6) - CORE_DATA_EPOCH


def read_date(c: Column) -> Column:
    """The first of dates parted by |, slashes as dashes; odd forms stay; blank is null."""
    return F.nullif(F.replace(F.trim(F.split_part(c, F.lit("|"), F.lit(1))), F.lit("/"), F.lit("-")), F.lit(""))


def duration(c: Column) -> Column:
    """Seconds of H:MM:SS, M:SS or a number; anything else is 0."""
    parts = F.transform(F.split(c, ":"), lambda x: F.when(F.regexp_like(x, F.lit(r"^\s*\d+(\.\d+)?\s*$")), F.trim(x).cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when(F.size(parts) <= 3, F.coalesce(total, F.lit(0.0))).otherwise(F.lit(0.0))


def rating(c: Column) -> Column:
    return c.try_cast("double")


def psalm_book(number: Column) -> Column:
    out = None
    for book, last in PSALM_BOOKS.items():
        out = F.when(number.between(1, last), book) if out is None else out.when(number <= last, book)
    return out


def conversation_date(c: Column, today: Column) -> Column:
    """struct<date, error>: an ISO date; null or empty is today."""
    given = F.try_to_date(F.when(F.regexp_like(F.trim(c), F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.trim(c)), "yyyy-MM-dd")
    none = F.coalesce(c == "", F.lit(True))
    return F.struct(F.when(none, F.to_date(today)).otherwise(given).alias("date"), F.when(~none & given.isNull(), "no ISO date").alias("error"))
