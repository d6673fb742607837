"""Values of the filters size:, dm:/dc:/da: and attrib:, read when a query is compiled.

Each reader returns inclusive bounds or a mask, or None if the value says nothing valid.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

U64_MAX = (1 << 64) - 1

# Units of sizes, and attribute letters with their bits.
SIZE_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}
ATTRIBUTE_BITS = {
    "r": 0x1, "h": 0x2, "s": 0x4, "d": 0x10, "a": 0x20, "n": 0x80, "t": 0x100, "p": 0x200, "l": 0x400, "c": 0x800,
    "o": 0x1000, "i": 0x2000, "e": 0x4000, "v": 0x10000,
}

NUMBER = re.compile(r"([0-9]+\.?[0-9]*|\.[0-9]+)")


@dataclass(frozen=True)
class Bounds:
    """Inclusive; None is open."""

    low: int | None = None
    high: int | None = None


def split_operator(value: str) -> tuple[str, str]:
    for sign in (">=", "<=", ">", "<", "="):
        if value.startswith(sign):
            return sign, value[len(sign) :]
    return "=", value


def size_bytes(text: str) -> int | None:
    """A number with a unit of 1024 powers; fractions of a byte are cut off."""
    text = text.strip()
    found = re.match(r"[0-9.]*", text).group()
    if not NUMBER.fullmatch(found):
        return None
    unit = SIZE_UNITS.get(text[len(found) :].strip().lower())
    return None if unit is None else min(U64_MAX, int(float(found) * unit))


def between(value: str, read) -> tuple | None:
    """The two sides of ``A..B``: (given a, read a, given b, read b); None if a given side can't be read."""
    a, b = value.split("..", 1)
    sides = [read(x) if x.strip() else None for x in (a, b)]
    if any(s is None and x.strip() for s, x in zip(sides, (a, b))) or not (a.strip() or b.strip()):
        return None
    return tuple(sides)


def size_filter(value: str) -> Bounds | None:
    if ".." in value:
        sides = between(value, size_bytes)
        if sides is None:
            return None
        low, high = sides
        return Bounds(min(low, high), max(low, high)) if None not in sides else Bounds(low, high)
    sign, rest = split_operator(value)
    n = size_bytes(rest)
    if n is None:
        return None
    if sign == "<" and n == 0:
        return Bounds(1, 0)
    return {">": Bounds(min(U64_MAX, n + 1)), ">=": Bounds(n), "<": Bounds(None, n - 1), "<=": Bounds(None, n), "=": Bounds(n, n)}[sign]


def attribute_mask(value: str) -> int | None:
    """Bits of the letters; unknown letters are skipped; no known letter at all is no mask."""
    mask = 0
    for letter in value.lower():
        mask |= ATTRIBUTE_BITS.get(letter, 0)
    return mask or None


# ------------------------------------------------------------------ dates


def days_from_civil(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, for any year."""
    shifted = year - (month <= 2)
    era, of_era = divmod(shifted, 400)
    of_year = (153 * ((month + 9) % 12) + 2) // 5 + day - 1
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719468


def month_days(year: int, month: int) -> int:
    return days_from_civil(year + month // 12, month % 12 + 1, 1) - days_from_civil(year, month, 1)


#: Years that a date may name.
FIRST_YEAR, LAST_YEAR = -262_143, 262_142


def civil(year: int, month: int, day: int) -> int | None:
    """Day number of a valid date."""
    if not (FIRST_YEAR <= year <= LAST_YEAR and 1 <= month <= 12 and 1 <= day <= month_days(year, month)):
        return None
    return days_from_civil(year, month, day)


def midnight_ms(day: int, tz: str) -> int:
    """First instant of a local day: the first valid wall time 00:00 to 05:00, the earlier one if it occurs twice."""
    zone, epoch = ZoneInfo(tz), datetime(1970, 1, 1)
    if not -719_161 < day < 2_932_895:  # years 2 to 9999, which datetime can hold
        return day * 86_400_000
    for hour in range(6):
        wall = epoch + timedelta(days=day, hours=hour)
        instant = wall.replace(tzinfo=zone, fold=0).astimezone(timezone.utc)
        if instant.astimezone(zone).replace(tzinfo=None) == wall:
            return (instant - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
    return day * 86_400_000


def whole(text: str) -> int | None:
    """A strictly ASCII integer."""
    return int(text) if re.fullmatch(r"[+-]?[0-9]+", text, re.ASCII) and len(text) < 12 else None


def next_month(year: int, month: int) -> tuple[int, int]:
    return (year + 1, 1) if month == 12 else (year, month + 1)


def keyword_days(word: str, now: datetime) -> tuple[int, int] | None:
    today = days_from_civil(now.year, now.month, now.day)
    monday = today - now.weekday()
    month = days_from_civil(now.year, now.month, 1)
    before = (now.year - 1, 12) if now.month == 1 else (now.year, now.month - 1)
    year = [days_from_civil(now.year + k, 1, 1) for k in (-1, 0, 1)]
    return {
        "today": (today, today + 1), "yesterday": (today - 1, today), "thisweek": (monday, monday + 7), "lastweek": (monday - 7, monday),
        "thismonth": (month, month + month_days(now.year, now.month)), "lastmonth": (days_from_civil(*before, 1), month),
        "thisyear": (year[1], year[2]), "lastyear": (year[0], year[1]),
    }.get(word)


def date_days(text: str, now: datetime) -> tuple[int, int] | None:
    """First day, and the day after the last, of a keyword, year, month or day."""
    text = text.strip().lower()
    if found := keyword_days(text, now):
        return found
    parts = [whole(x) for x in re.split("[-/]", text)]
    if None in parts or len(parts) > 3:
        return None
    first = civil(*(parts + [1, 1])[:3])
    if first is None:
        return None
    after = civil(parts[0] + 1, 1, 1) if len(parts) == 1 else civil(*next_month(parts[0], parts[1]), 1) if len(parts) == 2 else first + 1
    return None if after is None else (first, after)


def date_filter(value: str, now: datetime, tz: str) -> Bounds | None:
    """Bounds in Unix milliseconds; ``now`` is local to ``tz``."""
    value = value.strip()

    def span(text: str) -> tuple[int, int] | None:
        days = date_days(text, now)
        return days and (midnight_ms(days[0], tz), midnight_ms(days[1], tz))

    if not value:
        return None
    if ".." in value:
        sides = between(value, span)
        if sides is None:
            return None
        known = [s for s in sides if s]
        return Bounds(min(s[0] for s in known) if sides[0] else None, max(s[1] for s in known) - 1 if sides[1] else None)
    sign, rest = split_operator(value)
    found = span(rest)
    if found is None:
        return None
    start, end = found
    return {">": Bounds(end), ">=": Bounds(start), "<": Bounds(None, start - 1), "<=": Bounds(None, end - 1), "=": Bounds(start, end - 1)}[sign]
