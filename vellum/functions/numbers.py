"""Scalar functions on years, shares, codes, hashes and colours, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_year(y: Column) -> Column:
    return F.when(F.abs(y) < 10000, y.cast("int"))


def decade(y: Column) -> Column:
    return (F.floor(valid_year(y) / 10) * 10).cast("int")


def century(y: Column) -> Column:
    return (F.floor(valid_year(y) / 100) * 100).cast("int")


def century_number(y: Column) -> Column:
    """20 for 1968 and 2000, 21 for 2001; -1 for the years 0 to -99."""
    y = valid_year(y)
    return F.when(y > 0, F.floor((y - 1) / 100) + 1).otherwise(-(F.floor(-y / 100) + 1)).cast("int")


def ordinal(n: Column) -> Column:
    last, two = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    end = F.when(two.between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def share(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(0.0)


def percent(part: Column, total: Column) -> Column:
    """Rounded percent: a part of something is never 0, a part that is not all never 100."""
    p = F.round(100 * share(part, total))
    return F.when(part <= 0, 0).when(part >= total, 100).otherwise(F.least(F.greatest(p, F.lit(1)), F.lit(99))).cast("int")


def shelf_length(n: Column, thickness: float = 2.7) -> Column:
    return F.round(n * F.lit(thickness), 1)


def backoff(attempt: Column, base: int = 30, cap: int = 21600) -> Column:
    """Seconds to wait after the n-th attempt: base, four times that, and so on up to a cap."""
    return F.least(F.lit(base) * F.pow(F.lit(4.0), F.greatest(attempt, F.lit(1)) - 1), F.lit(float(cap))).cast("long")


def isbn13_from(body: Column) -> Column:
    """Twelve digits with their check digit."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(body, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def isbn_valid(code: Column) -> Column:
    """True for an ISBN of 10 or 13 signs, hyphens and spaces aside, with a right check digit."""
    c = F.upper(F.regexp_replace(F.coalesce(code, F.lit("")), "[^0-9Xx]", ""))
    at = lambda i: F.when(F.substring(c, i, F.lit(1)) == "X", 10).otherwise(F.substring(c, i, F.lit(1)).try_cast("int"))
    ten = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: at(i) * (11 - i)), F.lit(0), lambda a, x: a + x)
    return F.when(c.rlike("^[0-9]{9}[0-9X]$"), ten % 11 == 0).when(c.rlike("^97[89][0-9]{10}$"), isbn13_from(F.substring(c, 1, 12)) == c).otherwise(False)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-16 units, as an unsigned number in a long."""
    raw = F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-16BE"))
    units = F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.length(raw) / 4).cast("int")), lambda i: i * 4 < F.length(raw)), lambda i: F.conv(F.substring(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))


def hash01(c: Column, salt: int = 0) -> Column:
    """A number from 0 to 1 that a text and a salt always give."""
    return fnv1a(F.concat(F.lit(f"{salt}:"), c)) / 4294967296


_M32 = 4294967295


def _times32(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers, its lower 32 bits; by halves, so that no long overflows."""
    low = a.bitwiseAND(F.lit(65535).cast("long")) * b
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(65535).cast("long")) * 65536
    return (low.bitwiseAND(F.lit(_M32).cast("long")) + high).bitwiseAND(F.lit(_M32).cast("long"))


def seeded(seed: Column, step: Column) -> Column:
    """The number from 0 to 1 that a 32-bit generator of one addition and two mixing products gives at its ``step``-th call (from 1)."""
    mask = F.lit(_M32).cast("long")
    a = (seed.cast("long") + _times32(F.lit(0x6D2B79F5).cast("long"), step.cast("long"))).bitwiseAND(mask)
    t = _times32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = t.bitwiseXOR((t + _times32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftright(t, 14)) / 4294967296


def daily_seed(key: Column, day: Column) -> Column:
    """A seed that stays the same all day."""
    return fnv1a(F.concat(key, F.lit(":"), F.date_format(day, "yyyy-MM-dd")))


def split_days(days: Column) -> list[Column]:
    """Whole years of 365 days and the days left."""
    d = F.greatest(F.ceil(days), F.lit(0))
    return [F.floor(d / 365).alias("years"), (d % 365).alias("days")]


def iso_valid(day: Column) -> Column:
    """True for a text of the form year-month-day that names a day."""
    return F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False))


def calendar_day(at: Column, zone: str) -> Column:
    """The calendar day of a UTC instant in a zone, as year-month-day."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def language(code: Column) -> Column:
    """Lower-case code of two letters, regions cut off; null for anything else."""
    c = F.lower(F.trim(code))
    return F.when(c.rlike("^[a-z]{2}(?:[-_].*)?$"), F.substring(c, 1, 2))


def country(code: Column) -> Column:
    """Upper-case code of two letters, null for anything else."""
    c = F.upper(F.trim(code))
    return F.when(c.rlike("^[A-Z]{2}$"), c)


def flag(code: Column) -> Column:
    """The two letter signs that show a country's flag, empty for anything else."""
    letters = {chr(a): chr(0x1F1E6 + a - 65) for a in range(65, 91)}
    table = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    c = country(code)
    return F.when(c.isNotNull(), F.concat(F.try_element_at(table, F.substring(c, 1, 1)), F.try_element_at(table, F.substring(c, 2, 1)))).otherwise("")


def stars(rating: Column, of: int = 5) -> Column:
    """Full and empty stars, empty without a rating."""
    r = F.least(F.round(rating), F.lit(of)).cast("int")
    return F.when(rating > 0, F.concat(F.repeat(F.lit("★"), r), F.repeat(F.lit("☆"), of - r))).otherwise("")


def clean_isbn(code: Column) -> Column:
    """Digits (and X at last) of a code of 10 or 13 signs, empty for anything else; the check digit is not looked at."""
    c = F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), "[^0-9X]", "")
    return F.when(c.rlike(r"^(?:\d{13}|\d{9}[\dX])$"), c).otherwise("")


def isbn10_from(isbn13: Column) -> Column:
    """The 10-sign form of a 978 code, null for others."""
    body = F.substring(isbn13, 4, 9)
    digits = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substring(body, i, F.lit(1)).try_cast("int") * (11 - i))
    check = F.pmod(11 - F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 11, F.lit(11))
    return F.when(isbn13.rlike(r"^978\d{10}$"), F.concat(body, F.when(check == 10, "X").otherwise(check.cast("string"))))


def nice_step(most: Column, ticks: int = 5) -> Column:
    """Step of 1, 2, 5 or 10 times a power of ten with which ``ticks`` steps reach ``most``; 1 at least."""
    rough = F.greatest(most / ticks, F.lit(1e-9))
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    part = rough / power
    return F.greatest(F.when(part <= 1, 1).when(part <= 2, 2).when(part <= 5, 5).otherwise(10) * power, F.lit(1.0))


def luminance(hex_colour: Column) -> Column:
    """Relative luminance of ``#rrggbb``, null for anything else."""
    ok = hex_colour.rlike("^#[0-9A-Fa-f]{6}$")

    def channel(at: int) -> Column:
        v = F.conv(F.substring(hex_colour, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return F.when(ok, 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6))


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def clamp_confidence(c: Column) -> Column:
    """0 to 1; values from 2 to 100 are percents."""
    v = F.when(c.between(2, 100), c / 100).otherwise(c)
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def media_kind(head: Column) -> Column:
    """Kind of a file from the hex of its first bytes."""
    h = F.hex(head)
    # Signatures of media files.
    return (
        F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("1A45DFA3"), "webm")
        .when(F.substring(h, 9, 8) == "66747970", "mp4").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
    )
