"""Phone numbers: validity, kind and international form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import AREA_CODES
from .text import digits

RISING, FALLING = "01234567890123456789", "98765432109876543210"
_RUNS = "|".join(row[i : i + n] for row in (RISING, FALLING) for n in (8, 9) for i in range(len(row) - n + 1))
#: A subscriber number of at most two different digits, with one digit six times in a row, of a whole run, or with a run at its end.
PLACEHOLDER = rf"^..(?:([0-9])\1*(?:([0-9])(?:\1|\2)*)?|[0-9]*?([0-9])\3{{5}}[0-9]*|{_RUNS}|[0-9]*(?:12345678|87654321))$"
AREA = f"^(?:{'|'.join(map(str, AREA_CODES))})"


def _national(raw: Column) -> Column:
    """Digits without international prefix and leading zeros; 55 goes where 12 or 13 digits remain."""
    plain = F.regexp_replace(digits(raw), "^(?:00)?0*", "")
    return F.regexp_replace(plain, "^55(?=[0-9]{10,11}$)", "")


def checked(d: Column) -> Column:
    """struct<value, kind, reason> of prepared digits."""
    # patterns over one column keep the expression small, however it is nested
    reason = (
        F.when(~d.rlike("^[0-9]{10,11}$"), "foreign_or_bad_length")
        .when(~d.rlike(AREA), "bad_ddd")
        .when(d.rlike("^..[^9].{8}$"), "bad_mobile")
        .when(d.rlike("^..[^2-5].{7}$"), "bad_landline")
        .when(d.rlike(PLACEHOLDER), "placeholder_pattern")
    )
    ok = reason.isNull()
    return F.struct(F.when(ok, d).alias("value"), F.when(ok, F.when(F.length(d) == 11, "mobile").otherwise("landline")).alias("kind"), reason.alias("reason"))


def national_phone(raw: Column) -> Column:
    """struct<value, kind, reason>: a national number of a landline or mobile, or why it is none."""
    return F.when(raw.isNotNull(), checked(_national(raw)))


def _with_ninth(d: Column) -> Column:
    """An old mobile of eight digits that starts with 6 to 9 gets its ninth digit."""
    return F.regexp_replace(d, AREA.replace("(?:", "(?<a>") + "(?<n>[6-9][0-9]{7})$", "${a}9${n}")


def message_phone(raw: Column) -> Column:
    """As national_phone, of the number with its ninth digit."""
    return F.when(raw.isNotNull(), checked(_with_ninth(_national(raw))))


def prepared(raw: Column, message: bool) -> Column:
    """The digits that checked() looks at."""
    return _with_ninth(_national(raw)) if message else _national(raw)


def registry_phone_kind(area: Column, number: Column) -> Column:
    """mobile, landline or invalid as the registry stores numbers; null without a number."""
    first, size = F.substring(number, 1, 1), F.length(number)
    bad = (F.replace(number, first, F.lit("")) == "") | number.isin("12345678", "123456789") | area.isNull() | (F.length(area) != 2) | (area == "00")
    mobile = ((size == 9) & (first == "9")) | ((size == 8) & first.isin("6", "7", "8", "9"))
    return F.when(number.isNull(), F.lit(None)).when(bad, "invalid").when(mobile, "mobile").when((size == 8) & first.isin("2", "3", "4", "5"), "landline").otherwise("invalid")


def e164_variants(area: Column, number: Column) -> Column:
    """The numbers to try for a registered phone, in order: eight digits from 6 on first with the ninth digit."""
    a, n = digits(F.coalesce(area, F.lit(""))), digits(F.coalesce(number, F.lit("")))
    short = (F.length(n) == 8) & F.substring(n, 1, 1).isin("6", "7", "8", "9")
    full = F.concat(F.lit("55"), a, n)
    none = F.array().cast("array<string>")
    return F.when((F.length(a) != 2) | ~F.length(n).isin(8, 9), none).when(short, F.array(F.concat(F.lit("55"), a, F.lit("9"), n), full)).otherwise(F.array(full))
