"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


MONEY_WIDTH = 14  # ten digits, three commas and a sign


def money_text(cents: str | Column) -> Column:
    """Whole currency units, half up, as text with thousands commas, right-aligned to ``MONEY_WIDTH`` characters.

    A larger amount takes as many characters as it needs.
    """
    exact = _col(cents).cast("decimal(38,0)") / F.lit(100).cast("decimal(3,0)")
    text = F.format_number(F.round(exact, 0).cast("decimal(38,0)"), 0)
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(MONEY_WIDTH) - F.length(text))), text)


def units(cents: str | Column) -> Column:
    """Cents as a double in currency units."""
    return _col(cents).cast("double") / 100


def quarter_desc(date: str | Column) -> Column:
    return F.concat(F.year(_col(date)), F.lit("-Q"), F.quarter(_col(date)))


def month_desc(date: str | Column) -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def calendar(df: DataFrame, date: str) -> DataFrame:
    """Add the calendar columns of a date. Weeks are ISO numbers beside the calendar year."""
    return df.withColumns(
        {
            "calendar_year": F.year(date),
            "calendar_quarter_number": F.quarter(date),
            "calendar_month_number": F.month(date),
            "calendar_week_number": F.weekofyear(date),
            "calendar_quarter_desc": quarter_desc(date),
            "calendar_month_desc": month_desc(date),
        }
    )


# fixed values: the ten syllables of a generated last name
SYLLABLES = ["BAR", "OUT", "ABE", "PRI", "PRES", "ESE", "ANTI", "CALY", "ATN", "EING"]


def syllable_name(number: str | Column) -> Column:
    """A number's last three digits as three syllables."""
    n = F.pmod(_col(number).cast("long"), F.lit(1000))
    table = F.array(*[F.lit(s) for s in SYLLABLES])
    digits = [F.floor(n / 100), F.pmod(F.floor(n / 10), F.lit(10)), F.pmod(n, F.lit(10))]
    return F.concat(*[F.get(table, d.cast("int")) for d in digits])


def hash_key(column: str | Column) -> Column:
    """The first 32 bits of the md5 of a key: the same number in every engine and after every retry."""
    return F.conv(F.substring(F.md5(_col(column).cast("string")), 1, 8), 16, 10).cast("long")


def hash_bucket(column: str | Column, n: int) -> Column:
    """A steady bucket 0..n-1 of a text; null falls in bucket 0."""
    return F.coalesce(F.pmod(hash_key(column), F.lit(n)), F.lit(0)).cast("int")


def clamp(column: str | Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(column)))


# fixed values: stock below the least is refilled by the refill
LEAST_STOCK, REFILL = 10, 91


def stock_after(stock: Column, ordered: Column) -> Column:
    """Stock after taking ``ordered`` pieces in any number of order lines.

    A line takes its quantity, and 91 is added back whenever less than 10
    would remain. For lines of 1 to 81 pieces and stock from 0 up, each refill
    lands in 10..100, so the end state depends on the sum alone and the lines
    need neither an order nor a common task.
    """
    left = stock - ordered
    wrapped = F.pmod(left - LEAST_STOCK, F.lit(REFILL)) + LEAST_STOCK
    return F.when((ordered == 0) | (left >= LEAST_STOCK), left).otherwise(wrapped)


def minute_of(ts: str | Column) -> Column:
    return F.date_trunc("minute", _col(ts))


def iso_minute(ts: str | Column) -> Column:
    """UTC minute stamp such as ``2024-01-15T12:30Z``."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm'Z'")


def as_array(json_text: str | Column, element: str) -> Column:
    """A JSON value that may be absent, single or an array, always as an array.

    ``element`` is the type of one entry, e.g. ``struct<FlightDate:bigint,Airport:string>``.
    """
    text = F.trim(_col(json_text))
    single = F.array(F.from_json(text, element))
    many = F.from_json(text, f"array<{element}>")
    empty = F.array().cast(f"array<{element}>")
    return (
        F.when(text.isNull() | (text == "null"), empty).when(F.startswith(text, F.lit("[")), many).otherwise(single)
    )
