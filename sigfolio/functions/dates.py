"""Date and number parsing expressions (all JVM-side, ANSI-safe)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigfolio.functions._util import as_col

# Fixed value: SAS day serials count days from this origin.
SAS_EPOCH = "1960-01-01"


def sas_serial_to_date(c, fmt: str | None = None) -> Column:
    """Days since 1960-01-01 -> DATE (or a formatted string when ``fmt``).

    The fractional part is truncated toward zero like Python ``int()``;
    NULL or non-numeric input gives NULL instead of raising.
    """
    days = as_col(c).try_cast("double").try_cast("int")
    d = F.date_add(F.lit(SAS_EPOCH).cast("date"), days)
    return F.date_format(d, fmt) if fmt else d


def compact_date(c, fmt: str | None = None) -> Column:
    """``yyyyMMdd`` string -> DATE (or formatted); bad input -> NULL."""
    d = F.try_to_date(as_col(c).cast("string"), "yyyyMMdd")
    return F.date_format(d, fmt) if fmt else d


def month_key(c) -> Column:
    """``yyyy-MM`` month key of a date/timestamp column."""
    return F.date_format(as_col(c), "yyyy-MM")


def parse_date_auto(c) -> Column:
    """ISO ``yyyy-MM-dd`` when the value has a dash, else ``yyyyMMdd``.

    Decided per row (the reference decides once from the first row; per row
    gives the same answer on homogeneous columns and never aborts).
    """
    s = as_col(c).cast("string")
    return F.when(s.contains("-"), F.try_to_date(s, "yyyy-MM-dd")) \
            .otherwise(F.try_to_date(s, "yyyyMMdd"))


def safe_price(c) -> Column:
    """Parse a price; anything unparsable becomes 0.0."""
    return F.coalesce(as_col(c).cast("string").try_cast("double"), F.lit(0.0))
