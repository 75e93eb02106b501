"""Scalar column expressions shared by all operators (JVM-side, codegen-able)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.config import BROWSER_PATTERN, OS_PATTERN

DAY_MICROS = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(later: str, earlier: str) -> Column:
    """Microseconds from column ``earlier`` to column ``later``.

    Uses SQL ``timestampdiff``, which on TIMESTAMP_NTZ does not consult the
    session time zone (no DST shifts)."""
    return F.expr(f"timestampdiff(MICROSECOND, `{earlier}`, `{later}`)")


def floor_days(later: str, earlier: str) -> Column:
    """Whole days from ``earlier`` to ``later``, floored like a timedelta's
    ``.days`` (an event one hour before registration gives -1)."""
    return F.floor(micros_between(later, earlier) / F.lit(DAY_MICROS))


def minutes_between(later: str, earlier: str) -> Column:
    return micros_between(later, earlier) / F.lit(60_000_000.0)


#: Milliseconds of 0001-01-01 and of the last one of 9999-12-31.
FIRST_MILLIS, LAST_MILLIS = -62_135_596_800_000, 253_402_300_799_999


def epoch_millis_to_ntz(ms: str | Column) -> Column:
    """Epoch milliseconds to a naive timestamp (UTC wall clock), TZ-independent;
    null where the number is no time between the years 1 and 9999."""
    whole = col(ms).cast("long")
    exact = (whole.cast("decimal(20,0)") / F.lit(1000).cast("decimal(5,0)")).cast("decimal(18,6)")
    time = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=exact)
    return F.when(whole.between(FIRST_MILLIS, LAST_MILLIS), time)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, or 0.0 where the quotient is undefined (b = 0 or null)."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def cyclical(n: str | Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * col(n) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def gender_code(g: str | Column) -> Column:
    """F -> 0, M -> 1, anything else (incl. null) -> -1."""
    g = col(g)
    return F.when(g == "F", F.lit(0)).when(g == "M", F.lit(1)).otherwise(F.lit(-1))


def browser(ua: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(ua), BROWSER_PATTERN, 1), F.lit(""))


def operating_system(ua: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(ua), OS_PATTERN, 1), F.lit(""))


def token_bit(ua: str | Column, pattern: str) -> Column:
    """The place of the first token of a ``(a|b|c)`` pattern as a bit, 0 without
    one: ``bit_count(bit_or(...))`` counts distinct tokens in a hash aggregate."""
    tokens = pattern.strip("()").split("|")
    place = F.array_position(F.array(*[F.lit(t) for t in tokens]), F.regexp_extract(col(ua), pattern, 1))
    return F.coalesce(F.when(place > 0, F.pow(F.lit(2.0), place - 1).cast("long")), F.lit(0).cast("long"))


def normalize_blank(c: str | Column) -> Column:
    """'' -> null."""
    return F.nullif(col(c), F.lit(""))


def day_of_week(d: str | Column) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(col(d)) + 1


def round_doubles(df: DataFrame, scale: int = 6) -> DataFrame:
    """Round every floating column to ``scale`` places and turn -0.0 into 0.0,
    so results compare across engines."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(f"round(`{f.name}`, {scale}) + 0.0D AS `{f.name}`")
        else:
            exprs.append(f"`{f.name}`")
    return df.selectExpr(*exprs)
