"""Values as people read them: ratios in percent, durations in their unit; what is stored stays in seconds and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a unit of time.
SECONDS = {"seconds": 1, "s": 1, "minutes": 60, "min": 60, "hours": 3600, "h": 3600, "days": 86400, "d": 86400, "weeks": 604800}


def displayed(value: Column, unit: Column) -> Column:
    """The number shown: a ratio in %, seconds in their unit, all else as it is; null and what isn't finite stays."""
    per = F.create_map(*[F.lit(x) for pair in SECONDS.items() for x in pair])[unit]
    return F.when(unit == "%", value * 100).when(per.isNotNull(), value / per).otherwise(value)


def formatted(value: Column, unit: Column) -> Column:
    """The text shown: whole numbers as they are, large ones without decimals, others with two at most; — for none."""
    x = displayed(value.cast("double"), unit)
    whole = F.format_string("%.0f", x)
    # Rounded as doubles before they are written: the digits of a double alone may lie on the other side of a half.
    short = F.regexp_replace(F.format_string("%.2f", F.round(x * 100) / 100), r"\.?0+$", "")
    text = F.when((x == F.floor(x)) | (F.abs(x) >= 100), whole).otherwise(short)
    known = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value) < float("inf"))
    suffix = F.when(unit == "%", "%").when(unit.isNull() | (unit == "") | (unit == "count"), "").otherwise(F.concat(F.lit(" "), unit))
    return F.when(known, F.concat(text, suffix)).otherwise("—")
