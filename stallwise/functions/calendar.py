"""Calendar features and holidays."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREND_EPOCH = "2020-01-01"
#: National holidays of fixed date (month, day), and the offsets of the movable ones from Easter.
FIXED_HOLIDAYS = ((1, 1), (3, 1), (5, 1), (5, 14), (5, 15), (6, 12), (8, 15), (9, 29), (12, 8), (12, 25))
EASTER_OFFSETS = (-3, -2)


def calendar_columns(date: str = "dt") -> dict[str, Column]:
    """The 12 calendar features of a date."""
    dow, dom = F.weekday(date), F.dayofmonth(date)
    return {
        "dow": dow,
        "dow_sin": F.sin(2 * pi * dow / 7),
        "dow_cos": F.cos(2 * pi * dow / 7),
        "day_of_month": dom,
        "dom_sin": F.sin(2 * pi * dom / 31),
        "dom_cos": F.cos(2 * pi * dom / 31),
        "week_of_year": F.weekofyear(date),
        "month": F.month(date),
        "is_weekend": (dow >= 5).cast("int"),
        "is_month_start": (dom == 1).cast("int"),
        "is_month_end": (F.last_day(date) == F.col(date)).cast("int"),
        "days_since_start": F.datediff(date, F.lit(TREND_EPOCH).cast("date")),
    }


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, from the golden number and the epact of the paschal moon."""
    golden, century = year % 19, F.floor(year / 100)
    moon = (century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 19 * golden + 15) % 30
    moon = moon - F.floor(moon / 28) * (1 - F.floor(29 / (moon + 1)) * F.floor((21 - golden) / 11))
    sunday = (year + F.floor(year / 4) + moon + 2 - century + F.floor(century / 4)) % 7
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), (moon - sunday + 27).cast("int"))


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(holiday): the holidays of these years, a small dimension table."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    fixed = [F.make_date("y", F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    return years.select(F.explode(F.array(*fixed, *(F.date_add(easter(F.col("y")), n) for n in EASTER_OFFSETS))).alias("holiday")).distinct()


def with_holiday_distance(df: DataFrame, calendar: DataFrame, date: str = "dt", max_days: int = 7) -> DataFrame:
    """Signed days from the nearest holiday (before it negative; of two equally near the earlier), clipped, and
    whether the day is one. Worked out once per distinct date; the calendar has a few rows a year."""
    days = df.select(date).distinct()
    gap = F.datediff(date, "holiday")
    nearest = days.crossJoin(F.broadcast(calendar)).groupBy(date).agg(F.min_by(gap, F.struct(F.abs(gap), F.col("holiday"))).alias("gap"))
    clipped = F.greatest(F.least(F.coalesce("gap", F.lit(max_days)), F.lit(max_days)), F.lit(-max_days))
    return df.join(nearest, date, "left").withColumns({"days_to_holiday": clipped, "is_holiday": F.coalesce((F.col("gap") == 0).cast("int"), F.lit(0))}).drop("gap")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
