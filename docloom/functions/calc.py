"""Calculators: dates, fees, land, waits, keys and geometry, as column expressions.

Rounding is half up towards plus infinity (``floor(x + 0.5)``), which differs from Spark's ``round`` for
negative halves. Functions that need a clock take it as a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BENGALI = "০১২৩৪৫৬৭৮৯"
ASCII = "0123456789"
PACIFIC = "America/Los_Angeles"


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def to_bengali_digits(x: Column) -> Column:
    return F.translate(x.cast("string"), ASCII, BENGALI)


def to_ascii_digits(x: Column) -> Column:
    return F.translate(x, BENGALI, ASCII)


def leading_number(x: Column) -> Column:
    """The number that a text starts with, in either digit script; 0 without one."""
    text = F.regexp_replace(to_ascii_digits(F.coalesce(x, F.lit(""))), ",", "")
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def age(born: Column, on: Column) -> Column:
    """Calendar age: whole years, then months, then days since the last monthly anniversary."""
    months = F.floor(F.months_between(on, born)).cast("int")
    days = F.date_diff(on, F.add_months(born, months))
    return F.struct(F.floor(months / 12).cast("int").alias("years"), (months % 12).alias("months"), days.alias("days"))


def eligible(born: Column, on: Column) -> Column:
    """Aged 18 or more and at most 32 years, 0 months, 0 days."""
    return (F.add_months(born, 18 * 12) <= on) & (F.add_months(born, 32 * 12) >= on)


def land_units(decimals: Column) -> Column:
    """Decimals of land as katha (1.65), bigha (33) and acres (100), to three places."""
    to = lambda by: F.format_string("%.3f", decimals.cast("double") / by)
    return F.struct(to(1.65).alias("katha"), to(33.0).alias("bigha"), to(100.0).alias("acre"))


def deed_fees(value: Column) -> Column:
    """Registration 1 %, stamp 1.5 %, local tax 3 %, source tax 3 %, each rounded, and 650 fixed."""
    part = lambda rate: half_up(value * F.lit(rate))
    total = part(0.01) + part(0.015) + part(0.03) + part(0.03) + 650
    return F.struct(part(0.01).alias("registration"), part(0.015).alias("stamp"), part(0.03).alias("local_tax"), part(0.03).alias("source_tax"), F.lit(650).alias("fixed"), total.alias("total"))


def next_pacific_midnight(ts: Column) -> Column:
    """The next midnight in Pacific time, with the offset that holds then."""
    day = F.date_add(F.to_date(F.from_utc_timestamp(ts, PACIFIC)), 1)
    return F.to_utc_timestamp(day.cast("timestamp"), PACIFIC)


def pacific_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, PACIFIC))


def retry_delay_ms(text: Column) -> Column:
    """"34s", "1.5s", "500ms" or a bare number of seconds as milliseconds; 0 for anything else."""
    trimmed = F.trim(text)
    ms = F.regexp_extract(trimmed, r"(?i)^([\d.]+)\s*ms$", 1).try_cast("double")
    seconds = F.regexp_extract(trimmed, r"(?i)^([\d.]+)\s*s?$", 1).try_cast("double")
    return F.coalesce(half_up(ms), half_up(seconds * 1000), F.lit(0)).cast("long")


def mask_key(key: Column) -> Column:
    """The first 4 characters of a short key, the first 6 and last 4 of one over 12."""
    k = F.coalesce(key, F.lit(""))
    return F.when(F.length(k) <= 12, F.concat(F.substring(k, 1, 4), F.lit("..."))).otherwise(F.concat(F.substring(k, 1, 6), F.lit("..."), F.substring(k, -4, 4)))


def human_wait(seconds: Column) -> Column:
    """Seconds in words with Bengali digits; empty at 0 or less."""
    minutes = F.ceil((seconds % 3600) / 60)
    hours = F.concat(to_bengali_digits(F.floor(seconds / 3600)), F.lit(" ঘণ্টা"), F.when(minutes > 0, F.concat(F.lit(" "), to_bengali_digits(minutes), F.lit(" মিনিট"))).otherwise(""))
    return (
        F.when(F.coalesce(seconds, F.lit(0)) <= 0, "")
        .when(seconds < 60, F.concat(to_bengali_digits(F.ceil(seconds)), F.lit(" সেকেন্ড")))
        .when(seconds < 3600, F.concat(to_bengali_digits(F.ceil(seconds / 60)), F.lit(" মিনিট")))
        .otherwise(hours)
    )


def money(x: Column) -> Column:
    """Whole taka with lakh grouping and Bengali digits: the last three digits, then pairs."""
    digits = F.abs(half_up(x)).cast("string")
    grouped = F.regexp_replace(digits, r"(\d)(?=(?:\d{2})*\d{3}$)(?!$)", "$1,")
    return to_bengali_digits(F.concat(F.when(x < 0, "-").otherwise(""), grouped))


def ramp(v: Column, full: float, zero: float) -> Column:
    """1 up to ``full``, 0 from ``zero`` on, straight between."""
    return F.when(v <= full, F.lit(1.0)).when(v >= zero, F.lit(0.0)).otherwise((F.lit(zero) - v) / (zero - full))


def font_points(ink: Column, pitch: Column) -> Column:
    """Pitch / 1.15, or ink / 0.98 without a pitch, to half points within 6 and 48."""
    raw = F.when(pitch > 0, pitch / 1.15).otherwise(ink / 0.98)
    return F.least(F.lit(48.0), F.greatest(F.lit(6.0), half_up(raw * 2) / 2))


def box_to_pixels(box: Column, width: Column, height: Column, pad: float = 0.0) -> Column:
    """[y0, x0, y1, x1] of 0..1000 as a pixel rectangle, widened by a share of the page and clipped."""
    y0, x0, y1, x1 = (F.get(box, F.lit(i)) for i in range(4))
    left = F.greatest(F.lit(0), F.floor((x0 / 1000 - pad) * width))
    top = F.greatest(F.lit(0), F.floor((y0 / 1000 - pad) * height))
    return F.struct(left.alias("x"), top.alias("y"), (F.least(width, F.ceil((x1 / 1000 + pad) * width)) - left).alias("w"), (F.least(height, F.ceil((y1 / 1000 + pad) * height)) - top).alias("h"))


def physical_inches(crop: Column, page: Column, page_inches: float, most: float) -> Column:
    return F.least(F.lit(most), crop / page * page_inches)


def paper_size(width: Column, height: Column) -> Column:
    """Legal from a ratio of 1.53, Letter up to 1.35, else A4."""
    ratio = F.greatest(width, height) / F.least(width, height)
    return F.when(ratio >= 1.53, "Legal").when(ratio <= 1.35, "Letter").otherwise("A4")


def y_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals as a share of the shorter."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, shared / shorter).otherwise(F.lit(0.0))


def project(h: list[float], x: Column, y: Column) -> Column:
    """A point under a 3 by 3 homography given by rows."""
    w = h[6] * x + h[7] * y + h[8]
    return F.struct(((h[0] * x + h[1] * y + h[2]) / w).alias("x"), ((h[3] * x + h[4] * y + h[5]) / w).alias("y"))
