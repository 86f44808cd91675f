"""Dates and amounts found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks of dates and amounts, and the numerals.
DATE = "(\\d{4})[-/年.](\\d{1,2})[-/月.](\\d{1,2})"
HAN_DATE = "([〇零一二三四五六七八九0-9]{4})\\s*年\\s*([一二三四五六七八九十0-9]{1,3})\\s*月\\s*([一二三四五六七八九十0-9]{1,3})\\s*日"
DIGITS = "〇一二三四五六七八九"
ZERO = "零"
TEN = "十"
AMOUNT = "([0-9][0-9,]*(?:\\.[0-9]+)?) ?(万?)元"


def calendar_date(text: Column, first: int = 1900, last: int = 2100) -> Column:
    """The first date written with -, /, . or the Chinese marks, if the calendar has it and its year lies in the range; else null."""
    part = lambda k: F.nullif(F.regexp_extract(text, DATE, k), F.lit(""))
    date = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    return F.when(F.year(date).between(first, last), date)


def chinese_number(text: Column) -> Column:
    """A numeral up to 99 or a run of digits in Chinese characters, as a number; null for anything else."""
    plain = F.translate(text, DIGITS + ZERO, "01234567890")
    tens = F.regexp_extract(plain, f"^(\\d?){TEN}(\\d?)$", 1)
    ones = F.regexp_extract(plain, f"^(\\d?){TEN}(\\d?)$", 2)
    with_ten = F.coalesce(F.nullif(tens, F.lit("")).cast("int"), F.lit(1)) * 10 + F.coalesce(F.nullif(ones, F.lit("")).cast("int"), F.lit(0))
    return F.when(plain.rlike(f"^\\d?{TEN}\\d?$"), with_ten).when(plain.rlike("^\\d{1,9}$"), plain.cast("int"))


def chinese_date(text: Column) -> Column:
    """The first date in Chinese or Arabic numerals, if the calendar has it; else null."""
    part = lambda k: F.regexp_extract(text, HAN_DATE, k)
    year = F.translate(part(1), DIGITS + ZERO, "01234567890").try_cast("int")
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), *(F.lpad(chinese_number(part(k)).cast("string"), 2, "0") for k in (2, 3))), "yyyy-MM-dd")


def amounts(text: Column) -> Column:
    """All numbers before a currency word as doubles; ten-thousands are multiplied out."""
    pattern = F.lit(AMOUNT)
    numbers, units = F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2)
    return F.zip_with(numbers, units, lambda n, u: F.replace(n, F.lit(",")).try_cast("double") * F.when(u != "", 10000).otherwise(1))


def amount_outcome(requested: Column, awarded: Column) -> Column:
    """What was awarded of what was requested."""
    return F.when(requested.isNull() | awarded.isNull() | (requested <= 0), "unclear").when(awarded <= 0, "not_supported").when(awarded >= requested, "supported").otherwise("partially_supported")
