"""Date windows of the historical comparisons: complete fiscal years and aligned years to date."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession


def fiscal_bounds(fy: int, start_month: int = 10) -> tuple[date, date]:
    """First and last day of a fiscal year, which is named after the calendar year it ends in."""
    start = date(fy - (start_month > 1), start_month, 1)
    return start, date(start.year + 1, start_month, 1) - timedelta(days=1)


def fiscal_window(fy: int, start_month: int = 10) -> tuple[str, date, date]:
    return (f"FY{fy}", *fiscal_bounds(fy, start_month))


def ytd_window(fy: int, until: date, start_month: int = 10) -> tuple[str, date, date]:
    """The year to date of a fiscal year up to the month and day of ``until``; 29 February falls on the 28th."""
    start, end = fiscal_bounds(fy, start_month)
    year = start.year if until.month >= start_month > 1 else end.year
    leap = until.month == 2 and until.day == 29 and (year % 4 != 0 or year % 100 == 0 and year % 400 != 0)
    return f"FY{fy} YTD", start, min(date(year, until.month, 28 if leap else until.day), end)


def comparisons(first_fy: int, until: date, start_month: int = 10) -> tuple[list[tuple[str, date, date]], list[tuple[str, str, str]]]:
    """Windows, and comparisons of each complete fiscal year with the next and of the last two years to date.

    Complete years go from ``first_fy`` to the last one that ends by ``until``; the year to date is
    that of the fiscal year of ``until`` against the year before.
    """
    now = until.year + (start_month > 1 and until.month >= start_month)
    years = [fy for fy in range(first_fy, now + 1) if fiscal_bounds(fy, start_month)[1] <= until]
    windows = [fiscal_window(fy, start_month) for fy in years] + [ytd_window(fy, until, start_month) for fy in (now - 1, now)]
    pairs = [(f"FY{a}-FY{b}", f"FY{a}", f"FY{b}") for a, b in zip(years, years[1:], strict=False)]
    return windows, [*pairs, (f"FY{now - 1}YTD-FY{now}YTD", f"FY{now - 1} YTD", f"FY{now} YTD")]


def as_tables(spark: SparkSession, windows: list[tuple], pairs: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """``label, start, end`` and ``comparison, a, b``."""
    return spark.createDataFrame(windows, "label string, start date, end date"), spark.createDataFrame(pairs, "comparison string, a string, b string")
