"""Acquisition windows and seasons (UTC)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def season_of(t: Column) -> Column:
    """0..3 for Dec-Feb, Mar-May, Jun-Aug, Sep-Nov."""
    return F.floor((F.month(t) % 12) / 3).cast("int")


def in_season(t: Column, season: int) -> Column:
    return season_of(t) == season


def seasonal_year(t: Column) -> Column:
    """Year of the seasonal window [Dec of the year before, Dec) the time falls in."""
    return F.year(t) + F.when(F.month(t) == 12, 1).otherwise(0)


def in_annual_window(t: Column, year: int) -> Column:
    """[1 January, 31 December): the end is exclusive, so the last day of the year is not used."""
    return (t >= F.to_date(F.lit(f"{year}-01-01"))) & (t < F.to_date(F.lit(f"{year}-12-31")))


def in_seasonal_window(t: Column, year: int) -> Column:
    return (t >= F.to_date(F.lit(f"{year - 1}-12-01"))) & (t < F.to_date(F.lit(f"{year}-12-01")))


def from_epoch_ms(t: Column) -> Column:
    return F.timestamp_millis(t)
