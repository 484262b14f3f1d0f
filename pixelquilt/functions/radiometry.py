"""Masks and radar arithmetic on columns."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# fixed values: usable incidence angles of the radar swath (degrees) and the masked-angle sentinel
ANGLE_LOW, ANGLE_HIGH, ANGLE_MASKED = 30.63993, 45.23993, -9999.0


def angle_in_range(angle: Column) -> Column:
    return F.coalesce((angle != ANGLE_MASKED) & (angle > ANGLE_LOW) & (angle < ANGLE_HIGH), F.lit(False))


def qa_clear(qa: Column) -> Column:
    """Cloud bits 10 and 11 are both 0."""
    return (qa.bitwiseAND(F.lit(1 << 10)) == 0) & (qa.bitwiseAND(F.lit(1 << 11)) == 0)


def pair_valid(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def good_quality(quality: Column, degrade: Column) -> Column:
    return (quality == 1) & (degrade == 0)


def to_db(v: Column) -> Column:
    """10 log10, NULL for values <= 0."""
    return F.when(v > 0, F.lit(10.0) * F.log10(v))


def from_db(v: Column) -> Column:
    return F.pow(F.lit(10.0), v / 10.0)


def db_round_trip(v: Column) -> Column:
    """Linear value after a float32 trip through dB; NULL for values <= 0."""
    db = (F.lit(10.0) * F.log10(F.when(v > 0, v.cast("float")).cast("double"))).cast("float").cast("double")
    return F.pow(F.lit(10.0), db / 10.0).cast("float").cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """x / 0 = 0."""
    return F.when(b != 0, a / b).otherwise(F.when(b == 0, F.lit(0.0)))


def slope_towards_sensor(slope: Column, aspect: Column, heading: Column, aspect_valid: Column) -> Column:
    """Terrain slope in range direction (radians) from slope, aspect and look direction (degrees)."""
    signed = F.when(aspect_valid, F.when(aspect <= 180, aspect).otherwise(aspect - 360.0)).otherwise(F.lit(0.0))
    return F.atan(F.tan(F.radians(slope)) * F.cos(F.radians(heading) + F.radians(signed)))


def terrain_factor(angle: Column, range_slope: Column) -> Column:
    """Volume-model terrain correction tan(90 - theta + alpha) / tan(90 - theta)."""
    flat = F.lit(math.pi / 2) - F.radians(angle)
    return F.tan(flat + range_slope) / F.tan(flat)


def terrain_visible(angle: Column, range_slope: Column) -> Column:
    """Neither layover nor shadow."""
    theta = F.radians(angle)
    return (range_slope < theta) & (range_slope > -(F.lit(math.pi / 2) - theta))
