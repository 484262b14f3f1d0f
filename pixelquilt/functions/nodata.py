"""No-data handling: sentinels and NaN become NULL once, at import; sentinels come back only at export."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import EXPORT_MISSING, LABEL_MISSING


def to_null(v: Column, nodata: float | None = None, floor: float | None = None) -> Column:
    """NULL for NaN, for the declared nodata value and for everything at or below `floor`."""
    bad = F.isnan(v.cast("double"))
    if nodata is not None:
        bad = bad | (v == F.lit(nodata))
    if floor is not None:
        bad = bad | (v <= F.lit(floor))
    return F.when(~bad, v)


def encode_label(v: Column) -> Column:
    """Label as exported: float32, missing (NULL, NaN, -9999) -> -999."""
    kept = F.when(~F.isnan(v.cast("double")) & (v != EXPORT_MISSING), v)
    return F.coalesce(kept, F.lit(LABEL_MISSING)).cast("float")


def decode_label(v: Column) -> Column:
    return to_null(v, LABEL_MISSING)


def null_if_all_zero(value: Column, bands: Column) -> Column:
    """NULL where every annual band is 0 (no input there)."""
    return F.when(~F.forall(bands, lambda b: b == 0), value)


def labelled(label: Column, zero_to_nodata: bool = False) -> Column:
    """Predicate: the label is present (and, with zero_to_nodata, not 0)."""
    present = label.isNotNull()
    return present & (label != 0) if zero_to_nodata else present


def label_in_cap(label: Column, cap: float = 80.0) -> Column:
    return (label > 0) & (label <= cap)
