"""Band-array encodings and model inputs as array expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import (ALIASES, ANNUAL_LAYERS, N_EMBED, REPRESENTATIONS, canonical)


def _code(v: Column) -> Column:
    """Missing -> 0, clip to 0..65535, truncate. The clip is explicit: NaN would win `least`."""
    v = v.cast("double")
    return F.when(v.isNull() | F.isnan(v), 0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(65535.0))).cast("int")


def encode_annual(embedding: Column, dem: Column, radar: Column, optical: Column) -> Column:
    """76 codes: (embedding + 1) * 1e4, elevation, (dB + 50) * 100, optical as exported."""
    return F.concat(F.transform(embedding, lambda v: _code((v.cast("double") + 1) * 1e4)),
                    F.array(_code(dem)),
                    F.transform(radar, lambda v: _code((v + 50.0) * 100.0)),
                    F.transform(optical, _code))


def encode_seasonal(radar: Column, optical: Column) -> Column:
    """44 codes: 8 radar values (dB + 50) * 100, then 36 reflectances * 1e4; other lengths are an error."""
    sized = (F.size(radar) == 8) & (F.size(optical) == 36)
    codes = F.concat(F.transform(radar, lambda v: _code((v + 50.0) * 100.0)),
                     F.transform(optical, lambda v: _code(v * 10000.0)))
    return F.when(sized, codes).otherwise(F.raise_error(F.lit("seasonal bands: expected 8 radar and 36 optical"))
                                          .cast("array<int>"))


def unused_as_zero(annual: Column, representation: str) -> Column:
    """Annual codes with the bands of the layers the representation does not use set to 0."""
    used = REPRESENTATIONS[canonical(representation)]["layers"]
    parts, start = [], 1
    for layer, n in ANNUAL_LAYERS.items():
        parts.append(F.slice(annual, start, n) if layer in used else F.array_repeat(F.lit(0), n))
        start += n
    return F.concat(*parts)


def canonical_name(name: Column) -> Column:
    """Column version of schema.canonical: aliases translated, unknown names an error."""
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    current = F.coalesce(aliases[name], name)
    known = current.isin(*REPRESENTATIONS)
    return F.when(known, current).otherwise(
        F.raise_error(F.concat(F.lit("unknown representation "), F.coalesce(name, F.lit("NULL")))).cast("string"))


def assemble(representation: str, annual: Column, seasonal: Column | None = None) -> Column:
    """Model input: the representation's slices, concatenated."""
    spec = REPRESENTATIONS[canonical(representation)]
    a, b = spec["annual"]
    out = F.slice(annual, a + 1, b - a)
    if spec["seasonal"] is None:
        return out
    if seasonal is None:
        raise ValueError(f"representation {representation} needs the seasonal bands")
    present = F.when(seasonal.isNull(), F.raise_error(F.lit("seasonal bands missing")).cast("array<int>"))
    a, b = spec["seasonal"]
    return F.concat(out, F.slice(present.otherwise(seasonal), a + 1, b - a))


def channel_vector(representation: str, annual: Column, seasonal: Column | None, embedding_value: float) -> Column:
    """Per-channel statistic of a model input: seasonal statistics are (elevation, 44 bands); embedding channels of
    seasonal inputs get a constant (0 for the mean, 1 for the deviation)."""
    spec = REPRESENTATIONS[canonical(representation)]
    if spec["seasonal"] is None:
        a, b = spec["annual"]
        return F.slice(annual, a + 1, b - a)
    return F.concat(F.array_repeat(F.lit(float(embedding_value)), spec["n_embed"]), seasonal)


def normalise(x: Column, mean: Column, std: Column, n_embed: int, zero_restore: bool) -> Column:
    """Embedding channels x / 1e4 - 1, the others (x - mean) / (std + 1e-12); optionally 0 stays 0."""
    channels = F.zip_with(x, F.zip_with(mean, std, lambda m, s: F.struct(m.alias("m"), s.alias("s"))),
                          lambda v, st: F.struct(v.cast("double").alias("v"), st["m"].alias("m"), st["s"].alias("s")))

    def one(ch: Column, i: Column) -> Column:
        out = F.when(i < n_embed, ch["v"] / 10000.0 - 1.0).otherwise((ch["v"] - ch["m"]) / (ch["s"] + 1e-12))
        return F.when(ch["v"] == 0, F.lit(0.0)).otherwise(out) if zero_restore else out
    return F.transform(channels, one)


def forest_features(x: Column, encoding: str, n_embed: int = N_EMBED) -> Column:
    """'plain' codes, or 'paper': embedding codes minus 10000 in unsigned 16-bit arithmetic."""
    if encoding == "plain":
        return x
    if encoding != "paper":
        raise ValueError(f"unknown encoding {encoding!r}")
    return F.transform(x, lambda v, i: F.when(i < n_embed, F.pmod(v - 10000, F.lit(65536))).otherwise(v))


def colour_index(v: Column, vmin: float, vmax: float) -> Column:
    """0..1 position on a colour scale, NULL stays NULL (transparent)."""
    span = max(float(vmax) - float(vmin), 1e-9)
    return F.when(v.isNotNull(), F.least(F.greatest((v - vmin) / span, F.lit(0.0)), F.lit(1.0)))
