"""Colour arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Linear maps between RGB and YCbCr; rows are outputs, the last number is the offset (0.5 included).
TO_YCBCR = [(0.25678824, 0.50412941, 0.09790588, 16.5), (-0.14822353, -0.29099216, 0.43921569, 128.5),
            (0.43921569, -0.36778824, -0.07142745, 128.5)]
TO_RGB = [(1.16438281, 0.0, 1.59602734, -222.421), (1.16438281, -0.39176172, -0.81296875, 136.076),
          (1.16438281, 2.01723438, 0.0, -276.336)]


def _linear(rows: list[tuple], names: str, a: Column, b: Column, c: Column) -> Column:
    def one(k: tuple) -> Column:
        mixed = a * F.lit(k[0]) + b * F.lit(k[1]) + c * F.lit(k[2]) + F.lit(k[3])
        return F.floor(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(255.0)))
    return F.struct(*[one(k).alias(n) for n, k in zip(names.split(), rows)])


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> Column:
    return _linear(TO_YCBCR, "y cb cr", r, g, b)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    return _linear(TO_RGB, "r g b", y, cb, cr)


def scale_saturation(r: Column, g: Column, b: Column, factor: float) -> Column:
    """Scale the saturation of a pixel, clipped to 0..1, with hue and value unchanged.

    With V the largest channel, V - c is proportional to the saturation, so each channel moves along that line.
    """
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    s = F.when(top > 0, (top - low) / top).otherwise(0.0)
    ratio = F.when(s > 0, F.least(F.greatest(s * factor, F.lit(0.0)), F.lit(1.0)) / s).otherwise(1.0)
    return F.struct(*[(top - (top - c) * ratio).alias(n) for n, c in zip("rgb", (r, g, b))])


def alpha_overlay(fg: Column, bg: Column, alpha: Column) -> Column:
    """Foreground over background; ``alpha`` runs from 0 to 1."""
    return fg * alpha + bg * (F.lit(1.0) - alpha)
