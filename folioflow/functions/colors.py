"""Colour functions: columns of channel values to RGB and CSS."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The D65 white point, XYZ to linear sRGB, and the knees of both curves.
WHITE = (95.047, 100.0, 108.883)
XYZ_TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
LAB_KNEE, GAMMA_KNEE = 0.008856, 0.0031308

# The sixteen indexed colours, from 1.
INDEXED = ["black", "blue", "cyan", "green", "magenta", "red", "yellow", "white", "darkblue", "darkcyan", "darkgreen", "darkmagenta", "darkred", "darkyellow", "darkgray", "lightgray"]


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.array(*(F.round(x).cast("int") for x in (r, g, b)))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Percentages to 0..255; C8."""
    key = k / 100.0
    return rgb(*((1.0 - x / 100.0 * (1.0 - key) - key) * 255.0 for x in (c, m, y)))


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> Column:
    """CIE L*a*b* to sRGB by way of XYZ, clamped to 0..255; C9."""
    fy = (lightness + 16.0) / 116.0
    cubes = [F.pow(f, F.lit(3.0)) for f in (fy + a / 500.0, fy, fy - b / 200.0)]
    linear = [(f - 16.0 / 116.0) / 7.787 for f in (fy + a / 500.0, fy, fy - b / 200.0)]
    xyz = [F.when(c > LAB_KNEE, c).otherwise(s) * (w / 100.0) for c, s, w in zip(cubes, linear, WHITE)]
    out = []
    for row in XYZ_TO_RGB:
        v = xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2]
        curve = F.when(v > GAMMA_KNEE, F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(v * 12.92)
        out.append(F.least(F.greatest(curve * 255.0, F.lit(0.0)), F.lit(255.0)))
    return rgb(*out)


def to_rgb(space: Column, values: Column) -> Column:
    """Space-separated channel values in the named colour space; black for an unknown one; C10."""
    v = F.transform(F.split(values, " "), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    at = lambda i: F.coalesce(F.get(v, F.lit(i)), F.lit(0.0))
    return F.when(space == "LAB", lab_to_rgb(at(0), at(1), at(2))).when(space == "CMYK", cmyk_to_rgb(at(0), at(1), at(2), at(3))).when(space == "RGB", rgb(at(0), at(1), at(2))).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))


def tint(color: Column, percent: Column) -> Column:
    """Toward white as ``percent`` falls from 100; -1 leaves the colour; C11."""
    return F.when(percent == -1, color).otherwise(F.transform(color, lambda x: F.round(x + (255 - x) * (1.0 - percent / 100.0)).cast("int")))


def to_hex(color: Column) -> Column:
    """``#rrggbb``; C12."""
    return F.format_string("#%02x%02x%02x", *(F.get(color, F.lit(i)) for i in range(3)))


def _plain(value: Column) -> Column:
    """A number as text, without a fraction of zero."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def gradient_angle(angle: Column) -> Column:
    """90 - angle, brought between -360 and 360; C13."""
    turned = 90 - angle
    return F.when(turned >= 360, turned - 360).when(turned <= -360, turned + 360).otherwise(turned)


def _stops(stops: Column) -> Column:
    return F.array_join(F.transform(stops, lambda s: F.concat(F.lit(", "), s.rgb, F.lit(" "), _plain(s.location), F.lit("%"))), "")


def gradient(angle: Column, stops: Column) -> Column:
    """``linear-gradient`` of ``stops``, an array of structs of rgb (hex) and location; C13."""
    return F.concat(F.lit("linear-gradient("), _plain(gradient_angle(angle)), F.lit("deg"), _stops(stops), F.lit(")"))


def radial_gradient(stops: Column) -> Column:
    """A gradient from the middle; C13."""
    return F.concat(F.lit("radial-gradient(circle closest-side"), _stops(stops), F.lit(")"))


def indexed(value: Column) -> Column:
    """A named colour by its index, a hexadecimal one with its mark, or black; C14."""
    names = F.array(*(F.lit(n) for n in INDEXED))
    bare = F.replace(value, F.lit("#"), F.lit(""))
    number = value.try_cast("int")
    return F.when(number.between(1, len(INDEXED)), F.get(names, number - 1)).when(bare.rlike("^[A-Fa-f0-9]{3,6}$"), F.concat(F.lit("#"), bare)).otherwise("black")
