"""Colour, sample and exposure functions on Columns. All of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]

# D65 matrices of linear RGB and XYZ, and the YUV pair with 0.144 in its first row.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
RGB_TO_YUV = ((0.299, 0.587, 0.144), (-0.299, -0.587, 0.886), (0.701, -0.587, -0.114))
YUV_TO_RGB = ((0.97087, -0.02913, 1.0), (0.97087, -0.22333, -0.50937), (0.97087, 0.97087, 0.0))


def matrix(m, c: Triple) -> Triple:
    return tuple(F.lit(a) * c[0] + F.lit(b) * c[1] + F.lit(d) * c[2] for a, b, d in m)


def rgb_to_xyz(*c: Column) -> Triple:
    return matrix(RGB_TO_XYZ, c)


def xyz_to_rgb(*c: Column) -> Triple:
    return matrix(XYZ_TO_RGB, c)


def rgb_to_yuv(*c: Column) -> Triple:
    return matrix(RGB_TO_YUV, c)


def yuv_to_rgb(*c: Column) -> Triple:
    return matrix(YUV_TO_RGB, c)


def rgb_to_y(*c: Column) -> Column:
    return rgb_to_xyz(*c)[1]


def srgb_to_linear(c: Column) -> Column:
    """Odd-symmetric, linear up to the knee."""
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).when(c >= -0.04045, c / 12.92).otherwise(-F.pow((0.055 - c) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c > 0.0031308, 1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055).when(c >= -0.0031308, c * 12.92).otherwise((0.055 - 1) * F.pow(-c, F.lit(1 / 2.4)) - 0.055)


def srgb_to_xyz(*c: Column) -> Triple:
    return rgb_to_xyz(*map(srgb_to_linear, c))


def xyz_to_srgb(*c: Column) -> Triple:
    return tuple(map(linear_to_srgb, xyz_to_rgb(*c)))


def srgb_to_y(*c: Column) -> Column:
    return rgb_to_y(*map(srgb_to_linear, c))


def xyz_to_yuv_prime(x: Column, y: Column, z: Column) -> Triple:
    total = x + y + z
    cx, cy = x / total, y / total
    d = -2 * cx + 12 * cy + 3
    return y, 4 * cx / d, 9 * cy / d


def yuv_prime_to_xyz(y: Column, u: Column, v: Column) -> Triple:
    d = 6 * u - 16 * v + 12
    return yxy_to_xyz(y, 9 * u / d, 4 * v / d)


def xyz_to_yxy(x: Column, y: Column, z: Column) -> Triple:
    return y, x / (x + y + z), y / (x + y + z)


def yxy_to_xyz(y: Column, cx: Column, cy: Column) -> Triple:
    return cx / cy * y, y, (1 - cx - cy) / cy * y


CONVERSIONS = {
    ("rgb", "xyz"): rgb_to_xyz, ("xyz", "rgb"): xyz_to_rgb, ("srgb", "xyz"): srgb_to_xyz, ("xyz", "srgb"): xyz_to_srgb, ("rgb", "yuv"): rgb_to_yuv,
    ("yuv", "rgb"): yuv_to_rgb, ("xyz", "yu'v'"): xyz_to_yuv_prime, ("yu'v'", "xyz"): yuv_prime_to_xyz, ("xyz", "yxy"): xyz_to_yxy, ("yxy", "xyz"): yxy_to_xyz,
}


def convert_colorspace(df: DataFrame, src: str, dst: str, columns=("r", "g", "b")) -> DataFrame:
    """Convert three columns in place; a pair of spaces without a conversion is an error."""
    try:
        f = CONVERSIONS[src.lower(), dst.lower()]
    except KeyError:
        raise ValueError(f"no conversion from {src} to {dst}") from None
    return df.withColumns(dict(zip(columns, f(*map(F.col, columns)), strict=True)))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Triple:
    return tuple((1 - x) * (1 - k) for x in (c, m, y))


def inverted_cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Triple:
    return tuple(x * k for x in (c, m, y))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Triple:
    """Hue in (0, 1] from the signed difference of the two lesser channels; pure red has hue 1. Grey, and a lightness of 0 or less, have neither hue nor
    saturation."""
    top = F.greatest(r, g, b)
    span, light = top - F.least(r, g, b), (top + F.least(r, g, b)) / 2
    turn = F.when(r == top, (g - b) / span + F.when(g > b, 0.0).otherwise(6.0)).when(g == top, (b - r) / span + 2).otherwise((r - g) / span + 4)
    room = 1 - F.abs(2 * light - 1)
    colour = (light > 0) & (span > 0)
    return F.when(colour, turn / 6).otherwise(0.0), F.when(colour, span / F.when(F.abs(room) < 1e-15, 1e-15).otherwise(room)).otherwise(0.0), light


def hsl_to_rgb(h: Column, s: Column, light: Column) -> Triple:
    """Each channel is the lightness less a trapezoid of the hue. A hue of 1 or more, or a colour that would be black, gives the lightness as grey."""
    reach = s * F.least(light, 1 - light)

    def channel(offset: float) -> Column:
        k = (offset + 12 * h) % 12.0
        return light - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    plain = (light + reach <= 0) | (h >= 1)
    return tuple(F.when(plain, light).otherwise(channel(offset)) for offset in (0.0, 8.0, 4.0))


def to_float(c: Column, bits: int) -> Column:
    return c / float((1 << bits) - 1)


def to_uint(c: Column, bits: int) -> Column:
    return F.floor(c * float((1 << bits) - 1) + 0.5).cast("int")


def normalize(c: Column, lo: Column, hi: Column) -> Column:
    return (c - lo) / (hi - lo)


def clamp(c: Column, lo, hi) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(c, as_col(lo)), as_col(hi))


def gamma_curve(c: Column, gamma: float) -> Column:
    return c if gamma == 1 else F.when(c > 0, F.pow(c, F.lit(1 / gamma))).otherwise(0.0)


def log_irradiance(c: Column) -> Column:
    """Natural logarithm with the floor -11.09 for 0."""
    return F.when(c == 0, F.lit(-11.09)).otherwise(F.ln(c))


# Weight and response curves: functions of the quantised sample m = floor(v * 4095) / 4095.
BINS = 4096


def quantised(v: Column) -> Column:
    return F.floor(v * float(BINS - 1)).cast("double") / float(BINS - 1)


def weight(v: Column, kind: str = "gaussian") -> Column:
    m = quantised(v)
    kind = kind.lower()
    if kind == "flat":
        return F.lit(1.0)
    edge = 0.00025 if kind == "plateau" else 2 / BINS
    shape = {"triangular": F.when(m < 0.5, 2 * m).otherwise(2 * (1 - m)), "plateau": 1 - F.pow(2 * m - 1, F.lit(12.0))}.get(kind, F.exp(-32 * (m - 0.5) * (m - 0.5)))
    return F.when((m < edge) | (m > 1 - edge), 0.0).otherwise(shape)


def response(v: Column, kind: str = "linear") -> Column:
    """Bin 0 answers as bin 1; an unknown name is linear."""
    m = F.greatest(F.floor(v * float(BINS - 1)).cast("double"), F.lit(1.0)) / float(BINS - 1)
    curves = {"gamma": F.pow(4 * m, F.lit(1.7)) + 1e-4, "log10": 1e-8 * F.pow(F.lit(10.0), m / 0.0625 - 8), "srgb": srgb_to_linear(m)}
    return curves.get(kind.lower(), m)


def rgbe_pack(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """Shared-exponent bytes (r, g, b, e) of the samples divided by 179."""
    r, g, b = (c / 179.0 for c in (r, g, b))
    v = F.greatest(r, g, b)
    e0 = F.floor(F.log2(v)) + 1
    e = F.when(v >= F.pow(F.lit(2.0), e0), e0 + 1).when(v < F.pow(F.lit(2.0), e0 - 1), e0 - 1).otherwise(e0)
    scale = 256.0 / F.pow(F.lit(2.0), e)
    lit = v >= 1e-32
    return (*(F.when(lit, F.floor(c * scale)).otherwise(0).cast("int") for c in (r, g, b)), F.when(lit, e + 128).otherwise(0).cast("int"))


def rgbe_unpack(r: Column, g: Column, b: Column, e: Column, exposure: float = 1.0) -> Triple:
    f = F.pow(F.lit(2.0), e.cast("double") - 136) / exposure
    return tuple(F.when(e != 0, c * f).otherwise(0.0) for c in (r, g, b))


# Exposure metadata.
def exposure_time(time: Column, shutter: Column) -> Column:
    p = F.pow(F.lit(2.0), shutter)
    return F.coalesce(time, F.when(p > 1, 1 / F.floor(p + 0.5)).otherwise(F.floor(F.pow(F.lit(2.0), -shutter) + 0.5).cast("double")))


def f_number(number: Column, aperture: Column) -> Column:
    return F.coalesce(number, F.pow(F.lit(2.0), aperture / 2), F.lit(2.0**0.5))


def orientation_degrees(c: Column) -> Column:
    return F.when(c == 3, 180).when(c == 6, 90).when(c == 8, 270).otherwise(0)
