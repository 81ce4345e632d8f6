"""Column expressions over coordinates and cylinders; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | str

# Class edges in metres and their names.
DIAMETER_EDGES = [0.01, 0.02, 0.05, 0.10]
DIAMETER_CLASSES = ["lt1cm", "1to2cm", "2to5cm", "5to10cm", "gt10cm"]
RADIUS_EDGES = [0.02, 0.05, 0.10]
RADIUS_CLASSES = ["twig", "small", "med", "large"]


def _c(x: Num | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def norm(x: Num, y: Num, z: Num) -> Column:
    x, y, z = _c(x), _c(y), _c(z)
    return F.sqrt(x * x + y * y + z * z)


def dot(a: list[Num], b: list[Num]) -> Column:
    out = _c(a[0]) * _c(b[0])
    for p, q in zip(a[1:], b[1:]):
        out = out + _c(p) * _c(q)
    return out


def cross(a: list[Num], b: list[Num]) -> list[Column]:
    (ax, ay, az), (bx, by, bz) = [_c(v) for v in a], [_c(v) for v in b]
    return [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]


def unit(v: list[Num]) -> list[Column]:
    """Zero vectors stay zero: the length is at least 1e-9."""
    n = F.greatest(norm(*v), F.lit(1e-9))
    return [_c(x) / n for x in v]


def basis(v: list[Num]) -> list[list[Column]]:
    """Two unit vectors at right angles to v and to each other; the helper is the x axis
    unless v leans on it."""
    near_x = F.abs(unit(v)[0]) < 0.9
    helper = [F.when(near_x, 1.0).otherwise(0.0), F.when(near_x, 0.0).otherwise(1.0), F.lit(0.0)]
    first = unit(cross(v, helper))
    return [first, unit(cross(v, first))]


def fold_angle(a: list[Num], b: list[Num]) -> Column:
    """Angle of two directions in [0, pi/2]; zero vectors give pi/2."""
    cos = dot(unit(a), unit(b))
    return F.acos(F.least(F.abs(cos), F.lit(1.0)))


def plane_residual(p: list[Num], q: list[Num], n: list[Num]) -> Column:
    return F.abs(dot([_c(a) - _c(b) for a, b in zip(p, q)], n))


def cylinder_end(start: list[Num], axis: list[Num], length: Num) -> list[Column]:
    return [_c(s) + u * _c(length) for s, u in zip(start, unit(axis))]


def cylinder_centre(start: list[Num], axis: list[Num], length: Num) -> list[Column]:
    return [_c(s) + _c(a) * _c(length) / 2 for s, a in zip(start, axis)]


def zenith(axis_z: Num) -> Column:
    return F.degrees(F.acos(F.least(F.abs(_c(axis_z)), F.lit(1.0))))


def cylinder_volume(radius: Num, length: Num) -> Column:
    return F.lit(math.pi) * _c(radius) * _c(radius) * _c(length)


def slenderness(radius: Num, length: Num) -> Column:
    return F.when(_c(radius) == 0, F.lit(0.0)).otherwise(_c(length) / (_c(radius) * 2))


def diameter_class(radius: Num) -> Column:
    """0 to 4; an edge belongs to the class above it."""
    d, out = _c(radius) * 2, F.lit(len(DIAMETER_EDGES))
    for i in range(len(DIAMETER_EDGES) - 1, -1, -1):
        out = F.when(d < DIAMETER_EDGES[i], i).otherwise(out)
    return out.cast("int")


def radius_class(radius: Num) -> Column:
    """Names of right-closed classes; radii of zero and below count as large."""
    r = _c(radius)
    out = F.when(r <= 0, RADIUS_CLASSES[-1])
    for edge, name in zip(RADIUS_EDGES, RADIUS_CLASSES):
        out = out.when(r <= edge, name)
    return out.otherwise(RADIUS_CLASSES[-1])


def bin_index(v: Num, lo: Num | float, hi: Num | float, n: int | Column) -> Column:
    """Equal-width bin of v in [lo, hi], the last one closed; 0 if hi = lo."""
    w = _c(hi) - _c(lo)
    at = F.when(w == 0, F.lit(0.0)).otherwise((_c(v) - _c(lo)) / w * _c(n))
    return F.least(F.greatest(F.floor(at), F.lit(0)), _c(n) - 1).cast("int")


def world_to_norm(wx: Num, wy: Num, wz: Num, mean: tuple[Num | float, Num | float, Num | float]) -> list[Column]:
    """XY minus the plot's mean; a null height lies on the ground."""
    mx, my, mz = (_c(m) for m in mean)
    return [_c(wx) - mx, _c(wy) - my, F.when(_c(wz).isNull(), F.lit(0.0)).otherwise(_c(wz) - mz)]


def tukey_weight(residual: Num, mad: Num) -> Column:
    u = _c(residual) / (_c(mad) * 6)
    return F.when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2))).otherwise(F.lit(0.0))


def circle_residual(x: Num, y: Num, cx: Num, cy: Num, r: Num) -> Column:
    dx, dy = _c(x) - _c(cx), _c(y) - _c(cy)
    return F.abs(F.sqrt(dx * dx + dy * dy) - _c(r))


def rescale(v: Num, lo: Num, hi: Num, top: float = 65535.0) -> Column:
    """To [0, top] by the least and the largest value; 0 if they are equal."""
    return F.when(_c(hi) == _c(lo), F.lit(0.0)).otherwise((_c(v) - _c(lo)) / (_c(hi) - _c(lo)) * top)


def scale_intensity(v: Num, factor: float = 1.0) -> Column:
    """Intensity of 16 bits to [0, factor]."""
    return _c(v) / 65535.0 * factor


def to_metres(side: Num, units_per_metre: float) -> Column:
    """A length given in units of which ``units_per_metre`` make a metre."""
    return _c(side) / units_per_metre


def finite_or_zero(v: Num) -> Column:
    """The whole part of a number; 0 for null, NaN and infinities."""
    x = _c(v).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))).otherwise(F.lit(0)).cast("long")


def half_even(v: Num, digits: int = 0) -> Column:
    """Rounded to so many digits, ties to the even one."""
    return F.bround(_c(v), digits)


def round6(v: Num) -> Column:
    """``F.round`` of doubles to six digits.  That goes over a decimal for each row; away from
    ties the nearest whole millionth is the same number."""
    v = _c(v)
    x = v * 1e6
    return F.when((v >= 0) & (v < 1e6) & (F.abs(x - F.rint(x)) < 0.499), F.rint(x) / 1e6).otherwise(F.round(v, 6))


def time_suffix(t: Num) -> Column:
    """The mark behind the name of a run that is taken: yyyyMMdd_HHmmss."""
    return F.date_format(_c(t), "yyyyMMdd_HHmmss")


def utm(lon: Num, lat: Num, epsg: int) -> list[Column]:
    """Easting and northing by the Krueger series to the third order, for EPSG 326xx (north)
    and 327xx (south) on WGS 84."""
    zone, south = epsg % 100, epsg // 100 == 327
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"no projection for EPSG:{epsg}; only UTM zones on WGS 84 are built in")
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(s * e))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    east, north = eta, xi
    for j, al in enumerate(alpha, 1):
        east = east + al * F.cos(xi * 2 * j) * F.sinh(eta * 2 * j)
        north = north + al * F.sin(xi * 2 * j) * F.cosh(eta * 2 * j)
    return [east * (k0 * radius) + 500000.0, north * (k0 * radius) + (10000000.0 if south else 0.0)]


def safe_name(s: Num, default: str = "run") -> Column:
    """Letters, digits and underscores of a file stem."""
    t = F.regexp_replace(_c(s), r"[^A-Za-z0-9_]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, r"^_+|_+$", ""), F.lit("")), F.lit(default))


def title_name(s: Num) -> Column:
    return F.initcap(F.translate(_c(s), "_", " "))


def number_text(v: Num) -> Column:
    """Six decimals, blank for null."""
    return F.coalesce(F.format_string("%.6f", _c(v)), F.lit(""))


def parse_number(s: Num) -> Column:
    """A double, or null for blanks and text that is none."""
    return F.nullif(F.trim(_c(s)), F.lit("")).try_cast("double")
