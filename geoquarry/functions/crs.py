"""Map projections as Spark column maths.

UTM uses the Krueger series (Karney, J. Geodesy 2011), EPSG:3035 the ellipsoidal Lambert
azimuthal equal-area and web Mercator the spherical formulas (Snyder, USGS PP 1395).
A projection is a list of steps. Each step maps named columns to new named columns, so the
same steps run over plain columns (whole-stage code) and inside ``transform`` over points.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Get = Callable[[str], Column]
Step = Callable[[Get], dict[str, Column]]

# Ellipsoids (semi-major axis, flattening).
GRS80 = (6378137.0, 1 / 298.257222101)
WGS84 = (6378137.0, 1 / 298.257223563)


def normalize(crs) -> int:
    """EPSG code of ``25833``, ``"EPSG:25833"`` and the like."""
    match = re.search(r"(\d{4,6})\s*$", str(crs).strip().rstrip('"]}'))
    if not match:
        raise ValueError(f"Unknown CRS: {crs!r}")
    return int(match.group(1))


def _geographic(code: int) -> bool:
    return code in (4326, 4258)


def _utm(code: int) -> tuple[int, bool, tuple[float, float]] | None:
    if 25828 <= code <= 25838:
        return code - 25800, False, GRS80
    if 32601 <= code <= 32660:
        return code - 32600, False, WGS84
    if 32701 <= code <= 32760:
        return code - 32700, True, WGS84
    return None


def _poly(n: float, *coefficients: float) -> float:
    return sum(c * n ** (i + 1) for i, c in enumerate(coefficients))


def _utm_steps(zone: int, south: bool, ellipsoid, inverse: bool) -> list[Step]:
    a, f = ellipsoid
    n = f / (2 - f)
    scale = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    central = math.radians(6 * zone - 183)
    east, north = 500000.0, 10000000.0 if south else 0.0
    # Krueger series coefficients by power of n.
    alpha = [
        _poly(n, 1 / 2, -2 / 3, 5 / 16, 41 / 180),
        _poly(n, 0, 13 / 48, -3 / 5, 557 / 1440),
        _poly(n, 0, 0, 61 / 240, -103 / 140),
        _poly(n, 0, 0, 0, 49561 / 161280),
    ]
    beta = [
        _poly(n, 1 / 2, -2 / 3, 37 / 96, -1 / 360),
        _poly(n, 0, 1 / 48, 1 / 15, -437 / 1440),
        _poly(n, 0, 0, 17 / 480, -37 / 840),
        _poly(n, 0, 0, 0, 4397 / 161280),
    ]
    delta = [
        _poly(n, 2, -2 / 3, -2, 116 / 45),
        _poly(n, 0, 7 / 3, -8 / 5, -227 / 45),
        _poly(n, 0, 0, 56 / 15, -136 / 35),
        _poly(n, 0, 0, 0, 4279 / 630),
    ]
    if inverse:

        def unscale(g):
            return {
                "xi": (g("y") - F.lit(north)) / F.lit(scale),
                "eta": (g("x") - F.lit(east)) / F.lit(scale),
            }

        def gauss_schreiber(g):
            xi, eta = g("xi"), g("eta")
            for j, b in enumerate(beta, start=1):
                xi = xi - F.lit(b) * F.sin(g("xi") * 2 * j) * F.cosh(g("eta") * 2 * j)
                eta = eta - F.lit(b) * F.cos(g("xi") * 2 * j) * F.sinh(g("eta") * 2 * j)
            return {"xi": xi, "eta": eta}

        def conformal(g):
            return {
                "chi": F.asin(F.sin(g("xi")) / F.cosh(g("eta"))),
                "lam": F.atan2(F.sinh(g("eta")), F.cos(g("xi"))),
            }

        def geographic(g):
            phi = g("chi")
            for j, d in enumerate(delta, start=1):
                phi = phi + F.lit(d) * F.sin(g("chi") * 2 * j)
            return {"x": F.degrees(g("lam") + F.lit(central)), "y": F.degrees(phi)}

        return [unscale, gauss_schreiber, conformal, geographic]

    e = 2 * math.sqrt(n) / (1 + n)

    def radians(g):
        return {"s": F.sin(F.radians(g("y"))), "lam": F.radians(g("x")) - F.lit(central)}

    def tangent(g):
        return {
            "t": F.sinh(F.atanh(g("s")) - F.lit(e) * F.atanh(F.lit(e) * g("s"))),
            "lam": g("lam"),
        }

    def gauss_schreiber(g):
        return {
            "xi": F.atan2(g("t"), F.cos(g("lam"))),
            "eta": F.atanh(F.sin(g("lam")) / F.sqrt(F.lit(1.0) + g("t") * g("t"))),
        }

    def projected(g):
        xi, eta = g("xi"), g("eta")
        for j, c in enumerate(alpha, start=1):
            xi = xi + F.lit(c) * F.sin(g("xi") * 2 * j) * F.cosh(g("eta") * 2 * j)
            eta = eta + F.lit(c) * F.cos(g("xi") * 2 * j) * F.sinh(g("eta") * 2 * j)
        return {"x": eta * F.lit(scale) + F.lit(east), "y": xi * F.lit(scale) + F.lit(north)}

    return [radians, tangent, gauss_schreiber, projected]


def _laea_steps(inverse: bool) -> list[Step]:
    a, f = GRS80
    # Origin and false origin of EPSG:3035.
    lat0, lon0, fe, fn = math.radians(52), math.radians(10), 4321000.0, 3210000.0
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def authalic(s: float) -> float:
        return (1 - e2) * (
            s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e)
        )

    qp = authalic(1.0)
    beta0 = math.asin(authalic(math.sin(lat0)) / qp)
    rq = a * math.sqrt(qp / 2)
    d = a * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (rq * math.cos(beta0))
    sin0, cos0 = math.sin(beta0), math.cos(beta0)
    if inverse:

        def offsets(g):
            return {
                "dx": (g("x") - F.lit(fe)) / F.lit(d),
                "dy": (g("y") - F.lit(fn)) * F.lit(d),
            }

        def distance(g):
            rho = F.hypot(g("dx"), g("dy"))
            return {"dx": g("dx"), "dy": g("dy"), "rho": rho, "c": F.asin(rho / F.lit(2 * rq)) * 2}

        def authalic_latitude(g):
            at_origin = g("rho") == 0
            beta = F.asin(
                F.cos(g("c")) * F.lit(sin0)
                + g("dy") * F.sin(g("c")) * F.lit(cos0) / g("rho")
            )
            lam = F.atan2(
                g("dx") * F.sin(g("c")),
                g("rho") * F.lit(cos0) * F.cos(g("c")) - g("dy") * F.lit(sin0) * F.sin(g("c")),
            )
            return {
                "beta": F.when(at_origin, F.lit(beta0)).otherwise(beta),
                "lam": F.when(at_origin, F.lit(0.0)).otherwise(lam),
            }

        def geographic(g):
            b = g("beta")
            phi = (
                b
                + F.lit(e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(b * 2)
                + F.lit(23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(b * 4)
                + F.lit(761 * e2**3 / 45360) * F.sin(b * 6)
            )
            return {"x": F.degrees(g("lam") + F.lit(lon0)), "y": F.degrees(phi)}

        return [offsets, distance, authalic_latitude, geographic]

    def radians(g):
        return {"s": F.sin(F.radians(g("y"))), "lam": F.radians(g("x")) - F.lit(lon0)}

    def authalic_latitude(g):
        s = g("s")
        q = F.lit(1 - e2) * (
            s / (F.lit(1.0) - s * s * e2)
            - F.log((F.lit(1.0) - s * e) / (F.lit(1.0) + s * e)) / F.lit(2 * e)
        )
        return {"beta": F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), q / F.lit(qp)))), "lam": g("lam")}

    def parts(g):
        return {"sb": F.sin(g("beta")), "cb": F.cos(g("beta")), "lam": g("lam")}

    def scale(g):
        b = F.lit(rq) * F.sqrt(
            F.lit(2.0)
            / (F.lit(1.0) + g("sb") * sin0 + g("cb") * cos0 * F.cos(g("lam")))
        )
        return {"sb": g("sb"), "cb": g("cb"), "lam": g("lam"), "b": b}

    def projected(g):
        return {
            "x": F.lit(fe) + g("b") * F.lit(d) * g("cb") * F.sin(g("lam")),
            "y": F.lit(fn)
            + g("b") / F.lit(d) * (g("sb") * cos0 - g("cb") * sin0 * F.cos(g("lam"))),
        }

    return [radians, authalic_latitude, parts, scale, projected]


def _mercator_steps(inverse: bool) -> list[Step]:
    radius = 6378137.0

    def backward(g):
        return {
            "x": F.degrees(g("x") / F.lit(radius)),
            "y": F.degrees(F.atan(F.exp(g("y") / F.lit(radius))) * 2 - F.lit(math.pi / 2)),
        }

    def forward(g):
        return {
            "x": F.radians(g("x")) * F.lit(radius),
            "y": F.log(F.tan(F.radians(g("y")) / 2 + F.lit(math.pi / 4))) * F.lit(radius),
        }

    return [backward if inverse else forward]


def _steps(code: int, inverse: bool) -> list[Step]:
    utm = _utm(code)
    if utm:
        return _utm_steps(*utm, inverse)
    if code == 3035:
        return _laea_steps(inverse)
    if code in (3857, 900913):
        return _mercator_steps(inverse)
    raise ValueError(f"No projection for EPSG:{code}; known: 4326, 4258, UTM, 3035, 3857")


def projection_steps(source, target) -> list[Step]:
    source, target = normalize(source), normalize(target)
    if source == target or (_geographic(source) and _geographic(target)):
        return []
    steps: list[Step] = []
    if not _geographic(source):
        steps += _steps(source, inverse=True)
    if not _geographic(target):
        steps += _steps(target, inverse=False)
    return steps


def reproject(geom: Column, source, target) -> Column:
    """Nested geometry with every point moved from one CRS to the other.

    ``source`` None means unknown: the geometry is left as it is.
    """
    if source is None:
        return geom
    steps = projection_steps(source, target)
    if not steps:
        return geom

    def apply(step: Step) -> Callable[[Column], Column]:
        return lambda p: F.struct(*[c.alias(k) for k, c in step(p.getField).items()])

    def move(points: Column) -> Column:
        for step in steps:
            points = F.transform(points, apply(step))
        return points

    def moved(g: Column) -> Column:
        parts = F.transform(g["parts"], lambda part: F.transform(part, move))
        return F.when(g.isNotNull(), F.struct(g["kind"].alias("kind"), parts.alias("parts")))

    return F.get(F.transform(F.array(geom), moved), F.lit(0))


def known_codes() -> list[int]:
    """All EPSG codes that can be projected."""
    utm = [base + zone for base in (25800, 32600, 32700) for zone in range(1, 61)]
    return [c for c in (4326, 4258, 3035, 3857, *utm) if c in (4326, 4258, 3035, 3857) or _utm(c)]


def reproject_xy(df: DataFrame, x: str, y: str, source, target) -> DataFrame:
    """Replace coordinate columns ``x`` and ``y`` by their projection."""
    out = df.withColumns({"__p_x": F.col(x), "__p_y": F.col(y)})
    for step in projection_steps(source, target):
        out = out.withColumns(
            {f"__p_{k}": c for k, c in step(lambda name: F.col(f"__p_{name}")).items()}
        )
    out = out.withColumns({x: F.col("__p_x"), y: F.col("__p_y")})
    return out.drop(*[c for c in out.columns if c.startswith("__p_")])
