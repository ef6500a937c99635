"""Reference systems as column expressions: ellipsoidal projections, forward and inverse.

A system is read from an EPSG code, a PROJ string or WKT.  A change of system is a chain of
steps, each a pair of expressions of two numbers: projections of a table one after another,
or one pass a step over an array of points.

Conformal, authalic and rectifying latitudes are tied to the geographic one by sine series.
Their coefficients are found here by quadrature for each ellipsoid, which leaves
errors far below a micrometre; all projections rest on them.  Datums count as equal, as do
WGS 84 and NAD83 where no shift is given.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.errors import UnsupportedError

#: Terms of a sine series.
TERMS = 8
Step = Callable[[Column, Column], tuple[Column, Column]]
# Half axis in metres and inverse flattening of ellipsoids.
ELLIPSOIDS = {"wgs84": (6378137.0, 298.257223563), "grs80": (6378137.0, 298.257222101), "clrk66": (6378206.4, 294.9786982), "airy": (6377563.396, 299.3249646), "bessel": (6377397.155, 299.1528128), "sphere": (6370997.0, math.inf)}
DATUMS = {"wgs84": "wgs84", "nad83": "grs80"}
# Kinds of projection by their names in WKT, and the names of their parameters there.
KINDS = {"transverse_mercator": "tmerc", "albers_conic_equal_area": "aea", "albers": "aea", "lambert_conformal_conic_2sp": "lcc", "lambert_conformal_conic_1sp": "lcc", "lambert_conformal_conic": "lcc", "mercator_1sp": "merc", "mercator_2sp": "merc", "mercator": "merc", "mercator_auxiliary_sphere": "webmerc", "popular_visualisation_pseudo_mercator": "webmerc"}
PARAMETERS = {"latitude_of_origin": "lat_0", "latitude_of_center": "lat_0", "central_meridian": "lon_0", "longitude_of_center": "lon_0", "standard_parallel_1": "lat_1", "standard_parallel_2": "lat_2", "scale_factor": "k_0", "false_easting": "x_0", "false_northing": "y_0"}
UNITS = {"m": 1.0, "us-ft": 1200 / 3937, "ft": 0.3048, "km": 1000.0}


@dataclass(frozen=True)
class System:
    """Angles in degrees; false origins in units of the system."""

    kind: str = "longlat"
    a: float = ELLIPSOIDS["wgs84"][0]
    inverse_flattening: float = ELLIPSOIDS["wgs84"][1]
    lat_0: float = 0.0
    lon_0: float = 0.0
    lat_1: float | None = None
    lat_2: float | None = None
    k_0: float = 1.0
    x_0: float = 0.0
    y_0: float = 0.0
    unit: float = 1.0
    name: str = field(default="", compare=False)

    @property
    def geographic(self) -> bool:
        return self.kind == "longlat"


def _by_code(code: int) -> System | None:
    nad = dict(zip(("a", "inverse_flattening"), ELLIPSOIDS["grs80"]))
    if code == 4326:
        return System()
    if code == 4269:
        return System(**nad)
    if code in (3857, 900913):
        return System("webmerc")
    if code == 5070:
        return System("aea", **nad, lat_0=23, lon_0=-96, lat_1=29.5, lat_2=45.5)
    for first, zones, south, ellipsoid in ((32600, 60, False, {}), (32700, 60, True, {}), (26900, 23, False, nad)):
        if first < code <= first + zones:
            return System("tmerc", **ellipsoid, lon_0=6.0 * (code - first) - 183, k_0=0.9996, x_0=500000, y_0=1e7 if south else 0)
    return None


def _from_proj(text: str) -> System:
    given = {k: v for k, _, v in re.findall(r"\+([a-z_0-9]+)(=(\S+))?", text.lower())}
    kind = given.get("proj")
    if "init" in given:
        return system(given["init"])
    if kind == "utm":
        zone = int(given["zone"])
        given |= {"lon_0": 6 * zone - 183, "k_0": 0.9996, "x_0": 500000, "y_0": 10000000 if "south" in given else 0}
        kind = "tmerc"
    if kind not in ("longlat", "latlong", "tmerc", "merc", "webmerc", "aea", "lcc"):
        raise UnsupportedError(f"no projection for {text}")
    a, rf = ELLIPSOIDS[given["ellps"] if given.get("ellps") in ELLIPSOIDS else DATUMS.get(given.get("datum", "wgs84"), "wgs84")]
    if given.get("ellps") and given["ellps"] not in ELLIPSOIDS or given.get("datum") and given["datum"] not in DATUMS:
        raise UnsupportedError(f"unknown ellipsoid or datum in {text}")
    if any(float(x) for x in given.get("towgs84", "0").split(",")):
        raise UnsupportedError(f"shifts between datums are not built in: {text}")
    if "r" in given:
        a, rf = float(given["r"]), math.inf
    if "a" in given:
        a, rf = float(given["a"]), float(given["rf"]) if "rf" in given else math.inf if float(given.get("b", 0)) == float(given["a"]) else float(given["a"]) / (float(given["a"]) - float(given["b"])) if "b" in given else rf
    unit = float(given["to_meter"]) if "to_meter" in given else UNITS[given.get("units", "m")]
    number = {k: float(given[k]) for k in ("lat_0", "lon_0", "lat_1", "lat_2", "k_0") if k in given}
    number |= {"k_0": float(given["k"])} if "k" in given else {}
    # PROJ strings have false origins in metres.
    number |= {k: float(given[k]) / unit for k in ("x_0", "y_0") if k in given}
    if kind == "merc" and "lat_ts" in given:
        number["lat_1"] = float(given["lat_ts"])
    return System("longlat" if kind == "latlong" else kind, a, rf, unit=unit, **number)


def _from_wkt(text: str) -> System:
    # The authority of the whole system is the last one.
    codes = re.findall(r'AUTHORITY\["EPSG","?(\d+)"?\]\]\s*$', text, re.I)
    spheroid = re.search(r'SPHEROID\["[^"]*",([\d.]+),([\d.]+)', text, re.I)
    a, rf = (float(x) for x in spheroid.groups()) if spheroid else ELLIPSOIDS["wgs84"]
    shift = re.search(r"TOWGS84\[([^\]]*)\]", text, re.I)
    if shift and any(float(x) for x in shift[1].split(",")):
        raise UnsupportedError("shifts between datums are not built in")
    own = {"a": a, "inverse_flattening": rf or math.inf}
    if re.match(r"\s*GEOG", text, re.I):
        return System(**own)
    kind = re.search(r'PROJECTION\["([^"]+)"', text, re.I)
    kind = KINDS.get(kind[1].lower().replace(" ", "_")) if kind else None
    if kind is None:
        if codes and (known := _by_code(int(codes[0]))):
            return known
        raise UnsupportedError(f"no projection for {text[:80]}")
    given = {PARAMETERS[k.lower()]: float(v) for k, v in re.findall(r'PARAMETER\["([^"]+)",\s*([-+\d.eE]+)', text) if k.lower() in PARAMETERS}
    units = re.findall(r'UNIT\["[^"]*",\s*([\d.eE-]+)', text, re.I)
    return System(kind, **own, unit=float(units[-1]) if units else 1.0, **given)


@lru_cache(maxsize=256)
def system(text: str) -> System:
    """The system that an EPSG code, a PROJ string or WKT names."""
    t = text.strip()
    if code := re.fullmatch(r"(?:EPSG:|urn:ogc:def:crs:EPSG:[\d.]*:)?(\d+)", t, re.I):
        if found := _by_code(int(code[1])):
            return replace(found, name=t)
    elif t.upper() in ("WGS84", "OGC:CRS84", "CRS84"):
        return System(name=t)
    elif t.startswith("+"):
        return replace(_from_proj(t), name=t)
    elif re.match(r"(PROJCS|GEOGCS|GEOGCRS|PROJCRS)", t, re.I):
        return replace(_from_wkt(t), name=t)
    raise UnsupportedError(f"unknown reference system {text}")


def known(text: str) -> bool:
    try:
        return bool(text) and system(text) is not None
    except UnsupportedError:
        return False


def same(own: str, other: str) -> bool:
    """Whether two systems are one, by their text or what it means; the axes of equal datums may differ by a hair."""
    if not own or not other or own.strip().lower() == other.strip().lower():
        return True
    if not known(own) or not known(other):
        return False
    a, b = system(own), system(other)
    return replace(a, a=0, inverse_flattening=0) == replace(b, a=0, inverse_flattening=0) and abs(a.a - b.a) < 1e-3 and abs(1 / a.inverse_flattening - 1 / b.inverse_flattening) < 1e-8


def utm_of(lon: float, lat: float) -> str:
    """The zone of a point."""
    zone = min(60, max(1, int((lon + 180) // 6) + 1))
    return f"EPSG:{(32600 if lat >= 0 else 32700) + zone}"


# Latitudes ----------------------------------------------------------------------


class Latitudes:
    """Kinds of latitude on an ellipsoid, as numpy functions, and series between them."""

    def __init__(self, a: float, inverse_flattening: float):
        f = 1 / inverse_flattening
        self.a, self.e2 = a, f * (2 - f)
        self.e = math.sqrt(self.e2)
        nodes, weights = np.polynomial.legendre.leggauss(48)
        self._nodes, self._weights = (nodes + 1) / 2, weights / 2
        self.qp = self.q(np.array([math.pi / 2]))[0]
        #: Radius of the circle as long as a meridian.
        self.radius = a * self.arc(np.array([math.pi / 2]))[0] / (math.pi / 2)
        self.phi_of_chi = self._series(self._inverse(self.chi))
        self.phi_of_beta = self._series(self._inverse(self.beta))
        self.mu_of_chi = self._series(lambda x: self.mu(self._inverse(self.chi)(x)))
        self.chi_of_mu = self._series(lambda x: self.chi(self._inverse(self.mu)(x)))

    def chi(self, phi):
        """Conformal."""
        return np.arctan(np.sinh(np.arcsinh(np.tan(phi)) - self.e * np.arctanh(self.e * np.sin(phi))))

    def q(self, phi):
        s = np.sin(phi)
        return 2 * s if self.e == 0 else (1 - self.e2) * (s / (1 - self.e2 * s * s) + np.arctanh(self.e * s) / self.e)

    def beta(self, phi):
        """Authalic."""
        return np.arcsin(np.clip(self.q(phi) / self.qp, -1, 1))

    def arc(self, phi):
        """Length of a meridian from the equator, for a half axis of one."""
        at = np.outer(phi, self._nodes)
        return phi * (((1 - self.e2) * (1 - self.e2 * np.sin(at) ** 2) ** -1.5) @ self._weights)

    def mu(self, phi):
        """Rectifying."""
        return self.arc(phi) * self.a / self.radius

    @staticmethod
    def _inverse(f):
        def g(x):
            phi = x.copy()
            for _ in range(60):
                phi = phi + (x - f(phi))
            return phi

        return g

    @staticmethod
    def _series(f) -> list[float]:
        """Coefficients of f(x) - x in the sines of 2x, 4x, ..."""
        m = 96
        x = (np.arange(m) + 0.5) * (math.pi / 2 / m)
        return [float(2 / m * ((f(x) - x) @ np.sin(2 * k * x))) for k in range(1, TERMS + 1)]


@lru_cache(maxsize=32)
def latitudes(a: float, inverse_flattening: float) -> Latitudes:
    return Latitudes(a, inverse_flattening)


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _sines(x: Column, series: list[float]) -> Column:
    return x + _total([F.lit(c) * F.sin(F.lit(2.0 * (k + 1)) * x) for k, c in enumerate(series)])


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _wrapped(x: Column) -> Column:
    """An angle within half a turn."""
    return x - F.lit(2 * math.pi) * F.floor((x + F.lit(math.pi)) / F.lit(2 * math.pi))


def _chi(phi: Column, e: float) -> Column:
    return F.atan(F.sinh(F.asinh(F.tan(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))) if e else phi


def _complex_series(series: list[float]) -> Step:
    """(eta, xi) plus a sine series of complex latitudes."""

    def step(eta: Column, xi: Column):
        twice = [(F.lit(c), F.lit(2.0 * (k + 1)) * xi, F.lit(2.0 * (k + 1)) * eta) for k, c in enumerate(series)]
        return eta + _total([c * F.cos(x) * F.sinh(h) for c, x, h in twice]), xi + _total([c * F.sin(x) * F.cosh(h) for c, x, h in twice])

    return step


# Steps from longitude and latitude in radians to metres, and back ----------------


def _transverse(s: System, L: Latitudes) -> tuple[list[Step], list[Step]]:
    scale = s.k_0 * L.radius
    origin = scale * float(L.mu(np.array([math.radians(s.lat_0)]))[0])

    def onto(lam, phi):
        chi = _chi(phi, L.e)
        return F.atanh(_clamped(F.cos(chi) * F.sin(lam))), F.atan2(F.sin(chi), F.cos(chi) * F.cos(lam))

    def off(eta, xi):
        return F.atan2(F.sinh(eta), F.cos(xi)), F.asin(_clamped(F.sin(xi) / F.cosh(eta)))

    forward = [onto, _complex_series(L.mu_of_chi), lambda eta, xi: (eta * scale, xi * scale - origin)]
    return forward, [lambda x, y: (x / scale, (y + origin) / scale), _complex_series(L.chi_of_mu), off, lambda lam, chi: (lam, _sines(chi, L.phi_of_chi))]


def _mercator(s: System, L: Latitudes) -> tuple[list[Step], list[Step]]:
    k = s.k_0
    if s.lat_1 is not None:
        phi = math.radians(s.lat_1)
        k *= math.cos(phi) / math.sqrt(1 - L.e2 * math.sin(phi) ** 2)
    scale = k * s.a
    forward = [lambda lam, phi: (lam * scale, F.asinh(F.tan(_chi(phi, L.e))) * scale)]
    return forward, [lambda x, y: (x / scale, F.atan(F.sinh(y / scale))), lambda lam, chi: (lam, _sines(chi, L.phi_of_chi))]


def _conic(L: Latitudes, n: float, radius: Callable, latitude: Callable, origin: float) -> tuple[list[Step], list[Step]]:
    """Steps of a cone: ``radius`` of a latitude and ``latitude`` of a radius, with the radius at the origin."""

    def forward(lam, phi):
        rho = radius(phi)
        return rho * F.sin(lam * n), F.lit(origin) - rho * F.cos(lam * n)

    sign = 1.0 if n > 0 else -1.0

    def off(x, y):
        dx, dy = x * sign, (F.lit(origin) - y) * sign
        return F.atan2(dx, dy) / n, F.sqrt(dx * dx + dy * dy) * sign

    return [forward], [off, lambda lam, rho: (lam, latitude(rho))]


def _albers(s: System, L: Latitudes) -> tuple[list[Step], list[Step]]:
    one, two = (math.radians(x) for x in (s.lat_1 or 0.0, s.lat_2 if s.lat_2 is not None else s.lat_1 or 0.0))
    m = [math.cos(p) / math.sqrt(1 - L.e2 * math.sin(p) ** 2) for p in (one, two)]
    q = [float(L.q(np.array([p]))[0]) for p in (one, two, math.radians(s.lat_0))]
    n = math.sin(one) if abs(one - two) < 1e-12 else (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0])
    c = m[0] ** 2 + n * q[0]

    def q_of(phi):
        t = F.sin(phi)
        return t * 2 if L.e == 0 else (t / (F.lit(1.0) - t * t * L.e2) + F.atanh(t * L.e) / L.e) * (1 - L.e2)

    rho = lambda phi: F.sqrt(F.greatest(F.lit(0.0), F.lit(c) - q_of(phi) * n)) * (s.a / n)
    back = lambda r: F.asin(_clamped((F.lit(c) - (r * (n / s.a)) * (r * (n / s.a))) / (n * L.qp)))
    forward, inverse = _conic(L, n, rho, back, s.a * math.sqrt(c - n * q[2]) / n)
    return forward, [*inverse, lambda lam, beta: (lam, _sines(beta, L.phi_of_beta))]


def _lambert(s: System, L: Latitudes) -> tuple[list[Step], list[Step]]:
    one = math.radians(s.lat_1 if s.lat_1 is not None else s.lat_0)
    two = math.radians(s.lat_2) if s.lat_2 is not None else one
    m = [math.cos(p) / math.sqrt(1 - L.e2 * math.sin(p) ** 2) for p in (one, two)]
    t = [math.tan(math.pi / 4 - float(L.chi(np.array([p]))[0]) / 2) for p in (one, two, math.radians(s.lat_0))]
    n = math.sin(one) if abs(one - two) < 1e-12 else (math.log(m[0]) - math.log(m[1])) / (math.log(t[0]) - math.log(t[1]))
    scale = s.a * s.k_0 * m[0] / (n * t[0] ** n)
    rho = lambda phi: F.pow(F.tan(F.lit(math.pi / 4) - _chi(phi, L.e) / 2), F.lit(n)) * scale
    back = lambda r: F.lit(math.pi / 2) - F.atan(F.pow(r / scale, F.lit(1 / n))) * 2
    forward, inverse = _conic(L, n, rho, back, scale * t[2] ** n)
    return forward, [*inverse, lambda lam, chi: (lam, _sines(chi, L.phi_of_chi))]


def _steps(s: System) -> tuple[list[Step], list[Step]]:
    """(from longitude and latitude in degrees, back to them)."""
    if s.geographic:
        return [], []
    L = latitudes(s.a, math.inf) if s.kind == "webmerc" else latitudes(s.a, s.inverse_flattening)
    forward, inverse = {"tmerc": _transverse, "merc": _mercator, "webmerc": _mercator, "aea": _albers, "lcc": _lambert}[s.kind](s, L)
    start = lambda x, y: (_wrapped(F.radians(x) - math.radians(s.lon_0)), F.radians(y))
    end = lambda lam, phi: (F.degrees(_wrapped(lam + math.radians(s.lon_0))), F.degrees(phi))
    shift = lambda x, y: (x / s.unit + s.x_0, y / s.unit + s.y_0)
    unshift = lambda x, y: ((x - s.x_0) * s.unit, (y - s.y_0) * s.unit)
    return [start, *forward, shift], [unshift, *inverse, end]


def steps(own: str, other: str) -> list[Step]:
    """What leads from one system to another; nothing if they are the same."""
    if same(own, other):
        return []
    return _steps(system(own))[1] + _steps(system(other))[0]


def moved(table: DataFrame, x: Column, y: Column, own: str, other: str, names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``table`` with coordinates in another system as columns of these names; x is the longitude of geographic ones.

    Every step is a projection of its own, which Catalyst keeps apart as its inputs are used
    many times, so each value is computed once and all of it in generated code.  Nulls stay.
    A filter on the new columns would be pushed below the steps and repeat them; where one
    follows, ``transformed`` keeps its size.
    """
    u, v = "_moved_x", "_moved_y"
    out = table.withColumns({u: x.cast("double"), v: y.cast("double")})
    for step in steps(own, other):
        out = out.withColumns(dict(zip((u, v), step(F.col(u), F.col(v)))))
    return out.withColumns(dict(zip(names, (F.col(u), F.col(v))))).drop(u, v)


def transformed(x: Column, y: Column, own: str, other: str) -> Column:
    """Coordinates in another system as a struct of x and y, as one expression without repeated parts."""
    return F.element_at(transformed_points(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), own, other), 1)


def transformed_points(points: Column, own: str, other: str) -> Column:
    """An array of points (with nulls between parts) in another system."""

    def taken(step: Step):
        def one(p: Column) -> Column:
            x, y = step(p["x"], p["y"])
            return F.when(p.isNotNull(), F.struct(x.alias("x"), y.alias("y")))

        return one

    for step in steps(own, other):
        points = F.transform(points, taken(step))
    return points
