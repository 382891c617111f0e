"""Geometry as column arithmetic. Points are struct<lon, lat> in degrees (SIRGAS 2000, taken as WGS 84), lines arrays of
points, polygons arrays of rings, the first one outer. Formulas are SQL texts, so that tests can run them elsewhere."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltgrain.functions.crs import let

#: GRS 80.
A, FLATTENING = 6378137.0, 1 / 298.257222101
E2 = FLATTENING * (2 - FLATTENING)


def utm(lon: str, lat: str, zone: int = 23) -> tuple[str, str]:
    """SQL of easting and northing in metres, southern UTM zone (23: EPSG:31983), by the usual series in e2 and A."""
    k0, ep, lon0 = 0.9996, E2 / (1 - E2), (zone * 6 - 183) * pi / 180
    phi = f"radians({lat})"
    n = f"({_num(A)}/sqrt(1e0-{_num(E2)}*sin({phi})*sin({phi})))"
    t, c = f"(tan({phi})*tan({phi}))", f"({_num(ep)}*cos({phi})*cos({phi}))"
    a = f"(cos({phi})*(radians({lon})-({_num(lon0)})))"
    m0, m2 = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024
    m4, m6 = 15 * E2**2 / 256 + 45 * E2**3 / 1024, 35 * E2**3 / 3072
    m = f"({_num(A)}*({_num(m0)}*{phi}-{_num(m2)}*sin(2e0*{phi})+{_num(m4)}*sin(4e0*{phi})-{_num(m6)}*sin(6e0*{phi})))"
    x = f"(500000e0+{_num(k0)}*{n}*({a}+(1e0-{t}+{c})*pow({a},3)/6e0+(5e0-18e0*{t}+{t}*{t}+72e0*{c}-{_num(58 * ep)})*pow({a},5)/120e0))"
    y = f"(10000000e0+{_num(k0)}*({m}+{n}*tan({phi})*(pow({a},2)/2e0+(5e0-{t}+9e0*{c}+4e0*{c}*{c})*pow({a},4)/24e0+(61e0-58e0*{t}+{t}*{t}+600e0*{c}-{_num(330 * ep)})*pow({a},6)/720e0)))"
    return x, y


def _num(x: float) -> str:
    """A double literal of SQL, without an exponent of its own."""
    text = repr(float(x))
    return (f"{x:.25f}" if "e" in text else text) + "e0"


def planar_length(lon1: str, lat1: str, lon2: str, lat2: str, zone: int = 23) -> str:
    """SQL: metres between two points in the zone's plane."""
    (x1, y1), (x2, y2) = utm(lon1, lat1, zone), utm(lon2, lat2, zone)
    return f"sqrt(pow({x1}-{x2},2)+pow({y1}-{y2},2))"


def curvature(lat: str) -> tuple[str, str]:
    """SQL: metres of a radian along the meridian and along the parallel at a latitude of the ellipsoid."""
    w = f"(1e0-{_num(E2)}*sin(radians({lat}))*sin(radians({lat})))"
    return f"({_num(A * (1 - E2))}/({w}*sqrt({w})))", f"({_num(A)}*cos(radians({lat}))/sqrt({w}))"


#: Metres of chord up to which an arc follows from its chord to a tenth of a millimetre, however it lies.
SHORT = 20_000.0
#: Rounds of the usual iteration, which gain over two digits each, and of halving where two points are nearly antipodal.
ROUNDS, HALVINGS = 8, 54
B = A * (1 - FLATTENING)


def earth_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Metres from the middle of the earth of a place on the ellipsoid."""
    lon, lat = F.radians(lon), F.radians(lat)
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - E2) * F.sin(lat)


def chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres through the earth between two points of the ellipsoid; never more than the geodesic."""
    return F.sqrt(sum((((a - b) * (a - b)) for a, b in zip(earth_xyz(lon1, lat1), earth_xyz(lon2, lat2), strict=True)), F.lit(0.0)))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres of the shortest way on the ellipsoid between any two points, to a tenth of a millimetre or so.

    Up to SHORT it is the chord's arc on the sphere that fits the earth there. Beyond, the two points are taken to the
    auxiliary sphere: the difference of longitudes there is found by iteration, or, for points nearly antipodal, where that
    does not settle, by halving the first azimuth, of which the difference is a rising function. All loops have a fixed
    number of rounds. Of opposite points all shortest ways are equally long."""
    across = chord(lon1, lat1, lon2, lat2)
    return F.when(across <= SHORT, short_arc(across, lat1, lat2)).otherwise(_far(lon1, lat1, lon2, lat2))


def short_arc(across: Column, lat1: Column, lat2: Column) -> Column:
    """The geodesic between two latitudes whose chord is known and at most SHORT."""
    mid = F.radians((lat1 + lat2) / 2)
    w = 1 - E2 * F.sin(mid) * F.sin(mid)
    return across * (1 + across * across * w * w / (24 * A * A * (1 - E2)))  # the radii's product, of meridian and across


#: By what share about_geodesic() is wrong at most: far from antipodal, and anywhere.
ABOUT, ABOUT_ANYWHERE = 1e-4, 0.0034


def about_geodesic(one: tuple[Column, Column, Column], other: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Bounds of the geodesic between two places of earth_xyz(): the auxiliary sphere's arc, less what the flattening takes from it
    in the first order, and a margin; for points nearly antipodal the arc alone, which is longer by the flattening at most."""
    (x1, y1, z1), (x2, y2, z2) = (tuple(c / axis for c, axis in zip(p, (A, A, B), strict=True)) for p in (one, other))
    h = F.greatest(F.least(((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2)) / 4, F.lit(1.0)), F.lit(1e-30))
    arc, sine = 2 * F.asin(F.sqrt(h)), 2 * F.sqrt(h * (1 - h))
    less = FLATTENING / 8 * ((arc - sine) * (z1 + z2) * (z1 + z2) / F.greatest(1 - h, F.lit(1e-30)) + (arc + sine) * (z2 - z1) * (z2 - z1) / h)
    usual = h < 0.9
    metres, wrong = A * F.when(usual, arc - less).otherwise(arc), F.when(usual, ABOUT).otherwise(ABOUT_ANYWHERE)
    return metres * (1 - wrong) - 1e-3, metres * (1 + wrong) + 1e-3


def _series(cos2: Column) -> tuple[Column, Column, Column]:
    """The three factors of the ellipsoid's arcs, by the squared cosine of the azimuth at the equator."""
    u2 = cos2 * (A * A - B * B) / (B * B)
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    big_c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
    return big_a, big_b, big_c


def _arc(sin0: Column, sin_s: Column, cos_s: Column, sigma: Column, cos2m: Column) -> tuple[Column, Column]:
    """What the ellipsoid takes from the longitude of an arc, and the arc's metres. cos2m: of twice the arc's middle."""
    big_a, big_b, big_c = _series(1 - sin0 * sin0)
    less = (1 - big_c) * FLATTENING * sin0 * (sigma + big_c * sin_s * (cos2m + big_c * cos_s * (2 * cos2m * cos2m - 1)))
    part = big_b * sin_s * (cos2m + big_b / 4 * (cos_s * (2 * cos2m * cos2m - 1) - big_b / 6 * cos2m * (4 * sin_s * sin_s - 3) * (4 * cos2m * cos2m - 3)))
    return less, B * big_a * (sigma - part)


def _far(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    turn = F.pmod(F.abs(lon1 - lon2), F.lit(360.0))
    away = F.radians(F.least(turn, 360 - turn))
    # The point farther from the equator comes first and in the south; neither changes the distance.
    first, second = (reduced(F.when(F.abs(lat1) >= F.abs(lat2), x).otherwise(y)) for x, y in ((lat1, lat2), (lat2, lat1)))
    sign = F.when(first > 0, F.lit(-1.0)).otherwise(1.0)
    south = F.least(first * sign, F.lit(-1e-150))  # on the equator still south of it, so that azimuths keep their meaning
    at = F.struct(F.sin(south).alias("s1"), F.cos(south).alias("c1"), F.sin(second * sign).alias("s2"), F.cos(second * sign).alias("c2"), away.alias("l"))

    def solve(p: Column) -> Column:
        s1, c1, s2, c2, l = (p[x] for x in ("s1", "c1", "s2", "c2", "l"))

        def on_sphere(lam: Column) -> Column:
            x, y = c1 * s2 - s1 * c2 * F.cos(lam), c2 * F.sin(lam)
            return F.struct(F.sqrt(x * x + y * y).alias("sin"), (s1 * s2 + c1 * c2 * F.cos(lam)).alias("cos"), (c1 * c2 * F.sin(lam)).alias("up"))

        def measured(v: Column) -> Column:
            sin0 = F.when(v["sin"] > 0, v["up"] / v["sin"]).otherwise(0.0)
            cos2 = 1 - sin0 * sin0
            cos2m = F.when(cos2 > 1e-14, v["cos"] - 2 * s1 * s2 / cos2).otherwise(0.0)
            return F.struct(sin0.alias("sin0"), v["sin"].alias("sin"), v["cos"].alias("cos"), F.atan2(v["sin"], v["cos"]).alias("sigma"), cos2m.alias("cos2m"))

        arc = lambda m: _arc(*(m[x] for x in ("sin0", "sin", "cos", "sigma", "cos2m")))
        sphere = lambda lam: let(let(lam, on_sphere), measured)
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), l, lambda lam, _: l + let(sphere(lam), lambda m: arc(m)[0]))
        usual = let(lam, lambda lam: let(sphere(lam), lambda m: arc(m)[1]))

        def by_azimuth(a: Column) -> Column:
            """Both ends' arcs from the equator on the great circle that leaves the first point at an azimuth."""
            c0, sin0 = F.cos(a), F.sin(a) * c1
            rest = F.sqrt(F.greatest(c0 * c0 * c1 * c1 + (c2 * c2 - c1 * c1), F.lit(0.0)))
            sig1, sig2 = F.atan2(s1, c0 * c1), F.atan2(s2, rest)
            om1, om2 = F.atan2(sin0 * s1, c0 * c1), F.atan2(sin0 * s2, rest)
            return F.struct(sin0.alias("sin0"), (sig2 - sig1).alias("sigma"), (sig1 + sig2).alias("twice"), (om2 - om1).alias("omega"))

        def ends(a: Column) -> Column:
            def measured(v: Column) -> Column:
                less, metres = _arc(v["sin0"], F.sin(v["sigma"]), F.cos(v["sigma"]), v["sigma"], F.cos(v["twice"]))
                return F.struct((v["omega"] - less).alias("l"), metres.alias("metres"))

            return let(let(a, by_azimuth), measured)

        def halve(acc: Column, _: Column) -> Column:
            middle = (acc["low"] + acc["high"]) / 2
            return let(let(middle, ends)["l"] < l, lambda less: F.struct(F.when(less, middle).otherwise(acc["low"]).alias("low"), F.when(less, acc["high"]).otherwise(middle).alias("high")))

        start = F.struct(F.lit(0.0).alias("low"), F.lit(pi).alias("high"))
        halved = let(F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda acc: (acc["low"] + acc["high"]) / 2), lambda a: ends(a)["metres"])
        level = (F.abs(s1) < 1e-100) & (s2 == 0) & (l <= pi * (1 - FLATTENING))  # along the equator
        cos_s = s1 * s2 + c1 * c2 * F.cos(l)
        return F.when(level, A * l).when(cos_s > -0.99, usual).otherwise(halved)

    return let(at, solve)


def disc_span(lon1: str, lat1: str, lon2: str, lat2: str, lon: str, lat: str, radius: str) -> tuple[str, str]:
    """SQL of the two ends, as parts of the way from the first point to the second, of the stretch within radius of a
    third; null if there is none. In the plane that touches the ellipsoid at the stretch's first point."""
    north, east = curvature(lat1)
    x = lambda v: f"(radians({v}-{lon1})*{east})"
    y = lambda v: f"(radians({v}-{lat1})*{north})"
    dx, dy, px, py = x(lon2), y(lat2), x(lon), y(lat)
    ll = f"({dx}*{dx}+{dy}*{dy})"
    u = f"(({px}*{dx}+{py}*{dy})/{ll})"
    room = f"({radius}*{radius}-({px}*{px}+{py}*{py})+{u}*{u}*{ll})"
    half = f"sqrt(greatest({room},0e0)/{ll})"
    ok = f"{ll}>0e0 and {room}>=0e0 and {u}+{half}>0e0 and {u}-{half}<1e0"
    return f"case when {ok} then greatest(0e0,{u}-{half}) end", f"case when {ok} then least(1e0,{u}+{half}) end"


def to_wgs84(geom: Column) -> Column:
    """Degrees as maps want them: SIRGAS 2000 differs from WGS 84 by centimetres, so they stay."""
    return geom


def line_midpoint(line: str, several: bool = False) -> Column:
    """The point halfway along a line, or along several, an array of them, one after the other, by what they measure together;
    null without a vertex. Lengths are compared in a plane scaled at each piece."""
    size = lambda p: F.sqrt(F.pow((p["b"]["lon"] - p["a"]["lon"]) * F.cos(F.radians((p["a"]["lat"] + p["b"]["lat"]) / 2)), F.lit(2)) + F.pow(p["b"]["lat"] - p["a"]["lat"], F.lit(2)))
    some = F.filter(F.transform(_all_pieces(line) if several else pieces(line), lambda p: F.struct(p.alias("p"), size(p).alias("m"))), lambda x: x["m"] > 0)
    half = F.aggregate(some, F.lit(0.0), lambda acc, x: acc + x["m"]) / 2
    none = F.lit(None).cast("struct<lon:double,lat:double>")
    start = F.struct(half.alias("left"), none.alias("at"))

    def walk(acc: Column, x: Column) -> Column:
        t, a, b = acc["left"] / x["m"], x["p"]["a"], x["p"]["b"]
        here = F.struct((a["lon"] + t * (b["lon"] - a["lon"])).alias("lon"), (a["lat"] + t * (b["lat"] - a["lat"])).alias("lat"))
        return F.struct((acc["left"] - x["m"]).alias("left"), F.when(acc["at"].isNull() & (acc["left"] <= x["m"]), here).otherwise(acc["at"]).alias("at"))

    return F.coalesce(F.aggregate(some, start, walk, lambda acc: acc["at"]), F.get(F.flatten(line) if several else F.col(line), F.lit(0)))


def distance_to_line_m(line: str, point: Column) -> Column:
    """Metres from a point to a line, each piece in the plane that touches the ellipsoid at its first vertex; null without a
    piece."""

    def metres(p: Column) -> Column:
        w = 1 - E2 * F.sin(F.radians(p["a"]["lat"])) * F.sin(F.radians(p["a"]["lat"]))
        x = lambda q: F.radians(q["lon"] - p["a"]["lon"]) * A * F.cos(F.radians(p["a"]["lat"])) / F.sqrt(w)
        y = lambda q: F.radians(q["lat"] - p["a"]["lat"]) * A * (1 - E2) / (w * F.sqrt(w))
        dx, dy, px, py = x(p["b"]), y(p["b"]), x(point), y(point)
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.least(F.greatest((px * dx + py * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))

    return F.array_min(F.transform(pieces(line), metres))


def within_distance(line: str, point: Column, metres: float) -> Column:
    """Whether a point is within so many metres of a line."""
    return F.coalesce(distance_to_line_m(line, point) <= metres, F.lit(False))


def expr(sql: str) -> Column:
    return F.expr(sql)


def pieces(line: str) -> Column:
    """The straight pieces of a line: an array of struct<a, b>."""
    return F.expr(f"case when size({line}) > 1 then zip_with(slice({line}, 1, size({line}) - 1), slice({line}, 2, size({line}) - 1), (a, b) -> named_struct('a', a, 'b', b)) else array() end")


def _all_pieces(lines: str) -> Column:
    """The straight pieces of an array of lines; none lead from one line to the next."""
    return F.expr(f"flatten(transform(filter({lines}, g -> size(g) > 1), g -> zip_with(slice(g, 1, size(g) - 1), slice(g, 2, size(g) - 1), (a, b) -> named_struct('a', a, 'b', b))))")


def line_length_m(line: str, zone: int = 23) -> Column:
    return F.aggregate(pieces(line), F.lit(0.0), lambda acc, p: acc + _piece(p, zone))


def _piece(p: Column, zone: int) -> Column:
    x1, y1 = _xy(p["a"], zone)
    x2, y2 = _xy(p["b"], zone)
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _xy(point: Column, zone: int) -> tuple[Column, Column]:
    """utm() for a point that is a lambda's variable, which SQL texts can't name."""
    k0, ep, lon0 = 0.9996, E2 / (1 - E2), (zone * 6 - 183) * pi / 180
    phi = F.radians(point["lat"])
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), ep * F.cos(phi) * F.cos(phi)
    a = F.cos(phi) * (F.radians(point["lon"]) - lon0)
    m = A * ((1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * phi) + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * phi) - 35 * E2**3 / 3072 * F.sin(6 * phi))
    x = 500000 + k0 * n * (a + (1 - t + c) * F.pow(a, F.lit(3)) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(a, F.lit(5)) / 120)
    y = 10000000 + k0 * (m + n * F.tan(phi) * (F.pow(a, F.lit(2)) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, F.lit(4)) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(a, F.lit(6)) / 720))
    return x, y


def ring_area_m2(ring: Column, zone: int = 23) -> Column:
    """Shoelace area of a closed ring in the zone's plane."""
    flat = F.transform(ring, lambda p: F.struct(_xy(p, zone)[0].alias("x"), _xy(p, zone)[1].alias("y")))
    n = F.size(ring)
    pairs = F.zip_with(F.slice(flat, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(flat, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)) / 2


def polygon_area_km2(polygons: Column, zone: int = 23) -> Column:
    """Area of an array of polygons: outer rings less their holes."""
    one = lambda p: F.aggregate(F.transform(p, lambda r, i: F.when(i == 0, ring_area_m2(r, zone)).otherwise(-ring_area_m2(r, zone))), F.lit(0.0), lambda acc, x: acc + x)
    return F.aggregate(F.transform(polygons, one), F.lit(0.0), lambda acc, x: acc + x) / 1e6
