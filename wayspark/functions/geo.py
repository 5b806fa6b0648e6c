"""Plane geometry as SQL expressions, valid in Spark and other engines alike. Arguments are expressions."""

from __future__ import annotations

R = "6371000e0"


def to_x(lon: str, lon0: str, lat0: str) -> str:
    return f"({R} * cos(radians({lat0})) * radians(({lon}) - ({lon0})))"


def to_y(lat: str, lat0: str) -> str:
    return f"({R} * radians(({lat}) - ({lat0})))"


def to_lon(x: str, lon0: str, lat0: str) -> str:
    """The cosine keeps its sign and is at least 1e-9 in size."""
    c = f"cos(radians({lat0}))"
    return f"(({lon0}) + degrees(({x}) / ({R} * (case when abs({c}) < 1e-9 then (case when {c} < 0 then -1e-9 else 1e-9 end) else {c} end))))"


def to_lat(y: str, lat0: str) -> str:
    return f"(({lat0}) + degrees(({y}) / {R}))"


def dist(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt((({ax})-({bx}))*(({ax})-({bx})) + (({ay})-({by}))*(({ay})-({by})))"


def along(qx: str, qy: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Where on a segment the nearest point to q lies, from 0 to 1; 0 on a segment without length."""
    l2 = f"((({bx})-({ax}))*(({bx})-({ax})) + (({by})-({ay}))*(({by})-({ay})))"
    dot = f"((({qx})-({ax}))*(({bx})-({ax})) + (({qy})-({ay}))*(({by})-({ay})))"
    return f"(case when {l2} < 1e-18 then 0e0 else greatest(0e0, least(1e0, {dot} / {l2})) end)"


def point_segment(qx: str, qy: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = along(qx, qy, ax, ay, bx, by)
    return dist(qx, qy, f"({ax}) + {t} * (({bx})-({ax}))", f"({ay}) + {t} * (({by})-({ay}))")


def segment_segment(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> str:
    """The least of the four end distances; crossing segments are not at distance 0."""
    return f"least({point_segment(a[0], a[1], *b)}, {point_segment(a[2], a[3], *b)}, {point_segment(b[0], b[1], *a)}, {point_segment(b[2], b[3], *a)})"


def overlap(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> str:
    """The length of a that b's projection on it covers."""
    la = dist(*a)
    ux, uy = f"((({a[2]})-({a[0]})) / {la})", f"((({a[3]})-({a[1]})) / {la})"
    p = [f"((({b[i]})-({a[0]})) * {ux} + (({b[i + 1]})-({a[1]})) * {uy})" for i in (0, 2)]
    return f"(case when {la} < 1e-9 then 0e0 else greatest(0e0, least({la}, greatest({p[0]}, {p[1]})) - greatest(0e0, least({p[0]}, {p[1]}))) end)"


def acute_deg(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> str:
    """The acute angle between two chords in degrees; null if one has no length."""
    ax, ay, bx, by = (f"(({s[2 + i]})-({s[i]}))" for s in (a, b) for i in (0, 1))
    turn = f"abs(atan2({ax}*{by} - {ay}*{bx}, {ax}*{bx} + {ay}*{by}))"
    return f"(case when {dist(*a)} < 1e-6 or {dist(*b)} < 1e-6 then null else degrees(least({turn}, pi() - {turn})) end)"


def relaxed_deg(base: str, near: str, max_near: str, lap: str, need: str, ends: str) -> str:
    """The angle allowed to a pair: wider where it is near and overlaps, or its ends are near; 45 at most."""
    return (
        f"least(45e0, greatest({base}, case when {near} <= {max_near} and {lap} >= {need} then {base} + 10e0 else {base} end,"
        f" case when {ends} <= {max_near} * 125e-2 and {lap} >= {need} * 75e-2 then {base} + 18e0 else {base} end))"
    )


def signed_turn(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """The turn at b on the way from a to c in radians; 0 where a leg is under 1e-9."""
    ux, uy, vx, vy = f"(({bx})-({ax}))", f"(({by})-({ay}))", f"(({cx})-({bx}))", f"(({cy})-({by}))"
    return f"(case when {dist(ax, ay, bx, by)} < 1e-9 or {dist(bx, by, cx, cy)} < 1e-9 then 0e0 else atan2({ux}*{vy} - {uy}*{vx}, {ux}*{vx} + {uy}*{vy}) end)"


def cross(ux: str, uy: str, vx: str, vy: str) -> str:
    return f"(({ux})*({vy}) - ({uy})*({vx}))"


def crossing(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> tuple[str, str]:
    """Where on each of two segments their lines cross; null if they are parallel (1e-12)."""
    rx, ry, sx, sy = (f"(({s[2 + i]})-({s[i]}))" for s in (a, b) for i in (0, 1))
    wx, wy = f"(({b[0]})-({a[0]}))", f"(({b[1]})-({a[1]}))"
    d = cross(rx, ry, sx, sy)
    return tuple(f"(case when abs({d}) < 1e-12 then null else {cross(wx, wy, p, q)} / {d} end)" for p, q in ((sx, sy), (rx, ry)))


def wrap_abs(a: str, b: str) -> str:
    """The size of the angle from b to a, wrapped to 0..pi."""
    d = f"((({a})-({b})) + pi())"
    return f"abs({d} - 2e0*pi()*floor({d} / (2e0*pi())) - pi())"


def rotation_penalty(theta: str) -> str:
    """Free to 45 degrees, then a 150th for each degree more."""
    return f"(greatest(0e0, degrees({wrap_abs(theta, '0e0')}) - 45e0) / 150e0)"


def transform_distance(a: tuple[str, ...], b: tuple[str, ...], span_x: str, span_y: str) -> str:
    """Between two (tx, ty, theta, scale): the root of the sum of squares of the parts, each normalised."""
    raw = f"abs(({a[2]})-({b[2]}))"
    turn = f"(least({raw}, 2e0*pi() - {raw}) / pi())"
    size = f"(abs(ln(greatest({a[3]}, 1e-12)) - ln(greatest({b[3]}, 1e-12))) / (ln(8e0) - ln(15e-2)))"
    dx, dy = (f"(abs(({a[i]})-({b[i]})) / greatest(2e0*({s}), 1e0))" for i, s in ((0, span_x), (1, span_y)))
    return f"sqrt({turn}*{turn} + {size}*{size} + {dx}*{dx} + {dy}*{dy})"
