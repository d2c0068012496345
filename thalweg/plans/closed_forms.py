"""Distances and ranges of segments as SQL text, for the SQL beside the queries; the engine has its own in numpy.

Over the columns (x1, y1, x2, y2) of a segment table each function gives named steps, one after another.
"""

from __future__ import annotations


def point_segment(px, py, ax, ay, bx, by) -> str:
    """Squared distance of a point and a segment."""
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    n = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(case when {n} = 0 then 0 else greatest(0, least(1, (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / {n})) end)"
    ex, ey = f"({px} - {ax} - {t} * {dx})", f"({py} - {ay} - {t} * {dy})"
    return f"({ex} * {ex} + {ey} * {ey})"


def turn(ax, ay, bx, by, px, py) -> str:
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def segment_distance(a: str = "", b: str = "o_") -> list[tuple[str, str]]:
    """``gap2``: squared distance of two segments, ``near_x, near_y``: a place on the first where it is met, with the steps before them."""
    p, q, r, s = ((f"{a}x1", f"{a}y1"), (f"{a}x2", f"{a}y2"), (f"{b}x1", f"{b}y1"), (f"{b}x2", f"{b}y2"))
    steps = []
    for k, (v, (m, n)) in enumerate(((p, (r, s)), (q, (r, s)), (r, (p, q)), (s, (p, q)))):
        steps += [
            (f"g_x{k}", f"{n[0]} - {m[0]}"), (f"g_y{k}", f"{n[1]} - {m[1]}"), (f"g_n{k}", f"g_x{k} * g_x{k} + g_y{k} * g_y{k}"),
            (f"g_t{k}", f"case when g_n{k} = 0 then 0 else greatest(0, least(1, (({v[0]} - {m[0]}) * g_x{k} + ({v[1]} - {m[1]}) * g_y{k}) / g_n{k})) end"),
            (f"g_u{k}", f"{v[0]} - {m[0]} - g_t{k} * g_x{k}"), (f"g_v{k}", f"{v[1]} - {m[1]} - g_t{k} * g_y{k}"), (f"g_d{k}", f"g_u{k} * g_u{k} + g_v{k} * g_v{k}"),
        ]
    cross = f"({turn(*p, *q, *r)} * {turn(*p, *q, *s)} < 0 and {turn(*r, *s, *p)} * {turn(*r, *s, *q)} < 0)"
    (x1, y1), (x2, y2), (u1, v1), (u2, v2) = p, q, r, s
    steps += [("gap2", f"case when {cross} then 0 else least(g_d0, g_d1, g_d2, g_d3) end")]
    steps += [("g_c", f"case when {cross} then (({u1} - {x1}) * ({v2} - {v1}) - ({v1} - {y1}) * ({u2} - {u1})) / (g_x2 * ({v2} - {v1}) - g_y2 * ({u2} - {u1})) when g_d0 = gap2 then 0 when g_d1 = gap2 then 1 when g_d2 = gap2 then g_t2 else g_t3 end")]
    return [*steps, ("near_x", f"{x1} + g_c * g_x2"), ("near_y", f"{y1} + g_c * g_y2")]


def capsule_interval(radius: float, a: str = "", b: str = "o_") -> list[tuple[str, str]]:
    """``lo, hi``: the part of segment a, as a range of its parameter in [0, 1], within ``radius`` of segment b; null if none.  Two
    discs and a slab each give a range; the capsule is convex, so their hull is the answer."""
    r2 = f"cast({radius * radius!r} as double)"
    r = f"cast({radius!r} as double)"
    x1, y1, x2, y2 = (f"{a}{c}" for c in ("x1", "y1", "x2", "y2"))
    u1, v1, u2, v2 = (f"{b}{c}" for c in ("x1", "y1", "x2", "y2"))
    steps = [("dx", f"{x2} - {x1}"), ("dy", f"{y2} - {y1}"), ("qa", "dx * dx + dy * dy"), ("ex", f"{u2} - {u1}"), ("ey", f"{v2} - {v1}"), ("en", "ex * ex + ey * ey")]
    for k, (px, py) in enumerate(((u1, v1), (u2, v2))):
        steps += [
            (f"qb{k}", f"dx * ({x1} - {px}) + dy * ({y1} - {py})"),
            (f"qc{k}", f"({x1} - {px}) * ({x1} - {px}) + ({y1} - {py}) * ({y1} - {py}) - {r2}"),
            (f"qd{k}", f"qb{k} * qb{k} - qa * qc{k}"),
            (f"dl{k}", f"case when qa > 0 and qd{k} >= 0 then (-qb{k} - sqrt(greatest(qd{k}, 0))) / qa when qa = 0 and qc{k} <= 0 then 0 end"),
            (f"dh{k}", f"case when qa > 0 and qd{k} >= 0 then (-qb{k} + sqrt(greatest(qd{k}, 0))) / qa when qa = 0 and qc{k} <= 0 then 1 end"),
        ]
    # along: c0 + c1 t between 0 and en; across: p0 + p1 t between -r |e| and r |e|
    steps += [
        ("c0", f"({x1} - {u1}) * ex + ({y1} - {v1}) * ey"), ("c1", "dx * ex + dy * ey"),
        ("p0", f"({y1} - {v1}) * ex - ({x1} - {u1}) * ey"), ("p1", "dy * ex - dx * ey"), ("pw", f"{r} * sqrt(en)"),
        ("al", "case when c1 > 0 then -c0 / c1 when c1 < 0 then (en - c0) / c1 when c0 >= 0 and c0 <= en then -1e300 else 1e300 end"),
        ("ah", "case when c1 > 0 then (en - c0) / c1 when c1 < 0 then -c0 / c1 when c0 >= 0 and c0 <= en then 1e300 else -1e300 end"),
        ("pl", "case when p1 > 0 then (-pw - p0) / p1 when p1 < 0 then (pw - p0) / p1 when abs(p0) <= pw then -1e300 else 1e300 end"),
        ("ph", "case when p1 > 0 then (pw - p0) / p1 when p1 < 0 then (-pw - p0) / p1 when abs(p0) <= pw then 1e300 else -1e300 end"),
        ("sl", "case when en > 0 and greatest(al, pl) <= least(ah, ph) then greatest(al, pl) end"),
        ("sh", "case when en > 0 and greatest(al, pl) <= least(ah, ph) then least(ah, ph) end"),
        ("lo0", "least(coalesce(dl0, 1e301), coalesce(dl1, 1e301), coalesce(sl, 1e301))"),
        ("hi0", "greatest(coalesce(dh0, -1e301), coalesce(dh1, -1e301), coalesce(sh, -1e301))"),
        ("lo", "case when hi0 >= 0 and lo0 <= 1 and lo0 <= hi0 then greatest(lo0, 0) end"),
        ("hi", "case when hi0 >= 0 and lo0 <= 1 and lo0 <= hi0 then least(hi0, 1) end"),
    ]
    return steps
