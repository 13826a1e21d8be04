"""Triangles, boxes, spheres and rays."""

from __future__ import annotations

from .expr import Ex, add, atan2, choose, clamp, col, cross, dot, high, low, mul, norm, sqrt, sub, where

EPSILON = 1e-8


def closest_on_segment(p, a, b):
    e = sub(b, a)
    k = clamp(dot(sub(p, a), e) / dot(e, e), 0, 1)
    return add(a, mul(e, k))


def closest_on_triangle(p, a, b, c):
    """The nearest point of a triangle: the foot on its plane where that lies inside all three edges, else the nearest point
    of the edges; for a degenerate triangle its first corner."""
    n = cross(sub(b, a), sub(c, a))
    size = dot(n, n)
    within = None
    for u, v in ((a, b), (b, c), (c, a)):
        this = dot(cross(sub(v, u), sub(p, u)), n) >= 0
        within = this if within is None else within & this
    foot = sub(p, mul(n, dot(sub(p, a), n) / size))
    best, least = None, None
    for u, v in ((a, b), (b, c), (c, a)):
        at = closest_on_segment(p, u, v)
        d = dot(sub(p, at), sub(p, at))
        best, least = (at, d) if best is None else (choose(d < least, at, best), where(d < least, d, least))
    return choose(size <= 0, a, choose(within, foot, best))


def solid_angle(p, a, b, c):
    """Signed solid angle of a triangle seen from p; the sum over a closed outward mesh is 4 pi inside and 0 outside."""
    x, y, z = sub(a, p), sub(b, p), sub(c, p)
    l, m, n = norm(x), norm(y), norm(z)
    return 2 * atan2(dot(x, cross(y, z)), l * m * n + dot(x, y) * n + dot(y, z) * l + dot(z, x) * m)


def ray_box(o, d, low_, high_) -> tuple[Ex, Ex]:
    """Entry and exit of a ray and a box; missed where entry > exit or exit < 0. A direction of zero has NULL slabs, which
    least and greatest pass over."""
    first, last = [], []
    for oc, dc, lc, hc in zip(o, d, low_, high_, strict=True):
        s, t = (lc - oc) / dc, (hc - oc) / dc
        first.append(low(s, t))
        last.append(high(s, t))
    return high(high(*first[:2]), first[2]), low(low(*last[:2]), last[2])


def ray_sphere(o, d, center, r):
    """First crossing in front of the origin with a sphere; NULL for none."""
    m = sub(o, center)
    b, c = dot(m, d), dot(m, m) - r * r
    root = b * b - c
    near, far = -b - sqrt(root), -b + sqrt(root)
    return where(root < 0, Ex("CAST(NULL AS DOUBLE)"), where(near > 0, near, where(far > 0, far, Ex("CAST(NULL AS DOUBLE)"))))


def ray_triangle(o, d, a, b, c) -> dict:
    """t, u, v of the crossing by Cramer's rule, NULL for none in front or a ray in the plane."""
    e, f = sub(b, a), sub(c, a)
    h = cross(d, f)
    det = dot(e, h)
    s = sub(o, a)
    u = dot(s, h) / det
    q = cross(s, e)
    v, t = dot(d, q) / det, dot(f, q) / det
    big = (det > EPSILON) | (det < -EPSILON)
    hit = big & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > EPSILON)
    return {"t": where(hit, t, Ex("CAST(NULL AS DOUBLE)")), "u": u, "v": v}


def corners() -> tuple:
    """Columns of the triangle table."""
    return tuple(tuple(col(n) for n in names) for names in (("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")))


def fibonacci(i, n):
    """Point i of n on the unit sphere, as a lattice on the golden angle."""
    from .expr import PI, cos, floor, sin

    turn = i * 0.6180339887498949
    z = 1 - 2 * (i + 0.5) / n
    ring, theta = sqrt(1 - z * z), 2 * PI * (turn - floor(turn))
    return ring * cos(theta), ring * sin(theta), z


