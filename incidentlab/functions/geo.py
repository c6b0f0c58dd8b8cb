"""Hexagonal cells and ring arithmetic as native Column expressions.

Cells are axial hexagons on the longitude/latitude plane; their ids are
``res:q:r`` and are not those of any published index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

ROOT3 = math.sqrt(3.0)


def cell_size(resolution: int) -> float:
    """Edge length in degrees; each step halves it."""
    return 32.0 / (2 ** resolution)


def cell_axial(lat: Column | str, lon: Column | str, size: float) -> Column:
    """F12. struct(q, r) of the hexagon a point lies in, NULL for a missing coordinate."""
    y, x = col(lat), col(lon)
    q = (F.lit(ROOT3 / 3) * x - y / 3) / F.lit(size)
    r = (F.lit(2.0 / 3) * y) / F.lit(size)
    t = -q - r
    near = lambda v: F.floor(v + 0.5)
    dq, dr, dt = (F.abs(near(v) - v) for v in (q, r, t))
    fix_q = (dq > dr) & (dq > dt)
    fix_r = ~fix_q & (dr > dt)
    return F.when(
        x.isNotNull() & y.isNotNull(),
        F.struct(
            F.when(fix_q, -near(r) - near(t)).otherwise(near(q)).alias("q"),
            F.when(fix_r, -near(q) - near(t)).otherwise(near(r)).alias("r"),
        ),
    )


def cell_index(lat: Column | str, lon: Column | str, resolution: int) -> Column:
    """F12. Text id of the cell, ``<resolution>:<q>:<r>``."""
    axial = cell_axial(lat, lon, cell_size(resolution))
    return F.when(axial.isNotNull(), F.concat_ws(":", F.lit(str(resolution)), axial["q"], axial["r"]))


def cell_boundary(cell: Column | str) -> Column:
    """F13. Closed ring of the cell as an array of [lng, lat]; an unreadable id gives NULL."""
    part = lambda i: F.try_element_at(F.split(col(cell), ":"), F.lit(i)).try_cast("double")
    size = F.lit(32.0) / F.pow(F.lit(2.0), part(1))
    q, r = part(2), part(3)
    cx, cy = size * (ROOT3 * q + ROOT3 / 2 * r), size * 1.5 * r
    corner = lambda k: F.array(
        cx + size * F.cos(F.radians(60.0 * (k % 6) - 30)), cy + size * F.sin(F.radians(60.0 * (k % 6) - 30)))
    return F.when(cx.isNotNull() & cy.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(6)), corner))


def ring_bounds(ring: Column | str) -> dict[str, Column]:
    """Bounding box of a ring of struct(x, y)."""
    r = col(ring)
    return {
        "x_min": F.array_min(F.transform(r, lambda p: p["x"])), "x_max": F.array_max(F.transform(r, lambda p: p["x"])),
        "y_min": F.array_min(F.transform(r, lambda p: p["y"])), "y_max": F.array_max(F.transform(r, lambda p: p["y"])),
    }


def ring_contains(ring: Column | str, x: Column | str, y: Column | str) -> Column:
    """Even-odd test of a point against a closed ring; no Python involved."""
    r, px, py = col(ring), col(x), col(y)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(r, i), F.element_at(r, i + 1)
        spans = (a["y"] > py) != (b["y"] > py)
        at = F.try_divide((b["x"] - a["x"]) * (py - a["y"]), b["y"] - a["y"]) + a["x"]
        return spans & F.coalesce(px < at, F.lit(False))

    edges = F.sequence(F.lit(1), F.size(r) - 1)
    return F.aggregate(edges, F.lit(False), lambda inside, i: F.when(crosses(i), ~inside).otherwise(inside))


def ring_distance(ring: Column | str, x: Column | str, y: Column | str) -> Column:
    """Distance of a point to the nearest edge of a ring, in coordinate units."""
    r, px, py = col(ring), col(x), col(y)

    def to_edge(i: Column) -> Column:
        a, b = F.element_at(r, i), F.element_at(r, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        along = F.coalesce(F.try_divide((px - a["x"]) * dx + (py - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.hypot(a["x"] + s * dx - px, a["y"] + s * dy - py)

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(r) - 1), to_edge))


def shape_contains(rings: Column | str, x: Column | str, y: Column | str) -> Column:
    """Even-odd test against all rings of a shape: parts count, holes do not."""
    return F.aggregate(col(rings), F.lit(False), lambda inside, ring: inside != ring_contains(ring, x, y))


def shape_distance(rings: Column | str, x: Column | str, y: Column | str) -> Column:
    """Distance of a point to the nearest edge of any ring."""
    return F.array_min(F.transform(col(rings), lambda ring: ring_distance(ring, x, y)))


def area_centroid(rings: Column | str) -> Column:
    """Centre of area of a shape whose holes turn the other way than its parts; a shape without area gives its vertex mean."""
    def sums(ring: Column) -> Column:
        def term(i: Column) -> Column:
            a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
            cross = a["x"] * b["y"] - b["x"] * a["y"]
            return F.struct(cross.alias("w"), ((a["x"] + b["x"]) * cross).alias("x"), ((a["y"] + b["y"]) * cross).alias("y"))
        return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), term)

    terms = F.flatten(F.transform(F.filter(col(rings), lambda ring: F.size(ring) > 1), sums))
    total = lambda f: F.aggregate(terms, F.lit(0.0), lambda s, t: s + t[f])
    mean = ring_centroid(F.flatten(col(rings)))
    at = lambda f: F.coalesce(F.try_divide(total(f), 3 * F.nullif(total("w"), F.lit(0.0))), mean[f])
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def ring_centroid(ring: Column | str) -> Column:
    """A28. Plain average of all vertices, the closing one included; (0, 0) for an empty ring."""
    r = col(ring)
    mean = lambda f: F.coalesce(F.try_divide(
        F.aggregate(r, F.lit(0.0), lambda s, p: s + p[f]), F.size(r)), F.lit(0.0))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))
