"""Polygon centroids as array expressions, without exploding a polygon.

A ring is an array of [longitude, latitude] arrays. Malformed points are dropped, open rings closed; only outer rings count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT = 1e-12


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_ring(ring: Column) -> Column:
    """Well-formed points only; closed if it has two or more."""
    pts = F.filter(ring, lambda p: p.isNotNull() & (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    pts = F.transform(pts, lambda p: F.slice(p, 1, 2))
    is_open = lambda p: (F.size(p) >= 2) & (F.get(p, F.lit(0)) != F.element_at(p, -1))
    return let(pts, lambda p: F.when(is_open(p), F.concat(p, F.slice(p, 1, 1))).otherwise(p))


def outer_rings(kind: Column, polygon: Column, multi: Column) -> Column:
    """The cleaned outer rings of a Polygon or MultiPolygon with at least four points each."""
    none = F.array().cast("array<array<array<double>>>")
    rings = F.when(kind == "Polygon", F.slice(polygon, 1, 1)).when(kind == "MultiPolygon", F.transform(multi, lambda p: F.get(p, F.lit(0))))
    return F.filter(F.transform(F.coalesce(rings, none), clean_ring), lambda r: F.size(r) >= 4)


def ring_centroid(ring: Column) -> Column:
    """struct(lon, lat, weight) of a closed ring: shoelace centroid weighted by area; a flat ring has its mean corner, weight 0."""
    return let(ring, _shoelace)


def _shoelace(ring: Column) -> Column:
    n = F.size(ring)
    x, y = (lambda i: F.get(F.get(ring, i), F.lit(0))), (lambda i: F.get(F.get(ring, i), F.lit(1)))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

    def step(acc: Column, i: Column) -> Column:
        cross = x(i) * y(i + 1) - x(i + 1) * y(i)
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["cx"] + (x(i) + x(i + 1)) * cross).alias("cx"),
            (acc["cy"] + (y(i) + y(i + 1)) * cross).alias("cy"),
            (acc["sx"] + x(i)).alias("sx"),
            (acc["sy"] + y(i)).alias("sy"),
        )

    def finish(s: Column) -> Column:
        flat = F.abs(s["a"]) < FLAT
        corners = n - 1
        return F.struct(
            F.when(flat, s["sx"] / corners).otherwise(s["cx"] / (3 * s["a"])).alias("lon"),
            F.when(flat, s["sy"] / corners).otherwise(s["cy"] / (3 * s["a"])).alias("lat"),
            F.when(flat, F.lit(0.0)).otherwise(F.abs(s["a"]) / 2).alias("weight"),
        )

    return F.when(n >= 2, F.aggregate(F.sequence(F.lit(0), n - 2), zero, step, finish))


def geometry_centroid(kind: Column, polygon: Column, multi: Column) -> Column:
    """struct(lon, lat): the area-weighted mean over the outer rings, of flat rings their plain mean; null without rings."""
    return let(F.transform(outer_rings(kind, polygon, multi), ring_centroid), _weighted)


def _weighted(cs: Column) -> Column:
    def total(items: Column, pick) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda acc, c: acc + pick(c))

    weight, n = total(cs, lambda c: c["weight"]), F.size(cs)
    mean = lambda f: F.when(weight > 0, total(cs, lambda c: c[f] * c["weight"]) / weight).otherwise(total(cs, lambda c: c[f]) / n)
    return F.when(n > 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat")))
