"""Geometry on latitudes and longitudes (degrees), in metres, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
_PER_DEGREE = math.pi / 180


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def project(lat: Column, lon: Column, ref_lat: Column, ref_lon: Column) -> tuple[Column, Column]:
    """Equirectangular x (east) and y (north) about a reference point."""
    return (lon - ref_lon) * (F.cos(F.radians(ref_lat)) * (EARTH_RADIUS_M * _PER_DEGREE)), (lat - ref_lat) * (EARTH_RADIUS_M * _PER_DEGREE)


def segment_projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """(t in [0, 1] along a-b, distance, side: 1 to the left of a-b or on it, else -1) of a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / F.when(square == 0, F.lit(1.0)).otherwise(square))))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    side = F.when(dx * (py - ay) - dy * (px - ax) >= 0, F.lit(1)).otherwise(F.lit(-1))
    return t, F.sqrt(ex * ex + ey * ey), side


def _turned(ring: Column) -> Column:
    """The ring moved on by one: each vertex meets the one before it."""
    return F.concat(F.slice(ring, F.size(ring), F.lit(1)), F.slice(ring, 1, F.size(ring) - 1))


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd ray casting in a ring of struct(lat, lon); false for an empty ring."""

    def crosses(v: Column, u: Column) -> Column:
        spans = (v["lat"] > lat) != (u["lat"] > lat)
        run = F.when(spans, u["lat"] - v["lat"]).otherwise(F.lit(1.0))
        return spans & (lon < (u["lon"] - v["lon"]) * (lat - v["lat"]) / run + v["lon"])

    hits = F.aggregate(F.zip_with(ring, _turned(ring), crosses), F.lit(0), lambda n, hit: n + hit.cast("int"))
    return F.when(F.size(ring) > 0, hits % 2 == 1).otherwise(F.lit(False))


def open_ring(ring: Column) -> Column:
    """Without a closing repetition of the first vertex."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)


def ring_centroid(ring: Column) -> Column:
    """Mean of the vertices: struct(lat, lon)."""
    own = open_ring(ring)
    mean = lambda k: F.aggregate(own, F.lit(0.0), lambda s, v: s + v[k]) / F.size(own)
    return F.when(F.size(own) > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area in square degrees; it ranks rings."""
    terms = F.zip_with(ring, _turned(ring), lambda v, u: u["lon"] * v["lat"] - v["lon"] * u["lat"])
    return F.when(F.size(ring) > 0, F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(F.lit(0.0))


def orientation(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def in_hull(hull: Column, x: Column, y: Column) -> Column:
    """Inside a counter-clockwise hull of struct(x, y), its border included; false under three vertices."""
    before = F.concat(F.slice(hull, F.size(hull), F.lit(1)), F.slice(hull, 1, F.size(hull) - 1))
    left = F.zip_with(before, hull, lambda a, b: orientation(a["x"], a["y"], b["x"], b["y"], x, y) >= 0)
    return F.when(F.size(hull) >= 3, F.forall(left, lambda ok: ok)).otherwise(F.lit(False))


_MASK = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """32-bit product of unsigned 32-bit numbers held as bigint, by halves of 16 bits."""
    high = F.shiftrightunsigned(a, 16) * b
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit(_MASK))


def mulberry32(seed: Column, n: Column) -> Column:
    """The n-th draw (from 0) in [0, 1) of the 32-bit generator: its state is a multiple of a step, so any draw is direct."""
    step, unit = F.lit(0x6D2B79F5).cast("bigint"), F.lit(_MASK).cast("bigint")
    state = (seed.cast("bigint") + _times((n.cast("bigint") + 1).bitwiseAND(unit), step)).bitwiseAND(unit)
    t = _times(state.bitwiseXOR(F.shiftrightunsigned(state, 15)), state.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(unit))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)).bitwiseAND(unit) / F.lit(4294967296.0)
