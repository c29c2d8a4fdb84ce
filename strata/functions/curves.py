"""Rounded corners and smooth curves through polylines, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import length, point, segments


def corners(points: Column, radius: float) -> Column:
    """array<struct<corner, trim, turn>> of the inner points: what rounding cuts off either side, and the turn.

    A trim is radius * tan(turn / 2), and at most half of each neighbouring segment.  ``points`` without repeats.
    """
    s = segments(points)

    def corner(a: Column, i: Column) -> Column:
        b = F.get(s, i + 1)
        ux, uy, vx, vy = a["b"]["x"] - a["a"]["x"], a["b"]["y"] - a["a"]["y"], b["b"]["x"] - b["a"]["x"], b["b"]["y"] - b["a"]["y"]
        turn = F.abs(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy))
        # A reversal has no arc: its trim would be endless, the halves of the segments bound it.
        trim = F.least(F.when(turn < math.pi - 1e-9, radius * F.tan(turn / 2)).otherwise(F.lit(float("inf"))), length(a) / 2, length(b) / 2)
        return F.struct(a["b"].alias("corner"), trim.alias("trim"), turn.alias("turn"))

    return F.transform(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), corner)


def rounded_length(points: Column, radius: float) -> Column:
    """Length of a polyline with rounded corners."""
    plain = F.aggregate(segments(points), F.lit(0.0), lambda t, s: t + length(s))
    arc = lambda c: F.when((c["turn"] > 1e-9) & (c["turn"] < math.pi - 1e-9), c["trim"] / F.tan(c["turn"] / 2) * c["turn"] - 2 * c["trim"]).otherwise(0.0)
    return plain + F.aggregate(corners(points, radius), F.lit(0.0), lambda t, c: t + arc(c))


def catmull_rom(points: Column) -> Column:
    """array<struct<a, c1, c2, b>>: cubic Bezier pieces of the centripetal Catmull-Rom curve; ends count twice."""
    n = F.size(points)

    def piece(s: Column, i: Column) -> Column:
        p1, p2 = s["a"], s["b"]
        p0, p3 = F.get(points, F.greatest(i - 1, F.lit(0))), F.get(points, F.least(i + 2, n - 1))
        gap = lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
        e1, e2, e3 = gap(p0, p1), gap(p1, p2), gap(p2, p3)  # squares of the knot distances
        d1, d2, d3 = F.sqrt(e1), F.sqrt(e2), F.sqrt(e3)

        def control(near: Column, other: Column, outer: Column, e: Column, d: Column) -> Column:
            at = lambda k: F.when(d > 0, (e * other[k] - e2 * outer[k] + (2 * e + 3 * d * d2 + e2) * near[k]) / (3 * d * (d + d2))).otherwise(near[k])
            return point(at("x"), at("y"))

        return F.struct(p1.alias("a"), control(p1, p2, p0, e1, d1).alias("c1"), control(p2, p1, p3, e3, d3).alias("c2"), p2.alias("b"))

    return F.transform(segments(points), piece)


def s_curve(points: Column) -> Column:
    """struct<a, c1, c2, b>: one cubic from the first point to the last, pulled towards the two between."""
    names = ("a", "c1", "c2", "b")
    return F.struct(*[F.element_at(points, i).alias(n) for i, n in zip((1, 2, -2, -1), names, strict=True)])


def _between(a: Column, b: Column, t: Column) -> Column:
    return point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)


def split_cubic(c: Column, t: Column) -> Column:
    """struct<before, after>: both parts of a cubic cut at the parameter ``t``, by repeated interpolation."""
    p, q, r = _between(c["a"], c["c1"], t), _between(c["c1"], c["c2"], t), _between(c["c2"], c["b"], t)
    u, v = _between(p, q, t), _between(q, r, t)
    cut = _between(u, v, t)
    piece = lambda *ps: F.struct(*[x.alias(n) for x, n in zip(ps, ("a", "c1", "c2", "b"), strict=True)])
    return F.struct(piece(c["a"], p, u, cut).alias("before"), piece(cut, v, r, c["b"]).alias("after"))


def chords(a: Column, c1: Column, c2: Column, b: Column, tolerance: float = 0.5) -> Column:
    """Into how many chords a cubic is cut so that they stay within ``tolerance`` of it: the second differences bound the error."""
    bow = lambda p, q, r: F.sqrt((p["x"] - 2 * q["x"] + r["x"]) * (p["x"] - 2 * q["x"] + r["x"]) + (p["y"] - 2 * q["y"] + r["y"]) * (p["y"] - 2 * q["y"] + r["y"]))
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.greatest(bow(a, c1, c2), bow(c1, c2, b)) * 0.75 / tolerance)).cast("int"))


def cubic_at(a: Column, c1: Column, c2: Column, b: Column, t: Column) -> Column:
    """A coordinate of a cubic at the parameter ``t``, from those of its control points."""
    s = 1 - t
    return a * s * s * s + 3 * c1 * s * s * t + 3 * c2 * s * t * t + b * t * t * t


def flattened(c: Column, tolerance: float = 0.5) -> Column:
    """Points on a cubic whose chords stay within ``tolerance`` of it.  Tables of many curves take ``flat_curves``: rows
    are computed by compiled code, a lambda's points are not."""
    n = chords(c["a"], c["c1"], c["c2"], c["b"], tolerance)
    on = lambda k, i: cubic_at(c["a"][k], c["c1"][k], c["c2"][k], c["b"][k], i / n)
    return F.transform(F.sequence(F.lit(0), n), lambda i: point(on("x", i), on("y", i)))


_CONTROLS = [f"{p}{k}" for p in ("a", "c1", "c2", "b") for k in "xy"]


def flat_curves(curves: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Every row of ``curves`` (c: its cubic) with the numbers of its control points (ax, ay ... by) for c, and the number
    ``n`` of its chords."""
    c, keep = F.col("c"), [x for x in curves.columns if x != "c"]
    n = chords(c["a"], c["c1"], c["c2"], c["b"], tolerance)
    return curves.select(*keep, *[c[x[:-1]][x[-1]].alias(x) for x in _CONTROLS], n.alias("n"))


def on_curve(i: Column | str, k: str) -> Column:
    """x or y of the i-th point of a curve of ``flat_curves``."""
    return cubic_at(*[F.col(p + k) for p in ("a", "c1", "c2", "b")], (F.col(i) if isinstance(i, str) else i) / F.col("n"))


def flat_points(curves: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """The points of ``flattened`` as rows: k, x and y instead of c."""
    keep = [x for x in curves.columns if x != "c"]
    rows = flat_curves(curves, tolerance).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    return rows.select(*keep, "k", on_curve("k", "x").alias("x"), on_curve("k", "y").alias("y"))


def curve_pieces(flat: DataFrame, most: int = 16) -> DataFrame:
    """Curves of ``flat_curves`` in pieces of ``most`` chords: the first chord (low), the one behind the last (high), and a
    box (x1, x2, y1, y2) that holds the piece, for it holds the control points of the piece as a cubic of its own."""
    rows = flat.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(most))).alias("low"))
    rows = rows.withColumn("high", F.least(F.col("low") + most, F.col("n")))

    def way(k: str, t: Column) -> Column:
        a, c1, c2, b = (F.col(p + k) for p in ("a", "c1", "c2", "b"))
        return ((c1 - a) * (1 - t) * (1 - t) + 2 * (c2 - c1) * (1 - t) * t + (b - c2) * t * t) * (F.col("high") - F.col("low")) / F.col("n")

    # As generated rows: a filter over a projection's columns would repeat their expressions in its own.
    hull = [x for k in "xy" for e, at, sign in (("p", "low", 1), ("q", "high", -1)) for x in (on_curve(at, k).alias(f"{e}{k}"), (on_curve(at, k) + sign * way(k, F.col(at) / F.col("n"))).alias(f"{e}c{k}"))]
    rows = rows.select("*", F.inline(F.array(F.struct(*hull))))
    sides = []
    for k in "xy":
        four = [F.col(f"{e}{k}") for e in ("p", "pc", "qc", "q")]
        slack = 1e-6 + 1e-9 * F.greatest(*[F.abs(x) for x in four])  # rounding alone
        sides += [(F.least(*four) - slack).alias(f"{k}1"), (F.greatest(*four) + slack).alias(f"{k}2")]
    return rows.select(*flat.columns, "low", "high", F.inline(F.array(F.struct(*sides))))


def spline_pieces(points: Column) -> Column:
    """array<struct<a, c1, c2, b>>: the cubics of the uniform cubic B-spline that starts and ends in its outer points.

    ``points`` are four or more.  Knots are 0, 0, 0, 0, 1, 2, ..., m, m, m, m for m pieces; a control point of piece i is
    the value of its polar form at three of the knots i and i + 1.
    """
    m = F.size(points) - 3

    def piece(i: Column) -> Column:
        knot = lambda k: F.greatest(F.lit(0), F.least(i + k, m)).cast("double")

        def polar(*at: Column) -> Column:
            def step(level: Column, u: Column) -> Column:
                low = lambda j: knot(j + 2 - F.size(level))
                return F.transform(F.slice(level, F.lit(1), F.size(level) - 1), lambda p, j: _between(p, F.get(level, j + 1), (u - low(j)) / (knot(j + 1) - low(j))))

            return F.aggregate(F.array(*at), F.slice(points, i + 1, F.lit(4)), step, lambda level: F.get(level, F.lit(0)))

        lo, hi = i.cast("double"), (i + 1).cast("double")
        return F.struct(polar(lo, lo, lo).alias("a"), polar(lo, lo, hi).alias("c1"), polar(lo, hi, hi).alias("c2"), polar(hi, hi, hi).alias("b"))

    return F.transform(F.sequence(F.lit(0), m - 1), piece)
