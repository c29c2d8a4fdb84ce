"""Column expressions for rectangles, segments and polylines; everything stays in generated code or HOFs.

A rectangle is a struct or table row with x, y, width, height; a point is struct<x, y>; a polyline an array of points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def center(r: Column) -> Column:
    return point(r["x"] + r["width"] / 2, r["y"] + r["height"] / 2)


def overlaps(a: Column, b: Column, gap: float = 0.0) -> Column:
    """Open overlap of two rectangles of positive area, with a gap around them."""
    area = (a["width"] > 0) & (a["height"] > 0) & (b["width"] > 0) & (b["height"] > 0)
    return area & (a["x"] < b["x"] + b["width"] + gap) & (b["x"] < a["x"] + a["width"] + gap) & (a["y"] < b["y"] + b["height"] + gap) & (b["y"] < a["y"] + a["height"] + gap)


def border(a: Column, b: Column) -> Column:
    """Where the ray from a's centre to b's centre leaves a; coincident centres: the middle of a's right side."""
    ca, cb = center(a), center(b)
    dx, dy = cb["x"] - ca["x"], cb["y"] - ca["y"]
    scale = F.least(F.when(dx != 0, a["width"] / 2 / F.abs(dx)), F.when(dy != 0, a["height"] / 2 / F.abs(dy)))
    same = (dx == 0) & (dy == 0)
    return point(F.when(same, a["x"] + a["width"]).otherwise(ca["x"] + dx * scale), F.when(same, ca["y"]).otherwise(ca["y"] + dy * scale))


def segments(points: Column) -> Column:
    """array<struct<a, b>> of consecutive points."""
    n = F.size(points) - 1
    return F.zip_with(F.slice(points, 1, F.greatest(n, F.lit(0))), F.slice(points, 2, F.greatest(n, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(s: Column) -> Column:
    return F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2))


def path_length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda t, s: t + length(s))


def manhattan_length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda t, s: t + F.abs(s["b"]["x"] - s["a"]["x"]) + F.abs(s["b"]["y"] - s["a"]["y"]))


def point_at(points: Column, distance: Column) -> Column:
    """The point at an arc length, clamped to the ends."""
    first = F.struct(F.element_at(points, 1).alias("p"), F.greatest(distance, F.lit(0.0)).alias("left"))

    def walk(state: Column, s: Column) -> Column:
        n = length(s)
        t = F.when(n > 0, F.least(F.lit(1.0), state["left"] / n)).otherwise(F.lit(0.0))
        p = point(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * t, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * t)
        return F.when(state["left"] > 0, F.struct(p.alias("p"), F.greatest(F.lit(0.0), state["left"] - n).alias("left"))).otherwise(state)

    return F.aggregate(segments(points), first, walk, lambda s: s["p"])


def direction_at(points: Column, distance: Column) -> Column:
    """The unit direction of the segment that an arc length falls in, clamped to the ends; (0, 0) for a path without length."""
    first = F.struct(point(F.lit(0.0), F.lit(0.0)).alias("way"), F.lit(0.0).alias("far"))

    def walk(state: Column, s: Column) -> Column:
        n = length(s)
        here = (n > 0) & ((state["far"] == 0) | (state["far"] < distance))
        way = point((s["b"]["x"] - s["a"]["x"]) / n, (s["b"]["y"] - s["a"]["y"]) / n)
        return F.struct(F.when(here, way).otherwise(state["way"]).alias("way"), (state["far"] + n).alias("far"))

    return F.aggregate(segments(points), first, walk, lambda s: s["way"])


def trimmed(points: Column, start: Column, end: Column) -> Column:
    """The part of a path from ``start`` along it to ``end`` before its end; one point where nothing is left."""
    n = path_length(points)
    a, b = F.least(start, n), F.greatest(F.least(start, n), n - end)
    first = F.struct(F.lit(0.0).alias("far"), F.array().cast("array<struct<x:double,y:double>>").alias("kept"))

    def walk(state: Column, s: Column) -> Column:
        far = state["far"] + length(s)
        return F.struct(far.alias("far"), F.when((far > a) & (far < b), F.concat(state["kept"], F.array(s["b"]))).otherwise(state["kept"]).alias("kept"))

    inside = F.aggregate(segments(points), first, walk, lambda s: s["kept"])
    ends = F.when(b > a, F.array(point_at(points, b))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    return F.concat(F.array(point_at(points, a)), inside, ends)


def split(points: Column, at: Column) -> Column:
    """struct<before, after>: both parts of a path that is cut ``at`` so far along it."""
    n = path_length(points)
    return F.struct(trimmed(points, F.lit(0.0), n - at).alias("before"), trimmed(points, at, F.lit(0.0)).alias("after"))


def midpoint(points: Column) -> Column:
    return point_at(points, path_length(points) / 2)


def bends(points: Column) -> Column:
    """Changes of (signed) direction between consecutive segments that have a length."""
    real = F.filter(segments(points), lambda s: length(s) > EPS)
    way = F.transform(real, lambda s: F.struct(F.signum(F.when(F.abs(s["b"]["x"] - s["a"]["x"]) > EPS, s["b"]["x"] - s["a"]["x"]).otherwise(0.0)).alias("x"), F.signum(F.when(F.abs(s["b"]["y"] - s["a"]["y"]) > EPS, s["b"]["y"] - s["a"]["y"]).otherwise(0.0)).alias("y")))
    return F.size(F.filter(F.transform(way, lambda w, i: (i > 0) & (w != F.get(way, i - 1))), lambda x: x))


def diagonals(points: Column) -> Column:
    """Segments that are neither horizontal nor vertical."""
    return F.size(F.filter(segments(points), lambda s: (F.abs(s["b"]["x"] - s["a"]["x"]) > EPS) & (F.abs(s["b"]["y"] - s["a"]["y"]) > EPS)))


def number_text(x: Column, digits: int = 6) -> Column:
    """A number with up to ``digits`` decimals and no trailing zeros."""
    t = F.regexp_replace(F.round(x, digits).cast(f"decimal(30,{digits})").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\.$", ""), "^-0$", "0")


def svg_path(points: Column) -> Column:
    at = lambda p: F.concat(number_text(p["x"]), F.lit(" "), number_text(p["y"]))
    return F.array_join(F.transform(points, lambda p, i: F.concat(F.when(i == 0, "M ").otherwise("L "), at(p))), " ")


def section(name: Column, points: Column) -> Column:
    """A route of one piece: struct<id, startPoint, bendPoints, endPoint>; ``to_json`` makes an authored section of it."""
    bends = F.slice(points, 2, F.greatest(F.size(points) - 2, F.lit(0)))
    return F.struct(F.concat(name, F.lit("_s0")).alias("id"), F.element_at(points, 1).alias("startPoint"), bends.alias("bendPoints"), F.element_at(points, -1).alias("endPoint"))


def simplify(points: Column) -> Column:
    """Without repeated points and without middle points of straight, forward runs."""

    def add(kept: Column, p: Column) -> Column:
        last, before = F.try_element_at(kept, F.lit(-1)), F.try_element_at(kept, F.lit(-2))
        same = (F.abs(last["x"] - p["x"]) <= EPS) & (F.abs(last["y"] - p["y"]) <= EPS)
        ux, uy, vx, vy = last["x"] - before["x"], last["y"] - before["y"], p["x"] - last["x"], p["y"] - last["y"]
        straight = (F.abs(ux * vy - uy * vx) <= EPS) & (ux * vx + uy * vy > 0)
        return F.when(F.coalesce(same, F.lit(False)), kept).when(F.coalesce(straight, F.lit(False)), F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(p))).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(points, F.array().cast("array<struct<x:double,y:double>>"), add)


def snap(x: Column) -> Column:
    """To the nearest 64th."""
    return F.floor(x * 64 + 0.5) / 64


def parse_padding(text: Column) -> Column:
    """'[top=1,left=2,...]' or one number -> struct<top, right, bottom, left>; what is missing is 0."""
    side = lambda k: F.coalesce(F.when(text.rlike(r"^\s*-?[0-9.]+\s*$"), text.cast("double")).otherwise(F.nullif(F.regexp_extract(text, rf"{k}\s*=\s*(-?[0-9.]+)", 1), F.lit("")).cast("double")), F.lit(0.0)).alias(k)
    return F.struct(*map(side, ("top", "right", "bottom", "left")))
