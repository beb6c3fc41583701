"""Plane geometry as column expressions. Lengths that differ by less than NEAR are equal."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 1e-6


def near(a: Column, b: Column | float = 0.0) -> Column:
    return F.abs(a - b) < NEAR


def length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def three_quarter_plane(x1, y1, x2, y2, x3, y3) -> Column:
    """Twice the signed area of a triangle."""
    return (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)


def triangle_area(*corners: Column) -> Column:
    return F.abs(three_quarter_plane(*corners)) / 2


def sides(x1, y1, x2, y2, x3, y3) -> list[Column]:
    return [length(x2 - x3, y2 - y3), length(x1 - x3, y1 - y3), length(x1 - x2, y1 - y2)]


def triangle_kind(*corners: Column) -> Column:
    """flat, equilateral, right isosceles, isosceles, right or scalene."""
    a, b, c = sides(*corners)
    two = near(a, b) | near(b, c) | near(a, c)
    right = F.exists(F.array(a * a + b * b - c * c, b * b + c * c - a * a, a * a + c * c - b * b), lambda v: near(v))
    return (
        F.when(near(triangle_area(*corners)), "flat")
        .when(near(a, b) & near(b, c), "equilateral")
        .when(two & right, "right isosceles")
        .when(two, "isosceles")
        .when(right, "right")
        .otherwise("scalene")
    )


def circumcircle(x1, y1, x2, y2, x3, y3) -> Column:
    """(x, y, r); null for a flat triangle."""
    d = 2 * (x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2))
    x = ((x1 * x1 + y1 * y1) * (y2 - y3) + (x2 * x2 + y2 * y2) * (y3 - y1) + (x3 * x3 + y3 * y3) * (y1 - y2)) / d
    y = ((x1 * x1 + y1 * y1) * (x3 - x2) + (x2 * x2 + y2 * y2) * (x1 - x3) + (x3 * x3 + y3 * y3) * (x2 - x1)) / d
    return F.when(~near(d), F.struct(x.alias("x"), y.alias("y"), length(x - x1, y - y1).alias("r")))


def polygon_area(xs: Column, ys: Column) -> Column:
    """Of the polygon with these corners in order."""
    n = F.size(xs)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(xs, k) * F.get(ys, (k + 1) % n) - F.get(xs, (k + 1) % n) * F.get(ys, k))
    return F.when(n > 2, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2).otherwise(0.0)


def circle_points(x, y, r, x2, y2, r2) -> Column:
    """Where two circles meet: an array of (x, y), empty if they don't, one point if they touch; null for equal circles."""
    dx, dy = x2 - x, y2 - y
    d = length(dx, dy)
    a = (r * r - r2 * r2 + d * d) / (2 * d)
    h = F.sqrt(F.greatest(r * r - a * a, F.lit(0.0)))
    at = lambda s: F.struct((x + (dx * a - s * dy * h) / d).alias("x"), (y + (dy * a + s * dx * h) / d).alias("y"))
    same = near(dx) & near(dy) & near(r, r2)
    apart = (d > r + r2 + NEAR) | (d < F.abs(r - r2) - NEAR)
    touch = near(d, r + r2) | near(d, F.abs(r - r2))
    return F.when(same, F.lit(None)).when(apart | near(d), F.array().cast("array<struct<x: double, y: double>>")).when(touch, F.array(at(0.0))).otherwise(F.array(at(1.0), at(-1.0)))


def circle_overlap(x, y, r, x2, y2, r2) -> Column:
    """The common area of two circles as a share of the smaller one."""
    d, small = length(x2 - x, y2 - y), F.least(r, r2)
    clip = lambda c: F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))
    one = F.acos(clip((d * d + r * r - r2 * r2) / (2 * d * r)))
    two = F.acos(clip((d * d + r2 * r2 - r * r) / (2 * d * r2)))
    area = r * r * (one - F.sin(2 * one) / 2) + r2 * r2 * (two - F.sin(2 * two) / 2)
    return F.when(d >= r + r2, 0.0).when(d <= F.abs(r - r2), 1.0).otherwise(area / (math.pi * small * small))


def line_meets_line(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """(x, y) where the lines through two pairs of points meet; null if they are parallel."""
    d = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    p, q = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    return F.when(~near(d), F.struct(((p * (x3 - x4) - (x1 - x2) * q) / d).alias("x"), ((p * (y3 - y4) - (y1 - y2) * q) / d).alias("y")))


def circle_meets_line(x, y, r, x1, y1, x2, y2) -> Column:
    """Where a circle and the line through two points meet: no, one or two points."""
    ux, uy = (x2 - x1) / length(x2 - x1, y2 - y1), (y2 - y1) / length(x2 - x1, y2 - y1)
    t = (x - x1) * ux + (y - y1) * uy
    fx, fy = x1 + t * ux, y1 + t * uy
    d = length(fx - x, fy - y)
    h = F.sqrt(F.greatest(r * r - d * d, F.lit(0.0)))
    at = lambda s: F.struct((fx + s * ux * h).alias("x"), (fy + s * uy * h).alias("y"))
    return F.when(near(d, r), F.array(at(0.0))).when(d > r, F.array().cast("array<struct<x: double, y: double>>")).otherwise(F.array(at(1.0), at(-1.0)))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def midpoint(x1, y1, x2, y2) -> Column:
    return _point((x1 + x2) / 2, (y1 + y2) / 2)


def centroid(x1, y1, x2, y2, x3, y3) -> Column:
    return _point((x1 + x2 + x3) / 3, (y1 + y2 + y3) / 3)


def orthocentre(x1, y1, x2, y2, x3, y3) -> Column:
    """Where the heights meet; null for a flat triangle."""
    c = circumcircle(x1, y1, x2, y2, x3, y3)
    return F.when(c.isNotNull(), _point(x1 + x2 + x3 - 2 * c["x"], y1 + y2 + y3 - 2 * c["y"]))


def incircle(x1, y1, x2, y2, x3, y3) -> Column:
    """(x, y, r) of the circle that touches all sides from within; null for a flat triangle."""
    a, b, c = sides(x1, y1, x2, y2, x3, y3)
    area = triangle_area(x1, y1, x2, y2, x3, y3)
    around = a + b + c
    return F.when(~near(area), F.struct(((a * x1 + b * x2 + c * x3) / around).alias("x"), ((a * y1 + b * y2 + c * y3) / around).alias("y"), (2 * area / around).alias("r")))


def excircles(x1, y1, x2, y2, x3, y3) -> Column:
    """The three (x, y, r) that touch one side from outside and the other two where they go on, opposite to each corner; null for a flat triangle."""
    lengths = sides(x1, y1, x2, y2, x3, y3)
    area = triangle_area(x1, y1, x2, y2, x3, y3)

    def opposite(k: int) -> Column:
        a, b, c = (-v if j == k else v for j, v in enumerate(lengths))
        around = a + b + c
        return F.struct(((a * x1 + b * x2 + c * x3) / around).alias("x"), ((a * y1 + b * y2 + c * y3) / around).alias("y"), (2 * area / around).alias("r"))

    return F.when(~near(area), F.array(*(opposite(k) for k in range(3))))


def nine_point_circle(*corners: Column) -> Column:
    """(x, y, r) of the circle through the sides' midpoints; null for a flat triangle."""
    x1, y1, x2, y2, x3, y3 = corners
    return circumcircle((x2 + x3) / 2, (y2 + y3) / 2, (x1 + x3) / 2, (y1 + y3) / 2, (x1 + x2) / 2, (y1 + y2) / 2)


def collinear(*corners: Column) -> Column:
    return near(triangle_area(*corners))


def distance_to_line(x, y, x1, y1, x2, y2) -> Column:
    """From a point to the line through two others; null if these are one."""
    d = length(x2 - x1, y2 - y1)
    return F.when(~near(d), F.abs(three_quarter_plane(x1, y1, x2, y2, x, y)) / d)


def rotated(x, y, around_x, around_y, angle: Column) -> Column:
    """A point turned by an angle (radians, anticlockwise) around another."""
    dx, dy, c, s = x - around_x, y - around_y, F.cos(angle), F.sin(angle)
    return _point(around_x + dx * c - dy * s, around_y + dx * s + dy * c)


def line_angle(x1, y1, x2, y2) -> Column:
    """Of the line from one point to another, in radians from the x axis; null if they are one."""
    return F.when(~near(length(x2 - x1, y2 - y1)), F.atan2(y2 - y1, x2 - x1))


def circle_area(r: Column) -> Column:
    return math.pi * r * r
