"""Drawings as tables of pixels (image, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.graph import components
from tessella.session import materialise, release


def pixels(images: DataFrame, image: str, text: str) -> DataFrame:
    """image, x, y of the characters that aren't blank: x counts along a line, y down the lines."""
    lines = images.select(F.col(image).alias("image"), F.posexplode(F.split(F.col(text), "\n")).alias("y", "line"))
    marks = lines.where("line <> ''").select("image", "y", F.posexplode(F.split("line", "")).alias("x", "c"))
    return marks.where("c not in (' ', '')").select("image", "x", "y")


def bounds(dots: DataFrame) -> DataFrame:
    """image, x0, x1, y0, y1, n."""
    return dots.groupBy("image").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))


def adjacent(dots: DataFrame) -> DataFrame:
    """Pixels above or to the left of each other, as pairs of (image, x, y). Each pixel names its neighbours' places, which meet by an equi-join."""
    steps = F.array(F.struct((F.col("x") + 1).alias("x2"), F.col("y").alias("y2")), F.struct(F.col("x").alias("x2"), (F.col("y") + 1).alias("y2")))
    named = dots.select("image", "x", "y", F.explode(steps).alias("s")).select("image", "x", "y", "s.*")
    there = dots.select("image", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return named.join(there, ["image", "x2", "y2"]).select("image", "x", "y", "x2", "y2")


def parts(dots: DataFrame, least: int = 1) -> DataFrame:
    """image, x, y, part: connected pixels have the part of their smallest one; parts of fewer than `least` are left out."""
    name = lambda x, y: F.struct("image", F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = adjacent(dots).select(name("x", "y").alias("a"), name("x2", "y2").alias("b"))
    label = components(pairs).select(F.col("node.image").alias("image"), F.col("node.x").alias("x"), F.col("node.y").alias("y"), F.struct("component.x", "component.y").alias("part"))
    own = F.struct(F.col("x"), F.col("y"))
    found = dots.join(label, ["image", "x", "y"], "left").withColumn("part", F.coalesce("part", own))
    sizes = found.groupBy("image", "part").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return found.join(sizes, ["image", "part"]).select("image", "x", "y", "part")


def widths(dots: DataFrame) -> DataFrame:
    """image, direction, longest: the longest run of pixels along rows, columns and both diagonals (gaps and islands)."""
    x, y = F.col("x"), F.col("y")
    lines = F.array(
        F.struct(F.lit("row").alias("direction"), y.alias("line"), x.alias("at")),
        F.struct(F.lit("column").alias("direction"), x.alias("line"), y.alias("at")),
        F.struct(F.lit("falling").alias("direction"), (x - y).alias("line"), x.alias("at")),
        F.struct(F.lit("rising").alias("direction"), (x + y).alias("line"), x.alias("at")),
    )
    rows = dots.select("image", F.explode(lines).alias("l")).select("image", "l.*")
    island = F.col("at") - F.row_number().over(W.partitionBy("image", "direction", "line").orderBy("at"))
    runs = rows.withColumn("island", island).groupBy("image", "direction", "line", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("image", "direction").agg(F.max("n").alias("longest"))


_SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def _beside(dots: DataFrame, *more: str) -> DataFrame:
    """image, x2, y2 of the four places beside each pixel, with the pixel's own columns."""
    steps = F.array(*(F.struct((F.col("x") + dx).alias("x2"), (F.col("y") + dy).alias("y2")) for dx, dy in _SIDES))
    return dots.select("image", "x", "y", *more, F.explode(steps).alias("s")).select("image", "x", "y", *more, "s.x2", "s.y2")


def core(dots: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """image, x, y of the pixels that are left when ends are taken away again and again: loops, and what lies between them.

    An end has fewer than two of its four neighbours. A tail goes from its end, one pixel a round;
    a round reads what the one before has left.
    """
    left = materialise(dots.select("image", "x", "y").distinct(), "core")
    for _ in range(most_rounds):
        there = left.select("image", F.col("x").alias("x2"), F.col("y").alias("y2"))
        held = _beside(left).join(there, ["image", "x2", "y2"]).groupBy("image", "x", "y").agg(F.count("*").alias("n"))
        inner = materialise(held.where("n > 1").select("image", "x", "y"), "core")
        before, after = left.count(), inner.count()
        release(left)
        left = inner
        if before == after:
            return left
    raise RuntimeError(f"the core was not reached in {most_rounds} rounds")


def spread(dots: DataFrame, starts: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """image, x, y, steps, px, py: how many steps from the nearest start each pixel is, and from which neighbour it was reached.

    Starts have 0 steps and null neighbours; of several neighbours the smallest by (x, y) counts.
    Pixels that no start reaches are left out. All images grow at once, a step a round, and a round
    only meets the pixels that the one before has reached.
    """
    at = dots.select("image", "x", "y").distinct()
    known = starts.select("image", "x", "y").distinct().join(at, ["image", "x", "y"], "left_semi")
    front = materialise(known.select("image", "x", "y", F.lit(0).alias("steps"), F.lit(None).cast("int").alias("px"), F.lit(None).cast("int").alias("py")), "front")
    fronts, last = [front], None
    for step in range(1, most_rounds + 1):
        if front.isEmpty():
            break
        near = _beside(front).groupBy("image", F.col("x2").alias("x"), F.col("y2").alias("y")).agg(F.min(F.struct("x", "y")).alias("p"))
        near = near.join(at, ["image", "x", "y"], "left_semi")
        # what is beside a front was reached with it, before it, or is new
        for old in (front, *([last] if last is not None else [])):
            near = near.join(old.select("image", "x", "y"), ["image", "x", "y"], "left_anti")
        last = front
        front = materialise(near.select("image", "x", "y", F.lit(step).alias("steps"), F.col("p.x").cast("int").alias("px"), F.col("p.y").cast("int").alias("py")), "front")
        fronts.append(front)
    else:
        raise RuntimeError(f"the pixels were not reached in {most_rounds} rounds")
    out = fronts[0]
    for more in fronts[1:]:
        out = out.unionByName(more)
    whole = materialise(out, "steps")
    release(*fronts)
    return whole


def layers(dots: DataFrame) -> DataFrame:
    """image, x, y, layer: 1 for pixels with a blank place beside them, 2 for those beside these, and so on inwards."""
    at = dots.select("image", "x", "y").distinct()
    inside = _beside(at).join(at.select("image", F.col("x").alias("x2"), F.col("y").alias("y2")), ["image", "x2", "y2"]).groupBy("image", "x", "y").agg(F.count("*").alias("n"))
    border = at.join(inside.where("n = 4"), ["image", "x", "y"], "left_anti")
    return spread(at, border).select("image", "x", "y", (F.col("steps") + 1).alias("layer"))


def _farthest(reached: DataFrame, part: DataFrame) -> DataFrame:
    """image, part, x, y, steps of the pixel with most steps in each part, ties to the smaller one."""
    far = F.min(F.struct((-F.col("steps")).alias("s"), "x", "y")).alias("f")
    return reached.join(part, ["image", "x", "y"]).groupBy("image", "part").agg(far).select("image", "part", "f.x", "f.y", (-F.col("f.s")).alias("steps"))


def long_paths(dots: DataFrame, least: int = 2) -> DataFrame:
    """image, part, x, y, steps: a shortest path between two far ends of each part, its pixels numbered from 0.

    From the part's smallest pixel the farthest one is looked for, and from there the farthest
    again: no two pixels of a part without loops are farther apart. The way back is found by
    doubling: sets of pixels are moved 1, 2, 4 ... parents at once.
    """
    part = materialise(parts(dots, least), "parts")
    first = part.groupBy("image", "part").agg(F.min(F.struct("x", "y")).alias("p")).select("image", "p.x", "p.y")
    begin = materialise(_farthest(spread(dots, first), part), "ends")
    reached = spread(dots, begin)
    end = materialise(_farthest(reached, part), "ends")
    on = end.select("image", "part", "x", "y")
    jump = reached.where("px is not null").select("image", "x", "y", "px", "py")
    most = end.agg(F.max("steps")).first()[0] or 0
    for k in range(int(most).bit_length()):
        moved = on.join(jump, ["image", "x", "y"]).select("image", "part", F.col("px").alias("x"), F.col("py").alias("y"))
        on = materialise(on.unionByName(moved).distinct(), "path")
        further = jump.select("image", F.col("x").alias("px"), F.col("y").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"))
        if 2 ** (k + 1) <= most:
            jump = materialise(jump.join(further, ["image", "px", "py"]).select("image", "x", "y", F.col("qx").alias("px"), F.col("qy").alias("py")), "jumps")
    return on.join(reached.select("image", "x", "y", "steps"), ["image", "x", "y"]).select("image", "part", "x", "y", "steps")
