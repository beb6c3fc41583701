"""Operator 10: mix sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document of a source whose rate is r is taken floor(r) times, and once more with probability
r - floor(r). The extra copies are drawn dependently: two documents with fractional probabilities
pass mass (probability times words) from one to the other, in a random direction that keeps both
expectations, until one of them is 0 or 1. The other one carries the rest of the mass on. Small
groups of a source do this first; what each group carries on meets in groups of groups, and so
up a tree, until one document of the source is left, which is drawn by itself. So a source's
words miss their target by less than the words of one document; large documents meet first, so
that it tends to be a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.session import materialise

#: Documents that meet in one group, on average; also the width of the tree.
GROUP = 128
#: A document is taken at most this many times.
MOST = 3
#: The weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)

_FIELDS = ("doc_id", "source", "size", "digest", "rows", "sure", "words", "mass", "up")
_UNIT = "struct<doc_id: bigint, source: string, size: bigint, digest: bigint, rows: bigint, sure: bigint, words: double, mass: double, up: boolean>"


def words(text: Column) -> Column:
    """Number of words: runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    """What tells texts apart; null and empty ones have one each."""
    return F.xxhash64(text.cast("string"), text.isNull())


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3 in order of source (null last), none above MOST times its size.

    sizes has one row for each source. What the capped sources leave is shared by the others by
    weight; each round reads one row of totals until no further source is capped.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weighed = materialise(sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1).cast("double")), "sources")
    most = F.lit(float(MOST)) * F.col("source_size")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        full = most <= F.lit(share) * F.col("weight")
        got = weighed.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("int"))).first()
        if not got[1] or got[2] == capped:
            break
        capped, share = got[2], (total - got[0]) / got[1]
    return weighed.select("source", "source_size", F.least(most, F.lit(share) * F.col("weight")).alias("target"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _unit(x: Column, **change: Column) -> Column:
    return F.struct(*(change.get(n, x[n]).alias(n) for n in _FIELDS))


def _uniform(*on: Column) -> Column:
    """A number of [0, 1) that depends on its arguments alone."""
    return F.shiftrightunsigned(F.xxhash64(*on), 11) / F.lit(float(1 << 53))


def _settle(x: Column) -> Column:
    """A unit whose mass is 0 or all its words, as decided."""
    return _unit(x, up=x["mass"] > 0)


def _meet(state: Column, new: Column, seed: int) -> Column:
    """Let the carried unit and a new one pass mass until one is integral; it joins the decided ones."""
    old = state["carry"]
    give = F.least(old["mass"], new["words"] - new["mass"])
    take = F.least(new["mass"], old["words"] - old["mass"])
    chance = _uniform(old["doc_id"], old["digest"], new["doc_id"], new["digest"], F.lit(seed)) * (give + take) < take
    # after giving, old is empty or new is full; after taking, new is empty or old is full
    after = F.when(
        chance,
        F.when(old["mass"] <= new["words"] - new["mass"], _pair(old, F.lit(0.0), new, new["mass"] + old["mass"])).otherwise(_pair(new, new["words"], old, old["mass"] - give)),
    ).otherwise(F.when(new["mass"] <= old["words"] - old["mass"], _pair(new, F.lit(0.0), old, old["mass"] + new["mass"])).otherwise(_pair(old, old["words"], new, new["mass"] - take)))
    joined = _let(after, lambda p: F.struct(p["rest"].alias("carry"), F.concat(state["done"], F.array(_settle(p["fixed"]))).alias("done")))
    return F.when(old.isNull(), F.struct(new.alias("carry"), state["done"].alias("done"))).otherwise(joined)


def _pair(fixed: Column, mass: Column, rest: Column, left: Column) -> Column:
    return F.struct(_unit(fixed, mass=mass).alias("fixed"), _unit(rest, mass=left).alias("rest"))


def _fold(groups: DataFrame, seed: int) -> DataFrame:
    """source, bucket, carry, done of each group of units."""
    zero = F.expr(f"cast(null as {_UNIT})")
    start = F.struct(zero.alias("carry"), F.expr(f"cast(array() as array<{_UNIT}>)").alias("done"))
    largest_first = F.transform(F.array_sort("units"), lambda x: x["unit"])
    met = F.aggregate(largest_first, start, lambda s, x: _meet(s, x, seed))
    return groups.select("source", "bucket", met.alias("met")).select("source", "bucket", "met.carry", "met.done")


def _units(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, digest, rows, source_size, target, base, extra: how often the rows of a unit are taken.

    Rows that agree in doc_id, source and text are one unit. Each of them is taken `base` times,
    and `extra` of them once more. Of rows * part expected extra copies the whole ones are sure,
    and one row with what is left is drawn; so a unit moves at most one text's words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), digest(F.col("text")).alias("digest"))
    units = materialise(rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("rows")), "units")
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    by_source = materialise(by_source, "sizes")
    goal = targets(by_source.select("source", "source_size")).withColumnRenamed("source", "s")
    goal = goal.join(by_source.select(F.col("source").alias("s2"), "n"), F.expr("s <=> s2")).drop("s2")
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0))
    goal = materialise(goal.withColumn("base", F.least(F.floor("rate"), F.lit(MOST)).cast("long")).withColumn("part", F.when(F.col("rate") < MOST, F.col("rate") - F.floor("rate")).otherwise(0.0)), "goals")
    known = units.join(goal, F.expr("source <=> s"))
    open_ = (F.col("size") > 0) & (F.col("part") > 0)
    named = ("doc_id", "source", "size", "digest", "rows")
    plain = known.where(~open_).select(*named, F.lit(0).cast("long").alias("sure"), F.lit(False).alias("up"))
    sure = F.floor(F.col("rows") * F.col("part"))
    left = F.col("size") * (F.col("rows") * F.col("part") - sure)
    unit = F.struct(*named, sure.alias("sure"), F.col("size").cast("double").alias("words"), left.alias("mass"), F.lit(False).alias("up"))
    bucket = F.pmod(F.xxhash64("doc_id", "digest", F.lit(seed)), F.ceil(F.col("n") / GROUP))
    level = known.where(open_).select("source", bucket.alias("bucket"), unit.cast(_UNIT).alias("unit"))
    widest = goal.agg(F.max(F.ceil(F.col("n") / GROUP))).first()[0] or 0
    decided, k = [plain], 0
    while True:
        met = materialise(_fold(level.groupBy("source", "bucket").agg(F.collect_list(F.struct((-F.col("unit.words")).alias("order"), "unit")).alias("units")), seed + k), f"level{k}")
        decided.append(met.select(F.explode("done").alias("u")).select(*(f"u.{c}" for c in (*named, "sure", "up"))))
        if widest <= 1:
            break
        level = met.where("carry is not null").select("source", F.floor(F.col("bucket") / GROUP).alias("bucket"), F.col("carry").alias("unit"))
        widest, k = -(-widest // GROUP), k + 1
    last = met.where("carry is not null").select("carry.*")
    drawn = (_uniform(F.col("doc_id"), F.col("digest"), F.lit(seed - 1)) * F.col("words")) < F.col("mass")
    decided.append(last.select(*named, "sure", drawn.alias("up")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    full = out.join(goal.select("s", "source_size", "target", F.col("base").alias("b")), F.expr("source <=> s"))
    base = F.when(F.col("size") > 0, F.col("b")).otherwise(F.lit(1).cast("long"))
    return full.select(*named, "source_size", "target", base.alias("base"), (F.col("sure") + F.col("up").cast("long")).alias("extra"))


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, source, copies, taken, one row for each row of docs.

    Rows that agree in doc_id, source and text are drawn one by one: their copies differ by one
    at most. Null texts and texts without words have size 0, are taken once and add no words. A
    null source is a source, the last one; a null doc_id is a value like others; an empty table
    gives no rows; other columns, whatever their names, are not read. Reruns agree, since every
    draw is a hash of what meets; the partitioning has no part in it.
    """
    each = _units(docs, seed).withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.col("base") + (F.col("each") <= F.col("extra")).cast("long")
    return each.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "source", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, all columns kept.

    Of rows that agree in doc_id, source and text, the first by its other columns carries the
    extra copies of all; the others come `base` times.
    """
    units = _units(docs, seed).select(F.col("doc_id").alias("d_"), F.col("source").alias("s_"), F.col("digest").alias("h_"), F.col("rows").alias("r_"), F.col("base").alias("b_"), F.col("extra").alias("x_"))
    units = materialise(units, "copies")
    same = F.expr("cast(row.doc_id as bigint) <=> d_ and cast(row.source as string) <=> s_ and w_ = h_")
    rows = docs.select(F.expr("struct(*)").alias("row"), digest(F.col("text")).alias("w_"))
    alone = F.col("b_") + F.when(F.col("r_") == 1, F.col("x_")).otherwise(0)
    every = rows.join(units.withColumn("c_", alone).where("c_ > 0"), same).select("row", "c_")
    several = rows.join(units.where("r_ > 1 and x_ > 0"), same).groupBy("d_", "s_", "h_").agg(F.min_by("row", F.to_json("row")).alias("row"), F.first("x_").alias("c_")).select("row", "c_")
    return every.unionByName(several).withColumn("e_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c_")))).select("row.*")
