"""Edits of ordered trees that are tables of (tree, node, path): many nodes of many trees at once.

An edit changes what the path of a node adds at one level, and nothing else: a wrapped node's
place is taken by its wrapper, an unwrapped one's children stand in its place, a cut one's are
gone. So every node asks once for the edits of all nodes above it, by their paths, and folds what
they say into a path whose steps are sort keys rather than numbers: `[4, 1]` is child 1 of an
unwrapped child 4. Siblings are then numbered by their keys, where these are not numbers already,
and the numbers take the keys' place, again by one equi-join. Both joins have a row for each node
and level of the trees that are edited; other trees are left as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.trees import parent_path
from tessella.session import materialise, release

#: What can be done to a node; the second line needs `other`.
OPERATIONS = ("cut", "unwrap", "wrap", "wrap_children", "split", "merge", "merge_previous", "merge_next")
MOVES = ("put_first", "put_last", "put_next", "put_previous")

_LAST = 2**31 - 1


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that tells neither side to all tasks: paths take many times the space in memory that they take in files, by which Spark would judge."""
    return left.join(right.hint("merge"), on, how)


def _known(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """edits with the path and tag of their node, and the path of the other one."""
    edits = materialise(edits.select("tree", "seq", "op", "node", "other", "key"), "edits")
    asked = edits.select("tree", "node").unionByName(edits.select("tree", F.col("other").alias("node"))).where("node is not null").distinct()
    found = materialise(_met(nodes.select("tree", "node", "path", "tag"), asked, ["tree", "node"], "left_semi"), "found")
    own = found.withColumnRenamed("tag", "own_tag")
    other = found.select("tree", F.col("node").alias("other"), F.col("path").alias("to"))
    met = _met(_met(edits, own, ["tree", "node"], "left"), other, ["tree", "other"], "left")
    wrong = ~F.col("op").isin(*OPERATIONS, *MOVES) | F.col("path").isNull() | (F.col("op").isin(*MOVES) & F.col("to").isNull())
    said = F.concat(F.lit("no such operation or node: "), F.coalesce("op", F.lit("null")), F.lit(" of "), F.coalesce(F.col("node").cast("string"), F.lit("null")))
    known = materialise(met.withColumn("op", F.when(wrong, F.raise_error(said).cast("string")).otherwise(F.col("op"))), "known")
    release(edits, found)
    return known


def _steps(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """tree, path, kind, key, seq, op, to: what happens at single nodes. Splits and merges concern children and siblings, whose paths follow from the node's."""
    asked = _known(nodes, edits)
    ops = {r.op for r in asked.select("op").distinct().collect()}  # of OPERATIONS and MOVES, so few
    below = F.size("path") > 0
    at, none = ["tree", "path"], F.lit(None).cast("string").alias("key")
    plain = asked.where(F.col("op").isin("cut", "unwrap", "wrap") & below).select(*at, F.col("op").alias("kind"), "key", "seq")
    inner = asked.where("op = 'wrap_children'").select(*at, F.lit("inner").alias("kind"), "key", "seq")
    moves = asked.where(F.col("op").isin(*MOVES) & below).select(*at, F.lit("move").alias("kind"), none, "seq", "op", "to")
    every = plain.unionByName(inner).unionByName(moves, allowMissingColumns=True)
    if ops & {"split", "merge"}:
        child = nodes.select("tree", "path", "tag", parent_path(F.col("path")).alias("up"))
        families = _met(child, asked.where(F.col("op").isin("split", "merge")).select("tree", F.col("path").alias("up"), "op", "own_tag", "seq"), ["tree", "up"])
        kind = F.when(F.col("op") == "split", "wrap").when(F.col("tag").eqNullSafe(F.col("own_tag")), "unwrap")
        concerned = families.select(*at, kind.alias("kind"), F.when(F.col("op") == "split", F.col("own_tag")).alias("key"), "seq").where("kind is not null")
        every = every.unionByName(concerned, allowMissingColumns=True)
    if ops & {"merge_previous", "merge_next"}:
        step = F.when(F.col("op") == "merge_previous", -1).otherwise(1)
        beside = asked.where(F.col("op").isin("merge_previous", "merge_next") & below).withColumn("path", F.concat(parent_path(F.col("path")), F.array((F.element_at("path", -1) + step).cast("int"))))
        joined = _met(beside.drop("node"), nodes.select("tree", "path", "tag"), at).where("tag <=> own_tag")
        joined = joined.select(*at, F.when(F.col("op") == "merge_previous", "into_next").otherwise("into_previous").alias("kind"), none, "seq")
        every = every.unionByName(joined, allowMissingColumns=True)
    every = materialise(every, "concerned")
    # one edit for each node; what a merge makes a node part of is not edited itself
    takes = F.when(F.col("kind") == "into_next", 1).when(F.col("kind") == "into_previous", -1)
    part = every.where(takes.isNotNull()).select("tree", F.concat(parent_path(F.col("path")), F.array((F.element_at("path", -1) + takes).cast("int"))).alias("path"))
    touched = every.select("tree", "path", F.lit(1).alias("own")).unionByName(part.select("tree", "path", F.lit(0).alias("own")))
    twice = touched.groupBy("tree", "path").agg(F.sum("own").alias("own"), F.count("*").alias("n"))
    clash = twice.where("own > 1 or own = 1 and n > 1").select("tree", "path", F.raise_error(F.concat(F.lit("a node is edited twice in one batch: "), F.col("path").cast("string"))).cast("int").alias("clash"))
    steps = materialise(_met(every, clash, at, "left").withColumn("seq", F.coalesce("clash", "seq")).drop("clash"), "steps")
    release(asked, every)
    return steps


#: What a step adds to the keys, by what is done to the node there.
_FOLD = f"""aggregate(steps, named_struct('keys', cast(array() as array<array<int>>), 'carry', cast(array() as array<int>), 'gone', false, 'move', cast(null as bigint), 'under', 0), (s, x) -> CASE
  WHEN x.level = 0 THEN if(x.kind = 'inner' AND x.level < depth, struct(array(array(0)) AS keys, s.carry, s.gone, s.move, s.under), s)
  WHEN x.kind = 'cut' THEN struct(s.keys, s.carry, true AS gone, s.move, s.under)
  WHEN x.kind = 'unwrap' THEN struct(s.keys, concat(s.carry, array(x.step)) AS carry, s.gone OR x.level = depth AS gone, s.move, s.under)
  WHEN x.kind = 'into_next' THEN struct(concat(s.keys, array(concat(s.carry, array(x.step + 1)))) AS keys, array(-1) AS carry, s.gone OR x.level = depth AS gone, s.move, s.under)
  WHEN x.kind = 'into_previous' THEN struct(concat(s.keys, array(concat(s.carry, array(x.step - 1)))) AS keys, array({_LAST}) AS carry, s.gone OR x.level = depth AS gone, s.move, s.under)
  WHEN x.kind = 'wrap' THEN struct(concat(s.keys, array(concat(s.carry, array(x.step)), array(0))) AS keys, cast(array() as array<int>) AS carry, s.gone, s.move, s.under)
  WHEN x.kind = 'inner' AND x.level < depth THEN struct(concat(s.keys, array(concat(s.carry, array(x.step)), array(0))) AS keys, cast(array() as array<int>) AS carry, s.gone, s.move, s.under)
  WHEN x.kind = 'move' THEN struct(concat(s.keys, array(concat(s.carry, array(x.step)))) AS keys, cast(array() as array<int>) AS carry, s.gone, x.seq AS move, size(s.keys) + 1 AS under)
  ELSE struct(concat(s.keys, array(concat(s.carry, array(x.step)))) AS keys, cast(array() as array<int>) AS carry, s.gone, s.move, s.under) END)"""


def _keyed(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """tree, node, path, keys, move, under, own of the nodes that stay: where each is, without the moves, and what is done to it itself.

    nodes have `levels`, at which something is done in their tree; they ask there only. A node
    below one that moves has that move's seq, and `under` of its keys lead to what moves.
    """
    each = nodes.select("tree", "node", "path", F.explode(F.filter("levels", lambda k: k <= F.size("path"))).alias("level"))
    each = each.select("tree", "node", "level", F.slice("path", F.lit(1), F.col("level")).alias("at"))
    done = steps.select("tree", F.col("path").alias("at"), F.struct("kind", "key", F.col("seq").cast("long").alias("seq")).alias("done"))
    marks = _met(each, done, ["tree", "at"]).groupBy("tree", "node").agg(F.map_from_entries(F.collect_list(F.struct("level", "done"))).alias("marks"))
    met = _met(nodes.select("tree", "node", "path"), marks, ["tree", "node"], "left").withColumn("depth", F.size("path"))
    steps_of = "transform(sequence(0, depth), k -> named_struct('level', k, 'step', get(path, k - 1), 'kind', marks[k].kind, 'seq', marks[k].seq))"
    marked = met.where("marks is not null").withColumn("steps", F.expr(steps_of)).withColumn("f", F.expr(_FOLD)).where("not f.gone")
    plain = met.where("marks is null").select("tree", "node", "path", F.transform("path", lambda x: F.array(x)).alias("keys"))
    return marked.select("tree", "node", "path", "f.keys", "f.move", "f.under", F.expr("marks[depth]").alias("own")).unionByName(plain, allowMissingColumns=True)


def _moved(keyed: DataFrame, steps: DataFrame) -> DataFrame:
    """keyed, with the keys of what moves led to where it goes."""
    moves = steps.where("kind = 'move'").select("tree", "seq", "op", "to")
    if moves.isEmpty():
        return keyed.drop("move", "under")
    where = keyed.select("tree", F.col("path").alias("to"), F.col("keys").alias("there"), F.col("move").alias("moving"))
    last = F.element_at("there", -1)
    up = F.slice("there", F.lit(1), F.size("there") - 1)
    before = F.concat(F.slice(last, F.lit(1), F.size(last) - 1), F.array((F.element_at(last, -1) - 1).cast("int"), F.lit(_LAST), F.lit(_LAST), F.col("seq").cast("int")))
    seq = F.col("seq").cast("int")
    goal = (
        F.when(F.col("op") == "put_first", F.concat("there", F.array(F.array(F.lit(-1), -seq))))
        .when(F.col("op") == "put_last", F.concat("there", F.array(F.array(F.lit(_LAST), seq))))
        .when(F.col("op") == "put_next", F.concat(up, F.array(F.concat(last, F.array(F.lit(_LAST), -seq)))))
        .otherwise(F.concat(up, F.array(before)))
    )
    lost = F.col("there").isNull() | F.col("moving").isNotNull() | (F.col("op").isin("put_next", "put_previous") & (F.size("there") == 0))
    goal = F.when(lost, F.raise_error(F.lit("a node can't go to one that is cut, that moves in the same batch, that holds it, or beside the root")).cast("array<array<int>>")).otherwise(goal)
    goals = _met(moves, where, ["tree", "to"], "left").select("tree", F.col("seq").cast("long").alias("move"), goal.alias("goal"))
    goals = materialise(goals, "goals")
    met = _met(keyed.where("move is not null"), goals, ["tree", "move"], "left")
    keys = F.when(F.col("goal").isNull(), F.col("keys")).otherwise(F.concat("goal", F.slice("keys", F.col("under") + 1, F.size("keys"))))
    columns = ["tree", "node", "path", "keys", "own"]
    out = materialise(met.withColumn("keys", keys).select(columns).unionByName(keyed.where("move is null").select(columns)), "placed")
    release(goals)
    return out


def _added(placed: DataFrame) -> DataFrame:
    """tree, keys, tag, seq of the nodes that wraps make."""
    keys = F.when(F.col("own.kind") == "wrap", F.slice("keys", F.lit(1), F.size("keys") - 1)).otherwise(F.concat("keys", F.array(F.array(F.lit(0)))))
    return placed.where("own.kind in ('wrap', 'inner')").select("tree", keys.alias("keys"), F.col("own.key").alias("tag"), F.col("own.seq").cast("int").alias("seq"))


def _numbered(placed: DataFrame) -> DataFrame:
    """tree, node, path: keys as numbers of children. Families whose keys are 0, 1, 2 ... already are not sorted."""
    up = F.slice("keys", F.lit(1), F.greatest(F.size("keys") - 1, F.lit(0)))
    child = placed.where(F.size("keys") > 0).select("tree", up.alias("up"), F.element_at("keys", -1).alias("key"))
    family = child.groupBy("tree", "up").agg(F.max(F.size("key")).alias("longest"), F.max(F.element_at("key", 1)).alias("most"), F.min(F.element_at("key", 1)).alias("least"), F.count("*").alias("n"))
    odd = family.where("longest > 1 or least < 0 or most <> n - 1").select("tree", "up")
    order = W.partitionBy("tree", "up").orderBy("key")
    ranked = _met(child, odd, ["tree", "up"], "left_semi").withColumn("pos", (F.row_number().over(order) - 1).cast("int"))
    # only what gets another number is asked for, and only at its level
    changed = ranked.where("size(key) > 1 or key[0] <> pos").select("tree", F.concat("up", F.array("key")).alias("at"), "pos")
    changed = materialise(changed, "numbers")
    levels = sorted(r[0] for r in changed.select(F.size("at")).distinct().collect())  # no more than the trees are deep
    each = placed.select("tree", "node", "keys", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k <= F.size("keys"))).alias("level"))
    each = each.select("tree", "node", "level", F.slice("keys", F.lit(1), F.col("level")).alias("at"))
    marks = _met(each, changed, ["tree", "at"]).groupBy("tree", "node").agg(F.map_from_entries(F.collect_list(F.struct("level", "pos"))).alias("marks"))
    met = _met(placed.select("tree", "node", "keys"), marks, ["tree", "node"], "left")
    path = F.transform("keys", lambda x, k: F.coalesce(F.col("marks")[k + 1], F.get(x, 0)))
    out = materialise(met.select("tree", "node", path.alias("path")), "paths")
    release(changed)
    return out


def edit(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """nodes (tree, node, path, tag, and whatever else) after a batch of edits (tree, seq, op, node, other, key).

    cut: the node goes with all below it. unwrap: its children take its place. wrap: a new node,
    with key as its tag, takes its place and holds it. wrap_children: a new node holds all its
    children. split: each child is wrapped in a node of its tag. merge: children of its tag are
    unwrapped. merge_previous, merge_next: the neighbour takes part in it, if its tag is the same.
    put_first, put_last, put_next, put_previous: the node goes, with all below it, into or beside
    other. Where several are put in one place, the last one by seq is nearest to it.

    The edits of a batch are about the trees as they were before, and give what they would give one
    after the other by seq; a node takes part in one edit of a batch at most, and what moves goes to
    a node that stays where it is. Anything else is an error, as is an unknown node or operation.
    A root is not cut, unwrapped, wrapped, merged with a neighbour or moved; that does nothing. New nodes get
    the numbers after the largest of their tree, by seq and place; node is a whole number, seq one of 32 bits.
    Their other columns are null.
    """
    steps = _steps(nodes, edits)
    levels = steps.groupBy("tree").agg(F.collect_set(F.size("path")).alias("_levels"))
    known = materialise(_met(nodes, levels, ["tree"], "left"), "levels")
    touched = known.where("_levels is not null")
    keyed = materialise(_keyed(touched.select("tree", "node", "path", F.col("_levels").alias("levels")), steps), "keyed")
    placed = _moved(keyed, steps)
    most = touched.groupBy("tree").agg(F.max("node").alias("most"))
    number = F.row_number().over(W.partitionBy("tree").orderBy("seq", "keys"))
    kind = nodes.schema["node"].dataType
    added = _met(_added(placed), most, ["tree"]).select("tree", (F.col("most") + number).cast(kind).alias("node"), "keys", "tag")
    added = materialise(added, "added")
    paths = _numbered(placed.select("tree", "node", "keys").unionByName(added.select("tree", "node", "keys")))
    release(keyed, placed, steps)
    every = touched.drop("path", "_levels").unionByName(added.select("tree", "node", "tag"), allowMissingColumns=True)
    kept = _met(every, paths, ["tree", "node"]).withColumn("path", F.col("path").cast(nodes.schema["path"].dataType))
    out = materialise(known.where("_levels is null").select(nodes.columns).unionByName(kept.select(nodes.columns)), "edited")
    release(known, added, paths)
    return out
