"""Joins between what refers and what is referred to: checks, anti joins, repair, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T


def check(references: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """file, reference, target, reason of each reference that is broken.

    references: file, reference. files: file, topic (its own id, null if it has none). ids: file,
    id, n. The reasons are looked for in order: No such file, No topic id, Topic id does not match
    (an empty one matches), No such id in target topic, Duplicated id in target topic (one, or
    two where one of them is the topic's own, is fine). A reference without # only needs its file.
    A target that no file has is looked for once more with %xx decoded. The look-ups are
    equi-joins; null references are not broken.
    """
    part = T.split_reference(F.col("reference"))
    asked = references.where("reference is not null").select("file", "reference", part.alias("p"), F.contains("reference", F.lit("#")).alias("full"))
    asked = asked.select("file", "reference", "full", "p.topic", "p.id", T.absolute_path(F.col("file"), F.col("p.file")).alias("target"))
    known = files.select(F.col("file").alias("f"), F.col("topic").alias("own")).dropDuplicates(["f"])
    held = ids.groupBy(F.col("file").alias("g"), F.col("id").alias("i")).agg(F.sum("n").alias("n"))
    decoded = known.select(F.col("f").alias("f2"), F.col("own").alias("own2"))
    met = asked.join(known, F.col("target") == F.col("f"), "left").withColumn("again", F.when(F.col("f").isNull(), T.decode_percent(F.col("target")))).join(decoded, F.col("again") == F.col("f2"), "left")
    met = met.withColumns({"target": F.coalesce("f", "f2", "target"), "own": F.coalesce("own", "own2"), "f": F.coalesce("f", "f2")}).drop("f2", "own2", "again")
    met = met.join(held, (F.col("target") == F.col("g")) & (F.col("id") == F.col("i")), "left")
    found = F.coalesce(F.col("n"), F.lit(0))
    reason = (
        F.when(F.col("f").isNull(), "No such file")
        .when(~F.col("full"), None)
        .when(F.coalesce(F.col("own"), F.lit("")) == "", "No topic id")
        .when((F.col("topic") != F.col("own")) & (F.col("topic") != ""), "Topic id does not match")
        .when(F.col("id") == "", None)
        .when(found == 0, "No such id in target topic")
        .when(~((found == 1) | (found == 2) & (F.col("id") == F.col("topic"))), "Duplicated id in target topic")
    )
    return met.select("file", "reference", "target", reason.alias("reason")).where("reason is not null")


def unreferenced(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys no row of right has: ids nobody names, topics in no map, items without a label."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def exterior(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes that refer to others and that nothing refers to; a reference to oneself counts."""
    return edges.select(F.col(source).alias("node")).where("node is not null").distinct().join(edges.select(F.col(target).alias("t")).distinct(), F.col("node") == F.col("t"), "left_anti")


def chain(first: DataFrame, second: DataFrame) -> DataFrame:
    """a, b, c of (a, b) and (b, c): what is reached in two steps, with how many ways there are."""
    right = second.select(F.col("a").alias("m"), F.col("b").alias("c"))
    return first.join(right, F.col("b") == F.col("m")).groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def tag_mismatches(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References (file, tag, target, id) and the tags that hold the id there (targets: file, id, tag): matches says whether they agree."""
    held = targets.groupBy(F.col("file").alias("f"), F.col("id").alias("i")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    met = references.join(held, (F.col("target") == F.col("f")) & (F.col("id") == F.col("i")), "left")
    return met.select("file", "tag", "target", "id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce(F.array_contains("tags", F.col("tag")), F.lit(False)).alias("matches"))


def repair(broken: DataFrame, *candidates: tuple[DataFrame, list[str], str]) -> DataFrame:
    """broken plus `repaired` and `how` from the first candidate that knows an answer.

    A candidate is (table, keys, name): the table has the keys and `answer`. Only answers that are
    the only one for their keys count. What none can repair has nulls. Each is one left equi-join.
    """
    out, answers = broken, []
    for k, (table, keys, name) in enumerate(candidates):
        sole = table.where("answer is not null").groupBy(*keys).agg(F.count_distinct("answer").alias("n"), F.min("answer").alias(f"_a{k}")).where("n = 1").drop("n")
        out = out.join(sole, keys, "left")
        answers.append((F.col(f"_a{k}"), name))
    how = None
    for answer, name in answers:
        how = F.when(answer.isNotNull(), name) if how is None else how.when(answer.isNotNull(), name)
    return out.withColumn("repaired", F.coalesce(*(a for a, _ in answers))).withColumn("how", how).drop(*(f"_a{k}" for k in range(len(candidates))))


def largest(rows: DataFrame, key: str, name: str, size: str) -> DataFrame:
    """key, answer: the name with the largest size for each key, ties to the smaller name. Partial maxima are combined before the shuffle."""
    best = F.min(F.struct((-F.col(size)).alias("s"), F.col(name).alias("answer")))
    return rows.groupBy(key).agg(best.alias("x")).select(key, "x.answer")


def lineage(pairs: DataFrame) -> DataFrame:
    """target, sources, n of (source, target) pairs, turned around; n above 1 means that targets collide."""
    return pairs.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count_distinct("source").alias("n"))


def shared_targets(pairs: DataFrame) -> DataFrame:
    """target, source, n of the (source, target) pairs whose target n > 1 sources have. Targets are counted and joined back, so that no target's sources are gathered."""
    rows = pairs.select("target", "source").distinct()
    return rows.join(rows.groupBy("target").agg(F.count("source").alias("n")).where("n > 1"), "target")


def collisions(wanted: DataFrame, name: str) -> DataFrame:
    """The rows whose name another row wants too."""
    return wanted.withColumn("n", F.count("*").over(W.partitionBy(name))).where("n > 1")


def unique_labels(labels: DataFrame) -> DataFrame:
    """label, file of (label, file) for labels that one file alone defines."""
    return labels.groupBy("label").agg(F.count_distinct("file").alias("n"), F.min("file").alias("file")).where("n = 1").select("label", "file")


def fill_titles(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """Entries (map, href, navtitle) with `title` and `note`: Set, Changed, Unchanged or No title known."""
    known = titles.select(F.col("file").alias("f"), F.col("title").alias("t"))
    met = entries.join(known, F.col("href") == F.col("f"), "left")
    note = F.when(F.col("t").isNull(), "No title known").when(F.col("navtitle").isNull(), "Set").when(F.col("navtitle") == F.col("t"), "Unchanged").otherwise("Changed")
    return met.select("map", "href", "navtitle", F.coalesce("t", "navtitle").alias("title"), note.alias("note"))


def with_reason(*tables: tuple[DataFrame, str]) -> DataFrame:
    """The tables one after the other, each with its reason."""
    out = None
    for table, reason in tables:
        named = table.withColumn("reason", F.lit(reason))
        out = named if out is None else out.unionByName(named)
    return out


def differences(got: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct rows of one table that the other lacks; side says which has them."""
    a, b = got.distinct(), expected.distinct()
    return a.exceptAll(b).withColumn("side", F.lit("got")).unionByName(b.exceptAll(a).withColumn("side", F.lit("expected")))


def look_up(rows: DataFrame, codes: DataFrame, key: str, out: str, missing: Column | None = None) -> DataFrame:
    """rows plus the name of a code (codes: code, name)."""
    known = codes.select(F.col("code").alias("_c"), F.col("name").alias("_n"))
    name = F.col("_n") if missing is None else F.coalesce("_n", missing)
    return rows.join(known, F.col(key) == F.col("_c"), "left").withColumn(out, name).drop("_c", "_n")


def unused_ids(ids: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """file, id of the ids that no reference of any file names, but for a file's own topic id.

    ids: file, id. references: reference, as file#topic/id; an id that is named anywhere is kept
    everywhere, as what the reference leads to may have been moved. files: file, topic.
    """
    named = references.select(T.split_reference(F.col("reference"))["id"].alias("id")).where("id <> ''").distinct()
    own = files.where("topic is not null").select("file", F.col("topic").alias("id")).distinct()
    held = ids.where("file is not null and id is not null").select("file", "id").distinct()
    return held.join(named, "id", "left_anti").join(own, ["file", "id"], "left_anti").select("file", "id")
