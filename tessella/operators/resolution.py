"""Where broken references were meant to go: names followed through renames, guids, and ranked candidates.

Every look-up is an equi-join against a table that has been reduced to one row for each key, so a
name that a third of all references use is on one side only and its partition can be split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.session import materialise, release

GUID = "(?i)^guid-"


def final_names(renames: DataFrame, most_rounds: int = 40) -> DataFrame:
    """old, final, cyclic: where each name of (old, new) rows leads if all renames are followed.

    A name that was cut into several leads to all of their ends, a row each; a name that others were
    made of and that is not renamed itself is an end. Each round doubles the steps taken, so a
    chain of n renames takes log n rounds. cyclic says that some way from the name never ends;
    final is null where none ends. Nulls and names renamed to themselves are no renames.
    """
    steps = renames.select(F.col("old"), F.col("new")).where("old is not null and new is not null and old <> new").distinct()
    steps = materialise(steps, "renames")
    ended = F.col("o").isNull()
    old = steps.select(F.col("old").alias("o")).distinct()
    # open: the name `at` is renamed further
    state = materialise(steps.join(old, F.col("new") == F.col("o"), "left").select("old", F.col("new").alias("at"), (~ended).alias("open")), "names")
    names = old.count()
    taken = 1
    for _ in range(most_rounds):
        if taken > names or state.where("open").isEmpty():
            break
        further = state.select(F.col("old").alias("o"), F.col("at").alias("then"), F.col("open").alias("still"))
        moved = state.where("open").join(further, F.col("at") == F.col("o")).select("old", F.col("then").alias("at"), F.col("still").alias("open"))
        # ways that meet in a name go on as one
        after = materialise(state.where("not open").unionByName(moved).distinct(), "names")
        release(state)
        state, taken = after, 2 * taken
    else:
        raise RuntimeError(f"the names did not settle in {most_rounds} rounds")
    # what is open after more steps than there are names goes round for ever
    cyclic = state.groupBy("old").agg(F.bool_or("open").alias("cyclic"))
    found = cyclic.join(state.where("not open").select(F.col("old").alias("o"), F.col("at").alias("final")), F.col("old") == F.col("o"), "left")
    out = materialise(found.select("old", "final", "cyclic"), "final-names")
    release(state, steps)
    return out


def guid_files(files: DataFrame, *within: str) -> DataFrame:
    """guid, file of files (file, topic) whose topic is a guid; of several files that define one the last by name, for each value of the columns `within`."""
    return files.where(F.col("topic").rlike(GUID)).groupBy(*within, F.col("topic").alias("guid")).agg(F.max("file").alias("file"))


def guid_reasons(references: DataFrame, files: DataFrame, ids: DataFrame, *within: str) -> DataFrame:
    """file, reference, target, reason of the references (file, reference) that begin with a guid; the reason is null where all is well.

    A reference is guid, guid#topic or guid#topic/id. files: file, topic. ids: file, id, n. The
    reasons are looked for in order: No such guid defined, Guid does not match topic id, No such id
    in target topic, Duplicated id in target topic. All three tables may have columns that say which
    corpus a row is of (`within`, none of them null); a guid is then looked for in its reference's corpus only.
    """
    part = T.split_reference(F.col("reference"))
    asked = references.where(F.col("reference").rlike(GUID)).select("file", "reference", *within, part.alias("p")).select("file", "reference", *within, F.col("p.file").alias("g"), "p.topic", "p.id")
    known = guid_files(files, *within).select(*within, F.col("guid").alias("g"), F.col("file").alias("target"))
    held = ids.groupBy(*within, F.col("file").alias("target"), "id").agg(F.sum("n").alias("n"))
    met = asked.join(known, [*within, "g"], "left").withColumnRenamed("g", "guid").join(held, [*within, "target", "id"], "left")
    reason = (
        F.when(F.col("target").isNull(), "No such guid defined")
        .when((F.col("topic") != "") & (F.col("topic") != F.col("guid")), "Guid does not match topic id")
        .when((F.col("id") != "") & (F.coalesce("n", F.lit(0)) == 0), "No such id in target topic")
        .when((F.col("id") != "") & (F.col("n") > 1), "Duplicated id in target topic")
    )
    return met.select("file", "reference", "target", reason.alias("reason"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def relative_path(target: Column, base: Column) -> Column:
    """An absolute path as seen from a file: shared folders go, `../` for each folder left."""
    to, own = F.split(target, "/"), F.split(base, "/")
    folders = F.least(F.size(to), F.size(own)) - 1
    places = F.when(folders > 0, F.sequence(F.lit(1), folders)).otherwise(F.array().cast("array<int>"))
    shared = F.size(F.filter(places, lambda k: F.slice(to, 1, k) == F.slice(own, 1, k)))
    up = F.repeat(F.lit("../"), F.size(own) - 1 - shared)
    return F.concat(up, F.array_join(F.slice(to, shared + 1, F.size(to)), "/"))


def _best(rows: DataFrame, key: list[str], answer: str) -> DataFrame:
    """key, largest, n: of each key the answer of the largest size, ties to the smaller name, and how many answers there are."""
    one = rows.where(F.col(answer).isNotNull()).groupBy(*key, answer).agg(F.max("size").alias("size"))
    best = F.min(F.struct((-F.coalesce("size", F.lit(0))).alias("s"), F.col(answer).alias("name")))
    return one.groupBy(*key).agg(best.alias("x"), F.count("*").alias("n")).select(*key, F.col("x.name").alias("answer"), "n")


#: The ways in which a reference can be repaired, in the order in which they are tried.
WAYS = ("guid", "own id", "own file", "base name", "title", "largest of title")


def resolve(
    references: DataFrame, files: DataFrame, lineage: DataFrame, ids: DataFrame, aside: Column | None = None, all_of_guid: bool = False, alike: Callable[[Column], Column] = T.collapse
) -> DataFrame:
    """references plus `target`, `repaired` and `how`: the first way that leads somewhere.

    references: file, reference, text, with whatever else; all of them are taken to be broken. files:
    file, topic, title, size of what there is now. lineage: old, final, as final_names gives them,
    where the old names are those of the corpus that the references were written for. ids: old, id,
    file: which file has the id that an old one had. The ways, in order:

    guid: the topic that has it; own id: what the reference means beside the file's own old name, and
    the one file that has its id now; own file: the largest file that this old name leads to; base
    name: the only file of that name in any folder; title, largest of title: the file whose title is
    the reference's text, or the largest of several. A guid that nobody defines is tried in no other
    way. repaired is relative to the file, with the topic that now has the id, or with what stood
    behind #. What no way leads to is `moved aside` if aside says so (by default it does) and `none`
    otherwise. Ties go to the smaller name, unknown sizes are 0, a null reference has its text only.
    A guid that several files define leads to the last of them by name or, if all_of_guid, to each, a row
    each. Titles and texts are compared as `alike` makes them, by default with white space collapsed.
    """
    columns = references.columns
    part = T.split_reference(F.col("reference"))
    rest = F.regexp_extract("reference", "#(.*)$", 1)
    asked = references.withColumns({"_p": part, "_rest": rest, "_guid": F.coalesce(F.col("reference").rlike(GUID), F.lit(False)), "_base": base_name(F.split_part("reference", F.lit("#"), F.lit(1)))})
    # any old name of a file will do, as they held the same; the smallest does
    own = lineage.where("final is not null").groupBy(F.col("final").alias("_f")).agg(F.min("old").alias("_own"))
    met = asked.join(own, F.col("file") == F.col("_f"), "left").withColumn("_old", F.when(~F.col("_guid"), T.absolute_path(F.col("_own"), F.col("_p.file"))))
    size = files.select(F.col("file").alias("_s"), "size").groupBy("_s").agg(F.max("size").alias("size"))

    defined = files.where(F.col("topic").rlike(GUID)).select(F.col("topic").alias("guid"), "file").distinct() if all_of_guid else guid_files(files)
    guids = defined.select(F.col("guid").alias("_g"), F.col("file").alias("_a0"))
    met = met.join(guids, F.col("_guid") & (F.col("_p.file") == F.col("_g")), "left")
    # an id that several files have now says nothing
    moved = ids.groupBy(F.col("old").alias("_o1"), F.col("id").alias("_i1")).agg(F.count_distinct("file").alias("_n1"), F.min("file").alias("_a1")).where("_n1 = 1")
    met = met.join(moved, (F.col("_old") == F.col("_o1")) & (F.col("_p.id") == F.col("_i1")), "left")
    ends = _best(lineage.where("final is not null").join(size, F.col("final") == F.col("_s")), ["old"], "final")
    met = met.join(ends.select(F.col("old").alias("_o2"), F.col("answer").alias("_a2")), F.col("_old") == F.col("_o2"), "left")
    bases = _best(files.withColumn("_b", base_name(F.col("file"))), ["_b"], "file").where("n = 1 and _b <> ''")
    met = met.join(bases.select(F.col("_b").alias("_b3"), F.col("answer").alias("_a3")), ~F.col("_guid") & (F.col("_base") == F.col("_b3")), "left")
    titles = _best(files.withColumn("_t", alike(F.col("title"))), ["_t"], "file").where("_t <> ''")
    met = met.withColumn("_text", F.when(~F.col("_guid"), alike(F.col("text"))))
    met = met.join(titles.select(F.col("_t").alias("_t4"), F.col("answer").alias("_a4"), F.col("n").alias("_n4")), F.col("_text") == F.col("_t4"), "left")

    answers = [F.col("_a0"), F.col("_a1"), F.col("_a2"), F.col("_a3"), F.when(F.col("_n4") == 1, F.col("_a4")), F.when(F.col("_n4") > 1, F.col("_a4"))]
    how = F.when(answers[0].isNotNull(), WAYS[0])
    for answer, way in zip(answers[1:], WAYS[1:], strict=True):
        how = how.when(answer.isNotNull(), way)
    lost = F.when(F.coalesce(F.lit(True) if aside is None else aside, F.lit(False)), "moved aside").otherwise("none")
    met = met.withColumns({"target": F.coalesce(*answers), "how": how.otherwise(lost)})
    topics = files.groupBy(F.col("file").alias("_f5")).agg(F.max("topic").alias("_topic"))
    met = met.join(topics, F.col("target") == F.col("_f5"), "left")
    behind = F.when(F.col("how") == "own id", F.concat_ws("/", "_topic", "_p.id")).when(F.col("how").isin("guid", "base name"), F.col("_rest")).otherwise("")
    repaired = F.concat(relative_path(F.col("target"), F.col("file")), F.when(behind != "", F.concat(F.lit("#"), behind)).otherwise(""))
    return met.select(*columns, "target", repaired.alias("repaired"), "how")
