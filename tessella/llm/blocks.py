"""Operator 11: exact duplicates by naming blocks, with DataFrame functions only.

A text is cut into blocks of a fixed number of bytes. Sorting the blocks gives each different
one an integer, its name. Then neighbouring names are paired, pairs are sorted and named in the
same way, and so on, until a document has one name: after k rounds that is one with at most 2^k
blocks. Two documents have the same name in the same round exactly if their bytes are the same;
no digest decides that.

A round moves its rows once. Its 1024 most frequent blocks (or pairs), told by counting their
digests, are named apart: each is seen once by the task that names it, whatever the number of
its occurrences, and its name is told to all tasks. A block that is not among them has at most
a 1024th of all occurrences, so a sort by block leaves no task with much more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.session import materialise, release

#: Bytes of a block.
BLOCK = 1024
#: So many of the most frequent blocks are named apart.
FREQUENT = 1024
#: The second name of a pair that has one only; names are not negative.
NONE = -1

_KEY = ("doc_id", "digest", "blocks")


def _cut(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, digest, blocks, place, copies, block: a row for each block of each text, at least one for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("bytes"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / size)).cast("long")
    texts = texts.select("doc_id", F.unhex(F.sha2("bytes", 256)).alias("digest"), n.alias("blocks"), "bytes")
    # slices of bytes cost what they hold, wherever they stand in a text
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.substring("bytes", (i * size + 1).cast("int"), F.lit(size)))
    return texts.select(*_KEY, F.posexplode(parts).alias("place", "block")).select(*_KEY, F.col("place").cast("long").alias("place"), F.lit(1).cast("long").alias("copies"), "block")


def _named(rows: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows, written, with an integer `name` in place of the columns `on`, equal exactly where these are.

    Names follow the order of `on` in each task: the frequent ones have odd names, others even ones.
    """
    digest = F.xxhash64(*on)
    counts = rows.groupBy(digest.alias("hash")).agg(F.count("*").alias("n")).where("n > 1")
    frequent = counts.orderBy(F.desc("n"), "hash").limit(FREQUENT).select("hash")
    hot = rows.join(F.broadcast(frequent), digest == F.col("hash")).groupBy(*on).agg(F.lit(0).alias("x"))
    known = hot.repartition(1).sortWithinPartitions(*on).select(*(F.col(c).alias(f"{c}_") for c in on), (F.monotonically_increasing_id() * 2 + 1).alias("known"))
    known = materialise(known, f"{name}-names")
    # as many as there are frequent digests, unless texts were made for their digests to collide
    small = known.count() <= 2 * FREQUENT
    all_ = rows.join(F.broadcast(known) if small else known, [F.col(c) == F.col(f"{c}_") for c in on], "left")
    kept = [c for c in rows.columns if c not in on]
    # a row whose name is known moves without its block, to any task
    own = [F.when(F.col("known").isNull(), F.col(c)).alias(c) for c in on]
    apart = F.when(F.col("known").isNotNull(), F.xxhash64("doc_id", "digest", "place")).alias("apart")
    group = [*on, "apart"]
    sorted_ = all_.select(*kept, "known", *own, apart).repartition(*group).sortWithinPartitions(*group).withColumn("row", F.monotonically_increasing_id())
    first = F.min("row").over(W.partitionBy(*group))
    named = materialise(sorted_.withColumn("name", F.coalesce("known", first * 2)).select(*kept, "name"), name)
    release(known)
    return named


def _pairs(level: DataFrame) -> DataFrame:
    """Names of one round, put together two by two; rows that share doc_id and text become one."""
    at = F.col("place") % 2
    return level.groupBy(*_KEY, F.shiftright("place", 1).alias("place")).agg(
        F.sum(F.when(at == 0, F.col("copies"))).alias("copies"),
        F.max(F.when(at == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(at == 1, F.col("name"))), F.lit(NONE)).alias("right"),
    )


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, digest, copies, level, name, a row for each doc_id and text.

    (level, name) is the identity of a text. digest is the SHA-256 of its bytes, which tells the
    rows of one doc_id apart and nothing else; copies counts the rows that agree in both.
    """
    level = _named(_cut(docs, block), ["block"], "level0")
    most = level.agg(F.max("blocks")).first()[0] or 1
    levels, k = [], 0
    while True:
        levels.append(level)
        if most <= 2**k:
            break
        pairs = materialise(_pairs(level.where(F.col("blocks") > 2**k)), f"pairs{k}")
        k += 1
        level = _named(pairs, ["left", "right"], f"level{k}")
        release(pairs)
    found = None
    for k, level in enumerate(levels):
        done = level.where(F.col("blocks") <= 2**k).where("place = 0").select("doc_id", "digest", F.lit(k).alias("level"), "name", "copies")
        found = done if found is None else found.unionByName(done)
    whole = materialise(found.groupBy("doc_id", "digest", "level", "name").agg(F.sum("copies").alias("copies")), "identities")
    release(*levels)
    return whole


def _largest_first(doc_id: Column) -> Column:
    """Orders null before every doc_id."""
    return F.struct(doc_id.isNotNull(), doc_id)


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs.

    Texts are equal if their bytes are; nothing is normalised. Of equal texts the row with the
    largest doc_id stays; a null doc_id is smaller than all others, and keep_id is null only
    where the group has no other. Of rows that share that doc_id and the text one stays. Null
    and empty texts are equal. A text of any length takes one row for each block. An empty table
    gives no rows. Other columns, whatever their names, are not read.
    """
    known = identities(docs, block)
    groups = known.groupBy("level", "name").agg(F.max(_largest_first(F.col("doc_id")))["doc_id"].alias("keep_id"), F.sum("copies").alias("group_size")).where("group_size > 1")
    groups = materialise(groups.withColumnsRenamed({"level": "l", "name": "n"}), "groups")
    each = known.join(groups, (F.col("level") == F.col("l")) & (F.col("name") == F.col("n")), "left")
    each = each.withColumn("keep_id", F.when(F.col("l").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
