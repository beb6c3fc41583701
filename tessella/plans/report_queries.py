"""Queries about documents and the star tables: groups, orders, joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import arrays
from tessella.functions import text as T
from tessella.operators import choices, groups, nesting, references, sequences, similarity
from tessella.plans.registry import register
from tessella.session import table
from tessella.streaming import acceptance, segments


@register("md5_duplicates", "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def md5_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.duplicates(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@register("content_addressed", "SELECT md5(text) AS md5, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.keep_first(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


_WORDS = "SELECT doc_id AS file, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z]', ' ', 'g'), ' +')) AS word FROM documents"
_INDEX = f"WITH i AS (SELECT word, file, count(*) AS n FROM ({_WORDS}) WHERE length(word) BETWEEN 1 AND 15 GROUP BY 1, 2), h AS (SELECT word, count(*) AS f FROM i GROUP BY 1), k AS (SELECT word FROM h WHERE f * f <= (SELECT count(*) FROM h))"


@register("words_by_file", f"{_INDEX} SELECT word, count(*) AS files, CAST(sum(n) AS BIGINT) AS n FROM i JOIN k USING (word) GROUP BY word HAVING count(*) > 1")
def words_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of selective words that several documents hold: in how many documents, how often."""
    index = groups.word_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("word").agg(F.count("*").alias("files"), F.sum("n").alias("n")).where("files > 1")


@register(
    "similar_documents",
    r"""WITH RECURSIVE s AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM documents WHERE text IS NOT NULL),
    u AS (SELECT md5(array_to_string(list_sort(w), chr(10))) AS m, min(doc_id) AS c, any_value(w) AS w FROM s WHERE len(w) > 0 GROUP BY 1),
    e AS (SELECT c, len(w) AS n, unnest(w) AS t FROM u),
    p AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS x FROM e a JOIN e b ON a.t = b.t AND a.c <> b.c AND a.n >= 0.9 * b.n AND b.n >= 0.9 * a.n GROUP BY 1, 2),
    l AS (SELECT a, b FROM p WHERE x / (na + nb - x) >= 0.9 - 1e-12),
    r(c, o) AS (SELECT c, c FROM u UNION SELECT r.c, l.b FROM r JOIN l ON l.a = r.o),
    k AS (SELECT c, min(o) AS block FROM r GROUP BY 1),
    d AS (SELECT s.doc_id AS key, k.block FROM s JOIN u ON md5(array_to_string(list_sort(s.w), chr(10))) = u.m JOIN k ON k.c = u.c)
    SELECT key, block FROM d WHERE block IN (SELECT block FROM d GROUP BY block HAVING count(*) > 1)""",
)
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents connected by vocabularies that agree to 0.9 or more."""
    return similarity.similar(table(spark, sf_dir, "documents"), "doc_id", "text", 0.9)


@register(
    "unique_names",
    r"""WITH s AS (SELECT p_partkey, left(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_]', '', 'g'), '[0-9]+$', ''), 16) AS stem FROM part)
    SELECT p_partkey, stem || CASE WHEN k > 0 THEN CAST(k AS VARCHAR) ELSE '' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) - 1 AS k FROM s)""",
)
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.unique_names(table(spark, sf_dir, "part"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@register("conjunctive_filter", "SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(p_name, '^(red|blue)') AND regexp_matches(p_type, 'A') AND regexp_matches(p_brand, '#1') ORDER BY p_partkey")
def conjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name, type and brand all match."""
    wanted = {column: re.compile(pattern) for column, pattern in {"p_name": "^(red|blue)", "p_type": "A", "p_brand": "#1"}.items()}
    df = groups.matching(table(spark, sf_dir, "part"), wanted)
    return df.select("p_partkey", "p_name", "p_type").orderBy("p_partkey")


@register(
    "pass_rates",
    """SELECT lang, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS BIGINT) AS failed,
    round(100.0 * sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*), 4) AS percent FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return groups.pass_rates(rows, "lang", F.coalesce(F.col("quality") == 1, F.lit(False)))


@register("unlabelled_documents", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.unreferenced(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


_EDGES = "SELECT 'r' || r_regionkey AS a, 'n' || n_nationkey AS b FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: regions hold nations, nations hold suppliers."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return nation.select(name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b")).unionByName(supplier.select(name("n", "s_nationkey").alias("a"), name("s", "s_suppkey").alias("b")))


@register("exterior_nodes", f"SELECT DISTINCT a AS node FROM ({_EDGES}) WHERE a NOT IN (SELECT b FROM ({_EDGES}))")
def exterior_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.exterior(hierarchy(spark, sf_dir), "a", "b")


@register("reference_chain", f"WITH e AS ({_EDGES}) SELECT x.a, x.b, y.b AS c, count(*) AS n FROM e x JOIN e y ON x.b = y.a GROUP BY 1, 2, 3")
def reference_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = hierarchy(spark, sf_dir)
    return references.chain(edges, edges)


@register("topic_reuse", "SELECT l_partkey AS item, count(*) AS n, count(DISTINCT l_orderkey) AS users FROM lineitem GROUP BY 1")
def topic_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.reuse(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")


@register(
    "example_events",
    "SELECT event_type, event_id, value, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS place FROM events) WHERE place <= 6",
)
def example_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest events of each type, five and one more."""
    found = sequences.examples(table(spark, sf_dir, "events"), "event_type", [F.col("value"), F.col("event_id")], 5)
    return found.select("event_type", "event_id", "value", "place")


_KINDS = ("click", "error", "purchase", "signup", "view")


@register("pivot_matches", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS) + " FROM events GROUP BY user_id")
def pivot_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.pivot_counts(table(spark, sf_dir, "events"), "user_id", "event_type", list(_KINDS))


@register("extension_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def extension_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("most_frequent", "SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value DESC LIMIT 1")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.mode(table(spark, sf_dir, "part"), "p_size")


_GENRES = "SELECT p_partkey AS item, unnest(list_distinct(list_concat(string_split(p_name, ' '), [p_type, p_brand]))) AS g FROM part"


def _genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("genres", F.concat(F.split("p_name", " "), F.array("p_type", "p_brand")))


@register("genre_counts", f"SELECT g AS genre, count(*) AS n FROM ({_GENRES}) GROUP BY g")
def genre_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.genre_counts(_genres(spark, sf_dir), "genres")


@register(
    "genre_overlap",
    f"WITH x AS ({_GENRES}), c AS (SELECT g, count(*) AS n FROM x GROUP BY g) SELECT a.g AS g, b.g AS h, round(count(*) / (any_value(ca.n) + any_value(cb.n) - count(*)), 6) AS ratio FROM x a JOIN x b ON a.item = b.item AND a.g < b.g JOIN c ca ON ca.g = a.g JOIN c cb ON cb.g = b.g GROUP BY 1, 2",
)
def genre_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.genre_overlap(_genres(spark, sf_dir), "p_partkey", "genres")


@register("part_choices")
def part_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts divided by words of their names and types, brands and sizes into sets of twelve: how many are in each set, and how many are shown there."""
    words = F.concat(F.split("p_name", " "), F.split("p_type", " "), F.array("p_brand", F.concat(F.lit("size "), (F.col("p_size") % 7).cast("string"))))
    divided = choices.divide(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), words.alias("genres"), F.col("p_retailprice").alias("popularity")), 12)
    shown = choices.unwrap_singles(choices.promote(divided.where("problem is null"), 12))
    name = lambda c: F.array_join(c, "/")
    counts = divided.groupBy(name("path").alias("path"), "problem").agg(F.count("*").alias("n"))
    places = shown.groupBy(name("shown").alias("path")).agg(F.count("*").alias("shown"))
    extra = places.join(counts.where("problem is null"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("problem"), F.lit(0).cast("long").alias("n"), "shown")
    known = counts.join(places, "path", "left").select("path", "problem", "n", F.when(F.col("problem").isNull(), F.coalesce("shown", F.lit(0))).alias("shown"))
    return known.unionByName(extra)


@register("promoted_parts", "SELECT p_type, p_partkey, CAST(slot AS INT) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS slot FROM part) WHERE slot <= 4")
def promoted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.promote(table(spark, sf_dir, "part"), "p_type", "p_partkey", "p_retailprice", 4).select("p_type", "p_partkey", "slot")


@register(
    "longest_run",
    """WITH d AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS v FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v) AS k, CASE WHEN v = lag(v) OVER (PARTITION BY user_id ORDER BY v) + 1 THEN 0 ELSE 1 END AS new FROM d),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS run FROM s), g AS (SELECT user_id, run, count(*) AS length, min(v) AS low, max(v) AS high FROM r GROUP BY 1, 2)
    SELECT user_id, length, low, high FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, low) AS p FROM g) WHERE p = 1""",
)
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.longest_runs(table(spark, sf_dir, "events").select("user_id", F.floor("value").cast("long").alias("v")), "user_id", "v")


@register("event_neighbours", "SELECT event_id, lag(event_type) OVER w AS previous, lead(event_type) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def event_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.neighbours(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "previous", "following")


@register(
    "blank_repeats",
    """WITH l AS (SELECT *, lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderpriority, o_orderkey))
    SELECT o_custkey, o_orderkey, CASE WHEN ps = o_orderstatus THEN '' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN ps = o_orderstatus AND pp = o_orderpriority THEN '' ELSE o_orderpriority END AS o_orderpriority FROM l""",
)
def blank_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return sequences.blank_repeats(rows, "o_custkey", ["o_orderstatus", "o_orderpriority", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@register(
    "double_writes",
    """WITH o AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS op FROM events),
    s AS (SELECT *, lag(op) OVER w AS b, lead(op) OVER w AS a FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) FILTER (op = 'write' AND b = 'write') AS double_writes, bool_or(op = 'write' AND a IS NULL) AS unread FROM s GROUP BY user_id""",
)
def double_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("purchase", "signup"), "write").otherwise("read")
    return sequences.writes_and_reads(table(spark, sf_dir, "events").withColumn("op", op), "user_id", ["ts", "event_id"], "op")


@register(
    "under_headings",
    """WITH h AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 END AS level FROM events)
    SELECT event_id, coalesce(last_value(CASE WHEN level IS NOT NULL THEN event_id END IGNORE NULLS) OVER w, -1) AS section, coalesce(last_value(CASE WHEN level = 1 THEN event_id END IGNORE NULLS) OVER w, -1) AS "outer" FROM h
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def under_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading at or before each event, signups and purchases being headings of levels 1 and 2."""
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2)
    return sequences.under_headings(table(spark, sf_dir, "events").withColumn("level", level), "user_id", ["ts", "event_id"], "level", "event_id").na.fill(-1, ["section", "outer"]).select("event_id", "section", "outer")


@register(
    "nested_headings",
    """WITH h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 + event_id % 3 WHEN 'view' THEN 5 + event_id % 4 END AS level FROM events),
    t AS (SELECT a.event_id, b.event_id AS above, b.k, b.level, min(b.level) OVER (PARTITION BY a.event_id ORDER BY b.k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later, a.level AS own
      FROM h a JOIN h b ON a.user_id = b.user_id AND b.k < a.k AND b.level IS NOT NULL),
    o AS (SELECT event_id, above, k FROM t WHERE level < coalesce(later, 1000) AND level < coalesce(own, 1000))
    SELECT h.event_id, coalesce(max_by(above, o.k), -1) AS parent, count(above) AS depth, coalesce(string_agg(above, '/' ORDER BY o.k), '') AS trail FROM h LEFT JOIN o USING (event_id) GROUP BY 1""",
)
def nested_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings above each event, signups, purchases and views being headings of eight levels; the users are documents."""
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2 + F.col("event_id") % 3).when(F.col("event_type") == "view", 5 + F.col("event_id") % 4)
    found = nesting.under_headings(table(spark, sf_dir, "events").withColumn("level", level), "user_id", ["ts", "event_id"], "level", "event_id")
    parent = F.coalesce(F.get("trail", F.size("trail") - 1).cast("long"), F.lit(-1))
    return found.select("event_id", parent.alias("parent"), F.size("trail").cast("long").alias("depth"), F.array_join("trail", "/").alias("trail"))


@register(
    "name_collisions",
    "WITH w AS (SELECT c_custkey, left(c_mktsegment, 1) || c_nationkey || '_' || CAST(floor(c_acctbal / 500) AS BIGINT) AS wanted FROM customer) SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY wanted) AS n FROM w) WHERE n > 1",
)
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.concat(F.substring("c_mktsegment", 1, 1), F.col("c_nationkey").cast("string"), F.lit("_"), F.floor(F.col("c_acctbal") / 500).cast("string"))
    return references.collisions(table(spark, sf_dir, "customer").select("c_custkey", wanted.alias("wanted")), "wanted")


@register("unique_labels", "SELECT c_nationkey || '/' || c_mktsegment || '/' || CAST(floor(c_acctbal / 100) AS BIGINT) AS label, min(c_name) AS file FROM customer GROUP BY 1 HAVING count(DISTINCT c_name) = 1")
def unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 100).cast("string"))
    return references.unique_labels(table(spark, sf_dir, "customer").select(label.alias("label"), F.col("c_name").alias("file")))


@register("code_names", "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return references.look_up(table(spark, sf_dir, "customer"), codes, "c_nationkey", "nation", F.lit("unknown")).select("c_custkey", "nation")


@register(
    "tag_mismatches",
    """SELECT o_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS tags, bool_or(l_returnflag = CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END) AS matches
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def tag_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's lines hold the flag that its status asks for."""
    tag = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").otherwise("A")
    asked = table(spark, sf_dir, "orders").select(F.lit("o").alias("file"), tag.alias("tag"), F.col("o_orderkey").alias("target"), F.lit(0).alias("id"))
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.lit(0).alias("id"), F.col("l_returnflag").alias("tag"))
    found = references.tag_mismatches(asked, held).where(F.size("tags") > 0)
    return found.select(F.col("target").alias("o_orderkey"), F.array_join("tags", ",").alias("tags"), "matches")


@register(
    "golden_compare",
    """WITH a AS (SELECT DISTINCT p_type, p_size FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT DISTINCT p_type, p_size FROM part WHERE p_partkey % 3 <> 1)
    SELECT *, 'got' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'expected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and sizes that two overlapping stocks of parts do not share."""
    part = table(spark, sf_dir, "part")
    return references.differences(part.where("p_partkey % 3 <> 0").select("p_type", "p_size"), part.where("p_partkey % 3 <> 1").select("p_type", "p_size"))


@register(
    "fits_between",
    """WITH o AS (SELECT event_type AS tag, lag(event_type) OVER w AS p, lead(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    a AS (SELECT DISTINCT tag FROM o WHERE p = 'signup'), b AS (SELECT DISTINCT tag FROM o WHERE f = 'purchase')
    SELECT coalesce(a.tag, b.tag) AS tag, a.tag IS NOT NULL AS may_follow, b.tag IS NOT NULL AS may_precede FROM a FULL JOIN b ON a.tag = b.tag""",
)
def fits_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types seen right after a signup, and right before a purchase."""
    seen = sequences.neighbours(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").withColumnRenamed("event_type", "tag")
    return groups.fits_between(seen.where("previous = 'signup'"), seen.where("following = 'purchase'"))


@register("with_reason", "SELECT doc_id, 'No text' AS reason FROM documents WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT doc_id, 'No label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'Toxic' FROM labels WHERE toxic = 1")
def with_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    empty = docs.where("text is null or trim(text) = ''").select("doc_id")
    return references.with_reason((empty, "No text"), (references.unreferenced(docs.select("doc_id"), labels, ["doc_id"]), "No label"), (labels.where("toxic = 1").select("doc_id"), "Toxic"))


@register(
    "largest_order",
    "SELECT o_custkey, o_orderkey AS answer FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
)
def largest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.largest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@register("rule_statistics", "SELECT o_orderpriority AS rule, CAST(count(*) FILTER (o_totalprice > 499000) AS BIGINT) AS passes, CASE WHEN count(*) FILTER (o_totalprice > 499000) = 0 THEN max(o_custkey) ELSE -1 END AS furthest FROM orders GROUP BY 1")
def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return groups.rule_statistics(rows.select(F.col("o_orderpriority").alias("rule"), F.col("o_custkey").alias("line"), (F.col("o_totalprice") > 499000).alias("passed"))).na.fill(-1, ["furthest"])


#: Users begin with a signup or a view, and end with a purchase; errors end everything.
STEPS = {("new", "signup"): "in", ("new", "view"): "new", ("in", "view"): "in", ("in", "click"): "in", ("in", "purchase"): "bought", ("bought", "view"): "in", ("bought", "click"): "in", ("bought", "purchase"): "bought"}
_CASE = "CASE " + " ".join(f"WHEN s = '{a}' AND c = '{b}' THEN '{t}'" for (a, b), t in STEPS.items()) + " END"


@register(
    "accepted_sequences",
    f"""WITH RECURSIVE o AS (SELECT user_id, event_type AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 'new' AS s FROM events UNION ALL SELECT r.user_id, o.k, {_CASE} FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT user_id, s AS state, coalesce(s = 'bought', false) AS accepted FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS last FROM r) WHERE k = last""",
)
def accepted_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all of each user's events, and whether it is a final one."""
    ended = acceptance.end_states(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", STEPS, "new")
    return ended.withColumn("accepted", F.coalesce(F.col("state") == "bought", F.lit(False)))


@register(
    "sliding_windows",
    """SELECT w AS start, event_type AS kind, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 minute, ts) - INTERVAL 15 minute * k FOR k IN range(0, 4)]) AS w, ts FROM events) GROUP BY 1, 2""",
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind in hours that begin every quarter of an hour."""
    return segments.sliding_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@register(
    "sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 hour THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 hour AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events with less than half a day between."""
    return segments.session_counts(table(spark, sf_dir, "events"), "user_id", "ts", "12 hours")


@register("windowed_events", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@register(
    "issue_history",
    """WITH s AS (SELECT DISTINCT event_type AS issue, ts, CAST(user_id AS VARCHAR) AS u, trim(props) AS segment FROM events WHERE props IS NOT NULL)
    SELECT issue, count(*) OVER (PARTITION BY issue) AS n, row_number() OVER (PARTITION BY issue ORDER BY ts DESC, u DESC, segment DESC) AS place, u || ': ' || segment AS text FROM s""",
)
def issue_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of each type as segments, newest first: a row for each, with its place."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("issue"), F.col("user_id").cast("string").alias("user"), F.col("ts").alias("stamp"), F.col("props").alias("text"))
    return segments.placed(segments.stamped(rows)).select("issue", "n", "place", F.concat("user", F.lit(": "), "segment").alias("text"))


@register("best_answer")
def best_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of each conversation that holds all words of its first question with the fewest others between; ties to the shorter answer."""
    rows = table(spark, sf_dir, "conversations")
    clean = lambda c: F.filter(T.words(F.col(c)), lambda w: w != "")
    asked = rows.where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("x")).select("conv_id", clean("x.text").alias("q"))
    answers = rows.where("role = 'assistant'").select("conv_id", F.col("text").alias("answer"), clean("text").alias("a"))
    scored = asked.join(answers, "conv_id").withColumn("gap", arrays.least_span(F.col("q"), F.col("a"))).where("gap is not null")
    best = groups.argmin(scored.select("conv_id", "gap", F.length("answer").alias("size"), "answer"), "conv_id", "gap", "size", "answer")
    return best.select("conv_id", "gap", F.md5("answer").alias("answer"))


@register("closest_answer")
def closest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the answer that has most of the first question's first ten different words, with the fewest others between these; ties to the shorter answer."""
    rows = table(spark, sf_dir, "conversations")
    clean = lambda c: F.filter(T.words(F.col(c)), lambda w: w != "")
    asked = rows.where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("x")).select("conv_id", F.slice(F.array_distinct(clean("x.text")), 1, 10).alias("q"))
    answers = rows.where("role = 'assistant'").select("conv_id", F.col("text").alias("answer"), clean("text").alias("a"))
    met = asked.join(answers, "conv_id").withColumn("common", F.filter("q", lambda w: F.array_contains("a", w))).where("size(common) > 0")
    scored = met.withColumn("gap", arrays.least_span(F.col("common"), F.col("a"))).select("conv_id", (-F.size("common")).alias("fewest"), "gap", F.length("answer").alias("size"), "answer")
    best = groups.argmin(scored, "conv_id", "fewest", "gap", "size", "answer")
    return best.select("conv_id", (-F.col("fewest")).cast("long").alias("words"), "gap", F.md5("answer").alias("answer"))
