"""Queries that apply the scalar functions, arrangements, trees, drawings and rules to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import arrays, combinations, geometry, numbers
from tessella.functions import text as T
from tessella.operators import graph, images, rules, sequences, trees
from tessella.plans.registry import register
from tessella.plans.report_queries import _EDGES, hierarchy
from tessella.session import table
from tessella.sources import files, markup


@register("gcd_fold", "SELECT o_orderkey, gcd(o_orderkey, o_custkey) AS g, gcd(gcd(o_orderkey, o_custkey), 360) AS g3 FROM orders")
def gcd_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.gcd(a, b).alias("g"), numbers.gcd_of(F.array(a, b, F.lit(360).cast("long"))).alias("g3"))


@register("bezout", "SELECT o_orderkey, gcd(o_orderkey + 1, o_custkey + 1) AS g, true AS holds FROM orders")
def bezout(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("o_orderkey") + 1, F.col("o_custkey") + 1
    rows = table(spark, sf_dir, "orders").withColumn("x", numbers.bezout(a, b))
    return rows.select("o_orderkey", F.col("x.g").alias("g"), (a * F.col("x.m") + b * F.col("x.n") == F.col("x.g")).alias("holds"))


@register("primes", "SELECT p_partkey, NOT EXISTS (SELECT 1 FROM range(2, 1500) r(d) WHERE d * d <= p_partkey AND p_partkey % d = 0) AS prime FROM part WHERE p_partkey >= 1")
def primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey >= 1").select("p_partkey", numbers.is_prime(F.col("p_partkey")).alias("prime"))


@register("factorials", "SELECT DISTINCT p_size % 20 AS n, CAST(factorial(CAST(p_size % 20 AS INT)) AS BIGINT) AS f FROM part")
def factorials(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 20
    return table(spark, sf_dir, "part").select(n.alias("n"), numbers.factorial(n).alias("f")).distinct()


@register(
    "modular_roots",
    """WITH a AS (SELECT r * r % 101 AS k, string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) AS roots FROM range(0, 101) t(r) GROUP BY 1), b AS (SELECT r * r % 143 AS k, string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) AS roots FROM range(0, 143) t(r) GROUP BY 1)
    SELECT p_partkey, coalesce(a.roots, '') AS roots, coalesce(b.roots, '') AS roots2 FROM part LEFT JOIN a ON a.k = p_partkey % 101 LEFT JOIN b ON b.k = p_partkey % 143""",
)
def modular_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square roots modulo 101, and modulo 11 times 13."""
    s = F.col("p_partkey")
    joined = lambda a: F.array_join(a.cast("array<string>"), ",")
    one = numbers.square_roots(s, F.lit(101).cast("long"))
    two = numbers.square_roots_of_product(s, F.lit(11).cast("long"), F.lit(13).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", joined(one).alias("roots"), joined(two).alias("roots2"))


@register("pairing", "SELECT o_orderkey, CAST((o_orderkey + o_custkey) * (o_orderkey + o_custkey + 1) // 2 + o_custkey AS VARCHAR) AS single, o_orderkey AS i, o_custkey AS j FROM orders")
def pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numbers as one, and back."""
    rows = table(spark, sf_dir, "orders").withColumn("s", numbers.pair_to_single(F.col("o_orderkey"), F.col("o_custkey")))
    back = numbers.single_to_pair(F.col("s"))
    return rows.select("o_orderkey", F.col("s").cast("string").alias("single"), back["i"].alias("i"), back["j"].alias("j"))


@register(
    "level_index",
    """SELECT o_orderkey, round(CASE WHEN ln(ln(ln(x))) <= 1 AND ln(ln(x)) > 1 THEN 3 + ln(ln(ln(x))) WHEN ln(ln(x)) <= 1 AND ln(x) > 1 THEN 2 + ln(ln(x)) END, 6) AS sli, round(x, 2) AS back FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)""",
)
def level_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = numbers.to_level_index(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(s, 6).alias("sli"), F.round(numbers.from_level_index(s), 2).alias("back"))


@register(
    "level_index_sums",
    """WITH v AS (SELECT o_orderkey, o_totalprice AS x, 1.0 + o_custkey AS y FROM orders), r AS (SELECT o_orderkey, x + y AS a, abs(x - y) AS d, sign(x - y) AS s FROM v)
    SELECT o_orderkey, round(CASE WHEN ln(ln(a)) > 1 THEN 3 + ln(ln(ln(a))) WHEN ln(a) > 1 THEN 2 + ln(ln(a)) ELSE 1 + ln(a) END, 6) AS plus,
      round(s * CASE WHEN d <= 1 THEN d WHEN ln(d) <= 1 THEN 1 + ln(d) WHEN ln(ln(d)) <= 1 THEN 2 + ln(ln(d)) ELSE 3 + ln(ln(ln(d))) END, 6) AS minus FROM r""",
)
def level_index_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and differences of orders' prices and customers' numbers, without leaving the level index."""
    x, y = numbers.to_level_index(F.col("o_totalprice")), numbers.to_level_index(1 + F.col("o_custkey").cast("double"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), y.alias("y"))
    plus, minus = numbers.add_level_index(F.col("x"), F.col("y")), numbers.subtract_level_index(F.col("x"), F.col("y"))
    return rows.select("o_orderkey", F.round(plus, 6).alias("plus"), F.round(minus, 6).alias("minus"))


@register("base_digits", "SELECT c_custkey, lower(to_base(c_custkey, 36)) AS base36, to_base(c_custkey, 2) AS base2, c_custkey AS back FROM customer")
def base_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    coded = table(spark, sf_dir, "customer").select("c_custkey", T.encode_digits(F.col("c_custkey"), digits).alias("base36"), T.encode_digits(F.col("c_custkey"), "01").alias("base2"))
    return coded.withColumn("back", T.decode_digits(F.col("base36"), digits).cast("long"))


@register("base_93", "SELECT page_id, md5(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS back, true AS plain FROM pages")
def base_93(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in plain characters, and back."""
    rows = table(spark, sf_dir, "pages").select("page_id", T.encode_93(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("e"))
    return rows.select("page_id", F.md5(T.decode_93(F.col("e"))).alias("back"), (~F.col("e").rlike("[^\\x20-\\x7e]")).alias("plain"))


@register(
    "text_functions",
    r"""SELECT c_custkey, trim(regexp_replace('  ' || c_name || chr(9) || ' ' || c_mktsegment || ' ', '\s+', ' ', 'g')) AS collapsed, regexp_replace('<b>' || c_name || '</b><br/>', '<[^>]*>', '', 'g') AS bare,
    'GUID-' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS guid, c_mktsegment || ' end' AS once, regexp_replace('a b ' || c_name, ' ', '%20', 'g') AS blanks FROM (SELECT *, md5(c_name) AS m FROM customer)""",
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        T.collapse(F.concat(F.lit("  "), n, F.lit("\t "), s, F.lit(" "))).alias("collapsed"),
        T.without_tags(F.concat(F.lit("<b>"), n, F.lit("</b><br/>"))).alias("bare"),
        T.guid_of(n).alias("guid"),
        T.without_repeats(F.concat_ws(" ", s, s, F.lit("end end"))).alias("once"),
        T.encode_blanks(F.concat(F.lit("a b "), n)).alias("blanks"),
    )


@register(
    "dates_in_text",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS written FROM orders",
)
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates put into sentences and taken out again."""
    rows = table(spark, sf_dir, "orders")
    iso = F.concat(F.lit("due on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" at 5"))
    written = F.concat(F.lit("Signed "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("."))
    return rows.select("o_orderkey", T.extract_date(iso).cast("string").alias("iso"), T.extract_date(written).cast("string").alias("written"))


@register(
    "path_algebra",
    "SELECT s_suppkey, '/a/' || s_nationkey || '/y.xml' AS up, '/a/b/' || s_suppkey AS beside, '/z' AS top, 'f' || s_suppkey AS file, 't' AS topic, 'i' || s_nationkey AS id FROM supplier",
)
def path_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.lit("/a/b/x.xml")
    nation, key = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    part = T.split_reference(F.concat(F.lit("f"), key, F.lit("#t/i"), nation))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        T.absolute_path(base, F.concat(F.lit("../"), nation, F.lit("/./y.xml"))).alias("up"),
        T.absolute_path(base, key).alias("beside"),
        T.absolute_path(base, F.lit("../../../z")).alias("top"),
        part["file"].alias("file"),
        part["topic"].alias("topic"),
        part["id"].alias("id"),
    )


_CIRCLES = "SELECT o_orderkey, o_custkey % 50 AS x, o_orderkey % 40 AS y, 1 + o_custkey % 9 AS r, o_orderkey % 50 AS x2, o_custkey % 40 AS y2, 1 + o_orderkey % 11 AS r2 FROM orders"


def _circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = "cast({} as double)"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", *(f"{whole.format(e)} as {n}" for e, n in (("o_custkey % 50", "x"), ("o_orderkey % 40", "y"), ("1 + o_custkey % 9", "r"), ("o_orderkey % 50", "x2"), ("o_custkey % 40", "y2"), ("1 + o_orderkey % 11", "r2"))))


@register(
    "circle_overlap",
    f"""WITH c AS ({_CIRCLES}), d AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS d FROM c),
    a AS (SELECT *, CASE WHEN d < r + r2 AND d > abs(r - r2) THEN acos(greatest(-1, least(1, (d * d + r * r - r2 * r2) / (2 * d * r)))) END AS p, CASE WHEN d < r + r2 AND d > abs(r - r2) THEN acos(greatest(-1, least(1, (d * d + r2 * r2 - r * r) / (2 * d * r2)))) END AS q FROM d)
    SELECT o_orderkey, round(CASE WHEN d >= r + r2 THEN 0.0 WHEN d <= abs(r - r2) THEN 1.0 ELSE (r * r * (p - sin(2 * p) / 2) + r2 * r2 * (q - sin(2 * q) / 2)) / (pi() * least(r, r2) * least(r, r2)) END, 6) AS overlap,
    CASE WHEN abs(x - x2) + abs(y - y2) + abs(r - r2) = 0 THEN -1 WHEN d > r + r2 OR d < abs(r - r2) OR d = 0 THEN 0 WHEN d = r + r2 OR d = abs(r - r2) THEN 1 ELSE 2 END AS points FROM a""",
)
def circle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(n) for n in ("x", "y", "r", "x2", "y2", "r2")]
    points = F.coalesce(F.size(geometry.circle_points(*c)), F.lit(-1))
    same = F.coalesce(geometry.circle_points(*c).isNull(), F.lit(False))
    return _circles(spark, sf_dir).select("o_orderkey", F.round(geometry.circle_overlap(*c), 6).alias("overlap"), F.when(same, -1).otherwise(points).alias("points"))


@register(
    "triangle_kinds",
    """WITH t AS (SELECT p_partkey, p_size % 5 AS x1, p_partkey % 4 AS y1, p_partkey % 7 AS x2, p_size % 3 AS y2, (p_partkey + p_size) % 6 AS x3, (2 * p_partkey) % 5 AS y3 FROM part),
    s AS (SELECT *, abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2.0 AS area, (x2 - x3) ** 2 + (y2 - y3) ** 2 AS a, (x1 - x3) ** 2 + (y1 - y3) ** 2 AS b, (x1 - x2) ** 2 + (y1 - y2) ** 2 AS c FROM t),
    f AS (SELECT *, a = b OR b = c OR a = c AS two, a + b = c OR b + c = a OR a + c = b AS square FROM s)
    SELECT CASE WHEN area = 0 THEN 'flat' WHEN a = b AND b = c THEN 'equilateral' WHEN two AND square THEN 'right isosceles' WHEN two THEN 'isosceles' WHEN square THEN 'right' ELSE 'scalene' END AS kind, count(*) AS n, round(sum(area), 4) AS area FROM f GROUP BY 1""",
)
def triangle_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = ("p_size % 5", "p_partkey % 4", "p_partkey % 7", "p_size % 3", "(p_partkey + p_size) % 6", "(2 * p_partkey) % 5")
    c = [F.expr(f"cast({e} as double)") for e in corner]
    return table(spark, sf_dir, "part").groupBy(geometry.triangle_kind(*c).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(geometry.triangle_area(*c)), 4).alias("area"))


@register(
    "polygon_areas",
    "SELECT n_regionkey, round(abs(sum(x * ny - nx * y)) / 2, 4) AS area FROM (SELECT n_regionkey, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM (SELECT n_regionkey, n_nationkey, CAST(n_nationkey * 7 % 11 AS DOUBLE) AS x, CAST(n_nationkey * 3 % 13 AS DOUBLE) AS y FROM nation) WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) GROUP BY 1",
)
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = F.struct("n_nationkey", F.expr("cast(n_nationkey * 7 % 11 as double)").alias("x"), F.expr("cast(n_nationkey * 3 % 13 as double)").alias("y"))
    shapes = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(corner)).alias("c"))
    return shapes.select("n_regionkey", F.round(geometry.polygon_area(F.col("c.x"), F.col("c.y")), 4).alias("area"))


@register(
    "array_functions",
    "WITH c AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY 1) SELECT o_custkey, a[1] AS first, a[-1] AS last, len(a) AS n, len(list_filter(a, lambda v: v < 500)) AS less, len(list_filter(a, lambda v: v > 500)) AS greater, CAST(coalesce(list_position(a, a[2]), 0) AS BIGINT) AS place, len(a) >= 2 AS holds FROM c",
)
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    pair = F.array(F.get(a, 0), F.get(a, F.size(a) - 1))
    return lists.select(
        "o_custkey",
        arrays.shift(a)["value"].alias("first"),
        arrays.pop(a)["value"].alias("last"),
        F.size(a).cast("long").alias("n"),
        arrays.count_less(a, F.lit(500)).cast("long").alias("less"),
        arrays.count_greater(a, F.lit(500)).cast("long").alias("greater"),
        F.coalesce(arrays.index_of(a, F.get(a, 1)), F.lit(0)).cast("long").alias("place"),
        (arrays.has_subsequence(pair, a) & (F.size(a) >= 2)).alias("holds"),
    )


_FOUR = "SELECT p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand, CAST(p_size AS VARCHAR)] AS v FROM part"


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two words of each part's name, its brand and its size."""
    name = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array(name[0], name[1], F.col("p_brand"), F.col("p_size").cast("string")).alias("v"))


_PERMUTED = "SELECT p_partkey, a, b, c, d, v[a] || v[b] || v[c] || v[d] AS word FROM ({0}), range(1, 5) t1(a), range(1, 5) t2(b), range(1, 5) t3(c), range(1, 5) t4(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d".format(_FOUR)


@register("permutations", f"SELECT p_partkey, word FROM ({_PERMUTED})")
def permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of four things that each part has."""
    return combinations.permutations(_four(spark, sf_dir), "v", 4).select("p_partkey", F.array_join("arrangement", "").alias("word"))


@register("derangements", f"SELECT p_partkey, word FROM ({_PERMUTED}) WHERE a <> 1 AND b <> 2 AND c <> 3 AND d <> 4")
def derangements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combinations.derangements(_four(spark, sf_dir), "v", 4).select("p_partkey", F.array_join("arrangement", "").alias("word"))


@register(
    "subsets",
    f"SELECT p_partkey, CASE WHEN m % 2 = 1 THEN v[1] ELSE '' END || CASE WHEN m // 2 % 2 = 1 THEN v[2] ELSE '' END || CASE WHEN m // 4 % 2 = 1 THEN v[3] ELSE '' END || CASE WHEN m // 8 % 2 = 1 THEN v[4] ELSE '' END AS word FROM ({_FOUR}), range(0, 16) t(m)",
)
def subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combinations.subsets(_four(spark, sf_dir), "v", 4).select("p_partkey", F.array_join("subset", "").alias("word"))


@register("block_permutations", f"SELECT p_partkey, v[a] || v[b] || v[c] || v[d] AS word FROM ({_FOUR}), range(1, 3) t1(a), range(1, 3) t2(b), range(3, 5) t3(c), range(3, 5) t4(d) WHERE a <> b AND c <> d")
def block_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a name in any order, then brand and size in any order."""
    blocks = _four(spark, sf_dir).select("p_partkey", F.array(F.slice("v", 1, 2), F.slice("v", 3, 2)).alias("blocks"))
    return combinations.permutations_in_blocks(blocks, "blocks", 2).select("p_partkey", F.array_join("arrangement", "").alias("word"))


@register("cartesian", "SELECT s_suppkey, n_name, r_name FROM supplier, nation, region WHERE s_nationkey < n_nationkey AND length(r_name) > 4")
def cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with each nation that comes after its own, and each region with a long name; nations and regions are 25 and 5."""
    sets = [table(spark, sf_dir, name).select(*columns) for name, columns in (("supplier", ["s_suppkey", "s_nationkey"]), ("nation", ["n_nationkey", "n_name"]), ("region", ["r_name"]))]
    return combinations.cartesian(*sets).where("s_nationkey < n_nationkey and length(r_name) > 4").select("s_suppkey", "n_name", "r_name")


@register("sorted_runs", "SELECT user_id, count(*) AS events, 1 + count(*) FILTER (v < p) AS runs FROM (SELECT user_id, event_type AS v, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1")
def sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into how many runs that do not fall each user's event types are cut."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(ordered.alias("v"))
    return sequences.sorted_runs(lists, "v").select("user_id", F.size("v").cast("long").alias("events"), F.size("runs").cast("long").alias("runs"))


@register("closure", f"WITH RECURSIVE e AS ({_EDGES}), c(a, b, steps) AS (SELECT a, b, 1 FROM e UNION SELECT c.a, e.b, c.steps + 1 FROM c JOIN e ON c.b = e.a) SELECT a, b, min(steps) AS steps FROM c GROUP BY 1, 2")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(hierarchy(spark, sf_dir))


@register(
    "hoisted_values",
    """WITH v AS (SELECT 's' || s_suppkey AS s, 'n' || s_nationkey AS n, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_acctbal < 8000 THEN 'low' ELSE 'high' END AS value FROM supplier),
    u AS (SELECT s AS node, value FROM v UNION ALL SELECT n, value FROM v UNION ALL SELECT 'r' || n_regionkey, value FROM v JOIN nation ON n = 'n' || n_nationkey)
    SELECT node, CASE WHEN min(value) = max(value) THEN min(value) END AS value, min(value) < max(value) AS many FROM u WHERE value IS NOT NULL GROUP BY node""",
)
def hoisted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of suppliers, nations and regions: the rating that all suppliers below agree in, or that they differ; every fourth supplier has none."""
    suppliers = table(spark, sf_dir, "supplier")
    rating = F.when(F.col("s_suppkey") % 4 != 0, F.when(F.col("s_acctbal") < 8000, "low").otherwise("high"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    values = suppliers.select(name("s", "s_suppkey").alias("node"), rating.alias("value"))
    links = suppliers.select(name("n", "s_nationkey").alias("above"), name("s", "s_suppkey").alias("below"))
    links = links.unionByName(table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("above"), name("n", "n_nationkey").alias("below")))
    return graph.unanimous(links, values)


@register("paths", f"WITH RECURSIVE e AS ({_EDGES}), p(root, node, path) AS (SELECT DISTINCT a, a, a FROM e WHERE a LIKE 'r%' UNION ALL SELECT root, e.b, path || '/' || e.b FROM p JOIN e ON p.node = e.a) SELECT * FROM p")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = hierarchy(spark, sf_dir)
    roots = edges.where("a like 'r%'").select(F.col("a").alias("node")).distinct()
    return graph.paths(edges, roots, 2).select("root", "node", F.array_join("path", "/").alias("path"))


@register("components", f"WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, o) AS (SELECT a, a FROM u UNION SELECT r.n, u.b FROM r JOIN u ON u.a = r.o) SELECT n AS node, min(o) AS component FROM r GROUP BY 1")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(hierarchy(spark, sf_dir))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree, node, path: a tree for each region, of its nations and their suppliers."""
    nation, supplier, region = (table(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    n = nation.selectExpr("n_regionkey as tree", "concat('n', n_nationkey) as node", "concat('r', n_regionkey) as parent", "n_nationkey as pos")
    s = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).selectExpr("n_regionkey as tree", "concat('s', s_suppkey) as node", "concat('n', s_nationkey) as parent", "s_suppkey as pos")
    r = region.selectExpr("r_regionkey as tree", "concat('r', r_regionkey) as node", "cast(null as string) as parent", "r_regionkey as pos")
    return trees.from_parents(r.unionByName(n, True).unionByName(s, True), 2)


_TREE = """SELECT r_regionkey AS tree, 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, -1 AS k1, -1 AS k2 FROM region
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, -1 FROM nation
  UNION ALL SELECT n_regionkey, 's' || s_suppkey, 'n' || s_nationkey, s_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@register(
    "tree_order",
    f"SELECT tree, node, CAST(row_number() OVER (PARTITION BY tree ORDER BY k1, k2) AS INT) AS pre, CAST(row_number() OVER (PARTITION BY tree ORDER BY CASE WHEN k1 = -1 THEN 1000000 ELSE k1 END, CASE WHEN k2 = -1 THEN 1000000 ELSE k2 END) AS INT) AS post, CAST(row_number() OVER (PARTITION BY tree ORDER BY k1 DESC, k2 DESC) AS INT) AS reversed FROM ({_TREE})",
)
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.ranks(_tree(spark, sf_dir)).select("tree", "node", "pre", "post", "reversed")


@register(
    "tree_places",
    f"""WITH t AS ({_TREE}), c AS (SELECT t.*, count(*) OVER w AS n, row_number() OVER (PARTITION BY parent ORDER BY k1, k2) AS up, row_number() OVER (PARTITION BY parent ORDER BY k1 DESC, k2 DESC) AS down FROM t WINDOW w AS (PARTITION BY parent))
    SELECT tree, node, CASE WHEN k1 = -1 THEN 0 WHEN k2 = -1 THEN 1 ELSE 2 END AS depth, k1 = -1 OR up = 1 AS is_first, k1 = -1 OR down = 1 AS is_last, k1 = -1 AS is_top, k1 = -1 OR n = 1 AS is_only, node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) AS is_empty FROM c""",
)
def tree_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.located(_tree(spark, sf_dir)).drop("path")


@register("tree_ancestors", f"WITH RECURSIVE t AS ({_TREE}), a(tree, node, ancestor, distance) AS (SELECT tree, node, parent, 1 FROM t WHERE parent IS NOT NULL UNION ALL SELECT a.tree, a.node, t.parent, a.distance + 1 FROM a JOIN t ON a.ancestor = t.node WHERE t.parent IS NOT NULL) SELECT * FROM a")
def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.ancestors(_tree(spark, sf_dir))


@register(
    "siblings_between",
    f"WITH t AS ({_TREE}), n AS (SELECT tree, parent, arg_min(node, k2) AS start, arg_max(node, k2) AS finish FROM t WHERE k2 >= 0 GROUP BY 1, 2) SELECT n.tree, n.start, n.finish, t.node FROM n JOIN t a ON a.node = n.start JOIN t b ON b.node = n.finish JOIN t ON t.parent = n.parent WHERE t.k2 > a.k2 AND t.k2 < b.k2",
)
def siblings_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers between the first and the last of each nation."""
    tree = _tree(spark, sf_dir)
    spans = tree.where(F.size("path") == 2).groupBy("tree", trees.parent_path(F.col("path"))).agg(F.min_by("node", "path").alias("start"), F.max_by("node", "path").alias("finish"))
    return trees.siblings_between(tree, spans.select("tree", "start", "finish"))


@register(
    "common_ancestors",
    f"WITH t AS ({_TREE}), s AS (SELECT tree, node, parent, k2, lead(node) OVER w AS b, lead(parent) OVER w AS bp FROM t WHERE k2 >= 0 WINDOW w AS (PARTITION BY tree ORDER BY k2)) SELECT tree, node AS a, b, CASE WHEN parent = bp THEN parent ELSE 'r' || tree END AS ancestor FROM s WHERE b IS NOT NULL",
)
def common_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest node above each supplier of a region and the next one by number."""
    tree = _tree(spark, sf_dir)
    order = W.partitionBy("tree").orderBy(F.substring("node", 2, 20).cast("long"))
    pairs = tree.where(F.size("path") == 2).select("tree", F.col("node").alias("a"), F.lead("node").over(order).alias("b")).where("b is not null")
    return trees.common_ancestors(tree, pairs)


@register(
    "outermost_leaves",
    f"""WITH t AS ({_TREE}), leaf AS (SELECT * FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL))
    SELECT p.tree, p.node, arg_min(l.node, CAST(l.k1 AS BIGINT) * 100000000 + l.k2) AS first, arg_max(l.node, CAST(l.k1 AS BIGINT) * 100000000 + l.k2) AS last, count(*) AS n FROM t p JOIN leaf l ON l.tree = p.tree AND l.node <> p.node AND (p.k1 = -1 OR p.k2 = -1 AND p.k1 = l.k1) GROUP BY 1, 2""",
)
def outermost_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.outermost(_tree(spark, sf_dir))


@register(
    "leaves_and_parents",
    f"WITH t AS ({_TREE}) SELECT tree, node, CASE WHEN node IN (SELECT parent FROM t WHERE parent IS NOT NULL) THEN 'parent' ELSE 'leaf' END AS kind FROM t",
)
def leaves_and_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    kinds = trees.leaves(tree).withColumn("kind", F.lit("leaf")).unionByName(trees.parents(tree).withColumn("kind", F.lit("parent")))
    return kinds.select("tree", "node", "kind")


@register(
    "tree_contexts",
    f"SELECT t.tree, t.node, t.node || CASE WHEN t.k2 >= 0 THEN '<' || t.parent ELSE '' END || CASE WHEN t.k1 >= 0 THEN '<r' || t.tree ELSE '' END AS context FROM ({_TREE}) t",
)
def tree_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node with all above it, the root last."""
    return trees.context(_tree(spark, sf_dir), "node").select("tree", "node", F.array_join("context", "<").alias("context"))


@register(
    "tree_steps",
    f"""WITH t AS ({_TREE}), c AS (SELECT tree, parent, node, row_number() OVER (PARTITION BY parent ORDER BY k1, k2) AS k FROM t WHERE parent IS NOT NULL)
    SELECT r.tree, r.node, b.node AS found FROM t r LEFT JOIN c a ON a.parent = r.node AND a.k = 2 LEFT JOIN c b ON b.parent = a.node AND b.k = 3 WHERE r.k1 = -1""",
)
def tree_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each region's root: the third supplier of its second nation."""
    tree = _tree(spark, sf_dir)
    asked = tree.where(F.size("path") == 0).select("tree", "node", F.array(F.lit(1), F.lit(2)).alias("steps"))
    return trees.at_path(tree, asked).select("tree", "node", "found")


@register(
    "transformed_lists",
    "SELECT p_partkey, array_to_string([v[(a + s * 0) % 4 + 1], v[(a + s * 1) % 4 + 1], v[(a + s * 2) % 4 + 1], v[(a + s * 3) % 4 + 1]], '') AS word FROM ({0}), range(0, 4) t1(a), (SELECT unnest([1, 3]) AS s)".format(_FOUR),
)
def transformed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight orders that turning and mirroring four things on a ring reach."""
    return combinations.transforms(_four(spark, sf_dir), "v", [[1, 2, 3, 0], [0, 3, 2, 1]]).select("p_partkey", F.array_join("arrangement", "").alias("word"))


@register(
    "triangle_centres",
    """WITH t AS (SELECT p_partkey, CAST(p_size % 5 AS DOUBLE) AS x1, CAST(p_partkey % 4 AS DOUBLE) AS y1, CAST(p_partkey % 7 AS DOUBLE) AS x2, CAST(p_size % 3 AS DOUBLE) AS y2, CAST((p_partkey + p_size) % 6 AS DOUBLE) AS x3, CAST((2 * p_partkey) % 5 AS DOUBLE) AS y3 FROM part),
    s AS (SELECT *, abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2 AS area, sqrt((x2 - x3) * (x2 - x3) + (y2 - y3) * (y2 - y3)) AS a, sqrt((x1 - x3) * (x1 - x3) + (y1 - y3) * (y1 - y3)) AS b, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS c FROM t)
    SELECT p_partkey, round((x1 + x2 + x3) / 3, 6) AS middle, CASE WHEN area > 0 THEN round(2 * area / (a + b + c), 6) END AS inner_r, CASE WHEN area > 0 THEN round(2 * area / (b + c - a), 6) END AS outer_r,
      CASE WHEN area > 0 THEN round(a * b * c / (8 * area), 6) END AS nine_r, area = 0 AS flat, CASE WHEN c > 0 THEN round(2 * area / c, 6) END AS height FROM s""",
)
def triangle_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = ("p_size % 5", "p_partkey % 4", "p_partkey % 7", "p_size % 3", "(p_partkey + p_size) % 6", "(2 * p_partkey) % 5")
    c = [F.expr(f"cast({e} as double)") for e in corner]
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(geometry.centroid(*c)["x"], 6).alias("middle"),
        F.round(geometry.incircle(*c)["r"], 6).alias("inner_r"),
        F.round(geometry.excircles(*c)[0]["r"], 6).alias("outer_r"),
        F.round(geometry.nine_point_circle(*c)["r"], 6).alias("nine_r"),
        geometry.collinear(*c).alias("flat"),
        F.round(geometry.distance_to_line(*c[4:], *c[:4]), 6).alias("height"),
    )


_DOTS = "SELECT DISTINCT c_mktsegment AS image, c_nationkey AS x, CAST(floor(c_acctbal / 500) AS INT) AS y FROM customer"


def _dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_mktsegment as image", "c_nationkey as x", "cast(floor(c_acctbal / 500) as int) as y").distinct()


@register("pixel_bounds", f"SELECT image, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM ({_DOTS}) GROUP BY 1")
def pixel_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.bounds(_dots(spark, sf_dir))


@register(
    "pixel_parts",
    f"""WITH RECURSIVE d AS ({_DOTS}), u AS (SELECT a.image, a.x, a.y, b.x AS p, b.y AS q FROM d a JOIN d b ON a.image = b.image AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
    r(image, x, y, p, q) AS (SELECT image, x, y, x, y FROM d UNION SELECT r.image, r.x, r.y, u.p, u.q FROM r JOIN u ON u.image = r.image AND u.x = r.p AND u.y = r.q)
    SELECT image, part, count(*) AS n FROM (SELECT image, x, y, min(p * 1000 + q + 100) AS part FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def pixel_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected parts of three pixels or more, with their smallest pixel and size."""
    return images.parts(_dots(spark, sf_dir), 3).groupBy("image", (F.col("part.x") * 1000 + F.col("part.y") + 100).alias("part")).agg(F.count("*").alias("n"))


@register(
    "pixel_widths",
    f"""WITH d AS ({_DOTS}), l AS (SELECT image, 'row' AS direction, y AS line, x AS k FROM d UNION ALL SELECT image, 'column', x, y FROM d UNION ALL SELECT image, 'falling', x - y, x FROM d UNION ALL SELECT image, 'rising', x + y, x FROM d)
    SELECT image, direction, max(n) AS longest FROM (SELECT image, direction, line, i, count(*) AS n FROM (SELECT *, k - row_number() OVER (PARTITION BY image, direction, line ORDER BY k) AS i FROM l) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
)
def pixel_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.widths(_dots(spark, sf_dir))


#: A rule text: links of navigation lists become references, breaks go, paragraphs of articles are body text.
RULES = """Navigation
  rename xref a li ul
Breaks   # nothing stands in them
  delete br
Body text
  rename body p
  explode p
"""


@register("page_nodes")
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all pages by tag and depth. Markup is read by a parser, which SQL can't express."""
    nodes = markup.nodes(table(spark, sf_dir, "pages"), "page_id", "html")
    return nodes.groupBy("tag", "depth").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


@register("rule_hits")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rule text does to the nodes of all pages: hits of each rule."""
    nodes = markup.nodes(table(spark, sf_dir, "pages"), "page_id", "html").where("tag <> 'CDATA'")
    own = nodes.select("file", "node", "parent", "tag")
    for k in (1, 2):  # parents' and grandparents' tags, as deep as the rules look
        up = nodes.select("file", F.col("node").alias("parent"), F.col("tag").alias(f"tag{k}"), F.col("parent").alias("next"))
        own = own.join(up, ["file", "parent"], "left").drop("parent").withColumnRenamed("next", "parent")
    context = own.select("file", "node", F.array_compact(F.array("tag", "tag1", "tag2")).alias("context"))
    lines = files.lines(spark.createDataFrame([("given", RULES)], "file string, text string"), "file", "text")
    parsed = rules.parse(lines, "file", "number", "line")
    return rules.statistics(rules.apply(context, parsed), parsed)


@register(
    "navigation_maps",
    """SELECT n_regionkey, md5('<map>' || chr(10) || string_agg('  <topicref href="n' || n_nationkey || '" navtitle="' || n_name || '"/>', chr(10) ORDER BY 'n' || n_nationkey) || chr(10) || '</map>') AS xml FROM nation GROUP BY 1""",
)
def navigation_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of each region's nations."""
    entries = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("href"), F.col("n_name").alias("title"))
    return files.xml_map(entries, "n_regionkey", "href", "title").select("n_regionkey", F.md5("xml").alias("xml"))


@register("content_names", r"""SELECT part.p_partkey, left(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), 32) || '_' || md5(p_name) || '.dita' AS name FROM part""")
def content_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", files.content_name(F.col("p_name"), "dita").alias("name"))


#: A page behind comments that hold its address and language, as a report's trailer would.
_COMMENTED = "concat('<!--url: ', url, '--> <!--lang: ', regexp_extract(html, 'lang=\"([a-z]+)\"', 1), '--> ', html)"
_COMMENT = r"<!--\s*([a-zA-Z_]\w*):\s*(.*?)\s*-->"


@register(
    "comment_attributes",
    f"""WITH c AS (SELECT page_id, {_COMMENTED} AS t FROM pages), p AS (SELECT page_id, unnest(regexp_extract_all(t, '{_COMMENT}', 1)) AS name, unnest(regexp_extract_all(t, '{_COMMENT}', 2)) AS value FROM c)
    SELECT page_id AS file, name, min(value) AS value FROM p GROUP BY 1, 2""",
)
def comment_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names and values in the comments of pages that begin with two."""
    named = table(spark, sf_dir, "pages").select("page_id", F.expr(_COMMENTED).alias("text"))
    return files.comment_attributes(named, "page_id", "text").select("file", F.explode("attributes").alias("name", "value"))
