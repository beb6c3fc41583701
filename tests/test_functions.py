import math
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import arrays, combinations, geometry, numbers
from tessella.functions import text as T


def one(spark, column, kind="string", **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.trim, " \t a b\n ", "a b"),
        (T.collapse, "  a \n b  ", "a b"),
        (T.words, "What's up, Doc?", ["what", "s", "up", "doc"]),
        (T.words, " a", ["", "a"]),
        (T.letter_words, "Tea, make2 abcdefghijklmnop", ["tea", "make"]),
        (T.without_tags, "<a href='x'>y</a>", "y"),
        (T.without_repeats, "a a b  b a", "a b a"),
        (T.encode_blanks, "a b", "a%20b"),
        (T.decode_percent, "a%20b+c%C3%A9", "a b+cé"),
        (T.name_of_title, " Big Title 12 ", "big_title_"),
        (T.encode_93, "aé12é", "a233~49~50~233"),
        (T.decode_93, "a233~49~50~233", "aé12é"),
        (T.guid_of, "a", "GUID-0cc175b9-c0f1-b6a8-31c3-99e269772661"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f(F.col("t")), t=given) == want


def test_nulls_stay_null(spark):
    null = F.lit(None).cast("string")
    for f in (T.trim, T.collapse, T.words, T.without_tags, T.encode_blanks, T.decode_percent, T.encode_93, T.decode_93, T.guid_of, T.extract_date):
        assert one(spark, f(null)) is None


def test_references_and_paths(spark):
    assert tuple(one(spark, T.split_reference(F.col("r")), r="a.dita#t/i")) == ("a.dita", "t", "i")
    assert tuple(one(spark, T.split_reference(F.col("r")), r="a.dita")) == ("a.dita", "", "")
    for base, rel, want in [("/a/b/c.x", "../d.x", "/a/d.x"), ("/a/b/c.x", "", "/a/b/c.x"), ("/a/b.x", "./e/../f.x", "/a/f.x"), ("/a", "/z//y", "/z/y")]:
        assert one(spark, T.absolute_path(F.col("b"), F.col("r")), b=base, r=rel) == want
    assert [one(spark, T.external(F.col("r")), r=x) for x in ("HTTP://x", "mailto:a", "www.x", "x/www")] == [True, True, True, False]


@pytest.mark.parametrize(("text", "want"), [("on 2024-02-29.", "2024-02-29"), ("5 March 2021 it", "2021-03-05"), ("July 4, 1999", "1999-07-04"), ("nothing", None), ("2024-13-45", None)])
def test_dates(spark, text, want):
    assert one(spark, T.extract_date(F.col("t")).cast("string"), t=text) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=12))
def test_digits_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for digits in ("01", "0123456789abcdef", "αβγ"):
        e = T.encode_digits(F.col("v"), digits)
        assert [r.b for r in df.select(T.decode_digits(e, digits).cast("long").alias("b")).collect()] == values


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10**6), st.integers(1, 10**6)), min_size=1, max_size=12))
def test_numbers(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", numbers.gcd(F.col("a"), F.col("b")).alias("g"), numbers.bezout(F.col("a"), F.col("b")).alias("z"), numbers.single_to_pair(numbers.pair_to_single(F.col("a"), F.col("b"))).alias("p")).collect():
        assert r.g == math.gcd(r.a, r.b) == r.z.g == r.a * r.z.m + r.b * r.z.n
        assert (r.p.i, r.p.j) == (r.a, r.b)


def test_roots_and_primes(spark):
    lit = lambda x: F.lit(x).cast("long")
    assert one(spark, numbers.square_roots(lit(4), lit(15))) == [2, 7, 8, 13]
    assert one(spark, numbers.square_roots_of_product(lit(4), lit(3), lit(5))) == [2, 7, 8, 13]
    primes = [r.id for r in spark.range(1, 40).where(numbers.is_prime(F.col("id"))).collect()]
    assert primes == [1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37]


@pytest.mark.parametrize("x", [0.0, 0.5, 1.0, math.e, -7.25, 1e6, 1e300])
def test_level_index_round_trip(spark, x):
    s = numbers.to_level_index(F.lit(x))
    assert one(spark, numbers.from_level_index(s)) == pytest.approx(x, rel=1e-9)


def test_geometry(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    kind = lambda *v: one(spark, geometry.triangle_kind(*lit(*v)))
    assert [kind(0, 0, 1, 0, 2, 0), kind(0, 0, 3, 0, 0, 4), kind(0, 0, 1, 0, 0, 1), kind(0, 0, 2, 0, 1, 5)] == ["flat", "right", "right isosceles", "isosceles"]
    assert kind(0, 0, 1, 0, 0.5, math.sqrt(3) / 2) == "equilateral"
    assert [tuple(p) for p in one(spark, geometry.circle_points(*lit(0, 0, 5, 8, 0, 5)))] == [(4.0, 3.0), (4.0, -3.0)]
    assert one(spark, geometry.circle_points(*lit(0, 0, 1, 9, 0, 1))) == [] and one(spark, geometry.circle_points(*lit(0, 0, 1, 0, 0, 1))) is None
    assert len(one(spark, geometry.circle_points(*lit(0, 0, 1, 2, 0, 1)))) == 1
    assert one(spark, geometry.circle_overlap(*lit(0, 0, 2, 0.5, 0, 1))) == 1.0 and one(spark, geometry.circle_overlap(*lit(0, 0, 1, 5, 0, 1))) == 0.0
    assert tuple(one(spark, geometry.line_meets_line(*lit(0, 0, 1, 1, 0, 2, 2, 0)))) == (1.0, 1.0)
    assert one(spark, geometry.line_meets_line(*lit(0, 0, 1, 1, 0, 1, 1, 2))) is None
    assert len(one(spark, geometry.circle_meets_line(*lit(0, 0, 1, -5, 0, 5, 0)))) == 2
    c = one(spark, geometry.circumcircle(*lit(1, 0, -1, 0, 0, 1)))
    assert (c.x, c.y, c.r) == pytest.approx((0, 0, 1))
    square = F.array(*lit(0, 2, 2, 0)), F.array(*lit(0, 0, 2, 2))
    assert one(spark, geometry.polygon_area(*square)) == 4.0


def test_arrays(spark):
    a = F.array(*map(F.lit, (3, 1, 4)))
    assert one(spark, arrays.push(a, F.lit(5))) == [3, 1, 4, 5] and one(spark, arrays.unshift(a, F.lit(5))) == [5, 3, 1, 4]
    assert tuple(one(spark, arrays.pop(a))) == (4, [3, 1]) and tuple(one(spark, arrays.shift(a))) == (3, [1, 4])
    assert one(spark, arrays.at(a, F.lit(-2))) == 1 and one(spark, arrays.at(a, F.lit(9))) is None
    assert [one(spark, f(a, F.lit(3))) for f in (arrays.index_of, arrays.count_less, arrays.count_greater)] == [1, 1, 1]
    words = lambda s: F.split(F.lit(s), " ")
    assert one(spark, arrays.span(words("a d"), words("a b c d"))) == 2
    assert one(spark, arrays.span(words("a d"), words("a b c"))) is None


def test_least_span_of_long_lists(spark):
    """As trying every start says, and in time: 100,000 elements, where every start looked at all that follow."""
    import random
    import time

    from pyspark.sql import functions as F

    def brute(q, a):
        def in_order(q, a):
            met = passed = 0
            for x in a:
                if met == len(q):
                    break
                met, passed = (met + 1, passed) if x == q[met] else (met, passed + 1)
            return passed if met == len(q) else None

        def any_order(a):
            for n in range(len(q), len(a) + 1):
                if all(a[:n].count(w) >= q.count(w) for w in q):
                    return n - len(q)

        tries = [next((x for x in (in_order(q, a[i:]), in_order(q[::-1], a[i:]), any_order(a[i:])) if x is not None), None) for i in range(len(a))]
        return min((x for x in tries if x is not None), default=None)

    r = random.Random(8)
    rows = [([r.choice("abcd") for _ in range(r.randint(0, 5))], [r.choice("abcdxy") for _ in range(r.randint(0, 25))]) for _ in range(400)]
    df = spark.createDataFrame(rows, "q array<string>, a array<string>").withColumn("got", arrays.least_span(F.col("q"), F.col("a")))
    assert [x.got for x in df.collect()] == [brute(q, a) for q, a in rows]
    began = time.time()
    long = spark.range(1).select(F.split(F.lit("a b c d"), " ").alias("q"), F.split(F.lit("a d x c c b " + "a x c y d " * 20_000 + "a b c z d"), " ").alias("a"))
    assert long.select(arrays.least_span(F.col("q"), F.col("a"))).first()[0] == 1 and time.time() - began < 30



def test_arrangements(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None)], "k int, v array<string>")
    got = lambda rows, c="arrangement": sorted("".join(r[c]) for r in rows.where("k = 1").collect())
    assert got(combinations.permutations(df, "v", 3)) == sorted("".join(p) for p in permutations("abc"))
    assert got(combinations.derangements(df, "v", 3)) == ["bca", "cab"]
    assert got(combinations.subsets(df, "v", 3), "subset") == ["", "a", "ab", "abc", "ac", "b", "bc", "c"]
    assert combinations.permutations(df, "v", 3).where("k = 3").count() == 0 and combinations.permutations(df, "v", 3).where("k = 2").count() == 1
    for make in (combinations.permutations, combinations.derangements, combinations.subsets):
        with pytest.raises(Exception, match="more than 2 elements: 3"):
            make(df, "v", 2).collect()
    blocks = spark.createDataFrame([([["a"], ["b"], ["c"]],)], "b array<array<string>>")
    with pytest.raises(Exception, match="more than 2 elements"):
        combinations.permutations_in_blocks(blocks, "b", 2).collect()


def test_pairs_of_large_numbers(spark):
    rows = [(200_000_007, 3), (2**40 + 5, 2**40 - 1), (0, 0), (0, 10**14), (10**14, 0), (7, 94_906_266)]
    df = spark.createDataFrame(rows, "a long, b long").select(numbers.single_to_pair(numbers.pair_to_single(F.col("a"), F.col("b"))).alias("p"))
    assert [(r.p.i, r.p.j) for r in df.collect()] == rows
    beyond = spark.createDataFrame([(2**49, 2**49)], "a long, b long").select(numbers.single_to_pair(numbers.pair_to_single(F.col("a"), F.col("b"))).alias("p"))
    with pytest.raises(Exception, match="no pair below"):
        beyond.collect()


def test_centres_of_triangles(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    of = lambda f, *v: one(spark, f(*lit(*v)))
    assert tuple(of(geometry.midpoint, 0, 0, 2, 4)) == (1, 2) and tuple(of(geometry.centroid, 0, 0, 3, 0, 0, 6)) == (1, 2)
    assert tuple(of(geometry.orthocentre, 0, 0, 3, 0, 0, 4)) == pytest.approx((0, 0))
    assert tuple(of(geometry.incircle, 0, 0, 3, 0, 0, 4)) == pytest.approx((1, 1, 1))
    assert tuple(of(geometry.nine_point_circle, 0, 0, 3, 0, 0, 4)) == pytest.approx((0.75, 1, 1.25))
    outer = of(geometry.excircles, 0, 0, 3, 0, 0, 4)
    assert [c.r for c in outer] == pytest.approx([6, 3, 2])  # area / (half the way around - the side): 6 / (6 - 5), 6 / (6 - 4), 6 / (6 - 3)
    assert (outer[0].x, outer[0].y) == pytest.approx((6, 6))
    assert of(geometry.collinear, 0, 0, 1, 1, 2, 2) and not of(geometry.collinear, 0, 0, 1, 1, 2, 3)
    for f in (geometry.orthocentre, geometry.incircle, geometry.excircles, geometry.nine_point_circle):
        assert of(f, 0, 0, 1, 1, 2, 2) is None
    assert of(geometry.distance_to_line, 0, 5, -1, 0, 7, 0) == 5 and of(geometry.distance_to_line, 0, 5, 1, 1, 1, 1) is None
    assert tuple(of(geometry.rotated, 2, 1, 1, 1, math.pi / 2)) == pytest.approx((1, 2))
    assert of(geometry.line_angle, 0, 0, 0, 3) == pytest.approx(math.pi / 2) and of(geometry.line_angle, 1, 1, 1, 1) is None
    assert of(geometry.circle_area, 2) == pytest.approx(4 * math.pi)


def test_hex_as_words(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda k: F.concat(F.lit("word"), F.lpad(k.cast("string"), 4, "x")))
    plain = lambda k: "word" + str(k).rjust(4, "x")

    def want(digits):
        out = []
        digits += "0" * (-len(digits) % 4)
        for k in range(0, len(digits), 4):
            n = int(digits[k : k + 4], 16)
            w = plain(n & 2047)
            out.append("".join(c.upper() if j < 5 and n >> (15 - j) & 1 else c for j, c in enumerate(w)))
        return "_".join(out)

    for digits in ("0000", "ffff", "8001", "deadBEEF12", "7"):
        assert one(spark, T.hex_as_words(F.lit(digits), words)) == want(digits)


def test_transforms(spark):
    df = spark.createDataFrame([(1, list("abcd")), (2, list("wxyz"))], "k int, v array<string>")
    ring = combinations.transforms(df, "v", [[1, 2, 3, 0]])
    assert sorted("".join(r.arrangement) for r in ring.where("k = 1").collect()) == ["abcd", "bcda", "cdab", "dabc"]
    assert combinations.transforms(df, "v", [[1, 0, 2, 3], [1, 2, 3, 0]]).count() == 2 * 24
    with pytest.raises(ValueError, match="each move"):
        combinations.transforms(df, "v", [[0, 0, 1, 2]])
    with pytest.raises(Exception, match="does not have 4 elements"):
        combinations.transforms(spark.createDataFrame([(1, ["a"])], "k int, v array<string>"), "v", [[1, 2, 3, 0]]).collect()
