import random

from tessella.operators import nesting


def plain(rows):
    out, stacks = [], {}
    for doc, at, level, name in sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1], x[2] is not None, x[2] or 0, x[3])):
        stack = stacks.setdefault(doc, [])
        if level is not None:
            while stack and stack[-1][0] >= level:
                stack.pop()
        out.append((doc, at, level, name, [n for _, n in stack]))
        if level is not None:
            stack.append((level, name))
    return sorted(map(repr, out))


def judge(spark, rows):
    df = spark.createDataFrame(rows, "file string, at int, level int, name string").repartition(3)
    found = nesting.under_headings(df, "file", ["at"], "level", "name")
    assert found.columns == [*df.columns, "trail"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain(rows)


def test_headings_of_any_depth(spark):
    """One document has most of the rows, and so lies in most ranges; a heading is open across several of them."""
    r = random.Random(9)
    rows = [("long", k, r.choice([None, None, None, 2, 3, 3, 4, 5, 7, 9]) if k % 97 else 1 + k % 3, f"h{k}") for k in range(3000)]
    rows += [("deep", k, k if k < 40 else None, f"d{k}") for k in range(400)]
    rows += [(None, k, r.choice([None, 1, 2]), f"n{k}") for k in range(30)] + [("plain", k, None, "text") for k in range(5)] + [("one", 1, 4, "only")]
    rows += [("tie", 1, None, "a"), ("tie", 1, 2, "b"), ("tie", 1, 2, "c"), ("tie", 1, 1, "d"), ("tie", 2, -5, "e"), ("tie", 2, None, "f")]
    judge(spark, rows)


def test_nothing(spark):
    judge(spark, [("x", 1, None, "a")])
    df = spark.createDataFrame([], "file string, at int, level int, name string")
    assert nesting.under_headings(df, "file", ["at"], "level", "name").collect() == []
