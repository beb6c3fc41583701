"""Names through renames, guids and ranked candidates, on small tables."""

import random

from tessella.operators import resolution


def ends(renames):
    """Plain walks: (old, final, cyclic)."""
    out = {}
    for a, b in renames:
        if a is not None and b is not None and a != b:
            out.setdefault(a, set()).add(b)
    found = set()
    for old in out:
        seen, open_, final = set(), [old], set()
        while open_:
            for name in out.get(open_.pop(), ()):
                if name not in out:
                    final.add(name)
                elif name not in seen:
                    seen.add(name)
                    open_.append(name)

        def rounds(name):  # whether a way from here comes back to where it was
            todo, met = list(out.get(name, ())), set()
            while todo:
                x = todo.pop()
                if x == name:
                    return True
                if x not in met:
                    met.add(x)
                    todo += out.get(x, ())
            return False

        cyclic = any(rounds(x) for x in {old, *seen})
        found |= {(old, x, cyclic) for x in final or {None}}
    return found


def names(spark, renames):
    df = spark.createDataFrame(renames, "old string, new string")
    return {(r.old, r.final, r.cyclic) for r in resolution.final_names(df).collect()}


def test_final_names(spark):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(70)]
    odd = [("a", "b"), ("a", "b"), ("b", "c"), ("x", "x"), (None, "y"), ("y", None), ("r", "s"), ("s", "t"), ("t", "r"), ("s", "u"), ("q", "r"), ("m", "n1"), ("m", "n2"), ("n2", "n3")]
    assert names(spark, chain + odd) == ends(chain + odd)
    assert ("c0", "c70", False) in ends(chain) and ("q", "u", True) in ends(odd) and names(spark, []) == set()


def test_final_names_of_any_tables(spark):
    r = random.Random(5)
    every = [(f"{g}:{r.randrange(9)}", f"{g}:{r.randrange(9)}") for g in range(30) for _ in range(g % 12)]
    assert names(spark, every) == ends(every)


def test_relative_path(spark):
    rows = [("/a/b/c", "/a/b/x", "c"), ("/a/c", "/a/b/x", "../c"), ("/a/b/d/c", "/a/b/x", "d/c"), ("/c", "/a/b/x", "../../c"), ("/a/b/c", "/x", "a/b/c"), ("/b/a/c", "/a/a/x", "../../b/a/c"), ("/c", "/x", "c")]
    df = spark.createDataFrame(rows, "target string, base string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", resolution.relative_path(df.target, df.base)).collect())


FILES = [("/o/a.html", "GUID-1", "One", 5), ("/o/b.html", "t2", "Same name", 5), ("/p/c.html", "t3", " Same  name ", 9), ("/p/d.html", None, "Only", None), ("/q/d.html", "t5", "Same name", 9), ("/q/e.html", "guid-2", "", 3), ("/r/e2.html", "guid-2", None, 3)]
LINEAGE = [("/in/a.html", "/o/a.html", False), ("/in/b.html", "/o/b.html", False), ("/in/b.html", "/p/c.html", False), ("/in/zz.html", None, True), ("/in/x/d.html", "/p/d.html", False), ("/old/a.html", "/o/a.html", False)]
IDS = [("/in/b.html", "i", "/p/c.html"), ("/in/b.html", "i", "/p/c.html"), ("/in/b.html", "twice", "/p/c.html"), ("/in/b.html", "twice", "/o/b.html"), ("/in/x/d.html", "k", "/p/d.html")]
CASES = [
    ("/q/d.html", "GUID-1#GUID-1/x", "Only", ("/o/a.html", "../o/a.html#GUID-1/x", "guid")),
    ("/q/d.html", "guid-2", None, ("/r/e2.html", "../r/e2.html", "guid")),
    ("/o/a.html", "guid-none#x", "Only", (None, None, "none")),
    ("/o/a.html", "b.html#t/i", "Only", ("/p/c.html", "../p/c.html#t3/i", "own id")),
    ("/o/a.html", "x/d.html#t/k", None, ("/p/d.html", "../p/d.html#k", "own id")),
    ("/o/a.html", "b.html#t/twice", "Only", ("/p/c.html", "../p/c.html", "own file")),
    ("/o/a.html", "./b.html", None, ("/p/c.html", "../p/c.html", "own file")),
    ("/o/b.html", "somewhere/e2.html#a/b", None, ("/r/e2.html", "../r/e2.html#a/b", "base name")),
    ("/q/d.html", "b.html", None, ("/o/b.html", "../o/b.html", "base name")),
    ("/o/a.html", "moved/d.html", "  Only ", ("/p/d.html", "../p/d.html", "title")),
    ("/o/a.html", "zz.html", "Same name", ("/p/c.html", "../p/c.html", "largest of title")),
    ("/o/a.html", None, "One", ("/o/a.html", "a.html", "title")),
    ("/o/a.html", "zz.html", "", (None, None, "none")),
    ("/unknown/f.html", "zz.html", None, (None, None, "none")),
    (None, "nowhere", None, (None, None, "none")),
]


def test_resolve(spark):
    files = spark.createDataFrame(FILES, "file string, topic string, title string, size long")
    lineage = spark.createDataFrame(LINEAGE, "old string, final string, cyclic boolean")
    ids = spark.createDataFrame(IDS, "old string, id string, file string")
    asked = spark.createDataFrame([(k, f, r, t) for k, (f, r, t, _) in enumerate([*CASES, CASES[3]])], "k int, file string, reference string, text string")
    from pyspark.sql import functions as F

    found = {r.k: (r.target, r.repaired, r.how) for r in resolution.resolve(asked, files, lineage, ids, F.lit(False)).collect()}
    assert found == {k: want for k, (*_, want) in enumerate([*CASES, CASES[3]])}
    aside = resolution.resolve(asked, files, lineage, ids).where("target is null").collect()
    assert {r.how for r in aside} == {"moved aside"}
    assert resolution.resolve(asked.where("false"), files, lineage, ids).collect() == []
    assert {r.how for r in resolution.resolve(asked, files.where("false"), lineage.where("false"), ids.where("false")).collect()} == {"moved aside"}


def test_every_way_occurs(spark, sf_dir):
    from tessella.plans import registry

    found = {r.how for r in registry.QUERIES["resolved_references"](spark, sf_dir).select("how").distinct().collect()}
    assert found >= {*resolution.WAYS, "moved aside", "none"}


def test_guid_reasons(spark):
    files = spark.createDataFrame([("a", "GUID-1"), ("b", "t"), ("c", None)], "file string, topic string")
    ids = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "y", 1)], "file string, id string, n long")
    want = {"GUID-1": None, "GUID-1#GUID-1": None, "GUID-1#GUID-2": "Guid does not match topic id", "GUID-1#GUID-1/x": None, "GUID-1#GUID-1/y": "Duplicated id in target topic", "GUID-1#GUID-1/z": "No such id in target topic", "GUID-9": "No such guid defined"}
    asked = spark.createDataFrame([("b", r) for r in [*want, "other", None]], "file string, reference string")
    assert {r.reference: r.reason for r in resolution.guid_reasons(asked, files, ids).collect()} == want


def _as_sql(spark, folder, query, rows):
    """The query over pages (page_id, url, html), which must give what its SQL gives."""
    import duckdb

    from tessella.plans import registry

    path = f"{folder}/pages.parquet"
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{path}/*.parquet')")
    found = registry.QUERIES[query](spark, str(folder))
    said = con.execute(registry.ORACLES[query])
    want = [dict(zip((c[0] for c in said.description), r, strict=True)) for r in said.fetchall()]
    plain = lambda rows: sorted(repr(sorted(r.items())) for r in rows)
    got = [r.asDict() for r in found.collect()]
    assert plain(got) == plain(want)
    return got


def test_pages_of_one_address_have_their_own_guids(spark, tmp_path):
    rows = [(k, ["http://a/en/1", "http://a/en/2", None][k % 3], "") for k in range(30)]
    found = _as_sql(spark, tmp_path, "guid_reasons", rows)
    assert len(found) == 30 and all(r["target"] in (None, r["file"]) for r in found)


def test_a_guid_of_several_pages_leads_to_all(spark, tmp_path):
    """Pages 25 and 40 are topics of one address; 24 refers to 25 by guid. Links' texts may hold what ends a tag or a line."""
    page = lambda k: f'<title>Word{k % 7}, more</title><a href="x>y{k}">word{k % 5}</a><a href="z">word1\n</a><a href="w"> word2</a><a href="v">a > b</a>'
    rows = [(k, "http://a/en/25" if k in (25, 40) else f"http://a/en/{k}", page(k)) for k in range(60)]
    found = _as_sql(spark, tmp_path, "resolved_references", rows)
    assert {r["target"] for r in found if r["how"] == "guid" and r["file"] == "/out/en/24.html"} == {"/out/en/25.html", "/out/en/40.html"}


def test_unused_ids(spark):
    from tessella.operators import references

    ids = spark.createDataFrame([("a", "i"), ("a", "j"), ("a", "j"), ("b", "i"), ("b", "t"), ("c", "t"), (None, "z"), ("c", None)], "file string, id string")
    named = spark.createDataFrame([("x#y/i",), ("a",), ("a#t",), (None,)], "reference string")
    files = spark.createDataFrame([("a", None), ("b", "t"), ("d", "j")], "file string, topic string")
    assert sorted(map(tuple, references.unused_ids(ids, named, files).collect())) == [("a", "j"), ("c", "t")]


def test_unanimous_values(spark):
    from tessella.operators import graph

    r = random.Random(6)
    links = [(f"g{r.randrange(40)}", f"g{r.randrange(40)}") for _ in range(50)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), (None, "d"), ("d", None)] + [(f"c{k}", f"c{k + 1}") for k in range(12)]
    values = [(f"g{k}", r.choice(["u", "v", None])) for k in range(0, 40, 3)] + [("d", "u"), ("x", "w"), ("c12", "v"), ("c4", None), (None, "u"), ("b", "u")]
    below = {}
    for a, b in links:
        if a and b:
            below.setdefault(a, set()).add(b)
    own = {}
    for n, v in values:
        if n and v:
            own.setdefault(n, set()).add(v)
    want = set()
    for n in {*below, *own}:
        seen, todo = {n}, [n]
        while todo:
            new = below.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        have = set().union(*(own.get(x, set()) for x in seen))
        if have:
            want.add((n, min(have) if len(have) == 1 else None, len(have) > 1))
    got = graph.unanimous(spark.createDataFrame(links, "above string, below string"), spark.createDataFrame(values, "node string, value string"))
    assert {(x.node, x.value, x.many) for x in got.collect()} == want
