import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import facts, graph, groups, images, references, rules, sequences, similarity, stages, trees
from tessella.sources import files, markup


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reference_reasons(spark):
    given = [("/a.d", r) for r in ("b.d", "x.d", "b.d#tb/i1", "b.d#/i1", "b.d#no/i1", "b.d#tb/i9", "b.d#tb/i2", "c.d#t/i", "#ta/q", None)]
    refs = spark.createDataFrame(given, "file string, reference string")
    topics = spark.createDataFrame([("/a.d", "ta"), ("/b.d", "tb"), ("/c.d", None)], "file string, topic string")
    ids = spark.createDataFrame([("/b.d", "i1", 1), ("/b.d", "i2", 2), ("/a.d", "q", 1), ("/a.d", "ta", 2)], "file string, id string, n long")
    found = {r.reference: r.reason for r in references.check(refs, topics, ids).collect()}
    assert found == {"x.d": "No such file", "b.d#no/i1": "Topic id does not match", "b.d#tb/i9": "No such id in target topic", "b.d#tb/i2": "Duplicated id in target topic", "c.d#t/i": "No topic id"}
    own = spark.createDataFrame([("/b.d", "a.d#ta/ta")], "file string, reference string")
    assert references.check(own, topics, ids).count() == 0  # two of which one is the topic's own


def test_joins(spark):
    edges = spark.createDataFrame([("m", "a"), ("m", "b"), ("a", "b"), ("s", "s"), (None, "x")], "a string, b string")
    assert rows(references.exterior(edges, "a", "b")) == [("m",)]
    assert rows(references.chain(edges, edges)) == [("m", "a", "b", 1), ("s", "s", "s", 1)]
    wanted = spark.createDataFrame([(1, "n"), (2, "n"), (3, "o")], "k int, name string")
    assert rows(references.collisions(wanted, "name").select("k")) == [(1,), (2,)]
    pairs = spark.createDataFrame([("s1", "t"), ("s2", "t"), ("s1", "u")], "source string, target string")
    assert rows(references.lineage(pairs)) == [("t", ["s1", "s2"], 2), ("u", ["s1"], 1)]
    one, two = spark.createDataFrame([(1,), (1,), (2,)], "v int"), spark.createDataFrame([(2,), (3,)], "v int")
    assert rows(references.differences(one, two)) == [(1, "got"), (3, "expected")]
    broken = spark.createDataFrame([("x", "p"), ("y", "q"), ("z", "q")], "id string, base string")
    first = spark.createDataFrame([("x", "1"), ("y", "2"), ("y", "3")], "id string, answer string")
    second = spark.createDataFrame([("q", "9")], "base string, answer string")
    fixed = references.repair(broken, (first, ["id"], "id"), (second, ["base"], "base")).select("id", "repaired", "how")
    assert rows(fixed) == [("x", "1", "id"), ("y", "9", "base"), ("z", "9", "base")]
    titles = spark.createDataFrame([("f", "T"), ("g", "G")], "file string, title string")
    entries = spark.createDataFrame([("m", "f", None), ("m", "g", "G"), ("m", "g", "H"), ("m", "k", None)], "map string, href string, navtitle string")
    assert sorted(r.note for r in references.fill_titles(entries, titles).collect()) == ["Changed", "No title known", "Set", "Unchanged"]


def test_groups(spark):
    docs = spark.createDataFrame([(1, "make tea tea"), (2, "tea"), (3, "other words here now"), (4, None)], "file long, text string")
    assert rows(groups.word_index(docs, "file", "text").where("word = 'tea'")) == [("tea", 1, 2), ("tea", 2, 1)]
    counts = spark.createDataFrame([("refs", 5), ("lines", 1), ("ids", 0)], "name string, n long")
    assert rows(groups.status(counts)) == [(1, "1 line"), (5, "5 refs")]
    items = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "b", "b"]), ("3", ["a"])], "item string, genres array<string>")
    assert rows(groups.genre_counts(items, "genres")) == [("a", 3), ("b", 2)]
    assert rows(groups.genre_overlap(items, "item", "genres")) == [("a", "b", 0.666667)]
    outcomes = spark.createDataFrame([("r", 3, False), ("r", 9, True), ("s", 4, False), ("s", 2, False)], "rule string, line int, passed boolean")
    assert sorted(map(repr, (tuple(r) for r in groups.rule_statistics(outcomes).collect()))) == ["('r', 1, None)", "('s', 0, 4)"]


def test_sequences(spark):
    names = spark.createDataFrame([(1, "a b1"), (2, "ab"), (3, "a.b"), (4, "c")], "k int, t string")
    assert [r.unique_name for r in sequences.unique_names(names, "t", ["k"]).orderBy("k").collect()] == ["ab", "ab1", "ab2", "c"]
    dice = spark.createDataFrame([("d", v) for v in (6, 1, 2, 2, 3, 4)] + [("e", 5), ("e", None)], "k string, v int")
    assert rows(sequences.longest_runs(dice, "k", "v")) == [("d", 3, 2, 4), ("e", 1, 5, 5)]
    runs = spark.createDataFrame([(list("3210"),), ([],), (list("0123"),)], "v array<string>")
    assert [r.runs for r in sequences.sorted_runs(runs, "v").collect()] == [[["3"], ["2"], ["1"], ["0"]], [], [["0", "1", "2", "3"]]]


def test_similar_against_all_pairs(spark):
    r = random.Random(2)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(80)}" for _ in range(r.randint(3, 40))]
        for _ in range(6):
            copy = [w if r.random() > 0.04 else f"v{r.randrange(50)}" for w in base]
            texts.append((len(texts), " ".join(copy)))
    texts += [(100, None), (101, ""), (102, "alone")]
    sets = {k: set(t.split()) for k, t in texts if t}
    for level in (0.5, 0.9):
        label = {k: k for k in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if len(sets[a] & sets[b]) >= level * len(sets[a] | sets[b]) - 1e-12:
                        label[a] = label[b] = min(label[a], label[b])
        want = sorted((k, v) for k, v in label.items() if list(label.values()).count(v) > 1)
        assert rows(similarity.similar(spark.createDataFrame(texts, "k long, t string"), "k", "t", level)) == want


def test_similar_splits_crowded_words(spark, monkeypatch):
    """A word of every text: many share it, so its pairs with the words after it are what texts meet by; one more column has a name used inside."""
    monkeypatch.setattr(similarity, "CROWD", 2)
    r = random.Random(5)
    bases = [["x"] + [f"w{r.randrange(30)}" for _ in range(22)] for _ in range(8)]
    texts = [(k, " ".join(w if r.random() > 0.03 else f"v{r.randrange(9)}" for w in bases[k % 8]), "c") for k in range(64)]
    texts += [(3, "x " * 5, "c"), (None, texts[0][1], "c"), (90, " \t", "c")]
    sets = [(k, frozenset(t.split())) for k, t, _ in texts if k is not None and t.split()]
    for level in (0.6, 0.85, 1.0):
        part = list(range(len(sets)))
        for _ in sets:
            for i, (_, a) in enumerate(sets):
                for j, (_, b) in enumerate(sets):
                    if len(a & b) >= level * len(a | b) - 1e-12:
                        part[i] = part[j] = min(part[i], part[j])
        members = {p: [k for (k, _), q in zip(sets, part, strict=True) if p == q] for p in part}
        want = sorted((k, min(m)) for m in members.values() if len(m) > 1 for k in m)
        assert rows(similarity.similar(spark.createDataFrame(texts, "k long, t string, w string"), "k", "t", level)) == want


def test_graph(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (None, 4)], "a long, b long")
    assert rows(graph.components(chain)) == [(k, 0) for k in range(21)] + [(30, 30), (31, 30)]
    reach = {(r.a, r.b): r.steps for r in graph.closure(chain).collect()}
    assert reach[0, 20] == 20 and reach[30, 30] == 2 and (20, 0) not in reach
    assert graph.closure(chain.where("a < 0")).count() == 0
    roots = spark.createDataFrame([(30,)], "node long")
    assert rows(graph.paths(chain, roots, 5).select("node", "path")) == [(30, [30]), (31, [30, 31])]


PAGE = "<html><body><ul><li><a href='x'>One</a><li>Two</ul><br><p class=q>a &amp; b</p></body></html>"


def test_nodes_and_trees(spark):
    given = spark.createDataFrame([("f", PAGE), ("g", None), ("h", "</p>text<b>")], "file string, text string")
    nodes = markup.nodes(given, "file", "text")
    tags = [r.tag for r in nodes.where("file = 'f'").orderBy("node").collect()]
    assert tags == ["html", "body", "ul", "li", "a", "CDATA", "li", "CDATA", "br", "p", "CDATA"]
    assert nodes.where("tag = 'p'").first().attributes == {"class": "q"} and nodes.where("file = 'h'").count() == 2
    assert nodes.where("file = 'f' and tag = 'CDATA'").orderBy(F.desc("node")).first().text == "a & b"
    tree = nodes.where("file = 'f'").selectExpr("file as tree", "cast(node as string) as node", "path")
    ranked = {r.node: r for r in trees.ranks(tree).collect()}
    assert [ranked[str(k)].pre for k in range(11)] == list(range(1, 12)) and ranked["0"].post == 11 and ranked["0"].reversed == 11
    up = {(r.node, r.ancestor): r.distance for r in trees.ancestors(tree).collect()}
    assert up["5", "0"] == 5
    assert up["4", "3"] == 1
    pair = spark.createDataFrame([([0], [0, 1]), ([0, 1], [1])], "a array<int>, b array<int>")
    assert [tuple(r) for r in pair.select(trees.is_above(F.col("a"), F.col("b")), trees.is_before(F.col("a"), F.col("b"))).collect()] == [(True, False), (False, True)]


def test_rules(spark):
    text = "# all rules\nLinks\n  rename xref a li   # in lists\n  delete a\nOther\n  fly away\n  rename body p\n"
    lines = files.lines(spark.createDataFrame([("r", text)], "file string, text string"), "file", "text")
    parsed = rules.parse(lines, "file", "number", "line")
    assert rows(parsed.select("line", "description", "method", "argument")) == sorted([(3, "Links", "rename", "xref"), (4, "Links", "delete", None), (7, "Other", "rename", "body")], key=str) or parsed.count() == 3
    nodes = spark.createDataFrame([("f", 1, ["a", "li", "ul"]), ("f", 2, ["a", "p"]), ("f", 3, ["p"]), ("f", 4, ["q"])], "file string, node int, context array<string>")
    applied = rules.apply(nodes, parsed)
    assert rows(rules.outcome(applied)) == [("f", 1, "xref"), ("f", 3, "body"), ("f", 4, "q")]
    assert rows(rules.statistics(applied, parsed).select("line", "hits")) == [(3, 1), (4, 1), (7, 1)]


def test_drawings(spark):
    drawing = spark.createDataFrame([("i", "xx  x\n x  x\n\n  xx"), ("j", None)], "image string, text string")
    dots = images.pixels(drawing, "image", "text")
    assert rows(images.bounds(dots)) == [("i", 0, 4, 0, 3, 7)]
    sizes = images.parts(dots).groupBy("part").count().collect()
    assert sorted((r.part.x, r.part.y, r["count"]) for r in sizes) == [(0, 0, 3), (2, 3, 2), (4, 0, 2)]
    assert {r.direction: r.longest for r in images.widths(dots).collect()} == {"row": 2, "column": 2, "falling": 2, "rising": 1} or images.widths(dots).count() == 4


def test_facts_of_awkward_files(spark):
    given = spark.createDataFrame([(1, "<P><p a='x'>&lt;&amp;</p>"), (2, None), (3, ""), (1, '<a href="u" id="0">http://x.y/z</a>')], "file long, text string")
    assert rows(facts.tags(given, "file", "text")) == [(1, "a", 1), (1, "p", 2)]
    assert rows(facts.attributes(given, "file", "text")) == [(1, "href", "u", 1)]
    assert rows(facts.entities(given, "file", "text")) == [(1, "amp", 1), (1, "lt", 1)]
    assert rows(facts.urls(given, "file", "text")) == [(1, "http://x.y/z")]
    assert facts.parse_failures(given, "file", "text").count() == 4


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.xml").write_text("<a/><!--project: p1--><!--author: me--><!--project: p2-->", "utf-8")
    (tmp_path / "b.xml").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.txt").write_text("x")
    found = files.folder(spark, str(tmp_path), "xml", "ISO-8859-1")
    assert rows(found.select("name", "extension", "bytes")) == [("a.xml", "xml", 57), ("b.xml", "xml", 1)]
    assert found.where("name = 'b.xml'").first().content == "é"
    assert files.comment_attributes(found.where("name = 'a.xml'"), "name", "content").first().attributes == {"author": "me", "project": "p2"}
    line = files.write_report(spark.range(3), str(tmp_path / "out"), "Three").first()
    assert (line.title, line.rows, line["columns"]) == ("Three", 3, ["id"]) and spark.read.json(str(tmp_path / "out/json")).count() == 3
    index = spark.createDataFrame([("tea", 1, 2)], "word string, file long, n long")
    files.write_word_index(index, spark.createDataFrame([(1, "T")], "file long, title string"), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/files_to_words")).count() == 1


def test_stages_resume(spark, tmp_path):
    calls = []

    def step(name, fail=False):
        def run(df):
            calls.append(name)
            if fail:
                raise RuntimeError(name)
            return df.withColumn(name, F.lit(1))

        return name, run

    source = spark.range(2)
    with pytest.raises(RuntimeError):
        stages.run(spark, source, "v1", [step("load"), step("c1", fail=True)], str(tmp_path))
    df, ran = stages.run(spark, source, "v1", [step("load"), step("c1"), step("c2")], str(tmp_path))
    assert ran == ["c1", "c2"] and df.columns == ["id", "load", "c1", "c2"]
    assert stages.run(spark, source, "v1", [step("load"), step("c1"), step("c2")], str(tmp_path))[1] == []
    assert stages.run(spark, source, "v2", [step("load"), step("c1")], str(tmp_path))[1] == ["load", "c1"]


def test_decoded_targets_and_deep_trees(spark):
    import pytest
    from pyspark.errors import PySparkException

    from tessella.operators import references, trees

    links = spark.createDataFrame([("x.d", "a%20b.d"), ("x.d", "a%20c.d"), ("x.d", "a%20b.d#t/i")], "file string, reference string")
    files = spark.createDataFrame([("/a b.d", "t"), ("/x.d", None)], "file string, topic string")
    ids = spark.createDataFrame([("/a b.d", "i", 1)], "file string, id string, n long")
    assert [(r.reference, r.reason) for r in references.check(links, files, ids).collect()] == [("a%20c.d", "No such file")]
    rows = spark.createDataFrame([(1, 1, None, 0), (1, 2, 1, 0), (1, 3, 2, 0)], "tree int, node int, parent int, pos int")
    assert trees.from_parents(rows, 2).count() == 3
    with pytest.raises(PySparkException):
        trees.from_parents(rows, 1).collect()


def test_tree_neighbourhoods(spark):
    """r has a, b, c; a has d, e; e has f. A second tree is one node."""
    paths = {"r": [], "a": [0], "b": [1], "c": [2], "d": [0, 0], "e": [0, 1], "f": [0, 1, 0]}
    tree = spark.createDataFrame([(1, n, p) for n, p in paths.items()] + [(2, "z", [])], "tree int, node string, path array<int>")
    ask = lambda *x: spark.createDataFrame([(1, *p) for p in x], "tree int, a string, b string")
    assert rows(trees.common_ancestors(tree, ask(("d", "f"), ("d", "c"), ("e", "f"), ("b", "b"), ("b", "none"))).select("a", "b", "ancestor")) == [("b", "b", "b"), ("d", "c", "r"), ("d", "f", "a"), ("e", "f", "e")]
    assert rows(trees.leaves(tree).select("tree", "node")) == [(1, "b"), (1, "c"), (1, "d"), (1, "f"), (2, "z")]
    assert rows(trees.parents(tree).select("tree", "node")) == [(1, "a"), (1, "e"), (1, "r")]
    assert rows(trees.outermost(tree)) == [(1, "a", "d", "f", 2), (1, "e", "f", "f", 1), (1, "r", "d", "c", 4)]
    assert {r.node: r.context for r in trees.context(tree, "node").collect()} == {"r": ["r"], "a": ["a", "r"], "b": ["b", "r"], "c": ["c", "r"], "d": ["d", "a", "r"], "e": ["e", "a", "r"], "f": ["f", "e", "a", "r"], "z": ["z"]}
    steps = spark.createDataFrame([(1, "r", [0, 1, 0]), (1, "a", [1]), (1, "a", []), (1, "b", [0]), (2, "q", [0])], "tree int, node string, steps array<int>")
    assert sorted((r.node, tuple(r.steps), r.found) for r in trees.at_path(tree, steps).collect()) == [("a", (), "a"), ("a", (1,), "e"), ("b", (0,), None), ("q", (0,), None), ("r", (0, 1, 0), "f")]
    assert trees.outermost(tree.where("false")).collect() == [] and trees.leaves(tree.where("false")).collect() == []


def test_similar_texts_whatever_is_common(spark, monkeypatch):
    """As all pairs say, with few words ranked apart and many; and texts that are like no other are shuffled less than twice over."""
    r = random.Random(17)
    words = [f"word{k}" for k in range(3000)]
    base = [" ".join(words[min(int(r.paretovariate(0.6)), 2999)] for _ in range(r.choice([1, 2, 9, 60, 200]))) for _ in range(150)]
    texts = [*base, *(" ".join(w for w in r.choice(base).split() if r.random() > 0.04) for _ in range(80)), *base[:20]]
    sets = [set(t.split()) for t in texts]
    block = list(range(len(sets)))

    def top(k):
        while block[k] != k:
            k = block[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.9 * len(a | sets[j]) - 1e-9:
                x, y = sorted((top(i), top(j)))
                block[y] = x
    tops = [top(k) for k in range(len(sets))]
    want = sorted((k, t) for k, t in enumerate(tops) if tops.count(t) > 1 and sets[k])
    assert len(want) > 60
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for common, crowd in ((4096, 256), (5, 3), (1, 256)):
        monkeypatch.setattr(similarity, "COMMON", common, raising=False)
        monkeypatch.setattr(similarity, "CROWD", crowd)
        assert sorted(map(tuple, similarity.similar(df, "k", "t", 0.9).collect())) == want
    monkeypatch.undo()
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda: "".join(r.choice(letters) for _ in range(8))
    often = [name() for _ in range(2000)]
    long = [" ".join([r.choice(often) for _ in range(400)] + [name() for _ in range(100)]) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(long)), "k long, t string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert similarity.similar(df, "k", "t", 0.9).collect() == []
    assert written() - before < 1.8 * sum(map(len, long)), (written() - before) / sum(map(len, long))
