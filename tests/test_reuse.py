"""Content used again, and edits of parsed pages, against plain trees."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tessella.operators import reuse
from tessella.plans import registry, tree_queries

from test_tree_edits import Node, plain, rows

md5 = lambda text: hashlib.md5(text.encode()).hexdigest()


def build(table):
    """The tops of each tree: (node, tag, attributes, text, children, path)."""
    trees = defaultdict(dict)
    for tree, node, path, tag, attributes, text in table:
        trees[tree][tuple(path)] = [node, tag, attributes, text, [], tuple(path)]
    tops = {}
    for tree, by in trees.items():
        tops[tree] = []
        for path in sorted(by):
            up = by.get(path[:-1]) if path else None
            (up[4] if up else tops[tree]).append(by[path])
    return tops


def digest(x):
    pairs = "".join(md5(k) + md5(v or "") for k, v in sorted((x[2] or {}).items()))
    return md5("|".join((md5(x[1] or ""), pairs, md5(x[3] or ""), "".join(map(digest, x[4])))))


def chars(x):
    return len(x[3] or "") + sum(map(chars, x[4]))


def walk(x):
    yield x
    for c in x[4]:
        yield from walk(c)


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    df = tree_queries.page_trees(spark, sf_dir)
    return df, [(r.tree, r.node, r.path, r.tag, r.attributes, r.text) for r in df.collect()]


ODD = [
    (1, 0, [], "a", {"x": "1", "b": "2"}, None), (1, 1, [0], "p", None, "one"), (1, 2, [1], "p", {}, "one"), (1, 3, [2], None, {}, ""), (1, 4, [3], "q", {}, None), (1, 5, [3, 0], "p", {}, "one"),
    (2, 0, [], "a", {"b": "2", "x": "1"}, None), (2, 1, [0], "p", None, "one"), (2, 2, [1], "p", {}, "one"), (2, 3, [2], None, {}, ""), (2, 4, [3], "q", {}, None), (2, 5, [3, 0], "p", {}, "one"),
    (3, 0, [], "r", {}, None), (3, 1, [0], "q", {}, None), (3, 2, [0, 0], "p", {}, "one"), (3, 3, [1], "p", {"x": None}, "one"), (3, 4, [2], "p", {"x": ""}, "one"), (4, 0, [0], "p", {}, "on"), (4, 1, [1], "p", {}, "e"),
]
KIND = "tree long, node int, path array<int>, tag string, attributes map<string, string>, text string"


def judge(df, table, **options):
    digested = reuse.digests(df)
    tops = build(table)
    every = [(t, x) for t, xs in tops.items() for top in xs for x in walk(top)]
    assert sorted((r.tree, r.node, r.md5, r.chars, r["size"]) for r in digested.collect()) == sorted((t, x[0], digest(x), chars(x), sum(1 for _ in walk(x))) for t, x in every)
    contents = reuse.reused(digested, **options)
    least_uses, least_chars, tags = options.get("least_uses", 2), options.get("least_chars", 1), options.get("tags")
    counts = Counter(digest(x) for _, x in every if chars(x) >= least_chars and (tags is None or x[1] in tags))
    want = {d for d, n in counts.items() if n >= least_uses}
    assert {(r.md5, r.uses) for r in contents.collect()} == {(d, counts[d]) for d in want}
    kept = [(r.tree, r.path, r.reference) for r in reuse.replaced(digested, contents).collect()]
    entries = [(r.tree, r.node, r.path, r.tag, r.attributes, r.text, r.reference) for r in reuse.dictionary(digested, contents).collect()]

    def outer(x, t, root=False):
        here = digest(x) in want and not root
        yield t, list(x[5]), digest(x) if here else None
        if not here:
            for c in x[4]:
                yield from outer(c, t)

    assert sorted(map(repr, kept)) == sorted(repr(y) for t, xs in tops.items() for x in xs for y in outer(x, t))
    # every entry holds what its digest says, once its references are expanded
    books = {t: xs[0] for t, xs in build([x[:6] for x in entries]).items()}
    named = {(t, n): ref for t, n, *_, ref in entries}
    assert books.keys() == want

    def expanded(x, t):
        ref = named.get((t, x[0]))
        if ref:
            assert ref != t
            return expanded(books[ref], ref)
        return [*x[:4], [expanded(c, t) for c in x[4]]]

    assert all(digest(expanded(x, t)) == t for t, x in books.items())
    # no entry spells out what another one has
    assert all(digest(expanded(x, t)) not in want for t, top in books.items() for x in walk(top) if x is not top and not named.get((t, x[0])))


def test_reuse_of_odd_trees(spark):
    df = spark.createDataFrame(ODD, KIND).repartition(3)
    judge(df, ODD)
    judge(df, ODD, least_uses=3, tags=["p", "q"])
    judge(df, ODD, least_chars=0)
    assert reuse.digests(df.where("false")).collect() == []


def test_reuse_in_pages(pages):
    judge(*pages)


def test_pages_edited_in_sequence_equal_plain_trees(spark, sf_dir, pages):
    tops = defaultdict(dict)
    for tree, node, path, tag, *_ in pages[1]:
        tops[tree][tuple(path)] = Node(node, tag)
    roots = {}
    for tree, by in tops.items():
        for path in sorted(by):
            if len(path) > 1:
                by[path[:-1]].put(len(by[path[:-1]].children), by[path])
        # tops stand below one that is not in the table
        roots[tree] = Node(-1, "#", [by[p] for p in sorted(by) if len(p) == 1])
    nodes = pages[0].select("tree", "node", "path", "tag")
    for batch in (1, 2, 3):
        edits = defaultdict(list)
        state = [(t, *x[1:]) for t, root in roots.items() for x in rows(root, t) if x[1] != -1]
        here = spark.createDataFrame([(t, n, p, g) for t, n, p, g in state], "tree long, node int, path array<int>, tag string")
        for r in tree_queries.edits_of_pages(here, batch).collect():
            edits[r.tree].append((r.seq, r.op, r.node, r.other, r.key))
        assert len(edits) > 20
        for tree, some in edits.items():
            plain(roots[tree], some)
    got = sorted((r.tree, r.node, r.path, r.tag) for r in registry.QUERIES["edited_trees"](spark, sf_dir).collect())
    assert got == sorted((t, n, "/".join(map(str, p)), g) for t, root in roots.items() for _, n, p, g in rows(root, t) if n != -1)
    assert nodes.count() != len(got)
