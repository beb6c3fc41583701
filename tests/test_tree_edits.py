"""Edits of tables of nodes against a plain tree."""

import random

import pytest

from tessella.operators import tree_edits


class Node:
    def __init__(self, number, tag, children=()):
        self.number, self.tag, self.children, self.parent = number, tag, list(children), None
        for c in self.children:
            c.parent = self

    def all(self):
        yield self
        for c in self.children:
            yield from c.all()

    def put(self, place, child):
        child.parent = self
        self.children.insert(place, child)

    def place(self):
        return next(k for k, c in enumerate(self.parent.children) if c is self)


def rows(root, tree, path=()):
    yield tree, root.number, list(path), root.tag
    for k, c in enumerate(root.children):
        yield from rows(c, tree, (*path, k))


def unwrap(x):
    at, up = x.place(), x.parent
    del up.children[at]
    for c in reversed(x.children):
        up.put(at, c)


def plain(root, edits):
    """One edit after the other; new nodes are told by their objects and numbered at the end."""
    by = {x.number: x for x in root.all()}
    new = []
    for seq, op, number, other, key in sorted(edits):
        x = by[number]
        if op == "wrap_children":
            w = Node(None, key, x.children)
            x.children = []
            x.put(0, w)
            new.append((seq, w))
        elif op == "split":
            for k, c in enumerate(list(x.children)):
                w = Node(None, x.tag, [c])
                del x.children[k]
                x.put(k, w)
                new.append((seq, w))
        elif op == "merge":
            for c in list(x.children):
                if c.tag == x.tag:
                    unwrap(c)
        elif x.parent is None:
            pass
        elif op == "cut":
            del x.parent.children[x.place()]
        elif op == "unwrap":
            unwrap(x)
        elif op == "wrap":
            at, up = x.place(), x.parent
            del up.children[at]
            w = Node(None, key, [x])
            up.put(at, w)
            new.append((seq, w))
        elif op in ("merge_previous", "merge_next"):
            at = x.place() + (-1 if op == "merge_previous" else 1)
            if 0 <= at < len(x.parent.children) and x.parent.children[at].tag == x.tag:
                y = x.parent.children.pop(at)
                for k, c in enumerate(y.children):
                    x.put(k if op == "merge_previous" else len(x.children), c)
        else:
            del x.parent.children[x.place()]
            o = by[other]
            if op == "put_first":
                o.put(0, x)
            elif op == "put_last":
                o.put(len(o.children), x)
            else:
                o.parent.put(o.place() + (op == "put_next"), x)
    paths = {id(x): p for x, (_, _, p, _) in zip(root.all(), rows(root, 0), strict=True)}
    most = max(by)
    order = sorted((x for x in new if id(x[1]) in paths), key=lambda x: (x[0], paths[id(x[1])]))
    for k, (_, w) in enumerate(order):
        w.number = most + 1 + k


def grow(r, size):
    root = Node(0, "a")
    every = [root]
    for k in range(1, size):
        up = r.choice(every[-6:])
        x = Node(k * 3, r.choice("aabc"))
        up.put(r.randint(0, len(up.children)), x)
        every.append(x)
    return root


def table(spark, trees):
    return spark.createDataFrame([x for t, root in trees.items() for x in rows(root, t)], "tree int, node int, path array<int>, tag string")


def edited(spark, df, edits):
    got = tree_edits.edit(df, spark.createDataFrame(edits, "tree int, seq int, op string, node int, other int, key string"))
    return got, sorted((r.tree, r.node, r.path, r.tag) for r in got.collect())


def one_edit(r, root):
    every = list(root.all())
    op = r.choice([*tree_edits.OPERATIONS, *tree_edits.MOVES])
    x = r.choice(every)
    other = None
    if op in tree_edits.MOVES:
        below = set(map(id, x.all()))
        able = [y for y in every if id(y) not in below and (y.parent is not None or op in ("put_first", "put_last"))]
        if not able:
            return None
        other = r.choice(able).number
    return op, x.number, other, "new"


def test_edits_in_sequence_equal_a_plain_trees(spark):
    """Five rounds of an edit in each of 60 trees; every operation occurs."""
    r = random.Random(21)
    trees = {t: grow(r, r.randint(1, 25)) for t in range(60)}
    df, used = table(spark, trees), set()
    for _ in range(5):
        edits = []
        for t, root in trees.items():
            one = one_edit(r, root) if t % 7 else None
            if one:
                edits.append((t, 1, *one))
                used.add(one[0])
                plain(root, [(1, *one)])
        df, got = edited(spark, df, edits)
        assert got == sorted(x for t, root in trees.items() for x in rows(root, t))
    assert used == {*tree_edits.OPERATIONS, *tree_edits.MOVES}


def test_a_batch_of_edits(spark):
    """Nested edits of all kinds, several puts in one place, and a family that is numbered anew."""
    def tree():
        n = {k: Node(k, tag) for k, tag in enumerate("abcabcabcaabbcca")}
        for up, down in ((0, (1, 2, 3, 4)), (1, (5, 6)), (2, (7, 8)), (5, (9, 10)), (9, (11, 12)), (4, (13, 14)), (14, (15,))):
            for d in down:
                n[up].put(len(n[up].children), n[d])
        return n[0]

    batches = [
        [(1, "unwrap", 1, None, None), (2, "wrap", 5, None, "w"), (3, "unwrap", 9, None, None), (4, "wrap_children", 4, None, "v"), (5, "cut", 7, None, None)],
        [(1, "put_first", 7, 0, None), (2, "put_first", 8, 0, None), (3, "put_last", 11, 0, None), (4, "put_last", 12, 0, None), (5, "put_next", 13, 3, None), (6, "put_next", 6, 3, None), (7, "put_previous", 15, 4, None), (8, "put_previous", 10, 4, None)],
        [(1, "split", 0, None, None), (2, "unwrap", 14, None, None), (3, "wrap", 12, None, "w")],
        [(1, "put_next", 5, 4, None), (2, "unwrap", 9, None, None), (3, "wrap", 11, None, "w"), (4, "cut", 2, None, None)],
        [(1, "cut", 1, None, None), (2, "wrap", 9, None, "gone with 1"), (3, "wrap_children", 0, None, "x")],
        [(1, "merge_previous", 11, None, None), (2, "merge_next", 3, None, None), (3, "unwrap", 0, None, None), (4, "wrap", 0, None, "no")],
    ]
    trees, edits = {}, []
    for t, batch in enumerate(batches):
        trees[t] = tree()
        edits += [(t, *e) for e in batch]
    df = table(spark, trees)
    for t, batch in enumerate(batches):
        plain(trees[t], batch)
    assert edited(spark, df, edits)[1] == sorted(x for t, root in trees.items() for x in rows(root, t))


def test_what_can_not_be_done(spark):
    df = table(spark, {1: grow(random.Random(2), 9)})
    for bad in ([(1, 1, "turn", 3, None, None)], [(1, 1, "cut", 1000, None, None)], [(1, 1, "put_first", 3, 1000, None)], [(1, 1, "unwrap", 3, None, None), (1, 2, "wrap", 3, None, "x")], [(1, 1, "put_last", 3, 3, None)], [(9, 1, "cut", 3, None, None)]):
        with pytest.raises(Exception, match="no such operation|twice|can't go"):
            edited(spark, df, bad)
    assert edited(spark, df, [])[1] == sorted((r.tree, r.node, r.path, r.tag) for r in df.collect())


def test_other_columns_stay(spark):
    df = table(spark, {1: grow(random.Random(3), 6)}).selectExpr("tree", "node * 2 as twice", "node", "path", "tag", "array(tag) as keys")
    got = edited(spark, df, [(1, 1, "wrap", 3, None, "w")])[0]
    assert got.columns == df.columns and got.where("tag <> 'w'").where("twice = 2 * node and keys[0] = tag").count() == 6
    assert [(r.twice, r["keys"]) for r in got.where("tag = 'w'").collect()] == [(None, None)]


def test_no_table_of_nodes_is_told_to_all_tasks(spark, monkeypatch):
    """Whatever Spark takes their files' size for; the same rows come out where some trees are not edited."""
    plans = []
    write = tree_edits.materialise
    monkeypatch.setattr(tree_edits, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    trees = {t: grow(random.Random(t), 12) for t in range(4)}
    df = table(spark, trees)
    edits = [(1, 1, "split", 0, None, None), (2, 1, "merge_next", 3, None, None), (3, 1, "wrap", 3, None, "w")]
    for t, *e in edits:
        plain(trees[t], [tuple(e)])
    assert edited(spark, df, edits)[1] == sorted(x for t, root in trees.items() for x in rows(root, t))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
