"""Loops, layers and paths of drawings, and content chains of pages, against plain Python."""

import random
from collections import defaultdict, deque


from tessella.operators import groups, images
from tessella.plans import registry, tree_queries

DRAWINGS = {
    "loop": "  ###\n  # #  #\n###########\n  #      #\n  ########\n",
    "tail": "####\n   #\n   #####\n\n##\n##",
    "block": "#####\n#####\n#####\n#####\n#####",
    "dot": "\n  #\n",
    "blank": " \n",
}


def read(text):
    return {(x, y) for y, line in enumerate(text.split("\n")) for x, c in enumerate(line) if c != " "}


def beside(p):
    return [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]


def core(dots):
    dots = set(dots)
    while ends := {p for p in dots if sum(q in dots for q in beside(p)) < 2}:
        dots -= ends
    return dots


def steps(dots, starts):
    found, todo = dict.fromkeys(starts, 0), deque(starts)
    while todo:
        p = todo.popleft()
        for q in beside(p):
            if q in dots and q not in found:
                found[q] = found[p] + 1
                todo.append(q)
    return found


def layers(dots):
    border = [p for p in dots if any(q not in dots for q in beside(p))]
    return {p: n + 1 for p, n in steps(dots, border).items()}


def judge_paths(dots, rows):
    """rows: (part, x, y, steps). Each is a way of that many steps between the ends that two sweeps find."""
    by = defaultdict(dict)
    for part, x, y, n in rows:
        assert n not in by[part]
        by[part][n] = (x, y)
    for part, path in by.items():
        assert sorted(path) == list(range(len(path)))
        assert all(path[k + 1] in beside(path[k]) and path[k] in dots for k in range(len(path) - 1))
        around = steps(dots, [part])
        far = min((-n, p) for p, n in around.items())
        most = steps(dots, [far[1]])
        assert path[0] == far[1] and len(path) - 1 == max(most.values()) and path[len(path) - 1] == min((-n, p) for p, n in most.items())[1]
    return set(by)


def test_drawings(spark):
    r = random.Random(3)
    every = DRAWINGS | {f"r{k}": "\n".join("".join(r.choice("##  ") for _ in range(9)) for _ in range(7)) for k in range(3)}
    dots = images.pixels(spark.createDataFrame(list(every.items()), "image string, text string"), "image", "text")
    got = defaultdict(set)
    for x in dots.collect():
        got[x.image].add((x.x, x.y))
    want = {k: read(t) for k, t in every.items()}
    assert got == {k: d for k, d in want.items() if d}
    assert {(x.image, x.x, x.y) for x in images.core(dots).collect()} == {(k, *p) for k, d in want.items() for p in core(d)}
    assert {(x.image, x.x, x.y, x.layer) for x in images.layers(dots).collect()} == {(k, *p, n) for k, d in want.items() for p, n in layers(d).items()}
    rows = defaultdict(list)
    for x in images.long_paths(dots).collect():
        rows[x.image].append((tuple(x.part), x.x, x.y, x.steps))
    for k, d in want.items():
        assert judge_paths(d, rows[k]) == {min(steps(d, [p])) for p in d if len(steps(d, [p])) > 1}
    none = dots.where("false")
    assert images.core(none).collect() == images.layers(none).collect() == images.long_paths(none).collect() == []


def test_drawing_queries(spark, sf_dir):
    want = {r.image: read(r.text) for r in tree_queries.drawings(spark, sf_dir).collect()}
    found = registry.QUERIES["drawing_loops"](spark, sf_dir).collect()
    assert {(r.image, r.x, r.y, r.layer, r.in_core) for r in found} == {(k, *p, n, p in core(d)) for k, d in want.items() for p, n in layers(d).items()}
    rows = defaultdict(list)
    for r in registry.QUERIES["drawing_paths"](spark, sf_dir).collect():
        rows[r.image].append(((r.part_x, r.part_y), r.x, r.y, r.steps))
    for k, d in want.items():
        judge_paths(d, rows[k])


def chains(edges):
    """Tags on all ways from beginning to end, in their order; edges: (tag or None, next or None)."""
    tags = {t for e in edges for t in e if t is not None}

    def ways(without):
        seen, todo = set(), [None]
        while todo:
            here = todo.pop()
            for a, b in edges:
                if a == here and b != without and b is not None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        ends = any((a is None or a in seen) and b is None and a != without for a, b in edges if a is None or a in seen)
        return seen, ends

    must = [t for t in tags if not ways(t)[1]]
    return {t: 1 + sum(t not in ways(u)[0] for u in must if u != t) for t in must}


def test_content_chains(spark):
    r = random.Random(7)
    cases = {"fixed": {(None, "a"), ("a", "b"), ("b", "c"), ("c", None)}, "skip": {(None, "a"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "c"), ("c", None)}, "empty": {(None, "a"), ("a", None), (None, None)}, "loop": {(None, "a"), ("a", "b"), ("b", "a"), ("b", "z"), ("z", None)}}
    for k in range(20):
        words = [r.sample("abcde", r.randint(1, 5)) for _ in range(r.randint(1, 3))]
        cases[f"r{k}"] = {e for w in words for e in zip([None, *w], [*w, None], strict=True)}
    df = spark.createDataFrame([(p, a, b, 1) for p, es in cases.items() for a, b in es], "parent string, tag string, next string, n long")
    got = defaultdict(dict)
    for x in groups.content_chains(df).collect():
        got[x.parent][x.tag] = x.place
    assert got == {p: c for p, es in cases.items() if (c := chains(es))}
    assert got["fixed"] == {"a": 1, "b": 2, "c": 3} and got["loop"] == {"a": 1, "b": 2, "z": 3}
    follows = {(x.parent, x.tag): (x.must_precede, x.must_follow) for x in groups.content_follows(df).collect()}
    one = lambda found: next(iter(found)) if len(found) == 1 else None
    for p, es in cases.items():
        for t in {t for e in es for t in e if t is not None}:
            assert follows[p, t] == (one({b for a, b in es if a == t}), one({a for a, b in es if b == t}))


def test_chains_of_pages(spark, sf_dir):
    edges = defaultdict(set)
    for e in tree_queries.page_edges(spark, sf_dir).collect():
        edges[e.parent].add((e.tag, e.next))
    found = registry.QUERIES["page_content_chains"](spark, sf_dir).collect()
    assert {(r.parent, r.tag, r.place) for r in found} == {(p, t, c.get(t)) for p, es in edges.items() if (c := chains(es)) is not None for t in {t for e in es for t in e if t is not None}}
    assert {r.tag: r.place for r in found if r.parent == "html"} == {"head": 1, "body": 2}
