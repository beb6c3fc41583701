"""Trees of choices against plain recursion."""

import random
from collections import Counter, defaultdict

from tessella.operators import choices
from tessella.plans import registry


def divide(items, most, path=()):
    """(item, path, problem) of (name, genres) rows."""
    taken = 0
    while items:
        for name, genres in items:
            if not genres:
                yield name, path, "no genre left"
            elif taken >= most:
                yield name, path, "too many choices"
        items = [] if taken >= most else [x for x in items if x[1]]
        if not items:
            return
        counts = Counter(g for _, genres in items for g in genres)
        best = min(counts, key=lambda g: (-counts[g], g))
        inside = [(n, g - {best}) for n, g in items if best in g]
        items, taken = [x for x in items if best not in x[1]], taken + 1
        if len(inside) > most:
            yield from divide(inside, most, (*path, best))
        else:
            yield from ((n, (*path, best), None) for n, _ in inside)


def promote(placed, popularity, most):
    shown = dict(placed)
    sets = {p[:k] for p in placed.values() for k in range(len(p))}
    for s in sorted(sets, key=len):
        below = [n for n, p in placed.items() if p[: len(s)] == s and len(p) > len(s)]
        free = most - len({placed[n][len(s)] for n in below}) - sum(p == s for p in placed.values())
        waiting = sorted((n for n in below if shown[n] == placed[n]), key=lambda n: (placed[n][len(s)], -popularity[n], n))
        for n in waiting[: max(free, 0)]:
            shown[n] = s
    return shown


def unwrap(placed, shown):
    out = dict(shown)
    sets = {p[:k] for p in placed.values() for k in range(1, len(p) + 1)}
    for s in sorted(sets, key=len):
        inside = [n for n in shown if shown[n] == s and shown[n] != placed[n] or shown[n] == placed[n] and placed[n][: len(s)] == s]
        if len(inside) == 1 and out[inside[0]] == shown[inside[0]]:
            out[inside[0]] = s[:-1]
    return out


def judge(spark, items, most):
    df = spark.createDataFrame(items, "item string, genres array<string>, popularity double").repartition(3)
    clean = [(n, {g for g in genres or [] if g is not None}) for n, genres, _ in items]
    got = choices.divide(df, most)
    want = sorted(divide(clean, most), key=repr)
    assert sorted(((r.item, tuple(r.path), r.problem) for r in got.collect()), key=repr) == want
    good = {n: p for n, p, problem in want if problem is None}
    popularity = {n: p for n, _, p in items}
    shown = choices.promote(got.where("problem is null"), most)
    assert {r.item: tuple(r.shown) for r in shown.collect()} == promote(good, popularity, most)
    single = choices.unwrap_singles(shown)
    assert {r.item: tuple(r.shown) for r in single.collect()} == unwrap(good, promote(good, popularity, most))


def test_choices(spark):
    r = random.Random(17)
    judge(spark, [(f"i{k}", r.sample("abcdefg", r.randint(0, 5)), float(r.randint(1, 9))) for k in range(120)], 4)
    judge(spark, [("n", None, 1.0), ("e", [], 2.0), ("x", ["a", None, "a"], 3.0), ("y", ["b"], 3.0)], 2)


def test_query(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    items = [(str(p.p_partkey), {*p.p_name.split(" "), *p.p_type.split(" "), p.p_brand, f"size {p.p_size % 7}"}) for p in parts]
    want = defaultdict(int)
    for _, path, problem in divide(items, 12):
        want["/".join(path), problem] += 1
    found = registry.QUERIES["part_choices"](spark, sf_dir).collect()
    assert {(r.path, r.problem): r.n for r in found if r.n} == want
    assert sum(r.shown for r in found if r.problem is None) == sum(n for (_, problem), n in want.items() if problem is None)
