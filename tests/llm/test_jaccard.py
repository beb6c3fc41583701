import random
import re
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from tessella import session
from tessella.llm import jaccard, queries


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def brute(rows, size, up, down):
    """Sizes and components by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and i != j and a and b and down * len(a & b) >= up * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(repr((i, len(s), None if i is None else root(i))) for i, s in sets)


def got(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize(("size", "threshold", "up", "down"), [(3, 0.9, 90, 100), (5, 0.8, 8, 10)])
def test_awkward_rows(docs, texts, size, threshold, up, down):
    assert got(jaccard.groups(docs, size, threshold)) == brute([(i, t) for i, t, *_ in texts], size, up, down)


@pytest.mark.parametrize(("block", "stars"), [(1024, 2), (8, 0)])
def test_families_of_near_copies(spark, monkeypatch, block, stars):
    """Chains and crowds around the threshold; with small blocks and no stars the blocks do all the work."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "STARS", stars)
    r = random.Random(5)
    rows = []
    for _ in range(6):
        text = [f"w{r.randrange(900)}" for _ in range(r.choice((4, 30, 90, 140)))]
        for _ in range(25):
            copy = list(text)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = f"v{r.randrange(900)}"
            if r.random() < 0.3:
                text = copy
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.groups(df, 3, 0.9)) == brute(rows, 3, 90, 100)
    assert got(jaccard.groups(df, 5, 0.8)) == brute(rows, 5, 8, 10)


def test_one_of_each(docs, texts):
    kept = jaccard.one_of_each(docs, 5, 0.8)
    assert kept.columns == docs.columns
    want = [i for i, t, *_ in texts if i is None]
    parts = [eval(x) for x in brute([(i, t) for i, t, *_ in texts], 5, 8, 10)]
    want += sorted({i for i, _, c in parts if i == c and i is not None})
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, want))


def test_unlike_texts_of_a_doc_id_stay(spark):
    """Each row is judged by its own text: no text goes because another one shares its doc_id."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (2, long), (2, "something else entirely that nobody has said before"), (2, long), (3, None), (3, None), (3, ""), (4, long + " end"), (None, long), (None, long)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id int, text string"), 5, 0.8)
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[0], rows[2], rows[4], rows[6], rows[8], rows[9]]))


def test_a_digest_that_most_sets_share(spark, monkeypatch):
    """One group of near copies holds a third of all rows, and a long passage is shared by unlike texts: several ranges and blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(3)
    passage = [f"p{k}" for k in range(80)]
    text = [f"t{k}" for k in range(100)]
    rows = []
    for k in range(300):
        copy = list(text)
        copy[r.randrange(100)] = f"x{k}"
        own = [f"o{k}x{j}" for j in range(r.choice((2, 9, 30)))]
        rows += [(3 * k, " ".join(copy)), (3 * k + 1, " ".join(passage + own)), (3 * k + 2, " ".join(f"y{k}z{j}" for j in range(20)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(jaccard.groups(df, 3, 0.9)) == brute(rows, 3, 90, 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shared_over_ranges():
    """Keys that go on from one range to the next are told by their borders."""
    import pyarrow as pa

    r = random.Random(8)
    rows = sorted((r.randrange(6), r.randrange(40)) for _ in range(90))
    for cuts in ([], [30], [10, 11, 60], [5, 40, 41, 42, 80]):
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part = rows[a:b]
            batches = [pa.RecordBatch.from_pydict({"key": [x for x, _ in part[i : i + 7]], "r": [x for _, x in part[i : i + 7]]}, pa.schema([("key", pa.int64()), ("r", pa.int64())])) for i in range(0, len(part), 7)]
            found = [x for y in jaccard._shared(iter(batches)) for x in y.to_pylist()]
            firsts = {k: min(v for x, v in part if x == k) for k, _ in part}
            held = {k: {v for x, v in part if x == k} for k in firsts}
            assert sorted((x["key"], x["r"], x["low"]) for x in found if not x["border"]) == sorted((k, v, firsts[k]) for k, vs in held.items() if len(vs) > 1 for v in vs)
            assert {(x["key"], x["low"]) for x in found if x["border"]} == {(part[0][0], firsts[part[0][0]]), (part[-1][0], firsts[part[-1][0]])}


def test_empty_table(no_docs):
    assert jaccard.groups(no_docs).collect() == []
    assert jaccard.one_of_each(no_docs).collect() == []


def test_query(spark, sf_dir, documents):
    assert got(queries.QUERIES["op8_ngram_jaccard_join"](spark, sf_dir)) == brute([(i, t) for i, t, *_ in documents[1]], 3, 90, 100)


@pytest.mark.parametrize("threshold", [Fraction(1, 2), Fraction(4, 5), Fraction(9, 10)])
def test_linked_sets_share_a_digest(threshold):
    """The pigeonhole itself: whatever differs, a pair that reaches the threshold has a key in common."""
    r = np.random.default_rng(9)
    near = 0
    for _ in range(1500):
        n = int(r.integers(1, 160))
        pool = np.unique(r.integers(0, 2**63, 3 * n + 9, dtype=np.uint64) * np.uint64(2))
        r.shuffle(pool)
        drop, more = (int(r.integers(0, 1 + int(n * (1 - threshold)))) for _ in range(2))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[drop:n], pool[n : n + more])))
        both = n - drop
        if both and Fraction(both, n + more) >= threshold:
            near += 1
            shared = np.intersect1d(jaccard.digests(a, threshold), jaccard.digests(b, threshold))
            assert len(shared) or np.array_equal(a, b)
    assert near > 200


def test_digests_are_deleted_before_pairs_are_compared(docs, texts, monkeypatch):
    """They are most of what is written, and neither the comparison nor the result needs them."""
    written, left, compared = {}, [], jaccard._compared

    def write(df, name):
        out = session.materialise(df, name)
        written[name] = (set(df.columns), Path(session._written[id(out)][1].removeprefix("file:")))
        return out

    def compare(*args):
        left.append({name for name, (columns, path) in written.items() if columns & {"keys", "border"} and path.exists()})
        return compared(*args)

    monkeypatch.setattr(jaccard, "materialise", write)
    monkeypatch.setattr(jaccard, "_compared", compare)
    found = jaccard.groups(docs, 3, 0.9).collect()
    assert left and left[0] == set() and any("keys" in columns for columns, _ in written.values())
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in found) == brute([x[:2] for x in texts], 3, 9, 10)
