import re
from collections import defaultdict

import pytest

from tessella.llm import mixing, queries


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Weights 1, 2, 3; none above 3 times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1.0 + k % 3 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = left / w if (w := sum(weight[s] for s in order if s not in full)) else 0
        more = {s for s in order if s not in full and share * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in full else share * weight[s] for s in order}
        full |= more


def judge(found, rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += size(text)
    want, taken, most = targets(sizes), defaultdict(int), defaultdict(int)
    assert sorted(repr((r.doc_id, r.size, r.source)) for r in found) == sorted(repr((i, size(t), s)) for i, t, _, s in rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6


def test_awkward_rows(docs, texts):
    found = mixing.mix(docs).collect()
    judge(found, texts)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_levels_of_the_tree(docs, texts, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 3)
    judge(mixing.mix(docs).collect(), texts)


def test_repeated_rows_are_drawn_one_by_one(spark):
    """Many equal rows, and many rows of one size without a doc_id: the miss stays below one text."""
    rows = [(None, "same words here", "en", "a")] * 500 + [(7, "four words are here", "en", "a")] * 300 + [(None, f"own {k} text", "en", "b") for k in range(400)] + [(9, "x " * 2, "en", "c")] * 301
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    found = mixing.mix(df).collect()
    judge(found, rows)
    assert mixing.mixed(df).count() == sum(r.copies for r in found)


def test_query(spark, sf_dir, documents):
    judge(queries.QUERIES["op10_mixing"](spark, sf_dir).collect(), documents[1])


def test_copies(docs, texts):
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    want, have = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    for r in mixed.collect():
        have[r.doc_id, r.source, size(r.text)] += 1
        assert r.w_ == "z"
    assert have == {k: v for k, v in want.items() if v}


def test_no_python_on_the_main_path(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_table(no_docs):
    assert mixing.mix(no_docs).collect() == []
    assert mixing.mixed(no_docs).collect() == []
