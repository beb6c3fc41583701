import hashlib
import re
import time

import pytest

from tessella.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    words, hit, names = split(text), set(), set()
    for name, item in items:
        own = split(item)
        k = min(window, len(own))
        for a in range(len(own) - k + 1) if own else ():
            for b in range(len(words) - k + 1):
                if words[b : b + k] == own[a : a + k]:
                    hit |= set(range(b, b + k))
                    names.add(name)
    return len(words), len(hit), names


@pytest.fixture(scope="module")
def items(texts):
    long = texts[0][1].split()
    return [(1, " ".join(long[10:30])), (2, "last LINE, here"), (3, None), (4, ""), (5, "One"), (6, " ".join(long[:20])), (70, " ".join(long[:20])), (8, "façon d’écrire"), (9, "never seen at all")]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, d string")


@pytest.mark.parametrize("shard", [2_000_000, 60])
def test_matches_brute_force(docs, texts, benchmark, items, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", shard)  # the smaller one takes several passes
    found = decontaminate.report(docs, benchmark).collect()
    want = sorted((repr(i), *brute(t, items)[:2], sorted(brute(t, items)[2])) for i, t, *_ in texts)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in found) == want
    for r in found:
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)


def test_spans_have_original_offsets(docs, benchmark, texts):
    row = decontaminate.scan(docs, benchmark).where("doc_id = 10").first()
    text = next(t for i, t, *_ in texts if i == 10)
    assert [text[x["start"] : x["end"]] for x in row.runs] == ["façon d’écrire\nlast line here", "façon d’écrire"]


def test_removal(docs, benchmark, texts):
    found = {r.doc_id: r for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert found[10].text == "première \npremière " and found[4].text is None
    whole = texts[0][1].split()
    assert found[0].text.split() == whole[30:]


def test_clean_judges_each_row(docs, benchmark, texts, items):
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    want = [i for i, t, *_ in texts if not (lambda n, h, _: h and 20 * h >= n)(*brute(t, items))]
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, want))


def test_empty_tables(docs, no_docs, benchmark, texts):
    assert decontaminate.report(no_docs, benchmark).collect() == []
    found = decontaminate.report(docs, benchmark.where("false")).collect()
    assert len(found) == len(texts) and not any(r.contaminated for r in found)


def test_many_equal_and_short_items():
    """20,000 items of one word are one class, marked once."""
    import pickle
    import time

    began = time.perf_counter()
    items = [(k, [b"true"]) for k in range(20_000)] + [(20_000 + k, [b"it", b"is"] + [b"true"] * (k % 3)) for k in range(9)]
    built = decontaminate.Automaton(items, 13)
    spans, classes, longest = built.match([b"it", b"is", b"true", b"true", b"no", b"true"])
    assert (sorted(set(spans)), longest) == ([(0, 2), (0, 3), (0, 4), (2, 3), (3, 4), (5, 6)], 4)
    assert sorted(built.items(classes)) == list(range(20_009))
    assert len(pickle.dumps(built)) < 1_000_000 and time.perf_counter() - began < 5


def test_shards_read_again(docs, texts, benchmark, items, monkeypatch):
    """With one shard kept, each batch reads the others again; the driver's setting is the tasks' default, so search here."""
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 60)
    monkeypatch.setattr(decontaminate, "KEPT", 1)
    folder, names = decontaminate.automata(benchmark, 13)
    assert len(names) > 2
    shards = decontaminate.Shards(folder, names)
    found = list(decontaminate._search(shards, pa.array([t for _, t, *_ in texts])))
    assert [(n, sum(x["last"] - x["first"] for x in runs), set(which)) for n, which, runs, _ in found] == [brute(t, items) for _, t, *_ in texts]
    assert len(shards.kept) == 1


def test_query(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {r.doc_id: r for r in queries.QUERIES["op2_decontamination"](spark, sf_dir).collect()}
    for i, text, *_ in documents[1][:40]:
        n, h, names = brute(text, items)
        assert (found[i].n_words, found[i].n_hit, found[i].n_items) == (n, h, len(names))
        assert found[i].items_sha256 == hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()


def test_one_word_many_times_takes_no_longer_than_other_items():
    began = time.perf_counter()
    automaton = decontaminate.Automaton([(1, [b"again"] * 20_000), (2, [b"again"] * 5)], 13)
    assert time.perf_counter() - began < 3
    spans, found, longest = automaton.match([b"again"] * 40)
    assert sorted(automaton.items(found)) == [1, 2] and longest == 40 and (27, 40) in spans
