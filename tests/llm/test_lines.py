import hashlib
import re
import time
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import lines, queries

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        every = (text or "").split("\n")
        stay = [x for x in every if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(every), len(every) - len(stay), "\n".join(stay)))
    return sorted(map(repr, out))


def test_lines_of_awkward_rows(docs, texts):
    found = lines.drop_repeated_lines(docs).collect()
    assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.kept)) for r in found) == brute(texts)


def test_line_query(spark, sf_dir, documents):
    found = queries.QUERIES["op9_line_dedup"](spark, sf_dir).collect()
    want = {x[0]: x for x in map(eval, brute(documents[1]))}
    for r in found:
        i, n, d, kept = want[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, d, hashlib.sha256(kept.encode()).hexdigest())


def units(text):
    """(start, end, words, joined words), character by character: a unit ends at a line break, or behind a run of .!? (not at its start) before white space."""
    out, start = [], 0
    while start < len(text):
        if text[start] == "\n":
            start += 1
            continue
        end = start + 1
        while end < len(text) and text[end] != "\n":
            stop = end
            while stop < len(text) and text[stop] in ".!?":
                stop += 1
            if stop > end and stop < len(text) and text[stop].isspace():
                end = stop
                break
            end = max(stop, end + 1)
        word = "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text[start:end]).split(" ")
        if any(word):
            out.append((start, end, sum(map(bool, word)), " ".join(filter(None, word))))
        start = end
    return out


def passages(rows, least, tie=None):
    """Units rank by (doc_id, start), or (doc_id, tie of the text, start); runs of later occurrences with enough words go."""
    first = {}
    tie = tie or {}
    for i, text in {(i, t) for i, t, *_ in rows if i is not None and t}:
        for s, _, _, u in units(text):
            rank = (i, tie.get(text, 0), s)
            first[u] = min(first.get(u, rank), rank)
    out = []
    for i, text, *_ in rows:
        cut, run = [], []
        parts = units(text or "")
        for k, (s, _, _, u) in enumerate([*parts, (-1, -1, 0, None)]):
            if i is not None and u is not None and first[u] != (i, tie.get(text, 0), s):
                run.append(k)
                continue
            if run and sum(parts[j][2] for j in run) >= least:
                cut.append((parts[run[0]][0], parts[run[-1]][1]))
            run = []
        kept, at = "", 0
        for a, b in cut:
            kept, at = kept + (text or "")[at:a], b
        out.append((i, len(parts), kept + (text or "")[at:], cut))
    return sorted(map(repr, out))


def test_passages(docs, texts):
    for least in (1, 30):
        found = lines.remove_repeated_passages(docs, least).collect()
        assert sorted(repr((r.doc_id, r.n_units, r.kept, [(x.start, x.end) for x in r.removed])) for r in found) == passages(texts, least)


def test_least_words_on_the_whole_table(documents):
    found = lines.remove_repeated_passages(documents[0], 30).collect()
    assert sorted(repr((r.doc_id, r.n_units, r.kept, [(x.start, x.end) for x in r.removed])) for r in found) == passages(documents[1], 30)


def test_nothing_repeated_survives_beside_an_edit(spark):
    """An edit cuts a passage into short runs; a short unit follows a partly shared sentence."""
    unit = lambda letter, n: " ".join(f"{letter}{k}" for k in range(n)) + "."
    a, b, c, d, long = (unit(x, n) for x, n in (("a", 13), ("b", 13), ("c", 13), ("d", 13), ("e", 40)))
    first = " ".join([a, b, unit("x", 5), c, d, long, "Short end."])
    edited = " ".join([a, b, unit("y", 5), c, d])
    partly = " ".join(["Other " + long, "Short end.", a])
    rows = [(1, first), (2, edited), (3, partly)]
    found = {r.doc_id: r for r in lines.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.n_removed for i, r in found.items()} == {1: 0, 2: 4, 3: 2}
    assert [[edited[x.start : x.end].strip() for x in found[2].removed], found[2].kept.strip()] == [[f"{a} {b}", f"{c} {d}"], unit("y", 5)]
    assert [found[1].kept, found[3].kept.strip()] == [first, "Other " + long]
    runs = lambda text: {tuple(w[k : k + 51]) for w in [text.split()] for k in range(len(w) - 50)}
    assert not runs(found[3].kept) & runs(first) and not runs(found[2].kept) & runs(first)


def test_passage_query_leaves_no_later_occurrence(spark, sf_dir, documents):
    found = queries.QUERIES["op5_substring_dedup"](spark, sf_dir).collect()
    want = {x[0]: x for x in map(eval, passages(documents[1], 1))}
    for r in found:
        _, n, kept, cut = want[r.doc_id]
        assert (r.n_units, r.kept_sha256, r.removed_spans) == (n, hashlib.sha256(kept.encode()).hexdigest(), ",".join(f"{a}:{b}" for a, b in cut))


def test_rows_of_one_doc_id_with_unlike_texts(spark):
    """Their texts rank by digest: a unit stays in one of them only, whatever its offsets."""
    same = "This sentence is in all three."
    rows = [(1, f"{same} And more."), (1, f"Other words here. {same}"), (1, f"{same} Or less!"), (1, f"{same} Or less!"), (2, f"{same} {same}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r.text: r.t for r in df.selectExpr("text", "xxhash64(text) as t").collect()}
    found = lines.remove_repeated_passages(df).collect()
    assert sorted(repr((r.doc_id, r.n_units, r.kept, [(x.start, x.end) for x in r.removed])) for r in found) == passages(rows, 1, tie)
    kept = {r.kept for r in found if same in r.kept}
    assert len(kept) == 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.!? \n\t\x1cé", max_size=40))
def test_unit_bounds(text):
    assert lines.units(text) == [(s, e, n, w.encode()) for s, e, n, w in units(text)]


def test_long_runs_of_marks_take_no_longer_than_other_text():
    began = time.perf_counter()
    assert lines.units("." * 1_000_000) == [] and lines.units("!?" * 500_000 + "x") == [(0, 1_000_001, 1, b"x")]
    assert len(lines.units("a. " * 300_000)) == 300_000
    assert time.perf_counter() - began < 5


def windowed(rows, size, tie):
    """Texts without the windows of words that an earlier (doc_id, tie) holds, or that stand earlier in the text, apart."""
    word = re.compile("(?:[0-9A-Za-z]|[^\\x00-\\x7f])+")
    places = {}
    for i, text in {(i, t) for i, t, *_ in rows if i is not None and t}:
        found = list(word.finditer(text))
        low = [key(m[0]) for m in found]
        for k in range(len(low) - size + 1):
            places.setdefault(tuple(low[k : k + size]), {}).setdefault((i, tie[text]), []).append(k)
    out = []
    for i, text, *_ in rows:
        text = text or ""
        found = list(word.finditer(text))
        low = [key(m[0]) for m in found]
        gone = set()
        for k in range(len(low) - size + 1) if i is not None else ():
            held = places[tuple(low[k : k + size])]
            if min(held) < (i, tie[text]) or min(held[i, tie[text]]) + size <= k:
                gone |= set(range(k, k + size))
        cut = []
        for k in sorted(gone):
            end = found[k + 1].start() if k + 1 < len(found) else len(text)
            if cut and cut[-1][1] == found[k].start():
                cut[-1] = (cut[-1][0], end)
            else:
                cut.append((found[k].start(), end))
        kept, at = "", 0
        for a, b in cut:
            kept, at = kept + text[at:a], b
        lost = sum(any(k in gone and s <= m.start() < e for k, m in enumerate(found)) for s, e, *_ in units(text))
        out.append((i, len(units(text)), lost, kept + text[at:], cut))
    return sorted(map(repr, out))


def ties(df):
    return {r.text: r.t for r in df.selectExpr("text", "xxhash64(cast(text as string)) as t").collect()}


def test_long_passages(docs, texts, documents):
    for (df, rows), size in (((docs, texts), 5), ((docs, texts), 20), (documents, 50)):
        found = lines.remove_long_passages(df, size).collect()
        assert sorted(repr((r.doc_id, r.n_units, r.n_removed, r.kept, [(x.start, x.end) for x in r.removed])) for r in found) == windowed(rows, size, ties(df))


def test_passages_of_unlike_texts_of_one_doc_id(spark):
    same = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{same} a"), (1, f"b {same}"), (1, f"b {same}"), (None, same), (2, f"{same} {same}"), (0, f"c {same} d, {same}.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.remove_long_passages(df, 10).collect()
    assert sorted(repr((r.doc_id, r.n_units, r.n_removed, r.kept, [(x.start, x.end) for x in r.removed])) for r in found) == windowed(rows, 10, ties(df))


def test_passage_query_takes_passages_inside_sentences_and_leaves_clean_texts(spark, tmp_path):
    word = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    long = word("p", 51)
    rows = [(1, f"Yes. {word('a', 30)} {long} {word('b', 9)}. No."), (2, f"Yes. {word('c', 20)} {long}, {word('d', 20)}. No."), (3, f"Yes. {word('e', 60)}. {word('a', 30)}. No.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.QUERIES["op5_substring_dedup"](spark, str(tmp_path)).collect()}
    start = rows[1][1].index("p0")
    assert {i: (r.n_units, r.n_removed, r.removed_spans) for i, r in found.items()} == {1: (3, 0, ""), 2: (3, 1, f"{start}:{start + len(long) + 2}"), 3: (4, 0, "")}
    assert found[2].kept_sha256 == hashlib.sha256(f"Yes. {word('c', 20)} {word('d', 20)}. No.".encode()).hexdigest()


def test_empty_tables(no_docs):
    assert lines.drop_repeated_lines(no_docs).collect() == []
    assert lines.remove_repeated_passages(no_docs).collect() == []

def test_long_passages_of_an_empty_table(no_docs):
    assert lines.remove_long_passages(no_docs).collect() == []
