import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import infill, queries


def brute(i, text, seed=1, rearranged=90, suffix_first=20):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    k = [int(h[8 * j : 8 * j + 8], 16) for j in range(4)]
    a, b = sorted((k[0] % (n + 1), k[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or k[2] % 100 >= rearranged:
        return i, n, "plain", None, None, text
    if k[3] % 100 < suffix_first:
        return i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def judge(df, rows, **form):
    again = infill.restored(F.col("output"), F.col("form"))
    found = df.withColumn("again", again).collect()
    assert sorted(repr(tuple(r)[:6]) for r in found) == sorted(repr(brute(*x, **form)) for x in rows)
    assert Counter((r.doc_id, r.again) for r in found) == Counter((i, t or "") for i, t in rows)


def test_awkward_rows(docs, texts):
    made = infill.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    judge(made, [(i, t) for i, t, *_ in texts])


def test_lengths_about_a_run_and_texts_with_marks(spark):
    signs = "a<é日😀\0\nP>S"
    rows = [(k, "".join(signs[(k * j + j * j) % len(signs)] for j in range(n))) for k, n in enumerate([0, 1, 2, 3, 63, 64, 65, 127, 128, 129, 191, 192, 193, 640, *range(60, 70), *[100] * 40])]
    rows += [(1000, "a <P> b"), (1001, "<M>"), (1002, "<S"), (1003, "P><"), (1004, "<<P"), (1005, "<" * 200), (1006, ">S>M>P<S<M<P" * 9), (None, "no id " * 30), (7, None), (7, None), (-5, "minus " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    judge(infill.fill_in_middle(df), rows)
    judge(infill.fill_in_middle(df, infill.Form(seed=9, rearranged=100, suffix_first=100)), rows, seed=9, rearranged=100, suffix_first=100)


def test_a_very_long_text(spark):
    rows = [(k, "αβγ δε\n" * 400_000) for k in (3, 4)] + [(5, "short")]
    judge(infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)), rows)


def test_marks_that_can_not_be_told_apart():
    for marks in (("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.Form(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_query(spark, sf_dir, documents):
    found = queries.QUERIES["op12_fill_in_middle"](spark, sf_dir).collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = [(*(x := brute(i, t))[:5], digest(x[5]), digest(t or "")) for i, t, *_ in documents[1]]
    assert sorted(repr(tuple(r)) for r in found) == sorted(map(repr, want))
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table(no_docs):
    assert infill.fill_in_middle(no_docs).collect() == []
