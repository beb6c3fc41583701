import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import queries, resample


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


def brute(rows, items, percent=25, least=20):
    s, t = Counter(), Counter()
    known = [(i, *features(text)) for i, text in rows]
    for *_, f in known:
        s.update(f)
    for text in items:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    out = []
    for i, words, f in known:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[1], x[2]))
    for k, x in enumerate(may[: percent * len(may) // 100]):
        x[5] = k + 1
    return sorted(map(repr, map(tuple, out)))


def judge(df, rows, items, **options):
    assert df.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in df.collect()) == brute(rows, items, **options)


def test_awkward_rows(spark, docs, texts):
    items = ["One two a line that many share", None, "", "première façon", "own 20 own 21"]
    target = spark.createDataFrame([(x, 1) for x in items], "text string, doc_id int")
    rows = [(i, t) for i, t, *_ in texts]
    judge(resample.resample(docs, target), rows, items)
    judge(resample.resample(docs, target, percent=100, least_words=0), rows, items, percent=100, least=0)


def test_repeated_rows_and_ties(spark):
    """A third of all rows are the same; ranks have no gap, and only as many are drawn as asked for."""
    rows = [(7, "one two three " * 10)] * 40 + [(None, "four five " * 15)] * 13 + [(k, f"word{k % 3} " * 25) for k in range(67)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for percent in (25, 60):
        judge(resample.resample(df, df.limit(3).select("text").where("false"), percent), rows, [], percent=percent)


def test_empty_tables(spark, docs, texts, no_docs):
    assert resample.resample(no_docs, docs).collect() == []
    rows = [(i, t) for i, t, *_ in texts]
    judge(resample.resample(docs, no_docs), rows, [])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \nAbz9é日😀\0-", max_size=60)), max_size=8), st.sampled_from([1, 3, 16, 1 << 20]))
def test_features_of_any_texts(texts, stretch):
    """Also where a stretch ends after any byte."""
    before, resample.STRETCH = resample.STRETCH, stretch
    try:
        words, found = np.zeros(len(texts), int), [Counter() for _ in texts]
        for i, _, word, text, buckets in resample._features(pa.array(texts, pa.string())):
            for k in word:
                words[i + k] += 1
            for k, b in zip(text, buckets.tolist(), strict=True):
                found[i + k][b] += 1
    finally:
        resample.STRETCH = before
    for text, n, have in zip(texts, words, found, strict=True):
        want = features(text)
        assert n == len(want[0]) and have == Counter(want[1])


def test_long_words_and_long_texts(spark):
    word = "wörd" * 30
    rows = [(1, "x" * 63 + " " + "y" * 64 + " " + "z" * 65 + " ab " + word), (2, ("l" * 3_000_000) + " end " + "m" * 70), (3, f"some {word} text in one long row " * 60_000), (4, "e")]
    judge(resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(word,)], "text string"), percent=50, least_words=1), rows, [word], percent=50, least=1)


def test_query(spark, sf_dir, documents):
    found = queries.QUERIES["op13_importance_resampling"](spark, sf_dir).collect()
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = [eval(x) for x in brute([(i, t) for i, t, *_ in documents[1]], items)]
    assert sorted(repr(tuple(r)) for r in found) == sorted(repr((x[0], *x[2:])) for x in want)


def test_the_draw_resembles_the_target(spark, documents):
    """Documents of one language are drawn more often if the target is in that language."""
    lang = {i: k for i, _, k, _ in documents[1]}
    one = "fr" if "fr" in lang.values() else Counter(lang.values()).most_common()[-1][0]
    target = documents[0].where(documents[0].lang == one)
    found = resample.resample(documents[0], target).where("rank is not null").collect()
    share = sum(lang[r.doc_id] == one for r in found) / len(found)
    assert share > 1.3 * sum(k == one for k in lang.values()) / len(lang)
