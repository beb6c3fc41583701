import math
import zlib
from collections import Counter

import pyarrow as pa

from tessella.llm import langid, queries


def test_every_row_is_answered(docs, texts):
    found = langid.predict(docs).collect()
    assert len(found) == len(texts)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, r)
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in ("en", "fr", "und")
    for k in (4, 5, 6):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)


def test_nothing_to_learn(no_docs, docs):
    assert langid.predict(no_docs).collect() == []
    unlabelled = docs.withColumn("lang", docs["lang"].substr(9, 9)).where("doc_id = 0 and lang = 'none'")
    assert langid.predict(unlabelled).collect() == []
    assert langid.spoken(no_docs).columns == no_docs.columns


def test_held_out_accuracy(spark, sf_dir, documents):
    truth = {i: lang for i, _, lang, _ in documents[1]}
    found = [r for r in queries.QUERIES["op1_language_id"](spark, sf_dir).collect() if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) >= 0.97 * len(found)


def test_mixture_of_two_languages(documents, spark):
    df, rows = documents
    model = langid.train(df)
    one = {lang: max((t for _, t, x, _ in rows if x == lang and t and len(t) < 4000), key=len) for lang in ("en", "fr")}
    mixed = dict(model.mixture(one["en"][:1500] + " " + one["fr"][:1500]))
    assert set(mixed) == {"en", "fr"} and all(0.3 < p < 0.7 for p in mixed.values())
    assert len(model.mixture(one["en"])) == 1


def test_stage_keeps_columns_and_clean_rows(docs):
    kept = langid.spoken(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {4, 5, 6} and {0, 1, 10} <= ids


def plain_grams(text):
    """Buckets of 2 and 3 characters of each word with a blank at both ends, by whole numbers modulo 2^32."""
    letter = lambda c: "a" <= c <= "z" or ord(c) >= 0xAA and c not in "×÷" and not 0x2000 <= ord(c) <= 0x206F
    points, last = [32], True
    for c in text.lower():
        if letter(c) or last:
            points.append(ord(c) if letter(c) else 32)
        last = letter(c)
    points.append(32)
    out = []
    for k in range(len(points) - 1):
        two = points[k] * 0x9E3779B1 * 31 + points[k + 1] * 0x85EBCA6B
        out.append(two)
        if k + 2 < len(points) and points[k + 1] != 32:
            out.append(two * 31 + points[k + 2] * 0xC2B2AE35)
    mixed = ((x % 2**32) ^ (x % 2**32) >> 15 for x in out)
    return Counter((x * 0x2C1B3C6D % 2**32) >> 16 for x in mixed)


def plain_mixture(counts, text, penalty=6.0, rounds=12):
    """EM over dictionaries: counts has a Counter for each language."""
    labels = sorted(counts)
    every = sum(sum(c.values()) for c in counts.values()) + 0.5 * 2**16
    back = lambda b: (sum(c[b] for c in counts.values()) + 0.5) / every
    own = plain_grams(text)
    total = sum(own.values())
    sizes = {x: sum(counts[x].values()) for x in labels}
    p = {b: {x: (counts[x][b] + 200 * back(b)) / (sizes[x] + 200) for x in labels} for b in own}
    likelihood = lambda share: sum(n * math.log(sum(w * p[b][x] for x, w in share.items())) for b, n in own.items())
    first = max(labels, key=lambda x: likelihood({x: 1.0}))
    share = {first: 1.0}
    best = likelihood(share)
    while True:
        tries = []
        for x in labels:
            if x in share or sum(n * p[b][x] / sum(w * p[b][y] for y, w in share.items()) for b, n in own.items()) / total - 1 <= 0.02:
                continue
            new = {**{y: 0.8 * w for y, w in share.items()}, x: 0.2}
            for _ in range(rounds):
                add = dict.fromkeys(new, 0.0)
                for b, n in own.items():
                    whole = sum(w * p[b][y] for y, w in new.items())
                    for y, w in new.items():
                        add[y] += n * w * p[b][y] / whole
                new = {y: v / total for y, v in add.items()}
            tries.append((likelihood(new) - best, x, new))
        if not tries or max(tries)[0] <= penalty * math.log(total + 1):
            return share
        gain, _, share = max(tries)
        best += gain


def test_mixtures_by_brute_force(documents):
    """Chosen languages and proportions, of single texts and of pairs of them put together."""
    df, rows = documents
    model = langid.train(df)
    counts = {}
    for _, text, lang, _ in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    short = [t for _, t, *_ in rows if t and any(map(str.isalpha, t)) and len(t) < 1200]
    for text in [*short, *(a + " " + b for a, b in zip(short[:40], short[40:80], strict=False))]:
        got, want = dict(model.mixture(text)), plain_mixture(counts, text)
        assert set(got) == set(want)
        assert all(abs(got[x] - want[x]) < 1e-3 for x in got)


def test_many_labels_and_little_memory(spark, monkeypatch):
    """Counts do not depend on when they are passed on; of too many labels the most frequent are learnt."""
    rows = [(k, f"{'abcdefgh'[k % 8] * 3} {'xyz'[k % 3] * 4} own {k}", f"l{k % 40:02d}" if k % 5 else "most") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = langid.train(df)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in rows]), pa.array([x for *_, x in rows])], names=["text", "lang"])
    counts = {}
    for most in (1000, 3):
        monkeypatch.setattr(langid, "AT_ONCE", most)
        got = {}
        for part in langid._counts(iter([batch])):
            for r in part.to_pylist():
                got[r["lang"], r["bucket"]] = got.get((r["lang"], r["bucket"]), 0) + r["n"]
        counts[most] = got
    assert counts[3] == counts[1000] and sum(counts[3].values()) == sum(len(langid.grams(t)) for _, t, _ in rows)
    monkeypatch.setattr(langid, "LABELS", 3)
    few = langid.train(df).labels
    assert len(few) == 3 and "most" in few and few[:2] == ["l01", "l02"]
