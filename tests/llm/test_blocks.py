import hashlib
import re
from collections import defaultdict

import pytest

from tessella.llm import blocks, queries


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and stays, hashlib.sha256(text.encode()).hexdigest()))
            stays = stays and i != keep
    return sorted(map(repr, out))


def judge(found, rows):
    assert sorted(repr(tuple(r)) for r in found) == brute(rows)


@pytest.mark.parametrize("size", [64, blocks.BLOCK])
def test_awkward_rows(docs, texts, size):
    found = blocks.exact_duplicates(docs, size)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    judge(found.collect(), texts)


def test_long_texts_that_differ_in_one_place(spark):
    """Equal but for one byte, one missing block or the order of two blocks; block borders inside characters."""
    long = "".join(f"{k:05d}é" for k in range(40_000))
    rows = [(1, long), (2, long), (3, long[:-1]), (4, long[:200_001] + "x" + long[200_002:]), (5, long[1024:]), (6, long[:900] + long[900:1800][::-1] + long[1800:]), (7, long + long), (8, long + long), (9, "x" * 2048), (10, "x" * 2047), (11, "x" * 2048), (12, "y" + long)]
    judge(blocks.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_one_text_in_a_third_of_all_rows(spark, monkeypatch):
    """Frequent blocks are named apart; with few of them the others take the plain way."""
    rows = [(k, "many times " * 30 if k % 3 == 0 else f"own {k // 2} " * 20) for k in range(600)] + [(None, "many times " * 30)] * 5 + [(5, f"own {2} " * 20)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    judge(blocks.exact_duplicates(df, 32).collect(), rows)
    monkeypatch.setattr(blocks, "FREQUENT", 2)
    judge(blocks.exact_duplicates(df, 32).collect(), rows)


def test_one_name_for_each_text(docs, texts):
    found = blocks.identities(docs, 16).collect()
    by_digest, by_name = defaultdict(set), defaultdict(set)
    for r in found:
        by_digest[bytes(r.digest)].add((r.level, r.name))
        by_name[r.level, r.name].add(bytes(r.digest))
    assert all(len(x) == 1 for x in [*by_digest.values(), *by_name.values()])
    assert sum(r.copies for r in found) == len(texts) and max(r.level for r in found) > 8


def test_query(spark, sf_dir, documents):
    judge(queries.QUERIES["op11_exact_dedup"](spark, sf_dir).collect(), documents[1])


def test_no_python_on_the_main_path(docs):
    rows = blocks._cut(docs, blocks.BLOCK)
    for df in (rows, blocks._pairs(rows.withColumn("name", rows.block.cast("string").cast("long"))), blocks.exact_duplicates(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def test_empty_table(no_docs):
    assert blocks.exact_duplicates(no_docs).collect() == []
