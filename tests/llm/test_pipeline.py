import zlib

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from tessella.llm.queries import tokenizer_file

from . import test_decontamination, test_jaccard, test_mixing


def test_stages(spark, sf_dir):
    """Every stage by itself, against plain Python over what the one before kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark_decontamination", "mixing_sources", "token_ids"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        rows = after.collect()
        have = sorted(r.doc_id for r in rows)
        if name == "language_id":
            gone = {r.doc_id: r for r in before}.keys() - set(have)
            assert len(gone) < 0.1 * len(before)
            assert not {r.doc_id for r in before if not any(map(str.isalpha, r.text or ""))} & set(have)
        elif name == "near_duplicates":
            parts = [eval(x) for x in test_jaccard.brute([(r.doc_id, r.text) for r in before], 5, 8, 10)]
            assert have == sorted(i for i, _, c in parts if i == c)
        elif name == "benchmark_decontamination":
            hit = {r.doc_id: test_decontamination.brute(r.text, items) for r in before}
            assert have == sorted(i for i, (n, h, _) in hit.items() if not (h and 20 * h >= n))
        elif name == "mixing_sources":
            sizes = {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + test_mixing.size(r.text)
            want = test_mixing.targets(sizes)
            for s in sizes:
                got = sum(test_mixing.size(r.text) for r in rows if r.source == s)
                assert abs(got - want[s]) <= max(test_mixing.size(r.text) for r in before if r.source == s)
            assert max(have.count(i) for i in set(have)) <= 3
        else:
            t = Tokenizer.from_file(tokenizer_file())
            want = [[*t.encode(r.text, add_special_tokens=False).ids, 0] for r in before]
            assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want)
            assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
            break
        assert after.columns == columns
        docs, before = after, rows
        docs = spark.createDataFrame(rows, after.schema)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100
