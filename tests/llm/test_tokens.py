import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import queries, token_files

TOKENIZER = queries.tokenizer_file()


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def brute(rows, encode):
    out, start = [], 0
    for i, text in rows:
        ids = [*encode(text), 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_of_awkward_rows(docs, texts, encode):
    found = token_files.round_trip(docs, TOKENIZER).collect()
    found = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda x: x[1])
    ids = [x[0] for x in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [x[1] for x in found] == np.cumsum([0, *(x[2] for x in found)])[:-1].tolist()
    want = [(i, n, c) for i, _, n, c in brute([(i, t) for i, t, *_ in texts], encode)]
    assert sorted(map(repr, ((i, n, c) for i, _, n, c in found))) == sorted(map(repr, want))


def test_empty_table(no_docs):
    assert token_files.round_trip(no_docs, TOKENIZER).collect() == []


def test_query(spark, sf_dir, documents, encode):
    found = queries.QUERIES["op6_token_ids"](spark, sf_dir).collect()
    want = brute(sorted((i, t) for i, t, *_ in documents[1]), encode)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_select(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    top = int(values[-1]) if steps else 0
    edge = token_files.EliasFano.encode(values, top)
    assert [edge.select(i) for i in range(len(values))] == values.tolist()
    assert edge.decode().tolist() == values.tolist()


def test_space():
    r = np.random.default_rng(2)
    values = np.cumsum(r.integers(1, 2000, 10_000))
    edge = token_files.EliasFano.encode(values, int(values[-1]))
    bits = 8 * sum(x.nbytes for x in (edge.low, edge.high, edge.samples)) / len(values)
    assert bits < 3 + np.log2(values[-1] / len(values))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t'sabZ9é—日 !\0\xa0<|>", max_size=40), max_size=6))
def test_pieces_give_the_ids_of_the_whole(texts):
    encoder = token_files._encoder(TOKENIZER, "<u4")
    for most in (10, 1_000_000):
        encoder.most = most
        assert list(encoder.texts(pa.array(texts, pa.string()))) == list(map(encoder.whole, texts))


def test_added_tokens_as_the_tokenizer_has_them(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    encode = lambda text: plain.encode(text, add_special_tokens=False).ids
    assert encode("ab <|endoftext|> c") == [397, 220, 50256, 269]
    rows = [(1, "one two"), (2, "ab <|endoftext|> c"), (3, "x <|endof"), (4, "text|> y"), (5, ""), (6, "<|endoftext|><|endoftext|>\n"), (7, "é<|endoftext|>"), (8, "one two")]
    encoder = token_files._Encoder(TOKENIZER, "<u4")
    for _ in range(2):  # new pieces, then known ones
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.texts(pa.array([t for _, t in rows]))] == [encode(t) for _, t in rows]
    found = token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == brute(rows, encode)


def test_files_of_bounded_size(spark, docs, texts, encode, monkeypatch):
    """A range goes on in another file; blocks are smaller than some documents."""
    from tessella.session import shared_path

    want = sorted(repr((i, n, c)) for i, _, n, c in brute([(i, t) for i, t, *_ in texts], encode))
    store = shared_path(spark, "small-files")
    for name, value in (("FILE_DOCS", 3), ("FILE_BYTES", 500), ("BLOCK_BYTES", 64)):
        monkeypatch.setattr(token_files, name, value)
    rows = [(i, t) for i, t, *_ in texts]
    run = token_files._write(store, TOKENIZER, 0, 2)
    monkeypatch.setattr(token_files.TaskContext, "get", lambda: type("Here", (), {"partitionId": lambda self: 4})())
    made = [b.to_pylist()[0] for b in run(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["doc_id", "text"])]))]
    assert len(made) > len(rows) // 3 and [x["part"] for x in made] == list(range(len(made))) and all(x["docs"] <= 3 for x in made)
    found, before = [], 0
    for x in made:
        file = token_files.TokenFile(store, x["path"])
        parts = list(file.documents())
        assert all((a == file[i]).all() for i, a in enumerate(parts)) and sum(map(len, parts)) == x["ids"]
        found += [(i, len(p), zlib.crc32(p.astype("<u4").tobytes())) for i, p in zip(file.doc_ids, parts, strict=True)]
        before += x["ids"]
    assert sorted(map(repr, found)) == want


def test_other_tokenizers_encode_whole_texts(spark, texts):
    """Word ends, lower case and no byte level: its file says so, and no piece is looked up."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    rows = [(k, t) for k, (_, t, *_) in enumerate(texts[:30])]
    found = token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == brute(rows, lambda t: other.encode(t or "", add_special_tokens=False).ids)
    assert token_files._Encoder(TOKENIZER, "<u2").pieces and not token_files._Encoder(path, "<u2").pieces
