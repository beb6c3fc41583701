import numpy as np
import pytest

from tessella.llm import graph_index, queries


def brute(rows, every, k):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            near = sorted((-float(np.dot(v, w)), i) for i, w in rows.items() if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


KIND = "vec_id long, embedding array<float>, label int, e string, size string, shard string"


@pytest.fixture(scope="module")
def awkward(spark):
    r = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = {k: r.normal(size=8).astype(np.float32).round(2).tolist() for k in range(1, 90)}
    rows |= {k: rows[7] for k in range(200, 260)}  # copies, more than k
    rows |= {k: [1.0, 2.0, 3.0] for k in (300, 301)}
    odd = [(400, None), (420, []), (440, [0.0] * 8), (460, [nan] * 8), (480, [None, *[1.0] * 7]), (500, [inf] * 8), (None, rows[1])]
    every = [*rows.items(), *odd, (7, rows[7]), (300, [1.0, 2.0, 3.0])]  # repeated rows
    return spark.createDataFrame([(k, v, 1, "x", "x", "x") for k, v in every], KIND), rows


@pytest.mark.parametrize("shard", [8192, 16])
def test_matches_brute_force_on_awkward_rows(awkward, shard):
    df, rows = awkward
    found, want = got(graph_index.nearest(df, every=20, k=20, shard_size=shard)), brute(rows, 20, 20)
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in want[q]], rtol=1e-12)


def test_empty_table(awkward):
    assert graph_index.nearest(awkward[0].where("false")).collect() == []


def test_recall(spark, sf_dir):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    found, want = got(queries.QUERIES["op3_nearest_neighbours"](spark, sf_dir)), brute(rows, 20, 20)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_recall_of_a_graph():
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 32))
    vectors = centres[r.integers(0, 12, 5000)] + 0.5 * r.normal(size=(5000, 32))
    graph = graph_index.Graph.build(vectors)
    again = graph_index.Graph.unpack(32, **graph.pack())
    nodes, scores = again.search(vectors[:200], 20)
    exact = np.argsort(-(vectors[:200] @ vectors.T), axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(nodes, exact, strict=True)]) >= 0.95
    assert (np.diff(scores, axis=1) <= 0).all()


def test_recall_of_normal_vectors_in_full_shards(spark):
    """Vectors without any structure: a view of 128 finds 0.88 of the nearest, so wider ones are chosen."""
    r = np.random.default_rng(4)
    vectors = r.normal(size=(18_000, 64))
    vectors = vectors.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    graphs = graph_index.index(graph_index.classes(graph_index.usable(df), 21)).select("shard", "view").collect()
    assert len(graphs) == 3 and all(x.view >= 256 for x in graphs)
    found = got(graph_index.nearest(df))
    wide = vectors.astype(np.float64)
    hits = 0
    for q in range(0, len(wide), 20):
        near = np.argsort(-(wide @ wide[q]), kind="stable")
        hits += len({int(i) for i in near[near != q][:20]} & {i for i, _ in found[q]})
    assert hits >= 0.95 * 20 * len(found) and len(found) == 900


def test_recall_of_vectors_of_uneven_length():
    r = np.random.default_rng(14)
    vectors = r.normal(size=(8192, 64)) * np.exp(r.normal(size=(8192, 1)) / 2)
    graph = graph_index.Graph.build(vectors)
    nodes, _ = graph.search(vectors[::41], 20)
    exact = np.argsort(-(vectors[::41] @ vectors.T), axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(nodes, exact, strict=True)]) >= 0.95


def test_an_exact_scan_where_no_view_is_enough(monkeypatch):
    monkeypatch.setattr(graph_index, "RECALL", 1.01)
    vectors = np.random.default_rng(6).normal(size=(1500, 16))
    graph = graph_index.Graph.build(vectors)
    assert graph.view == 1500
    nodes, scores = graph.search(vectors[:50], 20)
    assert (nodes == np.argsort(-(vectors[:50] @ vectors.T), axis=1, kind="stable")[:, :20]).all() and (np.diff(scores, axis=1) <= 0).all()


def test_signs_of_zero_make_no_difference(spark):
    rows = [(20, [0.0, 1.0, 2.0]), (21, [-0.0, 1.0, 2.0]), (40, [-0.0, 3.0, 0.5]), (41, [1.0, 1.0, 1.0])]
    found = got(graph_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert found == brute(dict(rows), 20, 20)
