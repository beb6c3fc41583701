"""Operator 3: nearest vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one class, which stands in the graph once and names its smallest members, so
copies neither crowd a graph nor hide each other. Classes are hashed into shards of about the
same size, however many there are. A shard's graph is three flat arrays: a level for each node,
the neighbours at the lowest level, and the neighbours above. Nodes enter in their order and
link to near nodes that entered before, diverse in direction, which gives early nodes the long
links that searches travel on. As shards are small, the candidates for links are found by exact
products in blocks, not by searching the growing graph. Nearness is the inner product: one more component makes all
vectors of a shard equally long, after which it is a distance.

How many nodes a search keeps in view is measured for each shard when it is built: a bounded
sample of its own vectors is searched for, and the view is doubled until RECALL of what an exact
scan finds is found. A shard in which a quarter of the nodes does not suffice is scanned.

Queries are a stated set. A task reads a shard's graph once and streams blocks of queries past
it; what the shards find is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.session import materialise

#: Classes in a shard, on average.
SHARD = 8192
#: Links that a node makes when it enters, and those it keeps at the lowest level and above.
LINKS, LOWEST, UPPER = 16, 32, 16
#: Candidates for links, and nodes that a search keeps in view at least.
CANDIDATES, VIEW = 48, 128
#: Share of the NEAR nearest that a view must find, over SAMPLE vectors of the shard.
RECALL, NEAR, SAMPLE = 0.97, 21, 64
#: Nodes whose neighbours a search looks at in one step.
STEP = 4
#: Queries in one block, and blocks that one task streams past a shard, about.
BLOCK, STREAM = 512, 64


def _diverse(near: np.ndarray, own: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (rows, nearest first, -1 for none), those nearer to the row's node than to a link chosen before; then the nearest others, up to most."""
    rows, width = near.shape
    there = near >= 0
    found = points[np.maximum(near, 0)]
    between = np.matmul(found, found.transpose(0, 2, 1))
    mine = np.einsum("rcd,rd->rc", found, own)
    kept = np.zeros((rows, width), bool)
    closest = np.full((rows, width), -np.inf, points.dtype)
    for c in range(width):
        good = there[:, c] & (mine[:, c] > closest[:, c]) & (kept.sum(axis=1) < most)
        kept[:, c] = good
        np.maximum(closest, np.where(good[:, None], between[:, c, :], -np.inf), out=closest)
    order = np.argsort(~kept * width + ~there * 2 * width + np.arange(width), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, order, axis=1)


def _level(points: np.ndarray, entered: np.ndarray, most: int) -> np.ndarray:
    """Neighbours (node numbers, -1 for none) among the nodes that are at a level, in the order they entered."""
    n = len(entered)
    own = points[entered]
    width = min(CANDIDATES, max(1, n - 1))
    forward = np.full((n, LINKS), -1, np.int32)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        score = own[a:b] @ own[:b].T
        score[np.arange(b)[None, :] >= np.arange(a, b)[:, None]] = -np.inf
        take = min(width, b)
        near = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < b else np.broadcast_to(np.arange(b), (b - a, b))
        value = np.take_along_axis(score, near, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)
        chosen = _diverse(np.where(np.isfinite(value), near, -1), own[a:b], own, LINKS)
        forward[a:b, : chosen.shape[1]] = chosen
    at, to = np.nonzero(forward >= 0)
    source, target = at.astype(np.int32), forward[at, to]
    left, right = np.concatenate((source, target)), np.concatenate((target, source))
    score = np.einsum("nd,nd->n", own[left], own[right])
    order = np.lexsort((right, -score, left))
    left, right = left[order], right[order]
    first = np.searchsorted(left, np.arange(n))
    place = np.arange(len(left)) - first[left]
    width = min(3 * most, int(place.max()) + 1 if len(place) else 1)
    out = np.full((n, most), -1, np.int32)
    near = np.full((n, width), -1, np.int64)
    near[left[place < width], place[place < width]] = right[place < width]
    for a in range(0, n, BLOCK):
        chosen = _diverse(near[a : a + BLOCK], own[a : a + BLOCK], own, most)
        out[a : a + BLOCK, : chosen.shape[1]] = chosen
    return np.where(out >= 0, entered[np.maximum(out, 0)], -1).astype(np.int32)


class Graph:
    """A shard's vectors and the flat neighbour arrays of its levels."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, lowest: np.ndarray, upper: np.ndarray, view: int = VIEW) -> None:
        self.vectors, self.levels, self.lowest, self.upper, self.view = vectors, levels, lowest, upper, view
        self.light = vectors.astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 5) -> Graph:
        n = len(vectors)
        draw = np.random.Generator(np.random.PCG64(seed)).random(n)
        levels = np.minimum(30, np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS))).astype(np.int8)
        if n:
            levels[0] = max(1, levels.max())  # a search begins here
        scale = max(float(np.abs(vectors).max(initial=0.0)), 1e-300)
        scaled = vectors / scale
        square = np.einsum("nd,nd->n", scaled, scaled)
        points = np.concatenate((scaled, np.sqrt(np.maximum(0.0, square.max(initial=0.0) - square))[:, None]), axis=1).astype(np.float32)
        lowest = _level(points, np.arange(n), LOWEST) if n else np.zeros((0, LOWEST), np.int32)
        above = []
        for level in range(1, int(levels.max(initial=0)) + 1):
            entered = np.flatnonzero(levels >= level)
            above.append(_level(points, entered, UPPER))
        graph = cls(vectors, levels, lowest, np.concatenate(above) if above else np.zeros((0, UPPER), np.int32))
        graph.view = graph._enough()
        return graph

    def _enough(self) -> int:
        """The least view, from VIEW on and doubled each time, that finds RECALL of the nearest; all nodes if a quarter is not enough."""
        n = len(self.vectors)
        asked = self.vectors[:: max(1, n // SAMPLE)]
        k = min(NEAR, n)
        exact, _ = self.scan(asked, k)
        view = VIEW
        while view <= n // 4:
            found, _ = self.search(asked, k, view)
            if np.mean([np.isin(a, b).mean() for a, b in zip(exact, found, strict=True)]) >= RECALL:
                return view
            view *= 2
        return max(n, 1)

    def scan(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """What search returns, from all inner products."""
        n = len(self.vectors)
        nodes, scores = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf)
        if n:
            for a in range(0, len(queries), BLOCK):
                part = queries[a : a + BLOCK]
                near = np.argsort(-(part @ self.vectors.T), axis=1, kind="stable")[:, :k]
                exact = np.einsum("qcd,qd->qc", self.vectors[near], part)
                order = np.argsort(-exact, axis=1, kind="stable")
                nodes[a : a + BLOCK, : near.shape[1]] = np.take_along_axis(near, order, axis=1)
                scores[a : a + BLOCK, : near.shape[1]] = np.take_along_axis(exact, order, axis=1)
        return nodes, scores

    def pack(self) -> dict[str, bytes]:
        return {"view": self.view, "vectors": self.vectors.astype("<f8").tobytes(), "levels": self.levels.tobytes(), "lowest": self.lowest.astype("<i4").tobytes(), "upper": self.upper.astype("<i4").tobytes()}

    @classmethod
    def unpack(cls, size: int, view: int, vectors: bytes, levels: bytes, lowest: bytes, upper: bytes) -> Graph:
        return cls(
            np.frombuffer(vectors, "<f8").reshape(-1, size),
            np.frombuffer(levels, np.int8),
            np.frombuffer(lowest, "<i4").reshape(-1, LOWEST),
            np.frombuffer(upper, "<i4").reshape(-1, UPPER),
            view,
        )

    def _descend(self, queries: np.ndarray, light: np.ndarray) -> np.ndarray:
        """The node where each query enters the lowest level: greedy steps through the levels above."""
        at = np.zeros(len(queries), np.int64)
        best = np.einsum("qd,qd->q", light[at], queries)
        end = len(self.upper)
        for level in range(int(self.levels[0]), 0, -1):
            entered = np.flatnonzero(self.levels >= level)
            rows = np.full(len(self.levels), -1, np.int64)
            rows[entered] = np.arange(end - len(entered), end)
            end -= len(entered)
            while True:
                near = self.upper[rows[at]]
                score = np.where(near >= 0, np.einsum("qcd,qd->qc", light[np.maximum(near, 0)], queries), -np.inf)
                top = score.argmax(axis=1)
                value = score[np.arange(len(at)), top]
                better = value > best
                if not better.any():
                    break
                at = np.where(better, near[np.arange(len(at)), top], at)
                best = np.where(better, value, best)
        return at

    def search(self, queries: np.ndarray, k: int, view: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, inner products in double precision) of the k nearest found for each query, nearest first; -1 for none."""
        view = view or self.view
        if view >= len(self.vectors):
            return self.scan(queries, k)
        nodes, scores = [np.zeros((0, k), np.int64)], [np.zeros((0, k))]
        for a in range(0, len(queries), BLOCK):
            got = self._beam(queries[a : a + BLOCK], self.light, max(k, view))
            exact = np.einsum("qcd,qd->qc", self.vectors[np.maximum(got, 0)], queries[a : a + BLOCK])
            exact[got < 0] = -np.inf
            order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            nodes.append(np.take_along_axis(got, order, axis=1))
            scores.append(np.take_along_axis(exact, order, axis=1))
        return np.concatenate(nodes), np.concatenate(scores)

    def _beam(self, queries: np.ndarray, light: np.ndarray, view: int) -> np.ndarray:
        n, rows = len(light), np.arange(len(queries))[:, None]
        # a power of two as the scale leaves the order as it is
        size = np.abs(queries).max(axis=1, keepdims=True)
        q = (queries / np.exp2(np.floor(np.log2(np.maximum(size, 1e-300))))).astype(np.float32)
        nodes = np.full((len(q), view), -1, np.int64)
        score = np.full((len(q), view), -np.inf, np.float32)
        done = np.zeros((len(q), view), bool)
        seen = np.zeros((len(q), n), bool)
        mark = np.zeros((len(q), n + 1), np.int16)
        nodes[:, 0] = self._descend(q, light)
        score[:, 0] = np.einsum("qd,qd->q", light[nodes[:, 0]], q)
        seen[rows[:, 0], nodes[:, 0]] = True
        live = np.arange(len(q))
        while len(live):
            here = np.arange(len(live))[:, None]
            open_ = ~done[live] & (nodes[live] >= 0)
            step = np.argsort(~open_, axis=1, kind="stable")[:, :STEP]  # the nearest open ones, as the view is sorted
            valid = np.take_along_axis(open_, step, axis=1)
            done[live[:, None], step] = True
            at = np.where(valid, nodes[live[:, None], step], 0)
            near = np.where(valid[:, :, None], self.lowest[at], -1).reshape(len(live), -1)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            near = np.where(fresh, near, n)
            place = np.broadcast_to(np.arange(1, near.shape[1] + 1, dtype=np.int16), near.shape)
            mark[live[:, None], near] = place  # of a node named twice, one place stays
            fresh &= mark[live[:, None], near] == place
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            value = np.full(near.shape, -np.inf, np.float32)
            value[r, c] = np.einsum("nd,nd->n", light[near[r, c]], q[live[r]])
            every = np.concatenate((score[live], value), axis=1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :view]
            score[live] = np.take_along_axis(every, order, axis=1)
            names = np.concatenate((nodes[live], np.where(fresh, near, -1)), axis=1)
            nodes[live] = names[here, order]
            done[live] = np.concatenate((done[live], np.zeros_like(fresh)), axis=1)[here, order]
            live = live[(~done[live] & (nodes[live] >= 0)).any(axis=1)]
        return nodes


_INDEX = "shard long, size int, ids array<long>, view int, vectors binary, levels binary, lowest binary, upper binary"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part: neither null, empty nor zero, all components finite.

    Of rows that share a vec_id the one with the smallest vector stands for all.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """class_id (smallest vec_id), embedding, ids: the distinct vectors, each with the smallest `most` vec_ids that hold it."""
    place = W.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    return first.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (shard, number of components) of rows sorted by these."""
    held: list[tuple] = []
    name = None

    def out():
        ids = np.concatenate([x[0] for x in held])
        graph = Graph.build(np.concatenate([x[1] for x in held]))
        row = {"shard": [name[0]], "size": [name[1]], "ids": [ids], **{k: [v] for k, v in graph.pack().items()}}
        schema = pa.schema([("shard", pa.int64()), ("size", pa.int32()), ("ids", pa.list_(pa.int64())), ("view", pa.int32()), *((c, pa.binary()) for c in ("vectors", "levels", "lowest", "upper"))])
        return pa.RecordBatch.from_pydict(row, schema)

    for batch in batches:
        shard, size, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        flat, ends = batch.column(3).values.to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
        cut = np.flatnonzero((shard[1:] != shard[:-1]) | (size[1:] != size[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, len(shard)], strict=True):
            if a == b:
                continue
            if held and name != (shard[a], size[a]):
                yield out()
                held = []
            name = (int(shard[a]), int(size[a]))
            held.append((ids[a:b], flat[ends[a] : ends[b]].reshape(b - a, -1)))
    if held:
        yield out()


def index(distinct: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """The graphs of classes: shard, size, ids, view, vectors, levels, lowest, upper. Vectors of unlike length never share a graph."""
    n = distinct.count()
    shards = max(1, -(-n // shard_size))
    rows = distinct.select(F.pmod(F.xxhash64("class_id"), F.lit(shards)).alias("shard"), F.size("embedding").alias("size"), "class_id", "embedding")
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "size", "class_id").mapInArrow(_build, _INDEX)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries of equal length."""
    schema = pa.schema([("size", pa.int32()), ("queries", pa.list_(pa.int64())), ("asked", pa.binary())])
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        flat, ends = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
        size = np.diff(ends)
        for width in np.unique(size):
            at = np.flatnonzero(size == width)
            for k in range(0, len(at), BLOCK):
                part = at[k : k + BLOCK]
                asked = flat[ends[part][:, None] + np.arange(width)]
                yield pa.RecordBatch.from_pydict({"size": [int(width)], "queries": [ids[part]], "asked": [asked.astype("<f8").tobytes()]}, schema)


_STREAM = ("size", "ids", "view", "vectors", "levels", "lowest", "upper", "queries", "asked")


def _search(k: int, view: int | None):
    """Rows of a shard's graph, then of the blocks that are searched for in it; then the next one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = ids = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["queries"] is None:
                    graph = Graph.unpack(*(row[c] for c in ("size", "view", "vectors", "levels", "lowest", "upper")))
                    ids = np.array(row["ids"])
                    continue
                nodes, scores = graph.search(np.frombuffer(row["asked"], "<f8").reshape(-1, row["size"]), k, view)
                q, place = np.nonzero(nodes >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(row["queries"])[q]), pa.array(ids[nodes[q, place]]), pa.array(scores[q, place])], names=["query", "class_id", "score"])

    return run


def search(graphs: DataFrame, queries: DataFrame, k: int, view: int | None = None) -> DataFrame:
    """query, class_id, score: the k nearest classes that the shards found, for queries (class_id, embedding).

    Queries are dealt into parts of about STREAM blocks. For each part and each shard of its
    length, one task reads the shard's graph and then the part's blocks, one after the other. The
    shards' finds are merged by rank, each task passing on at most k rows for a query. view is
    what was measured for the shard unless it is given.
    """
    spread = max(2, int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, -(-queries.count() // (BLOCK * STREAM)))
    blocks = queries.select("class_id", "embedding").repartition(spread, "class_id").mapInArrow(_block, "size int, queries array<long>, asked binary")
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64(F.element_at("queries", 1)), F.lit(parts)))
    names = graphs.select(F.col("shard").alias("s"), F.col("size").alias("z"))
    asked = blocks.join(names, F.col("size") == F.col("z")).drop("z").withColumnRenamed("s", "shard")
    copies = graphs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    stream = copies.unionByName(asked, allowMissingColumns=True).repartition("shard", "size", "part")
    stream = stream.sortWithinPartitions("shard", "size", "part", F.col("queries").isNotNull(), F.element_at("queries", 1))
    found = stream.select(*_STREAM).mapInArrow(_search(k, view), "query long, class_id long, score double")
    return found.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "class_id"))).where(F.col("place") <= k).drop("place")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard_size: int = SHARD, view: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`.

    Nearness is the inner product in double precision, ties to the smaller vec_id; the query's own
    row is no candidate. Vectors null, empty, zero or with null or non-finite components take no
    part, nor do rows without a vec_id; only vectors of equal length are compared. Equal vectors
    are searched for once, and all of them are found. With fewer candidates than k, all are
    returned; an empty table gives an empty result. Of rows that share a vec_id one takes part.
    Other columns, whatever their names, are not read.
    """
    rows = materialise(usable(vectors), "vectors")
    distinct = materialise(classes(rows, k + 1), "classes")
    graphs = materialise(index(distinct, shard_size), "graphs")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    # sorted by a digest, with the vectors compared where it agrees
    named = asked.withColumn("h", F.xxhash64("embedding")).join(distinct.select(F.col("embedding").alias("e"), "class_id", F.xxhash64("embedding").alias("g")), F.expr("h = g and embedding <=> e"))
    named = named.select(F.col("vec_id").alias("query_id"), "class_id")
    named = materialise(named, "queries")
    wanted = distinct.join(named.select(F.col("class_id").alias("c")).distinct(), F.col("class_id") == F.col("c"), "left_semi")
    found = search(graphs, wanted, k + 1, view)
    members = found.join(distinct.select(F.col("class_id").alias("c"), "ids"), F.col("class_id") == F.col("c")).select("query", "score", F.explode("ids").alias("vec_id"))
    best = members.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    own = named.join(lists, F.col("class_id") == F.col("query"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
