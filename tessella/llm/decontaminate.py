"""Operator 2: find and remove passages of benchmark items with a generalised suffix automaton.

The automaton holds every run of words of every item. A document's words are streamed through it;
at each word it gives the longest run ending there that some item holds. Documents share only few
runs with the items, so arrays first find the stretches in which every two neighbouring words are
neighbours in some item, or which are a one-word item; only these can hold a window, and only
these are streamed.

Tasks build the automata, one for each shard of items, and write them to the shared folder as
flat arrays; the driver sees neither items nor automata. Each text is read once: a batch's
stretches go through one shard after the other. A worker keeps the hashes of all word pairs of
the benchmark (8 bytes each) and as many shards as KEPT allows.
"""

from __future__ import annotations

import pickle
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels
from tessella.llm.token_files import open_folder
from tessella.session import materialise, shared_path

#: Characters of items in one automaton, about.
SHARD_CHARS = 500_000
#: Shards that a worker keeps in memory; of a larger benchmark it reads the others again for each batch.
KEPT = 16
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


class Automaton:
    """Generalised suffix automaton of items' words, with the items that hold each window.

    Items of equal words are one class. A whole class shorter than a window is marked at the one
    state that stands for it, and found by following suffix links from marked state to marked
    state; a window is marked at the state that stands for it.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        equal: dict[tuple, list[int]] = {}
        for item, words in items:
            if words:
                equal.setdefault(tuple(words), []).append(item)
        self.classes = [sorted(x) for x in equal.values()]
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # state, words of the item so far or all of a short one, class
        for number, words in enumerate(equal):
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
                if n >= window or n == len(words):
                    ends.append((last, n, number))
        self._mark(ends)
        self._flatten()
        names = [b"".join(self.ids), np.cumsum([0, *map(len, self.ids)])]
        hashes = kernels.word_hashes(np.frombuffer(names[0], np.uint8), names[1][:-1], names[1][1:]) if self.ids else np.zeros(0, np.uint64)
        pairs = {(self.ids[a], self.ids[b]) for words in equal for a, b in zip(words, words[1:], strict=False)}
        left, right = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
        self.pairs = np.unique(pair_hashes(hashes[left], hashes[right]))
        self.single = np.unique(hashes if window == 1 else hashes[np.array([self.ids[w[0]] for w in equal if len(w) == 1], np.int64)])
        self.least = min((min(window, len(w)) for w in equal if len(w) > 1), default=2)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self._next, self._link, self._length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = len(self._next)
        self._next.append(dict(self._next[q]))
        self._link.append(self._link[q])
        self._length.append(self._length[p] + 1)
        self._link[q] = copy
        while p >= 0 and self._next[p].get(word) == q:
            self._next[p][word] = copy
            p = self._link[p]
        return copy

    def _mark(self, ends: list[tuple[int, int, int]]) -> None:
        """held: classes by the state that stands for a window; short: (width, class) of whole classes by state."""
        link, length, window = self._link, self._length, self.window
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.held: dict[int, set[int]] = {}
        above, marked = [0] * len(link), [0] * len(link)
        order = sorted(range(1, len(link)), key=length.__getitem__)
        for v in order:  # a suffix link leads to a shorter state
            if length[v] >= window:
                above[v] = v if length[link[v]] < window else above[link[v]]
        for at, words, number in ends:
            if words < window:  # the state of a whole item is as long as the item
                self.short.setdefault(at, []).append((words, number))
            else:
                self.held.setdefault(above[at], set()).add(number)
        for v in order:
            marked[v] = v if v in self.short else marked[link[v]]
        self.above, self.marked = np.array(above, np.int32), np.array(marked, np.int32)

    def _flatten(self) -> None:
        """Transitions as two sorted arrays."""
        steps = sorted((state << 32 | word, to) for state, out in enumerate(self._next) for word, to in out.items())
        self.steps, self.to = np.array([x for x, _ in steps], np.int64), np.array([x for _, x in steps], np.int32)
        self.link, self.length = np.array(self._link, np.int32), np.array(self._length, np.int32)
        del self._next, self._link, self._length

    def _step(self, state: int, word: int) -> int:
        """The next state, or -1."""
        code = state << 32 | word
        at = int(np.searchsorted(self.steps, code))
        return int(self.to[at]) if at < len(self.steps) and self.steps[at] == code else -1

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """(spans of words inside windows, classes with windows, longest match) of a stretch."""
        state = length = longest = 0
        spans, states, classes = [], set(), set()
        for k, word in enumerate(words, 1):
            number = self.ids.get(word)
            to = -1 if number is None else self._step(state, number)
            while state and to < 0:
                state = int(self.link[state])
                length = int(self.length[state])
                to = -1 if number is None else self._step(state, number)
            if to >= 0:
                state, length = to, length + 1
            longest = max(longest, length)
            if length >= self.window:
                spans.append((k - self.window, k))
                states.add(int(self.above[state]))
            at = int(self.marked[state])
            while at:
                for width, number in self.short[at]:
                    if width <= length:
                        spans.append((k - width, k))
                        classes.add(number)
                at = int(self.marked[self.link[at]])
        return spans, classes.union(*(self.held.get(x, ()) for x in states)), longest

    def items(self, classes: set[int]) -> list[int]:
        return [item for c in classes for item in self.classes[c]]


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return kernels.mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _among(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


class Shards:
    """The written automata, as one worker sees them."""

    def __init__(self, folder: str, names: list[str]) -> None:
        self.names = names
        self.store, self.root = open_folder(folder)
        self.kept: OrderedDict[str, Automaton] = OrderedDict()
        self.pairs = self.single = np.zeros(0, np.uint64)
        self.least = 2
        found = [self._load(f"{name}.pairs") for name in names]
        if found:
            self.pairs = np.unique(np.concatenate([x[0] for x in found]))
            self.single = np.unique(np.concatenate([x[1] for x in found]))
            self.least = min(x[2] for x in found)

    def _load(self, name: str):
        with self.store.open_input_stream(f"{self.root}/{name}") as file:
            return pickle.loads(file.read())

    def __iter__(self) -> Iterator[Automaton]:
        for name in self.names:
            if name not in self.kept:
                while len(self.kept) >= KEPT:
                    self.kept.popitem(last=False)
                self.kept[name] = self._load(name)
            yield self.kept[name]

    def stretches(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words in which a window may occur."""
        if not len(hashes):
            return []
        good = _among(self.pairs, pair_hashes(hashes[:-1], hashes[1:]))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        out = [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a + 1 >= self.least]
        if len(self.single):
            alone = _among(self.single, hashes)
            for a, b in out:
                alone[a:b] = False
            out += [(int(k), int(k) + 1) for k in np.flatnonzero(alone)]
        return out


_open: dict[str, Shards] = {}


def _shards(folder: str, names: list[str]) -> Shards:
    """A worker's shards, which its later tasks use too; those of another benchmark are dropped."""
    if folder not in _open:
        _open.clear()
        _open[folder] = Shards(folder, names)
    return _open[folder]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(shards: Shards, column: pa.Array) -> Iterator[tuple[int, list[int], list[dict], int]]:
    """(words, items with windows, runs, longest match) of each text of a column, in order."""
    data, offsets = kernels.utf8(column)
    for i, j in kernels.slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, low = kernels.word_bounds(part, at, kernels.ALPHANUMERIC)
        hashes = kernels.word_hashes(low, starts, ends)
        cut = np.searchsorted(starts, at)
        asked = []
        for k in range(j - i):
            for p, q in shards.stretches(hashes[cut[k] : cut[k + 1]]):
                a = cut[k] + p
                asked.append((k, p, [low[s:e].tobytes() for s, e in zip(starts[a : a + q - p], ends[a : a + q - p], strict=True)]))
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        longest: dict[int, int] = {}
        for automaton in shards if asked else ():
            classes: dict[int, set] = {}
            for k, p, words in asked:
                found, which, most = automaton.match(words)
                longest[k] = max(longest.get(k, 0), most)
                if found:
                    spans.setdefault(k, []).extend((p + x, p + y) for x, y in found)
                    classes.setdefault(k, set()).update(which)
            for k, which in classes.items():
                items.setdefault(k, set()).update(automaton.items(which))
        for k in range(j - i):
            a, runs = cut[k], []
            text = at[k]
            here = before = 0
            for x, y in _merge(spans.get(k, [])):
                s, e = int(starts[a + x] - text), int(ends[a + y - 1] - text)
                before += len(part[text + here : text + s].tobytes().decode())
                width = len(part[text + s : text + e].tobytes().decode())
                runs.append({"first": x, "last": y, "start": before, "end": before + width})
                here, before = e, before + width
            yield int(cut[k + 1] - a), sorted(items.get(k, ())), runs, longest.get(k, 0)


_FOUND = "doc_id long, tie long, n_words long, items array<long>, runs array<struct<first: long, last: long, start: long, end: long>>, longest long"
_RUN = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))


def _scan(folder: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _shards(folder, names)
        for batch in batches:
            found = list(_search(shards, batch.column(1)))
            n_words, items, runs, longest = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(runs, _RUN), pa.array(longest, pa.int64())], names=["doc_id", "tie", "n_words", "items", "runs", "longest"])

    return run


def _build(folder: str, window: int):
    """Write the automaton of each shard of items; rows are sorted by shard."""

    def write(shard: int, items: list[tuple[int, list[bytes]]]) -> None:
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        built = Automaton(items, window)
        for name, what in ((f"{shard}.pairs", (built.pairs, built.single, built.least)), (f"{shard}", built)):
            with store.open_output_stream(f"{root}/{name}") as out:  # another attempt writes the same
                out.write(pickle.dumps(what))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, done = [], None, []
        for batch in batches:
            for shard, item, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and shard != last:
                    write(last, held)
                    done.append(str(last))
                    held = []
                last = shard
                held.append((item, item_words(text)))
        if held:
            write(last, held)
            done.append(str(last))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["name"])

    return run


def automata(benchmark: DataFrame, window: int) -> tuple[str, list[str]]:
    """The folder and the names of the written automata, one for about SHARD_CHARS characters of items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-chars // SHARD_CHARS) or 1
    folder = shared_path(spark, "automata")
    dealt = items.select(F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard"), "item_id", "text")
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    built = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "item_id", "text").mapInArrow(_build(folder, window), "name string")
    return folder, sorted(r.name for r in materialise(built, "built").collect())


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, tie (a hash of the text), n_words, items (with windows in the text, sorted), runs, longest, for every row of docs.

    runs: maximal runs of words inside windows, as word numbers (first, last exclusive) and
    code points (start, end exclusive). A window is `window` consecutive words of an item; a
    shorter item is one window. Null texts have no words; an empty benchmark gives no runs;
    items without words or item_id have no windows; rows sharing an item_id are one item. Rows
    that repeat are each reported; an empty table gives an empty one; columns other than doc_id
    and text, whatever their names, are ignored.
    """
    return _texts(docs).mapInArrow(_scan(*automata(benchmark, window)), _FOUND)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20) -> DataFrame:
    """doc_id, tie, n_words, n_hit, n_items, items, runs, longest, contaminated: hit words times coverage reach the words of the text."""
    found = scan(docs, benchmark, window)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    found = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20) -> DataFrame:
    """The documents that are not contaminated, all columns and texts as they were.

    Each row is judged by its own text where it lies: nothing is joined or shuffled. Null texts
    have no words and stay. All rows stay if the benchmark is empty.
    """
    folder, names = automata(benchmark, window)

    @F.pandas_udf("boolean")
    def contaminated(texts: pd.Series) -> pd.Series:
        found = _search(_shards(folder, names), pa.array(texts, pa.string()))
        hits = ((n, sum(x["last"] - x["first"] for x in runs)) for n, _, runs, _ in found)
        return pd.Series([h > 0 and h * coverage >= n for n, h in hits], dtype=bool)

    return docs.where(~contaminated(F.col("text").cast("string")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at, kept = 0, []
            for run in runs or ():
                kept.append(text[at : run["start"]])
                at = run["end"]
            out.append(None if text is None else "".join([*kept, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(2)], names=["doc_id", "text", "removed"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, longest: int = 13, coverage: int = 20) -> DataFrame:
    """doc_id, text, removed: texts without runs of at least `longest` hit words, or without any run where the coverage rule holds."""
    removed = F.when(F.col("contaminated"), F.col("runs")).otherwise(F.filter("runs", lambda x: x["last"] - x["first"] >= longest))
    found = report(docs, benchmark, window, coverage).select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), removed.alias("removed"))
    met = _texts(docs).join(found.where("size(removed) > 0").distinct(), F.expr("doc_id <=> d and tie = t"), "left")
    kind = "array<struct<first: long, last: long, start: long, end: long>>"
    return met.select("doc_id", "text", "removed").mapInArrow(_cut, f"doc_id long, text string, removed {kind}")
