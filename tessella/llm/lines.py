"""Operators 9 and 5: lines, sentences, or passages of many words that several documents hold.

All digest units in tasks, group the digests globally, and send each document only the digests
that concern it. No group is gathered: a frequent unit is a count and a minimum, combined before
the shuffle, and the join back has one row for it on one side, which adaptive execution splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels
from tessella.session import materialise, release

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """The keys of a text's lines: ends stripped of ASCII white space, A-Z lowered."""
    return [line.strip(_WHITE) for line in (text or "").encode().translate(_LOWER).split(b"\n")]


def _digest(unit: bytes) -> bytes:
    return xxhash.xxh3_128_digest(unit)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _line_digests(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names = [], []
            for k, text in enumerate(batch.column(1)):
                found = {_digest(key) for key in line_keys(text.as_py()) if _long_enough(key, least)}
                rows += [k] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(names, pa.binary())], names=["doc_id", "key"])

    return run


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, dropped, kept = [], [], []
        for text, gone in zip(batch.column(1), batch.column(2), strict=True):
            text, gone = text.as_py() or "", gone.as_py()
            all_lines = text.split("\n")
            stay = all_lines
            if gone:
                gone = set(gone)
                stay = [line for line, key in zip(all_lines, line_keys(text), strict=True) if _digest(key) not in gone]
            lines.append(len(all_lines))
            dropped.append(len(all_lines) - len(stay))
            kept.append("\n".join(stay))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def drop_repeated_lines(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: each text without the lines that least_docs documents hold.

    The document with the smallest doc_id keeps its lines. Null and empty texts are one empty
    line; shorter keys and lines of rows without a doc_id stay and are not counted. Rows that
    share a doc_id are one document when documents are counted, and each is returned. Texts of any
    length are read whole; an empty table gives no rows. Other columns, whatever their names, are
    not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = texts.where("doc_id is not null and text is not null").mapInArrow(_line_digests(least_chars), "doc_id long, key binary")
    held = held.distinct()
    common = held.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= least_docs)
    gone = held.join(common.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).where("doc_id > first").groupBy("doc_id").agg(F.collect_list("key").alias("gone"))
    return texts.join(gone.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", "gone").mapInArrow(
        _drop_lines, "doc_id long, n_lines long, n_dropped long, kept string"
    )


_MARKS = re.compile(r"[.!?]+|\n")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _unit_bounds(text: str) -> Iterator[tuple[int, int]]:
    """A unit ends at a line break or after full stops, exclamation or question marks before white space, not with its first character.

    Each run of marks is looked at once, so any text takes a time in proportion to its length.
    """
    start = 0
    for m in _MARKS.finditer(text):
        end = m.end()
        if text[m.start()] == "\n":
            if m.start() > start:
                yield start, m.start()
            start = end
        elif end - start >= 2 and end < len(text) and text[end].isspace():
            yield start, end
            start = end
    if start < len(text):
        yield start, len(text)


def units(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, normalised) of each unit with words: its words, lowered, with one blank between."""
    out = []
    text = text or ""
    for start, end in _unit_bounds(text):
        words = _WORD.findall(text[start:end].encode().translate(_LOWER))
        if words:
            out.append((start, end, len(words), b" ".join(words)))
    return out


def _unit_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, names, starts, counts = [], [], [], []
        for k, text in enumerate(batch.column(1)):
            found: dict[bytes, list[int]] = {}
            for start, _, _, unit in units(text.as_py()):
                found.setdefault(_digest(unit), []).append(start)
            rows += [k] * len(found)
            names += found
            starts += [x[0] for x in found.values()]
            counts += map(len, found.values())
        doc_id, tie = (batch.column(c).take(pa.array(rows, pa.int32())) for c in (0, 2))
        yield pa.RecordBatch.from_arrays([doc_id, tie, pa.array(names, pa.binary()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "tie", "key", "start", "n"])


def _cut_runs(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, removed, spans, kept = [], [], [], []
            for text, later in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                parts = units(text)
                # for each repeated digest: where its first occurrence is, or -1 in another document
                known = {x["key"]: x["at"] for x in later.as_py() or ()}
                again = [bool(known) and known.get(_digest(u), s) != s for s, _, _, u in parts]
                cut, k = [], 0
                while k < len(parts):
                    end = k
                    while end < len(parts) and again[end]:
                        end += 1
                    if end > k and sum(p[2] for p in parts[k:end]) >= least_words:
                        cut.append((k, end))
                    k = max(end, k + 1)
                at, stay, where = 0, [], []
                for a, b in cut:
                    start, end = parts[a][0], parts[b - 1][1]
                    stay.append(text[at:start])
                    where.append({"start": start, "end": end})
                    at = end
                count.append(len(parts))
                removed.append(sum(b - a for a, b in cut))
                spans.append(where)
                kept.append("".join([*stay, text[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["doc_id", "n_units", "n_removed", "removed", "kept"])

    return run


def remove_repeated_passages(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """doc_id, n_units, n_removed, removed, kept: each text without passages that stand earlier.

    Units are sentences and lines, compared by their lowered words. Occurrences rank by (doc_id,
    digest of the text, start); the earliest of a unit stays, and every later one goes, however
    short. A larger least_words spares runs of neighbouring later occurrences that have fewer
    words together. removed holds the original offsets (code points, end exclusive) of what went.
    A null text is empty; rows without a doc_id neither lose anything nor count; rows that share
    a doc_id and a text rank alike and both keep a unit's first occurrence. A text of any length
    is read whole, in a time that grows with it. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    held = texts.where("doc_id is not null and text is not null").mapInArrow(_unit_digests, "doc_id long, tie long, key binary, start long, n long")
    first = held.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "tie", "start")).alias("first")).where("n > 1")
    later = held.join(first.select(F.col("key").alias("k"), "first"), F.col("key") == F.col("k"))
    same = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.tie") == F.col("tie"))
    later = later.select("doc_id", "tie", F.struct("key", F.when(same, F.col("first.start")).otherwise(-1).alias("at")).alias("x"))
    # rows that agree in doc_id and text bring each key once
    later = later.groupBy("doc_id", "tie").agg(F.collect_set("x").alias("later")).withColumnsRenamed({"doc_id": "d", "tie": "t"})
    return texts.join(later, (F.col("doc_id") == F.col("d")) & (F.col("tie") == F.col("t")), "left").select("doc_id", "text", "later").mapInArrow(
        _cut_runs(least_words), "doc_id long, n_units long, n_removed long, removed array<struct<start: long, end: long>>, kept string"
    )


def _run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of so many consecutive words, given the words' hashes; at least one run."""
    up, down = kernels.powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return kernels.mix((sums[size:] - sums[:-size]) * down[: len(words) - size + 1])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbouring values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def window_anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For each window of words the smallest hash of the runs of half its length in it: equal windows have equal ones."""
    run = max(1, window // 2)
    return _least(_run_hashes(words, run), window - run + 1)


def _anchors(window: int):
    """The distinct anchors of each text: about one for a quarter of a window's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names = [], [np.zeros(0, np.uint64)]
            for k, words in kernels.each_text(batch.column(1), kernels.ALPHANUMERIC):
                if len(words) >= window:
                    names.append(np.unique(window_anchors(words, window)))
                    rows.append(np.full(len(names[-1]), k))
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(np.concatenate(names).view(np.int64))], names=["doc_id", "tie", "anchor"])

    return run


def _windows(window: int):
    """Digest (key, and the half of the anchor) and place of each window whose anchor other documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(3)
            held = batch.filter(marks.is_valid())
            rows, keys, halves, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            shared = held.column(3)
            for k, words in kernels.each_text(held.column(1), kernels.ALPHANUMERIC) if len(held) else ():
                anchors = window_anchors(words, window)
                at = np.flatnonzero(np.isin(anchors, shared[k].values.to_numpy().view(np.uint64)))
                rows.append(np.full(len(at), k))
                keys.append(_run_hashes(words, window)[at])
                halves.append(anchors[at])
                places.append(at)
            of = pa.array(np.concatenate(rows))
            half = np.concatenate(halves).astype(np.uint32).view(np.int32)  # the lower half
            columns = [held.column(0).take(of), held.column(2).take(of), pa.array(np.concatenate(keys).view(np.int64)), pa.array(half), pa.array(np.concatenate(places))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "key", "half", "place"])

    return run


def _again_in(words: np.ndarray, window: int) -> np.ndarray:
    """Places of the windows that stand earlier in the same text, apart from them."""
    if len(words) < 2 * window:
        return np.zeros(0, np.int64)
    hashes = _run_hashes(words, window)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return np.flatnonzero(np.arange(len(hashes)) - first[which] >= window)


def _word_places(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Where each word of a text's bytes begins, and the text's length, in code points."""
    word = kernels.ALPHANUMERIC[data] != 0
    begins = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    points = np.cumsum((data & 0xC0) != 0x80)
    return points[begins] - 1, int(points[-1]) if len(points) else 0


def _cut_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            count, removed, spans, kept = [], [], [], []
            for k, words in kernels.each_text(batch.column(1), kernels.ALPHANUMERIC):
                text = batch.column(1)[k].as_py() or ""
                begins, length = _word_places(np.frombuffer(text.encode(), np.uint8))
                bounds = np.array(list(_unit_bounds(text)), np.int64).reshape(-1, 2)
                parts = np.searchsorted(begins, bounds)
                parts = parts[parts[:, 0] < parts[:, 1]]  # units with words, as ranges of words
                later = batch.column(2)[k]
                places = later.values.to_numpy() if later.is_valid else np.zeros(0, np.int64)
                places = np.concatenate((places, _again_in(words, window))) if ids[k] else places
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, places, 1)
                np.add.at(change, places + window, -1)
                gone = np.concatenate(([False], np.cumsum(change)[:-1] > 0, [False]))
                edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
                lost = np.concatenate(([0], np.cumsum(gone[1:-1])))
                at, stay, where = 0, [], []
                for a, b in edges:
                    start, end = int(begins[a]), int(begins[b]) if b < len(begins) else length
                    stay.append(text[at:start])
                    where.append({"start": start, "end": end})
                    at = end
                count.append(len(parts))
                removed.append(int((lost[parts[:, 1]] > lost[parts[:, 0]]).sum()))
                spans.append(where)
                kept.append("".join([*stay, text[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["doc_id", "n_units", "n_removed", "removed", "kept"])

    return run


def remove_long_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_units, n_removed, removed, kept: each text without passages of `window` words or more that stand earlier.

    Passages begin and end at any word, whatever the sentences, and are compared by their lowered
    words. A window of so many words goes if the same words stand in a document that ranks before,
    by (doc_id, digest of the text), or earlier in the same text without touching it; what no such
    window covers stays, so that texts without such passages are left as they are. removed holds
    original offsets (code points, end exclusive): from the first word that goes to the next that
    stays, or to the text's end. n_units are the sentences and lines with words, n_removed those
    of them that lose words.

    Equal windows have equal anchors, the smallest hash of the half windows inside, of which a
    text has few. Only windows whose anchor several documents hold are digested and grouped, so
    none that is repeated is missed.

    A null text is empty; rows without a doc_id neither lose anything nor count; rows that share a
    doc_id and a text rank alike and keep the same. A text of any length is read whole. An empty
    table gives no rows. Other columns, whatever their names, are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    held = materialise(texts.where("doc_id is not null and text is not null").mapInArrow(_anchors(window), "doc_id long, tie long, anchor long"), "anchors")
    ends = held.groupBy(F.col("anchor").alias("a")).agg(*(f(c).alias(f"{n}_{c}") for c in ("doc_id", "tie") for n, f in (("min", F.min), ("max", F.max))))
    shared = ends.where("min_doc_id < max_doc_id or min_tie < max_tie").select("a")
    marks = held.join(shared, F.col("anchor") == F.col("a")).groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t")).agg(F.collect_set("anchor").alias("marks"))
    marks = materialise(marks, "marks")
    release(held)
    same = (F.col("doc_id") == F.col("d")) & (F.col("tie") == F.col("t"))
    # the exchange of the texts is the same in each join with them, so that Spark moves them once
    found = texts.join(marks, same, "left").select("doc_id", "text", "tie", "marks").mapInArrow(_windows(window), "doc_id long, tie long, key long, half int, place long")
    rank = F.struct("doc_id", "tie")
    first = found.groupBy(F.col("key").alias("k"), F.col("half").alias("h")).agg(F.min(rank).alias("first"))
    later = found.join(first, (F.col("key") == F.col("k")) & (F.col("half") == F.col("h"))).where(rank > F.col("first"))
    later = later.groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t")).agg(F.collect_list("place").alias("later"))
    return texts.join(later, same, "left").select("doc_id", "text", "later").mapInArrow(
        _cut_windows(window), "doc_id long, n_units long, n_removed long, removed array<struct<start: long, end: long>>, kept string"
    )
