"""Operator 13: importance resampling towards a target, with hashed word and word-pair features.

Two passes over the texts, over Arrow batches. The first one counts the features of a partition
in one vector of BUCKETS numbers; vectors are merged in a tree, so the driver gets one. The second
one gathers the broadcast gains of a text's features and adds them up by document. Checksums of
features are computed for all words of a batch at once: byte by byte for the words, and for a
pair from those of its words, as a CRC of joined strings is linear in the CRC of the first one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import kernels
from tessella.session import materialise

BUCKETS = 10_000
#: Longer words are checksummed one by one.
WORD = 64
STRETCH = kernels.STRETCH
#: Reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _steps() -> np.ndarray:
    """What a CRC register becomes for each of its low bytes."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(_POLYNOMIAL), x >> 1).astype(np.uint32)
    return x


_STEP = _steps()


def _shifts() -> np.ndarray:
    """[n, k, b]: the part of byte k of a CRC, if it is b, in the CRC after n zero bytes."""
    out = np.empty((WORD + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, WORD + 1):
        out[n] = _STEP[out[n - 1] & 0xFF] ^ (out[n - 1] >> np.uint32(8))
    return out


_SHIFT = _shifts()


def _word_sums(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    length = ends - starts
    order = np.argsort(-np.minimum(length, WORD + 1), kind="stable")
    sizes = length[order]
    register = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    first = int(np.searchsorted(-sizes, -WORD))  # those before are longer
    at = starts[order]
    for p in range(WORD):
        n = int(np.searchsorted(-sizes, -p))  # words with more than p bytes
        if n <= first:
            break
        part = register[first:n]
        register[first:n] = _STEP[(part ^ low[at[first:n] + p]) & 0xFF] ^ (part >> np.uint32(8))
    register ^= np.uint32(0xFFFFFFFF)
    for k in range(first):
        register[k] = zlib.crc32(low[at[k] : at[k] + sizes[k]])
    out = np.empty_like(register)
    out[order] = register
    return out


def _pair_sums(sums: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, a blank and the next word."""
    spaced = sums[:-1] ^ np.uint32(0xFFFFFFFF)
    spaced = (_STEP[(spaced ^ np.uint32(0x20)) & 0xFF] ^ (spaced >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
    length = ends[1:] - starts[1:]
    n = np.minimum(length, WORD)
    out = sums[1:].copy()
    for k in range(4):
        out ^= _SHIFT[n, k, (spaced >> np.uint32(8 * k)) & 0xFF]
    for k in np.flatnonzero(length > WORD):
        out[k] = zlib.crc32(low[starts[k + 1] : ends[k + 1]], int(spaced[k]))
    return out


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, texts of words, texts of features, buckets of features) of runs of texts; texts are numbered from first.

    A text that is longer than a stretch gives several; the pair across their border is in the later one.
    """
    data, offsets = kernels.utf8(column)
    for i, j in kernels.slices(offsets, STRETCH):
        before = None
        for begin, end in kernels.stretches(data, int(offsets[i]), int(offsets[j]), kernels.ALPHANUMERIC, STRETCH):
            at = np.clip(offsets[i : j + 1], begin, end) - begin
            starts, ends, low = kernels.word_bounds(data[begin:end], at, kernels.ALPHANUMERIC)
            if not len(starts):
                continue
            sums = _word_sums(low, starts, ends)
            text = np.searchsorted(at, starts, side="right") - 1
            # with the last word before this stretch, if there is one
            lead = int(before is not None)
            chain = (np.concatenate(([before], sums)).astype(np.uint32), np.concatenate(([0], starts)), np.concatenate(([0], ends)), np.concatenate((text[:1], text))) if lead else (sums, starts, ends, text)
            inside = chain[3][1:] == chain[3][:-1]
            pairs = _pair_sums(chain[0], low, chain[1], chain[2])[inside]
            yield i, j, text, np.concatenate((text, chain[3][1:][inside])), np.concatenate((sums, pairs)) % np.uint32(BUCKETS)
            before = sums[-1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for *_, buckets in _features(batch.column(0)):
            total += np.bincount(buckets, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def _vector(row) -> np.ndarray:
    return np.frombuffer(row.counts, np.int64)


def feature_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket's features occur in all texts."""
    vectors = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    return vectors.map(_vector).treeReduce(np.add, depth=3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, 1000 times the logarithm of how much more frequent it is in the target, with one more feature in each bucket."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = told.value.astype(np.float64)
        for batch in batches:
            n = batch.num_rows
            words, features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, j, word, text, buckets in _features(batch.column(1)):
                words[i:j] += np.bincount(word, minlength=j - i)
                features[i:j] += np.bincount(text, minlength=j - i)
                # whole numbers below 2^53, which doubles hold
                total[i:j] += np.bincount(text, weights=gain[buckets], minlength=j - i).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def _noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate that follows from the doc_id alone, floored."""
    hash_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(hash_, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank, one row for each row of docs.

    Weight is the floored mean gain of a text's words and pairs of neighbouring words towards
    the texts of target; score adds noise, so that the highest scores are a draw without
    replacement. Of the N rows with least_words words or more, floor(percent * N / 100) are
    drawn and ranked from 1; rank is null in all others. Ties go to the smaller doc_id, null
    last, then to fewer words, and rows that agree in all columns take neighbouring ranks. A null
    text has no words, and a text without words weight 0; a null doc_id is hashed as an empty
    string. Texts of any length are read whole, in stretches. Either table may be empty. Other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(gains(feature_counts(docs), feature_counts(target)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = texts.mapInArrow(_weigh(told), "doc_id long, n_words long, n_features long, weight long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)), "scores")
    may = scored.where(F.col("n_words") >= least_words)
    quota = percent * may.count() // 100
    # scores are whole numbers: logarithms of counts below 2^63, times 1000, and noise between
    # -3101 and 22900, so this table has fewer than 120,000 rows whatever the number of texts
    levels = may.groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    levels = materialise(levels.withColumn("above", above).where(F.col("above") < quota).select(F.col("score").alias("s"), "above"), "score-levels")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = may.join(F.broadcast(levels), F.col("score") == F.col("s")).groupBy(*columns, "above").agg(F.count("*").alias("copies"))
    tied = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "n_features").rowsBetween(W.unboundedPreceding, W.currentRow)
    drawn = drawn.withColumn("last", F.col("above") + F.sum("copies").over(tied))
    drawn = drawn.withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last"))))
    drawn = drawn.select(*columns, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    low = scored.join(F.broadcast(levels), (F.col("score") == F.col("s")) & (F.col("n_words") >= least_words), "left_anti")
    return drawn.unionByName(low.select(*columns, F.lit(None).cast("long").alias("rank")))
