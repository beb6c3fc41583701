"""Operator 1: the languages of a text, as a mixture inferred by expectation maximisation.

Every language is a distribution over hashed n-grams of 2 and 3 characters, blanks at the ends of
words included, learnt from labelled texts. A text's n-grams are taken to be drawn from a mixture of
languages; EM estimates the proportions. Which languages take part is chosen greedily by
penalised likelihood: another language enters only if the log-likelihood it adds exceeds the
penalty for one more parameter. One that a first small step towards could improve the mean
likelihood of an n-gram by 2 % at most is not fitted at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets for hashed n-grams.
BUCKETS = 1 << 16
#: Labelled texts of a language that are learnt from: about as many, chosen by a hash of doc_id.
TRAIN_DOCS = 20_000
#: Languages that are learnt: the most frequent ones. The model has a number for each of them and each bucket.
LABELS = 256
#: Languages whose counts, half a MB each, a task keeps before it passes them on.
AT_ONCE = 32
_SEEDS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of 2 and 3 characters of a lowered text, white space and marks as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64)
    letter = (points >= 0x61) & (points <= 0x7A) | (points >= 0xAA) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points <= 0x206F))
    points = np.where(letter, points, np.uint32(32))
    keep = letter | np.concatenate(([True], letter[:-1]))  # one blank for a run
    points = np.concatenate(([np.uint32(32)], points[keep], [np.uint32(32)]))
    one = points * _SEEDS[0]
    two = one[:-1] * np.uint32(31) + points[1:] * _SEEDS[1]
    three = two[:-1] * np.uint32(31) + points[2:] * _SEEDS[2]
    three = three[points[1:-1] != 32] if len(points) > 2 else three
    out = np.concatenate((two, three))
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(16)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at])], names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if lang not in held and len(held) >= AT_ONCE:  # counts of tasks are added up anyhow
                yield from rows()
            n = np.bincount(grams(text.as_py()), minlength=BUCKETS)
            held[lang] = held[lang] + n if lang in held else n
    yield from rows()


class Model:
    """Labels, and each bucket's probability under each label, smoothed by the mean of all labels."""

    def __init__(self, labels: list[str], counts: np.ndarray) -> None:
        self.labels = labels
        every = counts.sum(axis=0) + 0.5
        back = every / every.sum()
        self.p = ((counts + 200.0 * back) / (counts.sum(axis=1, keepdims=True) + 200.0)).T.astype(np.float32).copy()

    def mixture(self, text: str | None, penalty: float = 6.0, rounds: int = 12) -> list[tuple[str, float]]:
        """(label, proportion), largest first; empty if the text is null or has no letter."""
        if not text or not any(map(str.isalpha, text)):
            return []
        found = grams(text)
        if len(found) > 4096:  # as counts, which is the same likelihood
            n = np.bincount(found, minlength=BUCKETS)
            at = np.flatnonzero(n)
            p, n = self.p[at], n[at].astype(np.float64)
        else:
            p, n = self.p[found], np.ones(len(found))
        alone = n @ np.log(p)
        chosen = [int(np.argmax(alone))]
        best, share = float(alone[chosen[0]]), np.ones(1)
        while len(chosen) < len(self.labels):
            have = p[:, chosen] @ share
            tried = None
            for k in range(len(self.labels)):
                if k in chosen:
                    continue
                # what a first small step towards k could gain bounds whether it is worth fitting
                if float(n @ (p[:, k] / have)) / n.sum() - 1 <= 0.02:
                    continue
                q = p[:, [*chosen, k]].astype(np.float64)
                w = np.append(share * 0.8, 0.2)
                for _ in range(rounds):
                    r = q * w
                    w = n @ (r / r.sum(axis=1, keepdims=True)) / n.sum()
                gain = float(n @ np.log(q @ w)) - best
                if tried is None or gain > tried[0]:
                    tried = (gain, k, w)
            if tried is None or tried[0] <= penalty * np.log(n.sum() + 1):
                break
            best, share = best + tried[0], tried[2]
            chosen.append(tried[1])
        order = np.argsort(-share, kind="stable")
        return [(self.labels[chosen[k]], float(share[k])) for k in order]


def train(labelled: DataFrame, per_language: int = TRAIN_DOCS, seed: int = 7) -> Model:
    """Learn from (doc_id, text, lang). Of a language with more than per_language texts, about that many, by a hash of doc_id.

    Of more than LABELS values of lang the most frequent are learnt, ties to the smaller one. What
    reaches the driver is one count for each of them and each bucket at most, whatever the corpus.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros((0, BUCKETS)))
    limits = F.create_map(*(F.lit(x) for lang in labels for x in (lang, round(min(1.0, per_language / sizes[lang]) * (1 << 20)))))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < limits[F.col("lang")]
    counted = rows.where(chosen).select("text", "lang").mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    counts = np.zeros((len(labels), BUCKETS))
    counts[got["lang"].map({x: k for k, x in enumerate(labels)}).to_numpy(int), got["bucket"].to_numpy(int)] = got["n"]
    return Model(labels, counts)


def _infer(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            found = [model.mixture(x.as_py()) for x in batch.column(1)]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("proportion", pa.float64())]))
            mixture = pa.array([[{"lang": a, "proportion": b} for a, b in x] for x in found], kind)
            pred = pa.array([x[0][0] if x else "und" for x in found])
            score = pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pred, score, mixture], names=["doc_id", "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, mixture for every row of docs; only the text decides.

    score is the estimated share of the predicted language; of languages with equal shares the
    one that entered first comes first. Null texts and texts without a letter, and all texts if
    nothing was learnt, are `und` with score 0. A null doc_id is kept, repeated rows come out
    alike, an empty table gives no rows, and texts of any length are read whole. Other columns,
    whatever their names, are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    if not model.labels:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<lang: string, proportion: double>>)").alias("mixture"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _infer(shipped), "doc_id long, lang_pred string, score double, mixture array<struct<lang: string, proportion: double>>"
    )


def held_out(doc_id) -> F.Column:
    """crc32 of the decimal doc_id, modulo 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture: learn from the labelled rows that are not held out, predict all.

    Nulls, empty and long texts, repeated rows and empty tables are as in `identify`; rows without
    a text or lang, and those held out, teach nothing; a null doc_id is not held out.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")


def spoken(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose main language is known and has at least that share; all rows if nothing can be learnt.

    Null texts and texts without a letter go; repeated rows stay or go together; columns of any names are kept.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    if not model.labels:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        found = map(shipped.value.mixture, texts)
        return pd.Series([bool(x) and x[0][1] >= least for x in found])

    return docs.where(known(F.col("text")))
