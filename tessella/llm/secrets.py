"""Operator 4: find secrets, by known forms and by a battery of randomness tests.

Known forms (assignments to telling names, access keys, long runs of hex digits) are patterns.
Beyond them, every long run of key characters is a candidate. Its encoding is inferred, and with
it an alphabet and an order of its symbols; then the battery looks at

- chi-squared uniformity over the alphabet, through the number of equal pairs of symbols,
- runs: how often neighbouring symbols change between lower case, upper case and digits,
- serial correlation of neighbouring symbols' places in the alphabet.

Ordinary text is the null hypothesis: the symbol and change frequencies that the whole corpus has
in its words. A candidate's p-value says how likely ordinary text of its length would look so
uniform and change so often; one that is not random either (too even, or serially correlated)
has p-value 1. Benjamini and Hochberg's step-up rule, applied to each band of lengths by itself,
decides which candidates are reported, so that short candidates, which are many and weak, do not
use up the error rate of long ones.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels
from tessella.session import materialise

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: The order of kinds among spans that begin together.
KINDS = ("assign", "access", "hex", "random")
#: Least length of a candidate, and where bands of lengths begin.
LEAST, BANDS = 20, (20, 28, 40, 64, 128)
#: Accepted share of ordinary text among what a band reports.
RATE = 0.001
#: Below this p-value under randomness a candidate isn't random.
ODD = 1e-4
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)

_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, the narrowest first: name, symbols in order.
ENCODINGS = (
    ("digits", _DIGIT),
    ("hex", _DIGIT + _LOWER[:6]),
    ("HEX", _DIGIT + _UPPER[:6]),
    ("base32", _UPPER + "234567"),
    ("BASE36", _DIGIT + _UPPER),
    ("base36", _DIGIT + _LOWER),
    ("base62", _DIGIT + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGIT + "-_"),
)
_PLACE = {name: {ord(c): i for i, c in enumerate(symbols)} for name, symbols in ENCODINGS}
_SETS = [(name, frozenset(symbols)) for name, symbols in ENCODINGS]
#: 0 lower case, 1 upper case, 2 digits, 3 others.
_CLASS = np.full(128, 3, np.int8)
for _k, _symbols in enumerate((_LOWER, _UPPER, _DIGIT)):
    _CLASS[[ord(c) for c in _symbols]] = _k


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known forms, by start and then kind as listed."""
    out = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            out.append((m.start(), m.end(), 0))
    for m in _ACCESS.finditer(text) if "AKIA" in text else ():
        if m.end() - m.start() >= 20:
            out.append((m.start(), m.end(), 1))
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def encoding(run: str) -> str | None:
    """The narrowest encoding that has all symbols of a run; none for single words and for mixtures."""
    symbols = set(run)
    if symbols <= set(_LOWER) or symbols <= set(_UPPER):
        return "base36" if symbols <= set(_LOWER) else "BASE36"
    return next((name for name, have in _SETS if symbols <= have), None)


def statistics(run: str, name: str) -> tuple[int, int, float]:
    """(equal pairs of symbols, changes of class, lag-1 serial correlation of the symbols' places)."""
    codes = np.frombuffer(run.encode(), np.uint8)
    counts = np.bincount(codes)
    pairs = int((counts * (counts - 1) // 2).sum())
    kinds = _CLASS[codes]
    place = _PLACE[name]
    x = np.array([place[c] for c in codes.tolist()], float)
    x -= x.mean()
    total = float(x @ x)
    return pairs, int((kinds[1:] != kinds[:-1]).sum()), float(x[:-1] @ x[1:]) / total if total else 1.0


def _tail(z: float) -> float:
    """Of the standard normal distribution, the share above z."""
    return 0.5 * math.erfc(z / math.sqrt(2))


class Ordinary:
    """What ordinary text looks like: the frequency of each symbol and of changes of class in the corpus' words."""

    def __init__(self, symbols: np.ndarray, neighbours: int, changes: int) -> None:
        self.symbols = symbols.astype(float) + 0.01
        self.change = (changes + 1) / (neighbours + 20)

    def power_sums(self, name: str) -> tuple[float, float]:
        p = self.symbols[[ord(c) for c in dict(ENCODINGS)[name]]]
        p = p / p.sum()
        return float((p**2).sum()), float((p**3).sum())

    def p_value(self, length: int, name: str, pairs: int, changes: int, serial: float) -> float:
        """How likely ordinary text of this length looks so random; 1 for what is not random itself."""
        n, k = length, len(dict(ENCODINGS)[name])
        if name == "digits":
            return 1.0
        every = n * (n - 1) / 2
        # randomness first: chi-squared is 2 k pairs / n + k - n, so both tails are tails of pairs
        mean, spread = every / k, math.sqrt(every * (1 / k) * (1 - 1 / k))
        if 2 * _tail(abs(serial + 1 / n) * math.sqrt(n)) < ODD or _tail((pairs - mean) / spread) < ODD / 10:
            return 1.0
        if pairs < mean and 2 * _tail((mean - pairs) / spread) < ODD:  # as even as a listing of the alphabet
            return 1.0
        s2, s3 = self.power_sums(name)
        variance = every * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
        even = _tail((every * s2 - pairs) / math.sqrt(max(variance, 1e-9)))
        expected = (n - 1) * self.change
        often = _tail((changes - 0.5 - expected) / math.sqrt(max(expected * (1 - self.change), 1e-9)))
        often = max(often, math.exp(-2 * (n - 1) * max(0.0, (changes - 0.5) / (n - 1) - self.change) ** 2) if changes > expected else often, 1e-300)
        even = max(even, 1e-300)
        x = -2 * (math.log(even) + math.log(often))  # Fisher: chi-squared with 4 degrees of freedom
        return math.exp(-x / 2) * (1 + x / 2)


def band(length: int) -> int:
    """The number of a length's band."""
    return sum(length >= b for b in BANDS) - 1


_FOUND = "doc_id long, base array<struct<start: long, end: long, kind: string>>, runs array<struct<start: long, end: long, encoding: string, pairs: long, changes: long, serial: double>>, symbols array<long>, neighbours long, changes long"
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("pairs", pa.int64()), ("changes", pa.int64()), ("serial", pa.float64())]))
_ROW = pa.schema([("doc_id", pa.int64()), ("base", _BASE), ("runs", _RUNS), ("symbols", pa.list_(pa.int64())), ("neighbours", pa.int64()), ("changes", pa.int64())])


def _word_counts(column: pa.Array, symbols: np.ndarray) -> tuple[int, int]:
    """Add the symbols of all words of a batch; (neighbouring symbols inside words, changes of class between them)."""
    data, offsets = kernels.utf8(column)
    neighbours = changes = 0
    for i, j in kernels.slices(offsets):
        raw = data[offsets[i] : offsets[j]]
        symbols += np.bincount(raw, minlength=256)[:128]
        kinds = np.where(raw < 128, _CLASS[raw & 127], 3)
        inside = (kinds[1:] != 3) & (kinds[:-1] != 3)
        ends = offsets[i + 1 : j] - offsets[i] - 1
        inside[ends[(ends >= 0) & (ends < len(inside))]] = False
        neighbours += int(inside.sum())
        changes += int((inside & (kinds[1:] != kinds[:-1])).sum())
    return neighbours, changes


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and after each batch one with what its words add up to."""
    for batch in batches:
        base, runs = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            known = base_spans(text)
            base.append([{"start": a, "end": b, "kind": k} for a, b, k in known])
            own = []
            starts = [s for s, _, _ in known]
            reach = list(accumulate((e for _, e, _ in known), max))  # the furthest end of a known form so far
            for m in _RUN.finditer(text):
                a, b, run = m.start(), m.end(), m[0]
                name = encoding(run)
                before = bisect_left(starts, b)  # known forms that begin before the run ends
                if name and not (before and reach[before - 1] > a):
                    pairs, changes, serial = statistics(run, name)
                    own.append({"start": a, "end": b, "encoding": name, "pairs": pairs, "changes": changes, "serial": serial})
            runs.append(own)
        n = len(base)
        empty = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _BASE), pa.array(runs, _RUNS), pa.nulls(n, pa.list_(pa.int64())), empty, empty], schema=_ROW)
        symbols = np.zeros(128, np.int64)
        neighbours, changes = _word_counts(batch.column(1), symbols)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], _BASE), pa.array([None], _RUNS), pa.array([symbols.tolist()]), pa.array([neighbours]), pa.array([changes])], schema=_ROW)


_SCORED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("p", pa.float64())]))
_SCORED_ROW = "doc_id long, base array<struct<start: long, end: long, kind: string>>, scored array<struct<start: long, end: long, band: int, p: double>>"


def _score(ordinary: Ordinary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = []
            for runs in batch.column(2).to_pylist():
                own = []
                for r in runs:
                    n = r["end"] - r["start"]
                    own.append({"start": r["start"], "end": r["end"], "band": band(n), "p": ordinary.p_value(n, r["encoding"], r["pairs"], r["changes"], r["serial"])})
                scored.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scored, _SCORED)], names=["doc_id", "base", "scored"])

    return run


#: Steps of -log10(p) by which a band's candidates are counted.
_STEPS = 4


def _ordinary(found: DataFrame) -> Ordinary:
    """The corpus' counts, as one row."""
    counted = found.where("symbols is not null")
    row = counted.agg(*(F.sum(F.col("symbols")[k]).alias(f"s{k}") for k in range(128)), F.sum("neighbours").alias("n"), F.sum("changes").alias("c")).first()
    return Ordinary(np.array([row[f"s{k}"] or 0 for k in range(128)]), row["n"] or 0, row["c"] or 0)


def _limits(scored: DataFrame, rate: float) -> dict[int, float]:
    """For each band the largest p-value that its step-up rule accepts (0: none). What comes back has a row for each band and step."""
    step = F.least(F.lit(1200), F.floor(-F.log10(F.greatest("r.p", F.lit(1e-300))) * _STEPS))
    counted = scored.select(F.explode("scored").alias("r")).groupBy(F.col("r.band").alias("band"), step.alias("step")).count().collect()
    limits = {}
    for k in range(len(BANDS)):
        steps = sorted(((r["step"], r["count"]) for r in counted if r["band"] == k), reverse=True)
        total, so_far, limits[k] = sum(n for _, n in steps), 0, 0.0
        for step, n in steps:
            so_far += n
            most = 10.0 ** (-step / _STEPS)  # no p-value of this step is larger
            if most * total <= rate * so_far:
                limits[k] = most
    return limits


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans, for every row of docs.

    base: the known forms' spans (start, end exclusive, in code points; kind), by start and then
    kind as listed. spans: these and the spans of kind `random` that the battery reports. A run
    that touches a known form is no candidate. Null texts are empty; a null doc_id is kept; rows
    that repeat are each reported; an empty table gives no rows; texts of any length are read whole,
    in a time that grows with them. Other columns, whatever their names, are not read. One pass reads the texts; what the rule needs from the whole
    corpus are counts by symbol and by band.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(rows.mapInArrow(_scan, _FOUND), "candidates")
    ordinary = _ordinary(found)

    texts = found.where("symbols is null").drop("symbols", "neighbours", "changes")
    busy = materialise(texts.where("size(runs) > 0").mapInArrow(_score(ordinary), _SCORED_ROW), "scored")
    limits = _limits(busy, rate)
    kinds = "array<struct<start: bigint, end: bigint, kind: string>>"
    accepted = F.array(*(F.lit(limits[k]) for k in range(len(BANDS))))
    random = F.transform(F.filter("scored", lambda r: r["p"] <= F.get(accepted, r["band"])), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(KINDS[3]).alias("kind")))
    whole = texts.where("size(runs) = 0").select("doc_id", "base", F.col("base").alias("spans"))
    more = busy.select("doc_id", "base", F.sort_array(F.concat("base", random.cast(kinds))).alias("spans"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return whole.unionByName(more).select("doc_id", count("assign"), count("access"), count("hex"), "base", "spans")


def joined(spans: str) -> F.Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
