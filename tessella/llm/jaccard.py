"""Operator 8: which documents have nearly the same set of word shingles.

Method: universe-partition pigeonhole. Shingles are hashed, and the hashed universe is cut into
equal segments, their number depending on the band of sizes a set belongs to. If two sets differ
in at most H shingles, and the segments can tolerate more than H differences in all, then some
segment tolerates its own: it holds the same subset in both (a plain segment, which tolerates
none), or subsets that differ by one shingle (a segment with its one-deletion neighbourhood).
Each band takes the mixture of both kinds that a cost model finds cheapest. Sets that share a
segment's digest are candidates; the texts of candidate pairs are then compared exactly.

Texts are read once for all digests. Rows of digests are sorted in ranges, so that a digest
which a large part of all sets share lies in several tasks; each finds the digest's smallest
member in its own range, and what the ranges' borders share meets once more.

Where many sets share a digest, they first meet one member, its centre, as in a star; digests
whose members this connects need no further comparison. Of the others, only the members outside
the digest's largest component are left to compare, with all of it: first with that component's
smallest member, then in blocks of bounded size, where bit sketches rule out most pairs. In the
first turn only as many pairs are compared as could connect all, and at the end all that are
still apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels
from tessella.operators.graph import components
from tessella.session import materialise, release

#: Standard deviations by which a plan's tolerance exceeds the differences, so that empty segments rarely do harm.
DEVIATIONS = 5
#: How likely unrelated sets share a shingle, and the cost of a chance match, in digests.
SHARED, PAIR_COST = 0.1, 200
#: Further rounds in which one member of a digest meets the others, before they meet in blocks.
STARS = 1
#: Members of a digest in one block, on average.
BLOCK = 2048
#: Sizes in one band: the largest is about this many times the smallest.
BAND = 1.6
#: Documents of which all tasks are told at most (8 bytes each).
TOLD = 1_000_000


@lru_cache(maxsize=4096)
def band_end(k: int, threshold: Fraction) -> int:
    """The sizes of band k are band_end(k - 1) to band_end(k) - 1."""
    if k < 0:
        return 1
    low = band_end(k - 1, threshold)
    least = int(Fraction(low) / threshold) + 1  # so that a partner is in this band or the next
    return max(least, int(low * BAND) + 1)


def most_differ(n: int, threshold: Fraction) -> int:
    """In how many shingles a set of n and a linked one of at least n can differ."""
    return int((1 - threshold) / threshold * n)


@lru_cache(maxsize=4096)
def plan(k: int, threshold: Fraction) -> tuple[int, int]:
    """Numbers of plain segments and of segments with neighbourhoods for pairs from band k up.

    The smaller set of a pair is in band k and the larger one in band k or k + 1. What a set of
    the band tolerates must exceed the differences by DEVIATIONS standard deviations, as hashing
    leaves some segments empty. Cost of a choice: digests written for a set, plus the matches
    expected by chance, at PAIR_COST each, if unrelated sets share a shingle with probability SHARED.
    """
    sizes = (band_end(k - 1, threshold), band_end(k, threshold) - 1)
    if most_differ(sizes[1], threshold) == 0:
        return 0, 0

    def enough(plain: int, double: int) -> bool:
        m = plain + double
        for n in sizes:
            held = n / m
            none, one = math.exp(-held), held * math.exp(-held)
            tolerated = plain * (1 - none) + double * (2 - 2 * none - one)
            spread = math.sqrt(plain * none * (1 - none) + double * (4 * none + one - (2 * none + one) ** 2))
            if tolerated - DEVIATIONS * spread < most_differ(n, threshold) + 1:
                return False
        return True

    best = None
    most = sizes[1]
    top = most_differ(most, threshold) + 1
    for double in range(0, top // 2 + 2, max(1, top // 40)):
        low, high = (0 if double else 1), 4 * top + 40
        if not enough(high, double):
            continue
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if enough(middle, double) else (middle + 1, high)
        held = most / (low + double)
        digests = low + double * (1 + held)
        chance = digests * (math.exp(-held * (1 - SHARED)) - math.exp(-held))
        cost = digests + PAIR_COST * chance
        if best is None or cost < best[0]:
            best = (cost, low, double)
    return best[1:] if best else (top + most, 0)


@lru_cache(maxsize=4096)
def _edges(m: int) -> np.ndarray:
    return np.array([(j << 64) // m for j in range(1, m)], dtype=np.uint64)


def bands_of(n: int, threshold: Fraction) -> list[int]:
    """The plans under which a set of n shingles writes digests: its own band's, and the one below where it can have a partner."""
    k = 0
    while band_end(k, threshold) <= n:
        k += 1
    below = k > 0 and threshold * n <= band_end(k - 1, threshold) - 1
    return [k - 1, k] if below else [k]


_bands_of = lru_cache(maxsize=1 << 16)(bands_of)


def digests(hashes: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The segment digests of a set of sorted distinct hashes.

    A pair is missed by its segments only if each plain one that isn't empty differs, and each of
    the others in as many shingles as it tolerates and one more; then neither set tolerates more
    than the pair's differences. Such sets, which are rare, write a digest that they all share.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    strong = kernels.mix(hashes + np.uint64(0x5851F42D4C957F2D))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(strong, out=sums[1:])
    out = []
    for k in _bands_of(n, threshold):
        plain, double = plan(k, threshold)
        m = plain + double
        if not m:
            continue  # only equal sets are linked
        cut = np.concatenate(([0], np.searchsorted(hashes, _edges(m)), [n]))
        total, held = sums[cut[1:]] - sums[cut[:-1]], np.diff(cut)
        salt = kernels.mix(np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32))
        out.append(kernels.mix(total + salt)[held > 0])
        if double:
            first = cut[plain]
            segment = np.repeat(np.arange(plain, m), held[plain:])
            fewer = kernels.mix(total[segment] - strong[first:] + salt[segment])
            out.append(fewer[held[segment] > 1])
        tolerates = np.minimum(held[:plain], 1).sum() + np.minimum(held[plain:], 2).sum()
        if tolerates <= min(most_differ(n, threshold), most_differ(band_end(k, threshold) - 1, threshold)):
            out.append(kernels.mix(np.array([(k + 1) << 32 | 0xFFFFFFFF], np.uint64)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """Whether each of about six bits a shingle, 512 at least, is hit an odd number of times: a shingle that one of two sets lacks changes one bit, so the bits that differ are no more than the shingles."""
    m = 1 << max(9, len(hashes).bit_length() + 2)
    at = (kernels.mix(hashes) & np.uint64(m - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def _fold(rows: list[bytes]) -> np.ndarray:
    """Sketches as rows of equal width: the halves of longer ones are combined."""
    width = min(map(len, rows))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0) for x in rows])


def _most_bits(n, threshold: Fraction):
    """In how many bits the sketches of linked sets can differ that have n shingles together."""
    up, down = threshold.numerator, threshold.denominator
    return n * (down - up) // (down + up)


def _allowed(threshold: Fraction):
    """r, low, a, b, near: whether sizes and sketches of a and b allow a link."""
    up, down = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            near = (n * down >= up * m) & (m * down >= up * n)
            most = _most_bits(n + m, threshold)
            x, y = batch.column("sketch_a"), batch.column("sketch_b")
            for k in np.flatnonzero(near):
                fine = _fold([x[k].as_py(), y[k].as_py()])
                near[k] = np.bitwise_count(fine[0] ^ fine[1]).sum(dtype=np.int64) <= most[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("r", "low", "a", "b")), pa.array(near)], names=["r", "low", "a", "b", "near"])

    return run


def _compared(pairs: DataFrame, heads: DataFrame, by: str, threshold: Fraction) -> DataFrame:
    """r, low, a, b, near for pairs (r, low) of sets known by a column of heads; a and b are their representatives."""
    side = lambda k, x: heads.select(F.col(by).alias(k), F.col("representative").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    met = pairs.join(side("x", "a"), F.col("r") == F.col("x")).join(side("y", "b").hint("merge"), F.col("low") == F.col("y")).where("a <> b")
    return met.select("r", "low", "a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_allowed(threshold), "r long, low long, a long, b long, near boolean")


_SETS_SCHEMA = "doc_id long, tie long, n_shingles long, digest binary, name long, sketch binary, keys array<long>"
#: Sets that a task remembers, so as not to write the digests of equal ones again.
REMEMBERED = 1 << 20


def _name(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _describe(size: int, threshold: Fraction):
    """Size, digest, name (the digest's first half) and sketch of each row's set; its segment digests where the task meets the set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        none = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            counts, names, fine, keys = [], [], [], []
            for k, words in kernels.each_text(batch.column(1), kernels.SPACED):
                hashes = kernels.shingles(words, size)
                name = _name(hashes)
                counts.append(len(hashes))
                names.append(name)
                fine.append(sketch(hashes))
                if not ids[k] or name in seen:
                    keys.append(none)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
                keys.append(digests(hashes, threshold).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else none
            short = np.frombuffer(b"".join(x[:8] for x in names), "<i8")
            columns = [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(short, pa.int64()), pa.array(fine, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "n_shingles", "digest", "name", "sketch", "keys"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, r, low, border of rows sorted by (key, r), for keys with several different r; low is the smallest of them here.

    The first and the last key may go on in other tasks, so that a row more names each of them
    and its low, as border. Of a key only its first r and what came last are kept from one batch
    to the next.
    """
    key = low = last = first = None
    alone = True  # whether the key's first r is still to be written
    for batch in batches:
        keys, rs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        new = np.concatenate(([keys[0] != key or key is None], keys[1:] != keys[:-1]))
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1 + (not new[0])
        firsts = np.concatenate((np.zeros(0, np.int64) if new[0] else np.array([low]), rs[starts]))
        lows = firsts[group]
        before = np.concatenate(([rs[0] if new[0] else last], rs[:-1]))
        more = ~new & (rs != before) & (rs != lows)
        shared = np.zeros(len(firsts), bool)
        shared[group[more]] = True
        write_first = np.flatnonzero(shared)
        if len(write_first) and not new[0] and not alone and write_first[0] == 0:
            write_first = write_first[1:]
        names = np.concatenate((np.zeros(0, np.int64) if new[0] else np.array([key]), keys[starts]))
        out = [np.concatenate((names[write_first], keys[more])), np.concatenate((firsts[write_first], rs[more])), np.concatenate((firsts[write_first], lows[more]))]
        continues = group[-1] == 0 and not new[0]
        alone = not shared[-1] and (alone or not continues)
        key, low, last = names[-1], firsts[-1], rs[-1]
        first = first or (names[0], firsts[0])
        if len(out[0]):
            yield _rows(*out, border=False)
    if first:
        ends = {first, (key, low)}
        yield _rows([x for x, _ in ends], [x for _, x in ends], [x for _, x in ends], border=True)


def _rows(keys, rs, lows, border: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (keys, rs, lows)), pa.array([border] * len(keys), pa.bool_())], names=["key", "r", "low", "border"])


def _crowd(sets: DataFrame) -> DataFrame:
    """key, r, low, as a written table: the names of the sets that share a digest with others, and of the digest's centre."""
    exploded = sets.select(F.explode("keys").alias("key"), F.col("name").alias("r"))
    ranges = exploded.repartitionByRange("key", "r").sortWithinPartitions("key", "r")
    found = materialise(ranges.mapInArrow(_shared, "key long, r long, low long, border boolean"), "shared")
    ends = found.where("border")
    # two rows for each range at most, so that all tasks can be told
    over = ends.groupBy("key").agg(F.min("low").alias("top"), F.max("low").alias("other")).where("top < other").select(F.col("key").alias("k"), "top")
    met = found.where("not border").join(F.broadcast(over), F.col("key") == F.col("k"), "left").select("key", "r", F.coalesce("top", "low").alias("low"))
    more = ends.join(F.broadcast(over), F.col("key") == F.col("k")).select("key", "r", F.col("top").alias("low"))
    crowd = materialise(met.union(more), "crowd")
    release(found)
    return crowd


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of rows sorted by (key, i, j); a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch])
        names = np.stack([table[c].to_numpy() for c in ("key", "i", "j")])
        cut = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cut[:-1]], cut, strict=True) if len(cut) else ():
            yield table.slice(a, b - a)
        held = table.slice(cut[-1] if len(cut) else 0).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _meet(threshold: Fraction, forest: bool):
    """Pairs of a block that the sketches can't rule out: all of them, or a forest of them that connects what they connect."""
    up, down = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            r, part, n, away, left = (rows[c].to_numpy() for c in ("r", "part", "n_shingles", "away", "left"))
            right = left == 0
            fine = _fold(rows["sketch"].to_pylist())
            tree = part.copy()
            a, b = [], []
            for k in np.flatnonzero(left):
                other = right & (tree != tree[k]) & (n[k] * down >= up * n) & (n * down >= up * n[k])
                if not forest:
                    other &= (away == 0) | (r < r[k])  # of two members away, each meets the other
                at = np.flatnonzero(other)
                differ = np.bitwise_count(fine[at] ^ fine[k]).sum(axis=1, dtype=np.int64)
                near = differ <= _most_bits(n[at] + n[k], threshold)
                at, differ = at[near], differ[near]
                if forest and len(at):
                    at = at[np.argsort(differ, kind="stable")]
                    trees, first = np.unique(tree[at], return_index=True)
                    at = at[first]
                    tree[np.isin(tree, trees)] = tree[k]
                a += [r[k]] * len(at)
                b += r[at].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["a", "b"])

    return run


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only ASCII is lowered, only ASCII white space splits


def shingle_set(text: str | None, size: int) -> set:
    """The exact set: tuples of words."""
    words = _words(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def _verify(size: int, threshold: Fraction):
    up, down = threshold.numerator, threshold.denominator

    def linked(left: set, right: set) -> bool:
        if len(left) * down < up * len(right) or len(right) * down < up * len(left):
            return False
        both = len(left & right)
        return bool(left) and down * both >= up * (len(left) + len(right) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, []
        for batch in batches:
            a, b, texts_a, texts_b = (batch.column(k) for k in range(4))
            keep = []
            for k in range(len(a)):
                if (name := b[k].as_py()) != last:
                    last, right = name, [shingle_set(x, size) for x in texts_b[k].as_py()]
                left = [shingle_set(x, size) for x in texts_a[k].as_py()]
                if any(linked(x, y) for x in left for y in right):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int32())), b.take(pa.array(keep, pa.int32()))], names=["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, repeated: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """Those of the written pairs (a, b) whose texts are linked.

    Only the texts of documents in a pair are moved, if these are few enough to tell all tasks.
    repeated: the doc_ids (id) of several rows, whose different texts are gathered.
    """
    named = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "named")
    texts = docs.select(F.expr(_ID).alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    texts = texts.join(_told(named), F.col("doc_id") == F.col("id"), "left_semi")
    many = _told(repeated)
    several = texts.join(many, F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
    texts = texts.join(many, F.col("doc_id") == F.col("id"), "left_anti").select("doc_id", F.array("text").alias("texts")).union(several)
    left = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("x"), F.col("texts").alias("texts_a")).hint("merge"), F.col("a") == F.col("x")).select("a", "b", "texts_a")
    full = left.join(texts.select(F.col("doc_id").alias("y"), F.col("texts").alias("texts_b")).hint("merge"), F.col("b") == F.col("y")).select("a", "b", "texts_a", "texts_b")
    out = materialise(full.mapInArrow(_verify(size, threshold), "a long, b long"), "linked")
    release(named)
    return out


def _parts_of(rows: DataFrame, parts: DataFrame, column: str, part: str) -> DataFrame:
    """Rows with the component of the document in a column; one without links is its own."""
    known = parts.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(known.hint("merge"), F.col(column) == F.col("_n"), "left").withColumn(part, F.coalesce("_c", column)).drop("_n", "_c")


def _unconnected(rest: DataFrame, parts: DataFrame) -> DataFrame:
    """key, r, part, home, centre, n, out: members of the digests whose members are in different components.

    home is the component with most of the n members, centre its smallest one; out members are
    elsewhere. Counts are combined by (key, component) and then by key before they are shuffled.
    """
    at = materialise(_parts_of(rest, parts, "r", "part"), "parted")
    sizes = at.groupBy("key", "part").agg(F.count("*").alias("m"), F.min("r").alias("least"))
    homes = sizes.groupBy("key").agg(F.max(F.struct("m", (-F.col("part")).alias("part"), "least")).alias("top"), F.sum("m").alias("n"), F.count("*").alias("k")).where("k > 1")
    homes = homes.select(F.col("key").alias("h"), (-F.col("top.part")).alias("home"), F.col("top.least").alias("centre"), "n", (F.col("n") - F.col("top.m")).alias("out"))
    out = materialise(at.join(homes.hint("merge"), F.col("key") == F.col("h")).drop("h"), "rest")
    release(at)
    return out


def _in_blocks(rest: DataFrame, heads: DataFrame, threshold: Fraction, forest: bool) -> DataFrame:
    """Pairs (a, b) of members of a digest in different components that the sketches can't rule out.

    Members away from home are dealt into blocks of about BLOCK, and so are all members; each
    pair of blocks meets in a group of its own, so that no group grows with the data.
    """
    known = heads.select(F.col("representative").alias("d"), "n_shingles", "sketch")
    away = F.col("part") != F.col("home")
    rows = rest.join(known, F.col("r") == F.col("d")).select("key", "r", "part", "n_shingles", "sketch", away.cast("int").alias("away"), F.ceil(F.col("out") / BLOCK).alias("across"), F.ceil(F.col("n") / BLOCK).alias("down"))
    block = lambda of: F.pmod(F.xxhash64("r"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    what = ["r", "part", "n_shingles", "away", "sketch"]
    left = rows.where("away = 1").select("key", block("across").alias("i"), every("down").alias("j"), F.lit(1).alias("left"), *what)
    right = rows.select("key", every("across").alias("i"), block("down").alias("j"), F.lit(0).alias("left"), *what)
    return left.union(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_meet(threshold, forest), "a long, b long").distinct()


#: A row's document, and a hash of its text (a null one is not like an empty one).
_ID, _TIE = "cast(doc_id as bigint)", "xxhash64(text is null, cast(text as string))"


def _told(ids: DataFrame) -> DataFrame:
    """A written table of ids, as one that all tasks are told if it is small enough."""
    return F.broadcast(ids) if ids.count() <= TOLD else ids


def similar(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, parts): the classes of equal sets, links between their representatives, and these' components.

    documents: doc_id, tie (a hash of the text), n_shingles, representative (smallest doc_id with the same set). links: a,
    b. Enough exact links to connect what is linked: a pair is left out only where other links
    already connect its ends. Nothing is capped or sampled. parts: node, component, for
    representatives with links.

    Rows that share a doc_id are one node. A null text or one without words has an empty set,
    which links with nothing; a null doc_id links with nothing. Other columns are ignored, whatever
    their names. Tables that are no longer needed are deleted on the way.
    """
    return _similar(docs, size, threshold)[:3]


def _similar(docs: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """What similar returns, and the written tables that documents and links rest on."""
    limit = Fraction(threshold).limit_denominator(10_000)
    texts = docs.select(F.expr(_ID).alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr(_TIE).alias("tie"))
    described = materialise(texts.mapInArrow(_describe(size, limit), _SETS_SCHEMA), "described")
    crowd = _crowd(described)
    heads = materialise(described.where("n_shingles > 0 and doc_id is not null").groupBy("digest", "name").agg(F.min("doc_id").alias("representative"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "heads")
    # the digests and sketches, most of what is written, are deleted before the pairs are made
    sets = materialise(described.select("doc_id", "tie", "n_shingles", "digest"), "sets")
    release(described)
    first = heads.select(F.col("name").alias("x"), F.col("representative").alias("a"))
    pairs = materialise(_compared(crowd.where("r <> low").select("r", "low").distinct(), heads, "name", limit), "pairs")
    repeated = materialise(sets.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    links = verified(pairs.where("near"), docs, repeated, size, limit)
    found = [links]
    parts = components(links)
    apart = _parts_of(_parts_of(pairs, parts, "a", "p"), parts, "b", "q").where("p <> q").select(F.col("r").alias("x"), F.col("low").alias("y")).distinct()
    apart = materialise(apart, "apart")
    if apart.limit(1).count():
        open_ = crowd.join(apart, F.expr("r = x and low = y"), "left_semi").select(F.col("key").alias("k")).distinct()
        # all others have met the centre
        rest = crowd.where("r <> low").join(open_.hint("merge"), F.col("key") == F.col("k"), "left_semi").select("key", "r").distinct()
        rest = materialise(rest.join(first, F.col("r") == F.col("x")).select("key", F.col("a").alias("r")).distinct(), "members")
        release(crowd, pairs, apart)
        for turn in range(STARS + 2):
            known = rest if turn in (0, STARS + 1) else rest.where("r <> centre")
            held, rest = rest, _unconnected(known.select("key", "r"), parts)
            release(held)
            if rest.limit(1).count() == 0:
                break
            if turn < STARS:
                star = rest.where("part <> home and r <> centre").select(F.greatest("r", "centre").alias("r"), F.least("r", "centre").alias("low")).distinct()
                more = _compared(star, heads, "representative", limit).where("near").select("a", "b").distinct()
            else:
                more = _in_blocks(rest, heads, limit, forest=turn == STARS)
            more = materialise(more, "pairs")
            found.append(verified(more, docs, repeated, size, limit))
            release(more, parts)
            links = links.union(found[-1])
            parts = components(links)
        release(rest)
    else:
        release(crowd, pairs, apart)
    named = heads.select(F.col("digest").alias("d"), "representative")
    documents = sets.join(named, F.col("digest") == F.col("d"), "left").select("doc_id", "tie", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("representative")).alias("representative"))
    return documents, links, parts, [sets, heads, repeated, *found]


def groups(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, for every row of docs.

    component_id is the smallest doc_id reachable over links, the document itself included.
    An empty table gives an empty one.
    """
    documents, _, parts = similar(docs, size, threshold)
    return documents.join(parts, F.col("representative") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "representative", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents with the smallest doc_id of their group, all columns kept.

    Of rows that share a doc_id and a text one stays; rows that share a doc_id but not the text
    all stay with it, as does every row without a doc_id. A text's hash stands for it.
    """
    documents, _, parts, used = _similar(docs, size, threshold)
    known = documents.where("doc_id is not null").select(F.col("doc_id").alias("i"), F.col("tie").alias("t"), "representative")
    gone = known.join(parts, F.col("representative") == F.col("node"), "left").where("i <> coalesce(component, representative, i)").select("i", "t")
    gone = materialise(gone.distinct(), "gone")
    again = materialise(known.groupBy("i", "t").agg(F.count("*").alias("n")).where("n > 1").select("i", "t"), "repeated")
    release(*used, parts)
    rows = docs.select(F.struct("*").alias("row"), F.expr(_ID).alias("_i"), F.expr(_TIE).alias("_t"))
    same = (F.col("_i") == F.col("i")) & (F.col("_t") == F.col("t"))
    rows = rows.join(_told(gone), same, "left_anti")
    once = rows.join(_told(again), same, "left_anti")
    return once.unionByName(rows.join(_told(again), same, "left_semi").dropDuplicates(["_i", "_t"])).select("row.*")
