"""Operator 6: token-id files with Elias-Fano document boundaries.

A file holds the ids of many documents one after the other, 2 or 4 bytes each. Where documents
end is a growing sequence; Elias-Fano coding keeps its low bits packed and its high bits in
unary, about 2 + log2(ids / documents) bits for a document. A sample of the positions of the
unary ones lets select() find any boundary without decoding the others.

Layout: ids | low bits | high bits | samples (uint32) | doc_ids (int64) | null flags | footer.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import kernels
from tessella.session import materialise, shared_path

#: A file ends at about so many bytes of ids, or documents; it is read in blocks of about so many bytes.
FILE_BYTES, FILE_DOCS, BLOCK_BYTES = 256 << 20, 1_000_000, 8 << 20
_MAGIC = b"TESSEF01"
_FOOTER = "<8sQQBBxxxxxx"  # magic, documents, ids, bytes for an id, low bits
#: Every so many boundaries the position of the unary one is kept.
SAMPLE = 64


class EliasFano:
    """A sequence that does not fall, of n values up to top, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def bits_for(n: int, top: int) -> int:
        return max(0, (top // n).bit_length() - 1) if n else 0

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        bits = cls.bits_for(n, top)
        values = values.astype(np.uint64)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> bits) + n + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def sizes(self, top: int) -> tuple[int, int, int]:
        return -(-self.n * self.low_bits // 8), -(-((top >> self.low_bits) + self.n + 1) // 8), -(-self.n // SAMPLE)

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        part = int.from_bytes(self.low[a >> 3 : ((a + self.low_bits) >> 3) + 1].tobytes(), "little")
        return part >> (a & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i, found from the sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:  # the next ones after the sample, eight bytes at a time
            word = int.from_bytes(self.high[(at + 1) >> 3 : ((at + 1) >> 3) + 8].tobytes(), "little") >> ((at + 1) & 7)
            width = 64 - ((at + 1) & 7)
            if (here := word.bit_count()) < left:
                left -= here
                at += width
                continue
            for _ in range(left - 1):
                word &= word - 1
            at += (word & -word).bit_length()
            left = 0
        return (at - i) << self.low_bits | self._low(i)

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (ones - np.arange(self.n)) << self.low_bits | bits @ (1 << np.arange(self.low_bits, dtype=np.int64))


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


#: How the byte-level pattern takes a text apart, and the character that stands for each byte.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _byte_level(path: str, tokenizer) -> bool:
    """Whether a tokenizer is byte-level BPE as _PATTERN and _BYTES have it, by its own file."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    before, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = told.get("normalizer") is None and told.get("truncation") is None and model.get("type") == "BPE"
    plain &= (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
    plain &= not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    # every byte is a token, so that no part is lost
    plain &= all(tokenizer.token_to_id(x) is not None for x in _BYTES.values())
    return plain and not any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in tokenizer.get_added_tokens_decoder().values())


class _Encoder:
    """Ids of texts; the pieces that texts are made of repeat, so each is encoded once and then known by two hashes.

    A run of white space that follows another character begins a token of the byte-level pattern,
    and so does the character after a lone line break. So the ids of a text are those of its
    words with the blank before them, of the marks after them, and of its line breaks, put together, unless white space
    is left at the end of a piece, or two of them meet; such a text is encoded whole, and so is one
    that holds the content of an added token, which the model does not know. A new piece
    is taken apart by the pattern, and the model gives the ids of its parts. Texts of a tokenizer
    that its file does not describe as byte-level BPE of this pattern are all encoded whole.
    """

    def __init__(self, path: str, kind: str, most: int = 600_000) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _byte_level(path, self.tokenizer)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.find = self.tokenizer.model, regex.compile(_PATTERN).findall
        self.kind, self.most = np.dtype(kind), most
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.kind)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _with_added(self, raw: bytes, offsets: np.ndarray) -> set[int]:
        """The places of the texts that hold an added token's content."""
        found = set()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(content) <= offsets[k + 1]:  # else it begins in one text and ends in another
                    found.add(k)
                at = raw.find(content, at + 1)
        return found

    def _piece(self, piece: str, known: dict[str, list[int]]) -> list[int] | None:
        """A piece's ids, by way of the ids of its parts; none if texts with it can't be taken apart."""
        if piece == "\n":
            return [x.id for x in self.model.tokenize(_BYTES[10])]
        if piece[-1].isspace() or piece[:2].isspace():
            return None
        out: list[int] = []
        for part in [piece] if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()) else self.find(piece):
            ids = known.get(part)
            if ids is None:
                ids = known[part] = [x.id for x in self.model.tokenize(part.encode().decode("latin-1").translate(_BYTES))]
            out += ids
        return out

    def _learn(self, pieces: list[str], keys: np.ndarray, checks: np.ndarray) -> None:
        if len(self.keys) + len(pieces) > self.most:
            self._forget()
        known: dict[str, list[int]] = {}
        got = [self._piece(x, known) for x in pieces]
        count = np.array([-1 if x is None else len(x) for x in got], np.int32)
        flat = np.array([i for x in got if x for i in x], self.kind)
        first = len(self.ids) + np.concatenate(([0], np.cumsum(np.maximum(count, 0))[:-1]))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)
        self.ids = np.concatenate((self.ids, flat))

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column; nulls are empty."""
        if not self.pieces:
            yield from (self.whole(x.as_py() or "") for x in column)
            return
        data, offsets = kernels.utf8(column)
        for i, j in kernels.slices(offsets, 1 << 20):
            yield from self._slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        if not len(data):
            yield from [b""] * (len(offsets) - 1)
            return
        raw = data.tobytes()
        added = self._with_added(raw, offsets)
        line = data == 10
        begins = line | (data == 32)
        begins[1:] |= line[:-1] | _LETTER[data[:-1]] & _MARK[data[1:]]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        keys, checks = kernels.piece_hashes(data, starts, ends)
        distinct, example, place = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            if len(self.keys) + len(new) > self.most:
                self._forget()
                new = np.arange(len(distinct))
            where = example[new]
            pieces = [raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            self._learn(pieces, distinct[new], checks[where])
            at = np.searchsorted(self.keys, distinct)
        at = at[place]
        count = self.count[at].astype(np.int64)
        twice = np.zeros(len(starts), bool)
        twice[:-1] = line[starts[:-1]] & line[starts[1:]]
        cut = np.searchsorted(starts, offsets)
        inner = cut[1:-1][(cut[1:-1] > 0) & (cut[1:-1] < len(starts))]
        twice[inner - 1] = False  # line breaks of two texts do not meet
        bad = (count < 0) | twice | (self.checks[at] != checks)
        bad_before = np.concatenate(([0], np.cumsum(bad)))
        count[bad] = 0
        stop = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(self.first[at] - stop[:-1], count) + np.arange(stop[-1])].tobytes()
        width = self.kind.itemsize
        for k in range(len(offsets) - 1):
            a, b = cut[k], cut[k + 1]
            if bad_before[a] != bad_before[b] or k in added:
                yield self.whole(raw[offsets[k] : offsets[k + 1]].decode())
            else:
                yield ids[stop[a] * width : stop[b] * width]


_encoders: dict[tuple[str, str], _Encoder] = {}


def _encoder(path: str, kind: str) -> _Encoder:
    """A worker's encoder, which its later tasks use too."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = _Encoder(path, kind)
    return _encoders[path, kind]


class _Part:
    """A file that is being written; it takes its name when it is whole."""

    def __init__(self, store: fs.FileSystem, root: str, shard: int, part: int, width: int) -> None:
        self.store, self.root, self.width = store, root, width
        self.row = {"shard": shard, "part": part}
        self.name, self.attempt = f"{root}/shard-{shard:06d}-{part:06d}.tok", f"{root}/.{shard:06d}-{part:06d}-{uuid.uuid4().hex}"
        self.out = store.open_output_stream(self.attempt)
        self.ends, self.doc_ids, self.total = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> bool:
        """Whether another document would be too much."""
        self.out.write(ids)
        self.total += len(ids) // self.width
        self.ends.append(self.total)
        self.doc_ids.append(doc_id)
        return self.total * self.width >= FILE_BYTES or len(self.ends) >= FILE_DOCS

    def close(self) -> pa.RecordBatch:
        edge = EliasFano.encode(np.array(self.ends, np.int64), self.total)
        self.out.write(edge.low.tobytes() + edge.high.tobytes() + edge.samples.astype("<u4").tobytes())
        self.out.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + np.array([x is None for x in self.doc_ids], np.uint8).tobytes())
        self.out.write(struct.pack(_FOOTER, _MAGIC, len(self.doc_ids), self.total, self.width, edge.low_bits))
        self.out.close()
        self.store.move(self.attempt, self.name)  # a second attempt writes the same bytes
        row = self.row | {"docs": len(self.doc_ids), "ids": self.total, "path": self.name}
        return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, pa.schema([*((c, pa.int64()) for c in ("shard", "part", "docs", "ids")), ("path", pa.string())]))


def _write(folder: str, tokenizer: str, end_id: int, width: int):
    kind = "<u2" if width == 2 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, kind)
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], kind).tobytes()
        number, part = 0, None
        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1)), strict=True):
                part = part or _Part(store, root, shard, number, width)
                if part.add(doc_id, got + end):
                    yield part.close()
                    number, part = number + 1, None
        if part:
            yield part.close()

    return run


class TokenFile:
    """A file's documents, by their place in it."""

    def __init__(self, folder: str, name: str) -> None:
        store, root = open_folder(folder)
        self.file = store.open_input_file(f"{root}/{name.rpartition('/')[2]}")
        size = self.file.size()
        magic, self.docs, self.ids, self.width, bits = struct.unpack(_FOOTER, self.file.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER)))
        if magic != _MAGIC:
            raise ValueError(f"{name} is not a token file")
        self.kind = "<u2" if self.width == 2 else "<u4"
        edge = EliasFano(self.docs, bits, *[np.zeros(0, np.uint8)] * 3)
        low, high, samples = edge.sizes(self.ids)
        at = self.ids * self.width
        tail = self.file.read_at(size - struct.calcsize(_FOOTER) - at, at)
        cut = np.cumsum([0, low, high, 4 * samples, 8 * self.docs, self.docs])
        part = [tail[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.edge = EliasFano(self.docs, bits, np.frombuffer(part[0], np.uint8), np.frombuffer(part[1], np.uint8), np.frombuffer(part[2], "<u4"))
        flags = np.frombuffer(part[4], np.uint8)
        self.doc_ids = [None if f else int(x) for x, f in zip(np.frombuffer(part[3], "<i8"), flags, strict=True)]

    def __getitem__(self, i: int) -> np.ndarray:
        start, end = self.edge.select(i - 1) if i else 0, self.edge.select(i)
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), self.kind)


    def documents(self) -> Iterator[np.ndarray]:
        """All documents in their order, read in blocks of about BLOCK_BYTES."""
        ends = self.edge.decode()
        a = 0
        while a < self.docs:
            first = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, first + BLOCK_BYTES // self.width, side="right")))
            block = np.frombuffer(self.file.read_at((int(ends[b - 1]) - first) * self.width, first * self.width), self.kind)
            yield from np.split(block, ends[a : b - 1] - first)
            a = b


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(folder, name)
                starts, counts, sums, start = [], [], [], before
                for ids in file.documents():
                    starts.append(start)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, vocabulary: int | None = None) -> tuple[str, DataFrame]:
    """Write documents in ascending doc_id order (null first; ties by text) to files; return the folder and the manifest.

    manifest: shard, part, docs, ids, path, start (ids in all files before). Ranges of doc_ids become
    files; equal doc_ids may share a range border, so ties never fill one task unless their texts
    are equal too. A file ends at about FILE_BYTES of ids or FILE_DOCS documents, and the range goes
    on in the next one. A null text is empty: the end id alone. A text of any length is one document
    of one file. An empty table gives no files and an empty manifest. Other columns, whatever
    their names, are not read. vocabulary: how many ids there are, by default as many as the
    tokenizer has; 2 bytes hold an id if that is enough. folder: a URI that pyarrow opens on all
    machines; by default below the shared folder. tokenizer: a file that all machines have.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0) + 1
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    ordered = texts.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    manifest = materialise(ordered.mapInArrow(_write(folder, tokenizer, end_id, 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4), "shard long, part long, docs long, ids long, path string"), "manifest")
    before = F.coalesce(F.sum("ids").over(W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return folder, manifest.withColumn("start", before)


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.where("docs > 0").repartition(n, "shard", "part").select("path", "start").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, **more) -> DataFrame:
    """Write the documents to files and describe them as read back. Null texts are empty: the end id alone."""
    return read(*write(docs, tokenizer, **more))
