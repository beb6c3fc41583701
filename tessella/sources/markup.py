"""Marked-up text, however it is formed, as a table of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NODES = "file string, node int, parent int, pos int, depth int, path array<int>, tag string, attributes map<string, string>, text string"
_KIND = pa.schema(
    [("file", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("pos", pa.int32()), ("depth", pa.int32()), ("path", pa.list_(pa.int32())), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())]
)


class _Shredder(HTMLParser):
    """Rows of one file. A closing tag closes the nearest open element of its name; one that closes nothing is passed over."""

    def __init__(self, file: str) -> None:
        super().__init__(convert_charrefs=True)
        self.file, self.rows, self.open, self.children = file, [], [], {}

    def _add(self, tag: str, attributes: list, text: str | None) -> int:
        node, up = len(self.rows), self.open[-1] if self.open else None
        pos = self.children.get(up, 0)
        self.children[up] = pos + 1
        path = [*(self.rows[up]["path"] if up is not None else []), pos]
        own = {k: v or "" for k, v in attributes}
        self.rows.append({"file": self.file, "node": node, "parent": up, "pos": pos, "depth": len(path), "path": path, "tag": tag, "attributes": list(own.items()), "text": text})
        return node

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = self._add(tag, attrs, None)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(tag, attrs, None)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]]["tag"] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._add("CDATA", [], data)


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, text in zip(batch.column(0), batch.column(1), strict=True):
            parser = _Shredder(file.as_py())
            parser.feed(text.as_py() or "")
            parser.close()
            if parser.rows:
                yield pa.RecordBatch.from_pylist(parser.rows, _KIND)


def nodes(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, node, parent, pos, depth, path, tag, attributes, text: a row for each element and each text that isn't blank (tag CDATA).

    Nodes are numbered in document order. Malformed markup is read as far as it goes; a null text has no nodes.
    """
    return files.select(F.col(file).cast("string").alias("file"), F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(_shred, NODES)
