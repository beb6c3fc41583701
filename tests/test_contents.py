"""Contents of trees, content models, selectors and edits in place, on small tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import groups, trees
from tessella.sources import files, markup


def test_contents_and_reuse(spark):
    pages = spark.createDataFrame([("a", "<div><p>one <b>two</b></p><p>one <b>two</b></p><i></i></div>"), ("b", "<p>one <b>two</b></p>"), ("c", None)], "file string, html string")
    # one tree a file: its own root stands above what the parser finds
    nodes = markup.nodes(pages, "file", "html").select(F.col("file").alias("tree"), "node", "path", "tag", "text")
    held = {(r.tree, r.node): r for r in trees.contents(nodes).collect()}
    assert len(held) == nodes.count()
    top = held["a", 0]
    assert (top.tag, top.text) == ("div", "one  two one  two")
    p = hashlib.md5(b"0:p:\n1:CDATA:one \n1:b:\n2:CDATA:two").hexdigest()
    assert [k for k, r in sorted(held.items()) if r.md5 == p] == [("a", 1), ("a", 5), ("b", 0)]
    assert held["a", 9].text == "" and held["a", 9].tag == "i"
    found = {(r.tag, r.text): r.n for r in trees.reused_contents(trees.contents(nodes)).collect()}
    assert found == {("p", "one  two"): 3, ("b", "two"): 3, ("CDATA", "one "): 3, ("CDATA", "two"): 3}
    assert trees.contents(nodes.where("false")).count() == 0


def test_content_model(spark):
    seen = spark.createDataFrame([("ul", 1, 0, "li"), ("ul", 1, 1, "li"), ("ul", 2, 0, None), ("dl", 3, 0, "dt"), ("dl", 3, 1, "dd")], "parent string, owner int, pos int, tag string")
    edges = groups.content_edges(seen)
    got = {(r.parent, r.tag, r.next): r.n for r in edges.collect()}
    assert got == {("ul", None, "li"): 1, ("ul", "li", "li"): 1, ("ul", "li", None): 1, ("ul", None, None): 1, ("dl", None, "dt"): 1, ("dl", "dt", "dd"): 1, ("dl", "dd", None): 1}
    assert sorted(map(tuple, groups.content_places(edges).collect())) == [("dl", "dd", False, True, False), ("dl", "dt", True, False, False), ("ul", "li", True, True, True)]


def test_selectors(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "b"), (3, None)], "k int, t string")
    keys = lambda df: sorted(r.k for r in df.collect())
    assert keys(groups.selected(rows, "t", "b")) == [2]
    assert keys(groups.selected(rows, "t", ["ab", "c"])) == [1] == keys(groups.selected(rows, "t", {"ab": 1}))
    assert keys(groups.selected(rows, "t", re.compile("^a|c"))) == [1]
    assert keys(groups.selected(rows, "k", lambda k: k > 1)) == [2, 3]
    assert keys(groups.selected(rows, "t", spark.createDataFrame([("b",), ("b",), (None,)], "x string"))) == [2]
    assert keys(groups.matching(rows, {"t": re.compile("b"), "k": [1, 3]})) == [1]
    for wrong in ({}, {"": "b"}, {"u": "b"}):
        with pytest.raises(ValueError):
            groups.matching(rows, wrong)


def test_edit_in_place_and_names(spark):
    source = '<?xml version="1.0"?>\n<!DOCTYPE a>\n<a>old</a>\n<!--x: 1-->\n<!--y: 2-->\n'
    rows = spark.createDataFrame([(source, "<a>new</a>"), ("<a/>", "<b/>")], "s string, b string")
    got = [r[0] for r in rows.select(files.with_body(F.col("s"), F.col("b"))).collect()]
    assert got == [source.replace("old", "new"), "<b/>"]
    text = "é&<>\""
    one = spark.createDataFrame([(text,)], "t string").select(T.blob_sha(F.col("t")), T.escape_xml(F.col("t"))).first()
    raw = text.encode()
    assert one[0] == hashlib.sha1(b"blob %d\0%s" % (len(raw), raw)).hexdigest() and one[1] == "é&amp;&lt;&gt;&quot;"


def test_report_index(spark, tmp_path):
    reports = {"one": spark.range(3), "two": spark.range(2).withColumn("x", F.lit("y"))}
    index = files.write_reports(reports, str(tmp_path))
    assert sorted((r.title, r.rows, r.columns) for r in index.collect()) == [("one", 3, ["id"]), ("two", 2, ["id", "x"])]
    assert spark.read.json(f"{tmp_path}/two/json").count() == 2
