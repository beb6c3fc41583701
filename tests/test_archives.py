"""Zip archives, read member by member."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.sources import archives, markup


@pytest.fixture(scope="module")
def zips(tmp_path_factory):
    folder = tmp_path_factory.mktemp("zips")
    held = {}
    for k in range(3):
        path = str(folder / f"a{k}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("folder/", "")
            for j in range(20 if k < 2 else 0):
                name, text = f"folder/{k}-{j}.{'html' if j % 3 else 'txt'}", f"<p>{'é' * j} {k}</p>" * (1 + j)
                z.writestr(name, text)
                held[path, name] = text.encode()
            if k == 0:
                z.writestr("empty.html", "")
                held[path, "empty.html"] = b""
                with pytest.warns(UserWarning):
                    z.writestr("folder/0-1.html", "again")
                held[path, "folder/0-1.html"] = b"again"
    return sorted({p for p, _ in held} | {str(folder / "a2.zip")}), held


def test_members(spark, zips):
    paths, held = zips
    got = archives.members(spark, paths)
    assert {(r.archive, r.name): bytes(r.content) for r in got.collect()} == held and got.count() == len(held)
    assert all(r.size == len(held[r.archive, r.name]) for r in got.select("archive", "name", "size").collect())


def test_pruned_and_in_several_tasks(spark, zips):
    paths, held = zips
    got = archives.members(spark, ["file://" + p for p in paths], r"\.txt$", 200)
    want = {n for _, n in held if n.endswith(".txt")}
    assert {r.name for r in got.collect()} == want
    assert got.select(F.spark_partition_id()).distinct().count() > 4
    assert archives.members(spark, paths[0], "nothing like this").collect() == [] and archives.members(spark, paths[2]).collect() == []


def test_members_as_documents(spark, zips):
    paths, held = zips
    files = archives.members(spark, paths, "html$").select("name", F.col("content").cast("string").alias("html"))
    nodes = markup.nodes(files, "name", "html")
    assert nodes.where("tag = 'p'").count() == sum(t.count(b"<p>") for (_, n), t in held.items() if n.endswith("html"))


def test_damage(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    for bad in ("bad.zip", "missing.zip"):
        with pytest.raises(Exception, match="zip|No such file"):
            archives.members(spark, str(tmp_path / bad)).collect()
