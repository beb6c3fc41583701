"""Reading folders of files, and writing reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.session import materialise, release


def folder(spark: SparkSession, path: str, extension: str | None = None, charset: str = "UTF-8") -> DataFrame:
    """path, name, extension, bytes, content of the files below a folder; content is the decoded text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", f"*.{extension}") if extension else reader
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return reader.load(path).select("path", name.alias("name"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"), F.col("length").alias("bytes"), F.decode("content", charset).alias("content"))


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("extension").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def comment_attributes(files: DataFrame, file: str, text: str) -> DataFrame:
    """file and a map of the `<!--name: value-->` comments; of repeated names the last counts."""
    names = F.regexp_extract_all(F.col(text), F.lit(r"<!--\s*([a-zA-Z_]\w*):\s*(.*?)\s*-->"), F.lit(1))
    values = F.regexp_extract_all(F.col(text), F.lit(r"<!--\s*([a-zA-Z_]\w*):\s*(.*?)\s*-->"), F.lit(2))
    placed = F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    # sorted by name and place, the last of a name stands before another name
    last = F.transform(F.array(F.sort_array(placed)), lambda a: F.filter(a, lambda p, j: F.coalesce(F.get(a, j + 1)["k"] != p["k"], F.lit(True))))
    entries = F.transform(F.get(last, F.lit(0)), lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))
    return files.select(F.col(file).alias("file"), F.map_from_entries(entries).alias("attributes"))


def lines(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, number (from 1), line."""
    return files.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n")).alias("p", "line")).select("file", (F.col("p") + 1).alias("number"), "line")


def content_name(text, extension: str):
    """A name that the content decides: a stem of its first words and its MD5."""
    stem = F.substring(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), 1, 32)
    return F.concat(stem, F.lit("_"), F.md5(text), F.lit(f".{extension}"))


def write_report(report: DataFrame, path: str, title: str, formats: tuple[str, ...] = ("csv", "json")) -> DataFrame:
    """Write a report in several formats below a folder; return its line for an index of reports: title, rows, columns, path.

    The report is computed once, whatever the number of formats.
    """
    kept = materialise(report, "report")
    for kind in formats:
        writer = kept.write.mode("overwrite")
        (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(f"{path}/{kind}")
    line = report.sparkSession.createDataFrame([(title, kept.count(), report.columns, path)], "title string, rows long, columns array<string>, path string")
    release(kept)
    return line


def write_reports(reports: dict[str, DataFrame], path: str, formats: tuple[str, ...] = ("csv", "json")) -> DataFrame:
    """Write each report below a folder of its own, and the table of them all (title, rows, columns, path) as `index`; return that table."""
    lines = [write_report(report, f"{path}/{title}", title, formats) for title, report in reports.items()]
    reduce(DataFrame.unionByName, lines).write.mode("overwrite").parquet(f"{path}/index")
    return lines[0].sparkSession.read.schema(lines[0].schema).parquet(f"{path}/index")


#: What stands before and after the root element of a marked-up file.
_HEADER = r"^((?:\s*<(?:\?[^>]*\?|![A-Za-z][^>]*)>)*\s*)"
_TRAILER = r"((?:\s*<!--(?:[^-]|-[^-])*-->)*\s*)$"


def with_body(source: Column, body: Column) -> Column:
    """body between the header (processing instructions, document type) and the trailer (comments) of the source it was made from; an edit in place."""
    return F.concat(F.regexp_extract(source, _HEADER, 1), F.trim(body), F.regexp_extract(source, _TRAILER, 1))


def write_word_index(index: DataFrame, titles: DataFrame, path: str) -> None:
    """Three tables: words with their files, files with their words, files with their titles."""
    index.select("word", "file", "n").write.mode("overwrite").parquet(f"{path}/words_to_files")
    index.select("file", "word", "n").repartition("file").sortWithinPartitions("file", "word").write.mode("overwrite").parquet(f"{path}/files_to_words")
    titles.write.mode("overwrite").parquet(f"{path}/files_to_titles")


def xml_map(entries: DataFrame, key: str, href: str, title: str) -> DataFrame:
    """key, xml: a map element for each key with its references in order of href; names and titles are escaped."""
    line = F.concat(F.lit('  <topicref href="'), T.escape_xml(F.col(href)), F.lit('" navtitle="'), T.escape_xml(F.col(title)), F.lit('"/>'))
    parts = F.array_sort(F.collect_list(F.struct(F.col(href).alias("h"), line.alias("l"))))
    body = F.array_join(F.transform(parts, lambda p: p["l"]), "\n")
    return entries.groupBy(key).agg(F.concat(F.lit("<map>\n"), body, F.lit("\n</map>")).alias("xml"))
