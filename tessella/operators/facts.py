"""Facts about marked-up files, one table each, from the text of the files.

All of them are expressions over the text, so that a query which needs one fact reads one column
and stays in the JVM. Files without the fact have no rows; a null text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = "<([a-zA-Z][a-zA-Z0-9]*)"
ATTRIBUTE = '\\s([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"'


def _all(text: str, pattern: str, group: int = 1) -> Column:
    return F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)))


def tags(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, tag, n."""
    return files.select(F.col(file).alias("file"), _all(text, TAG).alias("tag")).select("file", F.lower("tag").alias("tag")).groupBy("file", "tag").agg(F.count("*").alias("n"))


def attributes(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, attribute, value, n; only values that aren't empty or 0."""
    pair = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(ATTRIBUTE), F.lit(1)).alias("a"), F.regexp_extract_all(F.col(text), F.lit(ATTRIBUTE), F.lit(2)).alias("v"))
    rows = files.select(F.col(file).alias("file"), F.explode(pair).alias("x")).select("file", F.col("x.a").alias("attribute"), F.col("x.v").alias("value"))
    return rows.where("value not in ('', '0')").groupBy("file", "attribute", "value").agg(F.count("*").alias("n"))


def references(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, reference, n: what href attributes name."""
    return files.select(F.col(file).alias("file"), _all(text, 'href="([^"]*)"').alias("reference")).groupBy("file", "reference").agg(F.count("*").alias("n"))


def entities(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, entity, n: character entities such as &lt; and &amp;."""
    return files.select(F.col(file).alias("file"), _all(text, "&([a-zA-Z]+);").alias("entity")).groupBy("file", "entity").agg(F.count("*").alias("n"))


def titles(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, title; files without one are left out."""
    title = F.regexp_extract(F.col(text), "<title>([^<]*)</title>", 1)
    return files.select(F.col(file).alias("file"), title.alias("title")).where("title <> ''")


def urls(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, url: distinct absolute links anywhere in the text."""
    return files.select(F.col(file).alias("file"), _all(text, "(https?://[^\\s\"'<>]+)").alias("url")).distinct()


def counts(facts: DataFrame, *keys: str) -> DataFrame:
    """The facts' n added up by keys."""
    return facts.groupBy(*keys).agg(F.sum("n").alias("n"))


def tags_to_texts(files: DataFrame, text: str) -> DataFrame:
    """tags, texts, ratio of all files: opening tags and runs of text between tags that aren't blank. Both counts begin at 1."""
    n_tags = F.size(F.regexp_extract_all(F.col(text), F.lit(TAG), F.lit(1)))
    n_texts = F.size(F.regexp_extract_all(F.col(text), F.lit(">[^<]*[^<\\s][^<]*<"), F.lit(0)))
    total = files.where(F.col(text).isNotNull()).agg((F.coalesce(F.sum(n_tags), F.lit(0)) + 1).alias("tags"), (F.coalesce(F.sum(n_texts), F.lit(0)) + 1).alias("texts"))
    return total.withColumn("ratio", F.round(F.col("tags") / F.col("texts"), 4))


def matches(files: DataFrame, file: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """file and a column for each named pattern: how often it matches. One pass over the text, no shuffle."""
    return files.select(F.col(file).alias("file"), *(F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).alias(name) for name, p in patterns.items()))


def parse_failures(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, problem: what rules out a strict parse, in this order: no document type, unequal numbers of opening and closing paragraphs, a stray ampersand."""
    c = F.col(text)
    problem = (
        F.when(c.isNull() | (F.trim(c) == ""), "Empty")
        .when(~c.rlike("(?i)^\\s*<(!DOCTYPE|\\?xml)"), "No document type")
        .when(F.regexp_count(c, F.lit("<p[ >]")) != F.regexp_count(c, F.lit("</p>")), "Paragraphs do not match")
        .when(c.rlike("&[^a-zA-Z#]"), "Stray ampersand")
    )
    return files.select(F.col(file).alias("file"), problem.alias("problem")).where("problem is not null")
