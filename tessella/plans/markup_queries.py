"""Queries about marked-up pages and the links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import facts, groups, references, sequences
from tessella.plans.registry import register
from tessella.session import table

_TAGS = "SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages"
_ATTRIBUTES = r"""SELECT page_id, unnest(regexp_extract_all(html, '\s([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"', 1)) AS attribute,
  unnest(regexp_extract_all(html, '\s([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"', 2)) AS value FROM pages"""
_LINKS = "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS reference FROM pages"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@register("tag_count", f"SELECT tag, count(*) AS n FROM ({_TAGS}) GROUP BY tag")
def tag_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag is opened, most frequent first."""
    return facts.counts(facts.tags(pages(spark, sf_dir), "page_id", "html"), "tag").orderBy(F.desc("n"), "tag")


@register("attribute_count", f"SELECT attribute, count(*) AS n FROM ({_ATTRIBUTES}) WHERE value NOT IN ('', '0') GROUP BY attribute")
def attribute_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.counts(facts.attributes(pages(spark, sf_dir), "page_id", "html"), "attribute")


@register("attribute_values", f"SELECT attribute, value, count(*) AS n FROM ({_ATTRIBUTES}) WHERE value NOT IN ('', '0') GROUP BY attribute, value")
def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.counts(facts.attributes(pages(spark, sf_dir), "page_id", "html"), "attribute", "value")


@register("entity_count", "SELECT entity, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '&([a-zA-Z]+);', 1)) AS entity FROM pages) GROUP BY entity")
def entity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.counts(facts.entities(pages(spark, sf_dir), "page_id", "html"), "entity")


@register(
    "tags_to_texts",
    r"""SELECT CAST(t AS BIGINT) AS tags, CAST(x AS BIGINT) AS texts, round(t / x, 4) AS ratio FROM (SELECT 1 + sum(len(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)'))) AS t,
      1 + sum(len(regexp_extract_all(html, '>[^<]*[^<\s][^<]*<'))) AS x FROM pages)""",
)
def tags_to_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.tags_to_texts(pages(spark, sf_dir), "html")


@register("title_words", "SELECT page_id AS file, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> ''")
def title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.titles(pages(spark, sf_dir), "page_id", "html")


@register("page_urls", """SELECT DISTINCT page_id AS file, unnest(regexp_extract_all(concat_ws(' ', url, html), '(https?://[^\\s"''<>]+)', 1)) AS url FROM pages""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute links in each page and its own address."""
    return facts.urls(pages(spark, sf_dir).withColumn("text", F.concat_ws(" ", "url", "html")), "page_id", "text")


@register(
    "parse_failures",
    r"""SELECT * FROM (SELECT page_id AS file, CASE WHEN html IS NULL OR trim(html) = '' THEN 'Empty'
      WHEN NOT regexp_matches(html, '(?i)^\s*<(!DOCTYPE|\?xml)') THEN 'No document type'
      WHEN len(regexp_extract_all(html, '<p[ >]')) <> len(regexp_extract_all(html, '</p>')) THEN 'Paragraphs do not match'
      WHEN regexp_matches(html, '&[^a-zA-Z#]') THEN 'Stray ampersand' END AS problem FROM pages) WHERE problem IS NOT NULL""",
)
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.parse_failures(pages(spark, sf_dir), "page_id", "html")


def _path(url: str) -> str:
    return f"regexp_extract({url}, '^https?://[^/]*(/[^?#]*)', 1)"


@register(
    "link_check",
    f"""WITH f AS (SELECT DISTINCT {_path("url")} AS path FROM pages), l AS (SELECT DISTINCT p.path AS file, r.reference FROM ({_LINKS}) r JOIN (SELECT page_id, {_path("url")} AS path FROM pages) p USING (page_id))
    SELECT reason, count(*) AS n, count(DISTINCT reference) AS n_references FROM (
      SELECT l.reference, CASE WHEN f.path IS NULL THEN 'No such file' WHEN l.reference LIKE '%#%' THEN 'No topic id' END AS reason
      FROM l LEFT JOIN f ON split_part(l.reference, '#', 1) = f.path) WHERE reason IS NOT NULL GROUP BY reason""",
)
def link_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken links of all pages by reason."""
    df = pages(spark, sf_dir).withColumn("path", F.expr(_path("url")))
    links = facts.references(df, "path", "html").select("file", "reference")
    files = df.select(F.col("path").alias("file"), F.lit(None).cast("string").alias("topic"))
    ids = spark.createDataFrame([], "file string, id string, n long")
    broken = references.check(links, files, ids)
    return broken.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("reference").alias("n_references"))


#: Pages as files with a topic id (every fifth has none) and two ids, and a reference from each to the next one, in nine forms.
_FILE = "concat('/page ', {0}, '.html')"
_TOPIC = "concat('t', ({0}) % 7)"
_REFERENCE = f"""CASE page_id % 9 WHEN 0 THEN {_FILE.format("page_id + 1")} WHEN 1 THEN replace({_FILE.format("page_id + 1")}, ' ', '%20')
  WHEN 2 THEN concat({_FILE.format("page_id + 1")}, '#', {_TOPIC.format("page_id + 1")}, '/a') WHEN 3 THEN concat({_FILE.format("page_id + 1")}, '#none/a')
  WHEN 4 THEN concat({_FILE.format("page_id + 1")}, '#', {_TOPIC.format("page_id + 1")}, '/missing') WHEN 5 THEN concat({_FILE.format("page_id + 1")}, '#', {_TOPIC.format("page_id + 1")}, '/', {_TOPIC.format("page_id + 1")})
  WHEN 6 THEN concat({_FILE.format("page_id + 1")}, '#/a') WHEN 7 THEN concat({_FILE.format("page_id + 1")}, 'x') ELSE concat('#', {_TOPIC.format("page_id")}, '/a') END"""


@register(
    "reference_reasons",
    f"""WITH r AS (SELECT page_id, {_FILE.format("page_id")} AS file, {_REFERENCE} AS reference, page_id % 9 AS k, page_id + CASE WHEN page_id % 9 = 8 THEN 0 ELSE 1 END AS t FROM pages)
    SELECT * FROM (SELECT file, reference, CASE WHEN k = 7 OR t NOT IN (SELECT page_id FROM pages) THEN 'No such file' WHEN k < 2 THEN NULL WHEN t % 5 = 0 THEN 'No topic id' WHEN k = 3 THEN 'Topic id does not match'
      WHEN k = 4 THEN 'No such id in target topic' WHEN k = 5 OR t % 3 = 0 THEN NULL ELSE 'Duplicated id in target topic' END AS reason FROM r) WHERE reason IS NOT NULL""",
)
def reference_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references among all pages, taken as files that hold `a` one to three times and their topic's id once or twice."""
    df = pages(spark, sf_dir)
    topic = F.when(F.col("page_id") % 5 != 0, F.expr(_TOPIC.format("page_id")))
    named = df.select("page_id", F.expr(_FILE.format("page_id")).alias("file"), topic.alias("topic"), F.expr(_REFERENCE).alias("reference"))
    ids = named.select("file", F.lit("a").alias("id"), (F.col("page_id") % 3 + 1).alias("n")).unionByName(named.where("topic is not null").select("file", F.col("topic").alias("id"), (F.col("page_id") % 2 + 1).alias("n")))
    return references.check(named.select("file", "reference"), named.select("file", "topic"), ids).select("file", "reference", "reason")


@register("external_links", f"SELECT CASE WHEN regexp_matches(reference, '(?i)^(https?:|mailto:|www)') THEN 'external' ELSE 'internal' END AS kind, count(*) AS n FROM ({_LINKS}) GROUP BY 1")
def external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = facts.references(pages(spark, sf_dir), "page_id", "html")
    return links.groupBy(F.when(T.external(F.col("reference")), "external").otherwise("internal").alias("kind")).agg(F.count("*").alias("n"))


@register(
    "reference_repair",
    f"""WITH k AS (SELECT {_path("url")} AS path, page_id FROM pages),
    clean AS (SELECT regexp_replace(lower(path), '[^a-z0-9/]', '', 'g') AS c, path FROM k),
    one AS (SELECT c, min(path) AS answer FROM clean GROUP BY c HAVING count(DISTINCT path) = 1),
    base AS (SELECT regexp_extract(path, '([^/]+)$', 1) AS b, path FROM k),
    two AS (SELECT b, min(path) AS answer FROM base GROUP BY b HAVING count(DISTINCT path) = 1),
    l AS (SELECT DISTINCT reference FROM ({_LINKS})),
    j AS (SELECT l.reference, one.answer AS a, two.answer AS b FROM l LEFT JOIN one ON one.c = regexp_replace(lower(l.reference), '[^a-z0-9/]', '', 'g') LEFT JOIN two ON two.b = regexp_extract(l.reference, '([^/]+)$', 1))
    SELECT reference, coalesce(a, b) AS repaired, CASE WHEN a IS NOT NULL THEN 'same letters' WHEN b IS NOT NULL THEN 'same base name' END AS how FROM j""",
)
def reference_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where links may have meant to go: pages with the same letters in their path, or with the same base name, if there is only one."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9/]", "")
    base = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    path = pages(spark, sf_dir).select(F.expr(_path("url")).alias("answer"))
    links = facts.references(pages(spark, sf_dir), "page_id", "html").select("reference").distinct()
    keyed = links.withColumns({"letters": letters(F.col("reference")), "base": base(F.col("reference"))})
    known = path.withColumns({"letters": letters(F.col("answer")), "base": base(F.col("answer"))})
    fixed = references.repair(keyed, (known.select("letters", "answer"), ["letters"], "same letters"), (known.select("base", "answer"), ["base"], "same base name"))
    return fixed.select("reference", "repaired", "how")


@register(
    "link_targets_lineage",
    f"WITH l AS ({_LINKS}), k AS (SELECT reference, count(DISTINCT page_id) AS n FROM l GROUP BY 1 HAVING count(DISTINCT page_id) > 1) SELECT l.reference AS target, l.page_id AS source, k.n FROM l JOIN k ON l.reference = k.reference",
)
def link_targets_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that several pages share, a row for each of the pages, and how many pages they are."""
    links = facts.references(pages(spark, sf_dir), "page_id", "html").select(F.col("file").alias("source"), F.col("reference").alias("target"))
    return references.shared_targets(links)


@register(
    "navigation_titles",
    f"""WITH t AS (SELECT '/' || lower(split_part(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ', 1)) AS file, min(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' GROUP BY 1),
    e AS (SELECT page_id AS map, lower(reference) AS href, CASE page_id % 3 WHEN 1 THEN reference WHEN 2 THEN t.title END AS navtitle, t.title AS known FROM ({_LINKS}) l LEFT JOIN t ON lower(l.reference) = t.file)
    SELECT map, href, navtitle, coalesce(known, navtitle) AS title, CASE WHEN known IS NULL THEN 'No title known' WHEN navtitle IS NULL THEN 'Set' WHEN navtitle = known THEN 'Unchanged' ELSE 'Changed' END AS note FROM e""",
)
def navigation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles for links, where a page's title begins with the link's word.

    Of three pages one has no titles yet, one the links themselves and one the titles that are known.
    """
    known = facts.titles(pages(spark, sf_dir), "page_id", "html")
    titles = known.groupBy(F.concat(F.lit("/"), F.lower(F.split_part("title", F.lit(" "), F.lit(1)))).alias("file")).agg(F.min("title").alias("title"))
    links = facts.references(pages(spark, sf_dir), "page_id", "html").select(F.col("file").alias("map"), F.lower("reference").alias("href"), "reference")
    shown = links.join(titles.select(F.col("file").alias("f"), "title"), F.col("href") == F.col("f"), "left")
    entries = shown.select("map", "href", F.when(F.col("map") % 3 == 1, F.col("reference")).when(F.col("map") % 3 == 2, F.col("title")).alias("navtitle"))
    return references.fill_titles(entries, titles)


@register(
    "duplicate_link_holders",
    f"SELECT reference, l.page_id AS file, first FROM ({_LINKS}) l JOIN (SELECT reference, min(page_id) AS first FROM ({_LINKS}) GROUP BY 1) f USING (reference) WHERE l.page_id > first",
)
def duplicate_link_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.later_holders(facts.references(pages(spark, sf_dir), "page_id", "html").select("file", "reference"), "reference", "file")


@register(
    "links_in_group",
    f"SELECT page_id AS file, reference, count(*) OVER (PARTITION BY reference) AS in_group FROM ({_LINKS})",
)
def links_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.with_group_size(facts.references(pages(spark, sf_dir), "page_id", "html").select("file", "reference"), ["reference"]).select("file", "reference", "in_group")


@register(
    "zoom_out",
    r"SELECT page_id AS file, CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS paragraphs, CAST(len(regexp_extract_all(html, '<br>')) AS INT) AS breaks, CAST(len(regexp_extract_all(html, '<!--[^>]*-->')) AS INT) AS comments FROM pages",
)
def zoom_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page, one column for each pattern."""
    return facts.matches(pages(spark, sf_dir), "page_id", "html", {"paragraphs": "<p>", "breaks": "<br>", "comments": "<!--[^>]*-->"})


@register("url_extensions", "SELECT regexp_extract(url, '\\.([a-z]+)/', 1) AS extension, count(*) AS n FROM pages GROUP BY 1")
def url_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("extension")).agg(F.count("*").alias("n"))


@register(
    "status_summary",
    f"""WITH c AS (SELECT 'pages' AS name, count(*) AS n FROM pages UNION ALL SELECT 'links', count(*) FROM ({_LINKS}) UNION ALL SELECT 'tags', count(DISTINCT tag) FROM ({_TAGS})
      UNION ALL SELECT 'titles', count(*) FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> '')
    SELECT n, CAST(n AS VARCHAR) || ' ' || CASE WHEN n = 1 THEN regexp_replace(name, 's$', '') ELSE name END AS line FROM c WHERE n > 0""",
)
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    tags = facts.tags(df, "page_id", "html").select("tag").distinct()
    every = count(df, "pages").unionByName(count(facts.references(df, "page_id", "html"), "links")).unionByName(count(tags, "tags")).unionByName(count(facts.titles(df, "page_id", "html"), "titles"))
    return groups.status(every)


@register(
    "fact_levels",
    f"SELECT 1 AS depth, count(DISTINCT page_id) AS n FROM ({_TAGS}) UNION ALL SELECT 2, count(*) FROM (SELECT DISTINCT page_id, tag FROM ({_TAGS}))",
)
def fact_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.levels(facts.tags(pages(spark, sf_dir), "page_id", "html"), "file", "tag")
