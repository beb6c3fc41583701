"""The queries op1 to op13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import blocks, chat, decontaminate, graph_index, infill, jaccard, langid, lines, mixing, resample, secrets, token_files
from tessella.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def _register(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language mixture of every document, learnt from labelled ones that are not held out."""
    return langid.predict(table(spark, sf_dir, "documents"))


@_register
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows of benchmark items in every document."""
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, coverage=20)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


ORACLES["op2_decontamination"] = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT DISTINCT k FROM win),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM p),
m AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON g.k = win.k AND g.g = win.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
  sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@_register
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest vectors, by inner product, of each vector whose vec_id is divisible by 20."""
    return graph_index.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@_register
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of known forms, and runs that pass the randomness tests, in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.sha2(secrets.joined("base"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secrets.joined("spans").alias("spans"))


@_register
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand earlier in the corpus, and each text without them."""
    found = lines.remove_long_passages(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_units", "n_removed", spans.alias("removed_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


@_register
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks the template's own control strings, formatted and read back."""
    own = spark.sql("select -1L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(given.unionByName(own))


@_register
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, Jaccard 0.9 or more: set sizes and components of all documents."""
    return jaccard.groups(table(spark, sf_dir, "documents"), size=3, threshold=0.9)


#: formatted_chars follows from the template: 13 code points around a user's text, 7 around an assistant's, 15 around a
#: system's, 17 around another role's name and text, and one for each backslash or control string in them.
ORACLES["op7_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]', role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (
  SELECT *, len(regexp_extract_all(text, '\\|<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]')) AS more,
    len(regexp_extract_all(role, '\\|<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]')) AS named FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + more + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 17 + length(role) + named END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


ORACLES["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, r.component_id
FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""


@_register
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds."""
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents"), least_chars=10, least_docs=2)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
k AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, k.first IS NOT NULL AND k.first < l.doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@_register
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document in a mix of all sources with weights 1, 2, 3."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@_register
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest doc_id."""
    return blocks.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op11_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@_register
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle example, and the text rebuilt from it."""
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    again = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
k AS (SELECT *, [CAST('0x' || substr(h, 8 * i - 7, 8) AS BIGINT) FOR i IN [1, 2, 3, 4]] AS k FROM t),
c AS (
  SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


@_register
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn to resemble the benchmark."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB has no CRC-32: it is folded over the bytes of each different feature.
ORACLES["op13_importance_resampling"] = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
c AS (
  SELECT f, xor(list_reduce(list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda r, y: xor(r >> 8, step[(xor(r, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k
  FROM h, steps),
s AS (SELECT k, count(*) AS n FROM df JOIN c USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM bf JOIN c USING (f) GROUP BY k),
a AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s, coalesce((SELECT sum(n) FROM t), 0) AS t),
g AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (a.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k), a),
m AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM df JOIN c USING (f) JOIN g USING (k) GROUP BY doc_id),
z AS (
  SELECT d.doc_id, len(d.w) AS words, coalesce(m.n, 0) AS n_features, coalesce(m.weight, 0) AS weight,
    coalesce(m.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM z WHERE words >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN r.r <= 25 * r.n // 100 THEN r.r END AS rank
FROM z LEFT JOIN r USING (doc_id)
"""
