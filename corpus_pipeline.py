"""From raw documents to token-id files: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, and further columns of docs, whatever their names, are kept. An empty
table gives an empty one. Texts of any length are read whole. What a stage does with null and
empty texts, rows without a doc_id, repeated rows and ties is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, jaccard, langid, mixing, token_files
from tessella.llm.queries import tokenizer_file
from tessella.session import materialise, release, ship, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and mixtures without a main language, go.

    A null or empty text has no letter. A text with two languages of half each stays. A null
    doc_id or lang makes no difference to whether a row stays; repeated rows stay or go together.
    """
    ship(spark)
    return langid.spoken(docs, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of 5-word shingles, the one with the smallest doc_id stays.

    Texts without words, null ones too, are linked with nothing and stay, as do rows without a
    doc_id. Of rows that agree in doc_id and text one stays; of unlike texts that share the
    smallest doc_id all stay.
    """
    ship(spark)
    return jaccard.one_of_each(docs, size=5, threshold=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words inside 13-word windows of benchmark items go.

    Exactly a twentieth goes. Texts without words, null ones too, stay, whatever their doc_id;
    repeated rows stay or go together; with an empty benchmark all stay.
    """
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=13, coverage=20)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null texts and texts without words are taken once; a null source is a source, the last one;
    repeated rows are drawn one by one.
    """
    ship(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files of token ids.

    A row for each row of docs, a null doc_id first, ties in the order of their texts' digests; a
    null or empty text is the end id alone.
    """
    ship(spark)
    return token_files.round_trip(docs, tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("token_ids", token_ids),
]

#: SQL can express neither the mixture model nor the draws nor the files; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = materialise(stage(spark, before, sf_dir), name)
        release(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)  # the files of token ids are written
    return out
