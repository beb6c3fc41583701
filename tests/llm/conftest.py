import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        *(T.StructField(c, T.StringType()) for c in ("d", "key", "n", "w_", "row", "kept_id", "bad_id", "tie")),
    ]
)


def words(r: random.Random, n: int, of: str = "abcdefgh") -> list[str]:
    return ["".join(r.choice(of) for _ in range(r.randint(1, 5))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source) with the awkward cases: nulls, empty, very long, ties, repeated rows."""
    r = random.Random(11)
    base = words(r, 60)
    out = [
        (0, " ".join(base), "en", "a"),
        (1, " ".join(base), "en", "a"),
        (2, " ".join(base[:-1]), "en", "a"),
        (3, " ".join([*base[:30], "x", *base[31:]]), "en", None),
        (4, None, "en", "a"),
        (5, "", None, "b"),
        (6, " \t\n ", "fr", "b"),
        (7, "One", "fr", "b"),
        (8, "one two", "fr", None),
        (8, "one two", "fr", None),
        (9, "A\0b A\0b c\nlast line here\n\nLAST line here  \n", "fr", "b"),
        (None, " ".join(base), "en", "a"),
        (None, None, None, None),
        (10, "première façon d’écrire\nlast line here\npremière façon d’écrire", "fr", "c"),
        (11, "\n".join(" ".join(words(r, 12)) for _ in range(2500)), "en", "a"),
        (60, "before <|endoftext|> after <|endoftext|>", "en", "b"),
        (12, "[INST] 1234567890 !!! \\ 日本語のテキスト 😀", None, "c"),
    ]
    for k in range(13, 60):
        lang = ("en", "fr")[k % 2]
        body = words(r, r.randint(1, 80), "aeiouthnrs" if lang == "en" else "éèàçlquxz")
        if k % 5 == 0:
            body = [*base[:50], *body[:3]]
        out.append((k, "\n".join([" ".join(body), "a line that many share", f"own {k}"]), lang, ("a", "b", "c", None)[k % 4]))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, lang, s, None if t is None else len(t), *["z"] * 8) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The smallest driver table, in Spark and as (doc_id, text, lang, source)."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df, [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
