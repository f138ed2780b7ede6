import random
import re

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that clash with results of the operators
    *(T.StructField(c, T.StringType()) for c in ("SIZE", "kept", "fingerprint", "score", "n_words", "contaminated")),
])


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    copy, line = prose(120), "Shared footer line number 7 of this site"
    texts = [
        None, "", " \t\n ", "é", "12 34", "word", prose(9), copy, copy, copy.upper(), copy + " tail", prose(60_000),
        "x" * 700, "ab " * 300, "日本語のテキスト" * 40, *(f"{prose(30)}\n{line.replace('7', str(i))}\n{prose(20)}" for i in range(8)),
        *(prose(rng.randint(20, 200)) for _ in range(20)),
    ]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[20]]  # repeated rows
    rows += [(None, copy, None, None, None), (None, None, None, None, None), (None, "a b c d e f g h i j k l", "en", None, 1)]
    return [(*r, *(["x"] * 6)) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def items(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")
