import random

import pytest

from turnwise.llm.common import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, one long text, extra columns with names in use inside."""
    rng = random.Random(3)
    long = " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(400)) for _ in range(20_000))
    texts = [None, "", " \n\t ", "one", "two words", "Grüße, 日本語 🎉", long, long, "x" * 5000, "same text here " * 30, "same text here " * 30]
    rows = [(i, t, "k", [1], 7, None) for i, t in enumerate(texts)] + [(10, texts[10], "k", [1], 7, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, spans array<int>, id int, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return documents(spark, SF)
