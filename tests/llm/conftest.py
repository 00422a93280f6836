import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import llm_cases  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(llm_cases.edge_rows(), llm_cases.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.createDataFrame(llm_cases.corpus_rows(), llm_cases.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], llm_cases.SCHEMA)
