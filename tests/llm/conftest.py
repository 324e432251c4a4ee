import pytest

from brinelog.llm.common import table


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")
