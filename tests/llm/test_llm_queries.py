"""Every training-data query against its SQL, and against an empty table."""

import pytest

from parcelry.llm.queries import ORACLES, QUERIES
from parcelry.plans.compare import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(spark, sf, QUERIES[name], ORACLES[name]) == []


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
