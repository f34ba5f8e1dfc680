"""Every registered query against its SQL on the same tables."""

import os
import re

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    result = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert result["ok"], result


def test_every_query_has_sql():
    own = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
    assert own - set(entry.oracle_sql()) == set()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == [
        "query_id", "chunk_id", "dense_rank", "text_rank", "rrf_score", "rrf_rank"
    ]
