"""Every registered query against its SQL twin on the smallest tables; queries without one must give rows."""

import pytest
from oracle_check import compare, oracle_connection

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries(), oracle_sql()
# Selections by value that the smallest tables may not meet.
MAY_BE_EMPTY = {"ag3_contains_all", "pf3_keyset_page", "tx8_first_emoji", "cp3_pair_channels", "pf9_completed_page", "sm2_ready_items"}


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    message = compare(spark, connection, name, QUERIES[name], ORACLE.get(name), FOLDER)
    if name in MAY_BE_EMPTY and message in ("EMPTY", "no rows"):
        return
    assert message is None, message


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
