import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from recordlens.session import local_session

    session = local_session(8, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def rows(df, *cols):
    """Rows as sorted tuples."""
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="session")
def table(spark):
    """Small table of text columns: table("a b", ("1", "2"), ...)."""

    def make(columns, *data):
        schema = ", ".join(f"`{c}` string" for c in columns.split())
        return spark.createDataFrame([tuple(r) for r in data], schema)

    return make
