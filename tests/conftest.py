import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitrina.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture()
def one(spark):
    """Value of an expression over given column values."""

    def value(expression, **columns):
        names = ", ".join(f"{n} {_type(v)}" for n, v in columns.items()) or "x int"
        df = spark.createDataFrame([tuple(columns.values()) or (1,)], names)
        return df.select(expression.alias("out")).first()["out"]

    return value


def _type(v):
    return {str: "string", int: "long", float: "double", bool: "boolean"}.get(type(v), "string")
