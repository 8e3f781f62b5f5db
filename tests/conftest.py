from __future__ import annotations

import pytest

from tessella.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows and a schema to a DataFrame, with a column that clashes with whatever an operator may call its own."""

    def make(rows, schema, *clash):
        df = spark.createDataFrame(rows, schema)
        for name in clash:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
