import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cutline.session import build_session

    session = build_session(
        "cutline-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
        spark__sql__dataFrameQueryContext__enabled="false",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column expression over one row of named inputs."""

    def run(build, schema=None, **inputs):
        if not inputs:
            df = spark.range(1)
        elif schema:
            df = spark.createDataFrame([tuple(inputs.values())], schema)
        else:
            df = spark.createDataFrame([tuple(inputs.values())], list(inputs))
        out = df.select(build().alias("v")).first()["v"]
        return out.asDict(recursive=True) if hasattr(out, "asDict") else out

    return run
