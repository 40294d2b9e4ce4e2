import pytest

from docintake.session import local_session

# started here, so that test modules may build column expressions when they are imported
SESSION = local_session(4, **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def column(spark):
    """Evaluate one column expression for a list of values."""

    def run(values, expression, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
        got = rows.select("i", expression.alias("x")).collect()
        return [r["x"] for r in sorted(got, key=lambda r: r["i"])]

    return run
