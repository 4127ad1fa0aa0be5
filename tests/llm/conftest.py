import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def docs(spark):
    """Small documents table; rows are (doc_id, text, lang, source)."""

    def make(rows):
        return spark.createDataFrame([(*r, *["en", "s0"][len(r) - 2 :]) for r in rows], "doc_id bigint, text string, lang string, source string")

    return make
