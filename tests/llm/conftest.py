import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Build a documents-like table with an extra column whose name clashes with the operators' own."""

    def make(rows, extra=False):
        ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, ddl)
        if extra:
            for name in ("removed", "leaks", "class_id", "version", "key", "n", "h1", "size", "lang_pred", "score", "digest", "norm"):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit("x"))
        return df

    return make
