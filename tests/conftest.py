import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def value(spark):
    """The value of an expression over literal text columns a, b ..."""
    def run(make, *texts):
        names = "abcdef"[: len(texts)]
        df = spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names))
        return df.select(make(*names).alias("v")).first()["v"]

    return run
