import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def table(spark):
    """A table of documents from (id, text) pairs, with columns whose names an operator might use itself."""

    def make(rows, more=("_id", "t", "_block", "_maybe", "c0", "txt")):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in more)])
        return spark.createDataFrame([(i, t, *(f"{c}{n}" if n % 3 else None for c in more)) for n, (i, t) in enumerate(rows)], schema)

    return make
