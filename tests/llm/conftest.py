import pytest


@pytest.fixture
def make(spark):
    """A frame of (id, text) rows with columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    def frame(rows, key="doc_id", text="text"):
        out = spark.createDataFrame(rows, f"{key} long, {text} string")
        return out.withColumn("rid", F.lit(1)).withColumn("hits", F.lit("x")).withColumn("blob", F.lit(2)).withColumn("score", F.lit(3)).repartition(3)

    return frame

