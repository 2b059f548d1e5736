"""Query of the quality classifier."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, table
from .mil import learn, score

#: Documents scored lower are of low quality.
THRESHOLD = 0.3


def scored(docs: DataFrame, labels: DataFrame, score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, by a model of the labelled rows outside the held-out fold."""
    model = learn(docs, labels.filter(crc_fold("doc_id") != 0), "doc_id", "text", "quality")
    return score(docs, model, score_col=score_col)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLE: dict = {}
