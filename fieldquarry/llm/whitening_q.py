"""Query of the embedding whitening."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .whitening import whiten


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLE: dict = {}
