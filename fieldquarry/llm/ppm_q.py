"""Query of language-model scores."""

from pyspark.sql import DataFrame, SparkSession

from .common import crc_fold, table
from .ppm import score_documents


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, crc_fold("doc_id") != 1)
    return out.select("doc_id", (crc_fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLE: dict = {}
