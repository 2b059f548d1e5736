"""Query of the token counts."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .transducer import token_counts


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLE: dict = {}
