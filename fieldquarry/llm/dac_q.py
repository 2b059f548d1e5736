"""Query of token-id files."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .dac import token_files


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op10_token_id_output": op10_token_id_output}
ORACLE: dict = {}
