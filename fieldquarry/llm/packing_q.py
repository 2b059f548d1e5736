"""Query of packing."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op6_packing": op6_packing}
ORACLE: dict = {}
