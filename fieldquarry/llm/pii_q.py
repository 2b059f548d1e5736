"""Query of pseudonyms."""

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pii import pseudonymise

#: The setting that holds the key.
KEY = "spark.fieldquarry.pseudonyms.key"


def key(spark: SparkSession) -> str:
    """The session's key; without one, a new key that nobody keeps: pseudonyms are linked within a run, and can't be inverted."""
    return spark.conf.get(KEY, None) or secrets.token_hex(32)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents"), key(spark), counts_col="found")
    n = F.aggregate(F.map_values("found"), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "text", n.alias("n_values"), F.concat_ws(",", F.array_sort(F.map_keys("found"))).alias("kinds"))


QUERIES = {"op4_pii_pseudonyms": op4_pii_pseudonyms}
ORACLE: dict = {}
