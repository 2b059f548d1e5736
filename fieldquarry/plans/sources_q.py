"""Queries of reading, writing, exports, verification and stage isolation."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import exports, tables
from ..sources.scratch import fresh_path
from .views import Book

BOOK = Book()
query = BOOK.query


@query("SELECT row_id, TRY_CAST(CASE WHEN row_id%11 = 0 THEN 'n/a' ELSE CAST(slope AS VARCHAR) END AS DOUBLE) AS slope, candidate_type, CAST(NULL AS DOUBLE) AS absent FROM candidates")
def s1_read_table(v):
    c = v("candidates").select("row_id", F.when(F.col("row_id") % 11 == 0, "n/a").otherwise(F.col("slope").cast("string")).alias("slope"), "candidate_type")
    path = fresh_path(c.sparkSession, "table") + ".csv"
    c.write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("slope", T.DoubleType()), T.StructField("candidate_type", T.StringType()), T.StructField("absent", T.DoubleType())])
    return tables.read_table(c.sparkSession, path, schema)


@query("SELECT 'decimal' AS source, row_id, latitude, longitude FROM candidates UNION ALL SELECT 'short', row_id, latitude, longitude FROM detections UNION ALL SELECT 'both', row_id, latitude, longitude FROM detections")
def s2_named_coordinates(v):
    c, d = v("candidates"), v("detections")
    named = {
        "decimal": c.select("row_id", F.col("latitude").alias("decimalLatitude"), F.col("longitude").alias("decimalLongitude")),
        "short": d.select("row_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lng")),
        # the first known pair wins
        "both": d.select("row_id", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.col("latitude").alias("_latitude"), F.col("longitude").alias("_longitude")),
    }
    out = None
    for source, df in named.items():
        one = tables.named_coordinates(df).select(F.lit(source).alias("source"), "row_id", "latitude", "longitude")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS row_count, 'row_id,survey_area_id,priority_score' AS columns, count(*) AS rows_read, round(sum(priority_score), 4) AS total FROM candidates")
def s12_write_results(v):
    c = v("candidates").select("row_id", "survey_area_id", "priority_score")
    path = fresh_path(c.sparkSession, "results")
    summary = tables.write_results(c, path, ["survey_area_id", F.desc("priority_score"), "row_id"])
    back = c.sparkSession.read.parquet(path).agg(F.count("*").alias("rows_read"), F.round(F.sum("priority_score"), 4).alias("total"))
    return summary.crossJoin(back)  # one row each


def _folds(v):
    return v("folds").select("pair_id", "repeat", "method", "recall")


@query("SELECT pair_id, repeat, count(*) AS row_count, 64 AS digest_length, count(*) AS rows_read FROM folds GROUP BY 1, 2")
def s13_export_folds(v):
    folds = _folds(v)
    path = fresh_path(folds.sparkSession, "export")
    told = exports.export_folds(folds, path)
    back = folds.sparkSession.read.parquet(f"{path}/data").groupBy("pair_id", "repeat").agg(F.count("*").alias("rows_read"))
    return told.join(back, ["pair_id", "repeat"]).select(F.col("pair_id").cast("long").alias("pair_id"), "repeat", "row_count", F.length("content_sha256").alias("digest_length"), "rows_read")


@query("SELECT pair_id, repeat FROM folds GROUP BY 1, 2 HAVING pair_id%7 = 3 AND max(recall) > 0 OR pair_id%11 = 5 AND repeat = 2")
def s14_verify_export(v):
    folds = _folds(v)
    path = fresh_path(folds.sparkSession, "export")
    exports.export_folds(folds, path)
    # values change in some folds, and some are gone: the manifest must tell which
    changed = folds.withColumn("recall", F.when(F.col("pair_id") % 7 == 3, F.col("recall") * 2).otherwise(F.col("recall"))).filter("not (pair_id % 11 = 5 and repeat = 2)")
    changed.write.mode("overwrite").partitionBy("pair_id", "repeat").parquet(f"{path}/data")
    return exports.verify_export(folds.sparkSession, path).select(F.col("pair_id").cast("long").alias("pair_id"), "repeat")


@query("""SELECT DISTINCT pair_id, repeat, sha256('{"pair_id":' || pair_id || ',"repeat":' || repeat || '}') AS digest FROM folds""")
def s15_row_digest(v):
    rows = v("folds").select("pair_id", "repeat").distinct()
    return rows.withColumn("digest", exports.row_digest(rows))


@query("SELECT 'product' AS completed_stages, 'plan' AS failed_stage, 'no plan' AS failure, count(*) AS product_rows FROM candidates")
def s16_stage_isolation(v):
    c = v("candidates")
    path = fresh_path(c.sparkSession, "stages")

    def plan():
        raise ValueError("no plan")

    told = exports.staged([("product", lambda: c), ("plan", plan), ("report", lambda: c.limit(1))], path, c.sparkSession)
    kept = c.sparkSession.read.parquet(f"{path}/product").agg(F.count("*").alias("product_rows"))
    return told.crossJoin(kept).select(F.concat_ws(",", "completed_stages").alias("completed_stages"), "failed_stage", "failure", "product_rows")  # one row each
