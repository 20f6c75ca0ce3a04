"""Small record and line frames for builder tests."""

from pyspark.sql import functions as F

KEYS = "upload_id string, site_id string, host_name string, collection_ts timestamp, seq long"


def records(spark, rows, **columns):
    """Record frame out of dicts; extra columns are the same on every row."""
    data = [("u1", "s1", "HOST", i, {k: v for k, v in r.items() if v is not None}) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "upload_id string, site_id string, host_name string, seq long, rec map<string,string>")
    df = df.withColumn("collection_ts", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


def lines(spark, text, file="f.txt", **columns):
    data = [("u1", "s1", "HOST", i, file, i + 1, t) for i, t in enumerate(text.split("\n"))]
    df = spark.createDataFrame(
        data, "upload_id string, site_id string, host_name string, seq long, file string, line_no int, line string"
    )
    df = df.withColumn("collection_ts", F.lit("2024-02-01 00:00:00").cast("timestamp")).withColumn(
        "mtime", F.lit("2024-01-15 10:00:00").cast("timestamp")
    ).withColumn("rel", F.lit(file)).withColumn("size", F.lit(7))
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


def messages(df):
    return sorted(r["message"] for r in df.select("message").collect())


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
