"""Volumes of the driver's tables: images of embeddings, volumes of order lines, sparse event grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.volume import Volume


#: Vectors in a task; a file may have them all in one row group, which is one task's.
VECTORS = 16_384


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y = vec_id, x = position, v = component, label = the vector's label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if (tasks := -(-e.count() // VECTORS)) > 1:
        e = e.select("vec_id", "embedding", "label").repartition(tasks, "vec_id")
    return e.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"), "label").select("y", F.col("x").cast("bigint").alias("x"), F.col("v").cast("double").alias("v"), "label")


def _rows(spark, sf_dir) -> tuple[int, bool]:
    """Height of the image, and whether each of its rows is there."""
    r = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id").alias("top"), F.count(F.when(F.size("embedding") == 64, 1)).alias("n")).first()
    return r["top"] + 1, r["n"] == r["top"] + 1


def image(spark: SparkSession, sf_dir: str) -> Volume:
    height, complete = _rows(spark, sf_dir)
    return Volume(image_rows(spark, sf_dir).select("y", "x", "v"), (height, 64), "float64", complete=complete)


def labels_a(spark: SparkSession, sf_dir: str) -> Volume:
    g = image(spark, sf_dir)
    return g.with_values(F.floor((F.col("v") + 0.6) * 8), "int64")


def labels_b(spark: SparkSession, sf_dir: str) -> Volume:
    rows, (height, complete) = image_rows(spark, sf_dir), _rows(spark, sf_dir)
    return Volume(rows.select("y", "x", (F.floor((F.col("v") + 0.6) * 4) + F.col("label") % 2).cast("bigint").alias("v")), (height, 64), "int64", complete=complete)


def mask(spark: SparkSession, sf_dir: str) -> Volume:
    """A box that no block fits: rows 10 to 299, columns 5 to 39."""
    g = image(spark, sf_dir).dense()
    return g.with_values((F.col("y").between(10, 299) & F.col("x").between(5, 39)).cast("int"), "uint8")


def scattered_mask(spark: SparkSession, sf_dir: str) -> Volume:
    """A rule over all rows: four voxels of seven."""
    g = image(spark, sf_dir).dense()
    return g.with_values(((F.col("y") * 5 + F.col("x") * 3) % 7 < 4).cast("int"), "uint8")


def volume3d(spark: SparkSession, sf_dir: str) -> Volume:
    """Order lines by line number, supplier and quantity; cells without any are left out (0)."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_linenumber") - 1).cast("bigint").alias("z"), F.col("l_suppkey").alias("y"), (F.col("l_quantity").cast("int") - 1).cast("bigint").alias("x"))
    top = rows.agg(F.max("y")).first()[0]
    return Volume(rows.groupBy("z", "y", "x").agg(F.count(F.lit(1)).alias("v")), (7, top + 1, 50), "int64")


def events_grid(spark: SparkSession, sf_dir: str) -> Volume:
    """Events by user and day; empty cells are left out (0)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("y"), (F.dayofmonth("ts") - 1).cast("bigint").alias("x"))
    top = rows.agg(F.max("y")).first()[0]
    return Volume(rows.groupBy("y", "x").agg(F.count(F.lit(1)).alias("v")), (top + 1, 31), "int64")
