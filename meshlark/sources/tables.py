"""Groups at rest: Parquet partitioned by stretches of cells, so that cell ranges prune folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Spec

BUCKET = "cell_bucket"


def write(df: DataFrame, path: str, per_bucket: int = 64, files_per_bucket: int = 8) -> None:
    """Writes rows (id, cell, ...) below path; a bucket of cells is dealt over several files, however many rows it has."""
    bucket = F.floor(F.col("cell") / F.lit(per_bucket)).cast("bigint")
    salt = F.pmod(F.xxhash64("id"), F.lit(files_per_bucket))
    dealt = df.withColumn(BUCKET, bucket).repartition(F.col(BUCKET), salt).sortWithinPartitions(BUCKET, "cell", "id")
    dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str, spec: Spec, cells: tuple[int, int] | None = None, per_bucket: int = 64) -> DataFrame:
    """(id, cell, spec's columns), of the cells in [start, end) if given: other buckets are not listed or opened."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("cell", T.LongType()), *spec.struct().fields, T.StructField(BUCKET, T.LongType())])
    df = spark.read.schema(schema).option("basePath", path).parquet(path)
    if cells is not None:
        start, end = cells
        df = df.where((F.col(BUCKET) >= start // per_bucket) & (F.col(BUCKET) <= (end - 1) // per_bucket) & (F.col("cell") >= start) & (F.col("cell") < end))
    return df.drop(BUCKET)
