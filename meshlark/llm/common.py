"""Pieces that the operators share: input columns, the shared folder, written cut points.

Every operator reads two columns of its input by name (an integer id and a text) and
ignores all others, so extra columns with any names cannot clash with its own. A null
text counts as empty. Ids may be null or repeated unless an operator says otherwise.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that Python works on at a time; Spark bounds a batch's bytes (64 MiB by its default).
ROWS = 1000
#: Bytes of a file that one reading task takes at a time.
STRETCH = 4 << 20
_made: dict[int, str] = {}


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string not null) of a table, whatever else it holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores is dealt over all of them; others stay where they are.

    Results do not depend on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ROWS rows, so that what Python makes of them stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing a temporary folder takes its place in local mode, elsewhere it is an error. Folders
    made here are removed when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        key = id(spark.sparkContext)
        if key not in _made:
            _made[key] = tempfile.mkdtemp(prefix="meshlark-")
            spark.sparkContext.setCheckpointDir(_made[key])
        base = _made[key]
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = re.sub(r"^file:/+", "file:///", fs.makeQualified(path).toString()).rstrip("/") + f"/llm-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs.mkdirs(target)

    def remove() -> None:
        try:
            fs.delete(target, True)
        except Exception:  # the JVM is gone already
            pass

    atexit.register(remove)
    return uri


def written(df: DataFrame, folder: str | None = None, name: str = "rows") -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_file(df: DataFrame, file: str, offset: str) -> DataFrame:
    """Rows dealt by stretches of files and sorted by offset, so that tasks read from front to back.

    Some tasks for each core: the rows are few and narrow, the files that they point to are not.
    """
    tasks = 8 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, file, F.floor(F.col(offset) / STRETCH)).sortWithinPartitions(file, offset)


def store(uri: str):
    """(pyarrow file system, path) of a URI of the shared folder; works in Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def unique_name(prefix: str) -> str:
    """A file name that no other attempt of the same task uses; manifests carry it."""
    return f"{prefix}-{partition_id():05d}-{uuid.uuid4().hex[:12]}"
