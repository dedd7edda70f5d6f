"""Operator 8: exact duplicates by content sort.

Sampled splitters over (first characters, 64-bit content hash, id) range-partition the rows,
so splitters stay small and a group of any size spreads over partitions; an external sort
inside each partition places equal texts next to each other; each row is compared in full
with its neighbour. Runs that end inside a partition are complete; the first and last run of
each partition (two small rows) are stitched by digest, and that table is at most two rows
per partition, so it may be broadcast.

Edge cases: null counts as empty, and empty texts are equal to each other; of rows with equal
text and equal id one is kept; null ids sort first, so a null id stays only in a group of null
ids; an empty table gives an empty table; other columns are ignored or carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partition_id, slices, written

#: Characters of a text that splitters carry.
PREFIX = 32
ROWS = "doc_id long, text_sha256 string, part int, edge int, keep_id long, group_size long, kept boolean"


def _sorted(df: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *([F.struct("*").alias("row")] if carry else []))
    keys = [F.substring("text", 1, PREFIX).alias("head"), F.xxhash64("text").alias("tail")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.select("*", *keys).repartitionByRange(parts, "head", "tail", "doc_id")
    return dealt.sortWithinPartitions("head", "tail", "text", "doc_id").select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"), *(["row"] if carry else []))


def _runs(batches: Iterator[pa.RecordBatch], ends_only: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their run's figures.

    edge: 0 for a run inside the partition, 1 for the first, 2 for the last, 3 for one that
    is both; the figures of such runs are the partition's share only. A row is held until its
    run ends, by id alone (or, with ends_only, just the last row is held).
    """
    part = partition_id()
    text = sha = None
    ids: list = []
    first, count = True, 0
    held = last_row = None

    def flush(end: bool):
        edge = (1 if first else 0) + (2 if end else 0)
        n = len(ids)
        out = {"doc_id": pa.array(ids, pa.int64()), "text_sha256": pa.array([sha] * n), "part": pa.array([part] * n, pa.int32()), "edge": pa.array([edge] * n, pa.int32()), "keep_id": pa.array([ids[-1]] * n, pa.int64()), "group_size": pa.array([count] * n, pa.int64()), "kept": pa.array([False] * (n - 1) + [True])}
        if ends_only:
            out = {k: v[-1:] for k, v in out.items()} | {"row": last_row}
        return pa.RecordBatch.from_pydict(out)

    for b in slices(batches):
        texts, shas, docs = b.column(1), b.column(2).to_pylist(), b.column(0).to_pylist()
        ready = []
        for k, t in enumerate(texts.to_pylist()):
            if count and t != text:
                if ends_only:
                    last_row = b.column(3)[k - 1 : k] if k else held
                ready.append(flush(False))
                first, ids, count = False, [], 0
            text, sha = t, shas[k]
            count += 1
            if ends_only:
                ids = [docs[k]]
            else:
                ids.append(docs[k])
        if b.num_rows and ends_only:
            held = b.column(3)[-1:]
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
    if count:
        last_row = held
        yield flush(True)


def _stitched(rows: DataFrame, names: list[str]) -> DataFrame:
    """Replaces the figures of runs that touch a partition's edge by those of their whole class."""
    edges = rows.where("edge > 0 AND kept").groupBy(F.col("text_sha256").alias("class_sha256")).agg(F.max("keep_id").alias("class_id"), F.sum("group_size").alias("class_size"), F.max("part").alias("class_part")).withColumn("edge_class", F.lit(True))
    # at most two classes per partition of the sort
    joined = rows.join(F.broadcast(edges), (F.col("edge") > 0) & (F.col("text_sha256") == F.col("class_sha256")), "left")
    return joined.select(
        *names,
        F.when(F.col("edge_class"), F.col("class_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("edge_class"), F.col("class_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("kept") & F.coalesce(F.col("part") == F.col("class_part"), F.lit(True))).alias("kept"),
    )


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; the largest id of each text stays."""
    rows = written(_sorted(df, id_col, text_col, False).mapInArrow(lambda b: _runs(b, False), ROWS))
    return _stitched(rows, ["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    ordered = _sorted(df, id_col, text_col, True)
    schema = T._parse_datatype_string(ROWS).add("row", ordered.schema["row"].dataType)
    rows = written(ordered.mapInArrow(lambda b: _runs(b, True), schema))
    return _stitched(rows, ["row"]).where("kept").select("row.*")


