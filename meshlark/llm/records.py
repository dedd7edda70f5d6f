"""Operator 10: token ids as length-delimited binary records.

A record is: length (8 bytes, little-endian), masked CRC-32C of those 8 bytes, the payload,
masked CRC-32C of the payload. A payload is a document's ids as little-endian unsigned 16-bit
integers if the vocabulary fits, else 32-bit. Beside each file lies an index of 24 bytes a
record (offset and length of the payload, number of ids before it in the file), so that a
shuffled reader can fetch any record by itself.

Rows are range-partitioned by (doc_id, text hash, partition of the input) and sorted, so that even
rows that repeat an id and its text spread; each task tokenises its range and writes files of
FILE_BYTES at most, one record more at the end. Files in order of their task and number hold all
documents in ascending order (null ids first, equal ids in order of their text's hash). A document's
global start is its start in the file plus the lengths of all files before. One small row per file,
some 128 MiB of ids, comes to the driver; a file is read back by one task, a slice at a time.

Edge cases: null or empty text is the end id alone; repeated rows are records of their own;
null ids come first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import coder
from .common import documents, partition_id, shared_folder, slices, store, unique_name

#: Reflected CRC-32C polynomial and the mask's addend (fixed values of the record format).
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes of a block, and up to which a checksum is taken byte by byte.
BLOCK, SHORT = 512, 16
_PLACES = np.arange(0, BLOCK * 256, 256)
INDEX, ENTRY = "<QQQ", 24
#: A file is closed beyond this many bytes.
FILE_BYTES = 128 << 20
MANIFEST = "part int, number int, file string, records long, tokens long, width int"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, list[list[int]], list[int]]:
    """What byte v at place p of a block adds to the block's CRC; what a state becomes after a block, and after a byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    place = np.empty((BLOCK, 256), np.uint32)
    place[-1] = step
    for p in range(BLOCK - 2, -1, -1):
        place[p] = step[place[p + 1] & 0xFF] ^ (place[p + 1] >> 8)
    # a state's low byte acts like a data byte at the block's first place, and so on
    return place.ravel(), [place[k].tolist() for k in range(4)], step.tolist()


def crc32c(data: bytes) -> int:
    """CRC-32C: byte by byte for short data, else by XOR of table entries, a block at a time."""
    flat, after, step = _tables()
    state = 0xFFFFFFFF
    if len(data) <= SHORT:
        for v in data:
            state = step[(state ^ v) & 0xFF] ^ (state >> 8)
        return state ^ 0xFFFFFFFF
    pad = -len(data) % BLOCK
    a = np.zeros(pad + len(data), np.intp)
    a[pad:] = np.frombuffer(data, np.uint8)
    a[pad : pad + 4] ^= 0xFF  # the initial state; zeros in front change nothing
    at = a.reshape(-1, BLOCK)
    at += _PLACES
    state, (t0, t1, t2, t3) = 0, after
    for c in np.bitwise_xor.reduce(flat.take(at), axis=1).tolist():
        state = t0[state & 0xFF] ^ t1[state >> 8 & 0xFF] ^ t2[state >> 16 & 0xFF] ^ t3[state >> 24] ^ c
    return state ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(crc32c(head))) + payload + struct.pack("<I", masked(crc32c(payload)))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record; a wrong length or checksum raises ValueError."""
    (n,), (head_crc,) = struct.unpack("<Q", record[:8]), struct.unpack("<I", record[8:12])
    if masked(crc32c(record[:8])) != head_crc or len(record) != n + 16:
        raise ValueError("damaged record length")
    payload = record[12:-4]
    if masked(crc32c(payload)) != struct.unpack("<I", record[-4:])[0]:
        raise ValueError("damaged record")
    return payload


class _File:
    """A record file being written, with its index and its doc_ids."""

    def __init__(self, folder: str):
        fs, root = store(folder)
        self.name = unique_name("tokens")
        self.data, self.index, self.sink = (fs.open_output_stream(f"{root}/{self.name}.{x}") for x in ("rec", "idx", "ids"))
        self.ids = pa.ipc.new_stream(self.sink, pa.schema([("doc_id", pa.int64())]))
        self.at = self.tokens = self.records = 0
        self.entries: list[bytes] = []

    def add(self, ids: np.ndarray) -> None:
        payload = ids.tobytes()
        self.data.write(frame(payload))
        self.entries.append(struct.pack(INDEX, self.at + 12, len(payload), self.tokens))
        self.at, self.tokens, self.records = self.at + len(payload) + 16, self.tokens + len(ids), self.records + 1

    def mark(self, doc_ids: pa.Array) -> None:
        """Writes the index entries of the records added since the last mark, and their doc_ids."""
        self.index.write(b"".join(self.entries))
        self.entries.clear()
        self.ids.write_batch(pa.RecordBatch.from_arrays([doc_ids], ["doc_id"]))

    def close(self, number: int, width: int) -> pa.RecordBatch:
        self.ids.close()
        for f in (self.data, self.index, self.sink):
            f.close()
        return pa.RecordBatch.from_pydict({"part": pa.array([partition_id()], pa.int32()), "number": pa.array([number], pa.int32()), "file": [self.name], "records": [self.records], "tokens": [self.tokens], "width": pa.array([width], pa.int32())})


def write_records(df: DataFrame, folder: str, path: str, end_id: int, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the record files and indexes; part, number, file, records, tokens and width of each, in order.

    One small row per file comes to the driver, which keeps only committed attempts' names.

    Each file also has `<file>.ids`, the doc_ids in order, as Arrow IPC.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, out, number = coder(path), None, 0
        width = 2 if len(c.tokens) <= 1 << 16 and end_id < 1 << 16 else 4
        for b in slices(batches):
            lo, ids_column = 0, b.column(0)
            for k, t in enumerate(b.column(1).to_pylist()):
                if out is None:
                    out, lo = _File(folder), k
                out.add(np.append(c.encode(t), np.uint32(end_id)).astype(f"<u{width}"))
                if out.at > FILE_BYTES:
                    out.mark(ids_column[lo : k + 1])
                    yield out.close(number, width)
                    out, number = None, number + 1
            if out is not None:
                out.mark(ids_column[lo:])
        if out is not None:
            yield out.close(number, width)

    spark = df.sparkSession
    docs = documents(df, id_col, text_col)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.spark_partition_id().alias("origin"))
    dealt = keyed.repartitionByRange(parts, "doc_id", "tie", "origin").sortWithinPartitions("doc_id", "tie")
    files = dealt.select("doc_id", "text").mapInArrow(run, MANIFEST).toArrow()
    return sorted(files.to_pylist(), key=lambda f: (f["part"], f["number"]))


def read_records(spark: SparkSession, files: list[dict], folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; every checksum is verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for b in slices(batches):
            for row in b.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}.rec") as data, fs.open_input_stream(f"{root}/{row['file']}.idx") as index, fs.open_input_stream(f"{root}/{row['file']}.ids") as ids_in:
                    for ids in pa.ipc.open_stream(ids_in):
                        starts, n, crc = [], [], []
                        entries = list(struct.iter_unpack(INDEX, index.read(ENTRY * ids.num_rows)))
                        chunk_at = entries[0][0] - 12
                        chunk = data.read_at(entries[-1][0] + entries[-1][1] + 4 - chunk_at, chunk_at)
                        for offset, length, before in entries:
                            got = unframe(chunk[offset - 12 - chunk_at : offset + length + 4 - chunk_at])
                            tokens = np.frombuffer(got, f"<u{row['width']}")
                            starts.append(row["base"] + before)
                            n.append(len(tokens))
                            crc.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_arrays([ids.column(0), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    base, rows = 0, []
    for f in files:
        rows.append((f["file"], f["width"], base))
        base += f["tokens"]
    listed = spark.createDataFrame(rows, "file string, width int, base long")
    return listed.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, RESULT)


def token_records(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents as records and returns what is read back."""
    folder = shared_folder(df.sparkSession)
    return read_records(df.sparkSession, write_records(df, folder, path, end_id, None, id_col, text_col), folder)
