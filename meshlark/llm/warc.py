"""Operator 5: WARC archives and the normaliser of monolithic gzip files.

Pages are written as whole-file gzip streams, one stream of many records. Revisits are then
known from one narrow row per page. The normaliser inflates each whole-file stream once,
rewrites every record as a gzip member of its own (a revisit without its payload) and writes a
sidecar index with each member's offset and length. Pages are read back from the members by
range. Only (file, record number, digest, size) is shuffled, never a payload.

Edge cases: null or empty html is an empty payload, below the smallest size for revisits, so
always a response; of equal rows with equal page_id one is the response; null page_ids sort
last, and a revisit whose group has only null ids refers to null; an empty table gives an
empty table; other columns are ignored. A null url is left out of the record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_file, shared_folder, slices, store, unique_name, written

#: Payloads below this size are never revisits; a stream is closed beyond so many bytes of records.
LEAST, FILE_BYTES = 100, 128 << 20
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes read, and inflated bytes taken, at a time.
READ, INFLATED = 1 << 20, 4 << 20
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(file: str, number: int) -> str:
    """The id of a whole-file stream's record: unique also where page ids repeat, and the same after rewriting."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{number}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, own_id: str, refers_to: tuple[str, int | None] | None = None, size: int | None = None) -> bytes:
    """One WARC record: a response with its payload or, if refers_to (record id, page id) is given, a revisit without."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload) if size is None else size}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[0]}", f"X-Refers-To-Page-ID: {'' if refers_to[1] is None else refers_to[1]}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, total length) of the record at the start of data; length 0: data ends before the record."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return {}, b"", 0
    headers = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
    total = end + 4 + int(headers["Content-Length"]) + 4
    if len(data) < total:
        return headers, b"", 0
    body = data[end + 4 : total - 4]
    return headers, body[body.find(b"\r\n\r\n") + 4 :], total


def write_streams(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes whole-file gzip streams; (page_id, file, number, digest, n_bytes) per record, written too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        out, number, held = None, 0, 0
        for b in slices(batches):
            rows = []
            for i, url, html in zip(*(b.column(k).to_pylist() for k in range(3))):
                if out is None:
                    name, pack = unique_name("whole") + ".warc.gz", zlib.compressobj(1, zlib.DEFLATED, 31)
                    out, number, held = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                whole = record(i, url, payload, digest, record_id(name, number))
                out.write(pack.compress(whole))
                rows.append((i, name, number, digest, len(payload)))
                number, held = number + 1, held + len(whole)
                if held > FILE_BYTES:
                    out.write(pack.flush())
                    out.close()
                    out = None
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], ["page_id", "file", "number", "digest", "n_bytes"])
        if out is not None:
            out.write(pack.flush())
            out.close()

    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return written(pages.mapInArrow(run, "page_id long, file string, number long, digest string, n_bytes long"), folder, "records")


def revisits(records: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """(file, number, refers_to, head_file, head_number) of the records whose payload another record holds."""
    head = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "number")).alias("head")
    heads = records.where(F.col("n_bytes") >= least).groupBy("digest").agg(head, F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("head_digest"), "head")
    heads = written(heads, folder, "heads")  # both sides are plain tables, so that the join can split a large group of copies
    return records.where(F.col("n_bytes") >= least).join(heads, F.col("digest") == F.col("head_digest")).where("file <> head.file OR number <> head.number").select("file", "number", F.col("head.page_id").alias("refers_to"), F.col("head.file").alias("head_file"), F.col("head.number").alias("head_number"))


def _records(stream) -> Iterator[bytes]:
    """The records of a whole-file gzip stream, inflated once and a piece at a time."""
    unpack, held, rest, full = zlib.decompressobj(31), bytearray(), b"", False
    ended = False
    while not ended:
        if not rest and not full:
            rest = stream.read(READ)
            ended = not rest
        got = unpack.decompress(rest, INFLATED)  # a small input may hold a thousand times its size
        rest, full = unpack.unconsumed_tail, len(got) == INFLATED
        held += got
        at = 0
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            mark = held.rfind(b"Content-Length: ", at, end)
            total = end + 4 + int(held[mark + 16 : end]) + 4
            if len(held) < total:
                break
            yield bytes(held[at:total])
            at = total
        del held[:at]
    if held:
        raise ValueError("the stream ends inside a record")


def normalise(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites whole-file streams (file, revisits array<struct<number, refers_to, head_file, head_number>>) as archives with a member a record.

    Returns (archive, offset, length) per record, written; the same figures lie beside each
    archive as its sidecar index, 16 bytes a record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for b in slices(batches):
            for row in b.to_pylist():
                again = {x["number"]: (record_id(x["head_file"], x["head_number"]), x["refers_to"]) for x in row["revisits"] or []}
                name, offsets, lengths, at = unique_name("members") + ".warc.gz", [], [], 0
                with fs.open_input_stream(f"{root}/{row['file']}", compression=None) as stream, fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for number, whole in enumerate(_records(stream)):
                        if number in again:
                            h, payload, _ = parse(whole)
                            page = h["X-Page-ID"]
                            whole = record(int(page) if page else None, h.get("WARC-Target-URI"), b"", h["WARC-Payload-Digest"][7:], h["WARC-Record-ID"], again[number], len(payload))
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = pack.compress(whole) + pack.flush()
                        out.write(member)
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                with fs.open_output_stream(f"{root}/{name}.idx") as index:
                    index.write(b"".join(struct.pack("<QQ", *x) for x in zip(offsets, lengths)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["archive", "offset", "length"])

    return written(files.mapInArrow(run, "archive string, offset long, length long"), folder, "index")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every indexed member, read by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        name, file = None, None
        for b in slices(batches):
            rows = []
            for archive, offset, length in zip(*(b.column(k).to_pylist() for k in range(3))):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{root}/{archive}")
                h, payload, _ = parse(zlib.decompress(file.read_at(length, offset), 31))
                page, to, size, digest = h["X-Page-ID"], h.get("X-Refers-To-Page-ID", ""), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][7:]
                if h["WARC-Type"] == "response":
                    size, found = len(payload), hashlib.sha256(payload).hexdigest()
                    if found != digest:
                        raise ValueError(f"{archive} at {offset}: the payload differs from its digest")
                rows.append((int(page) if page else None, size, digest, h["WARC-Type"], int(to) if to else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    return by_file(index, "archive", "offset").mapInArrow(run, RESULT)


def archived(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives all pages and returns what is read back from the archives."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    records = write_streams(df, folder, id_col, url_col, html_col)
    files = records.groupBy("file").agg(F.count("*").alias("n"))
    # the records of one file, bounded by its size
    again = revisits(records, folder).groupBy("file").agg(F.collect_list(F.struct("number", "refers_to", "head_file", "head_number")).alias("revisits"))
    n = max(1, min(files.count(), 100_000))
    listed = files.join(again, "file", "left").select("file", "revisits").repartitionByRange(n, "file")  # a file a task: hashing would deal several to some
    index = normalise(listed, folder)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder + "/whole-*")) or []:
        fs.delete(f.getPath(), False)  # every record has its member now
    return read_back(index, folder)
