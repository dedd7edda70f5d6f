"""Operator 2: media columns over content-addressed payloads in tar shards.

A payload (the text's bytes, padded with spaces to a positive multiple of 192) is stored as
a PNG image of 8-bit RGB samples, 64 pixels or 192 bytes a line: lossless, deflated, with its
shape in the first 33 bytes. Each task appends the images that it has not yet stored to tar
shards of bounded size, named by their digest; rows carry shard, digest, offset and length.
Each content then has one address: of copies that different tasks have stored, that with the least
(shard, offset); the others are dead bytes. Contents are read back in two steps, sorted by
address, each content once: a ranged read of the header alone fills the metadata columns, a ranged
read of the body yields the samples. A row finds its content by the digest.

Shards and the manifest of (row, digest, shard, offset, length) lie in the shared folder; the
manifest is written by Spark's commit, so shards of lost or repeated attempts are never referred to.

Edge cases: null or empty text is one line of spaces; repeated rows share a payload; null ids
stay null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_file, documents, shared_folder, slices, spread, store, unique_name, written

LINE, PIXELS = 192, 64
HEADER = 33
#: A shard is closed beyond this many bytes.
SHARD_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"
METADATA = "width int, height int, bits int, samples int"
READ = "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string"


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw.ljust(max(LINE, -(-len(raw) // LINE) * LINE), b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes) -> bytes:
    """A PNG of the samples; each line is stored unfiltered."""
    lines = np.frombuffer(data, np.uint8).reshape(-1, LINE)
    raw = np.zeros((len(lines), LINE + 1), np.uint8)
    raw[:, 1:] = lines
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", PIXELS, len(lines), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 5)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits a sample, samples a pixel) from a PNG's first 33 bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != int.from_bytes(first[29:33], "big"):
        raise ValueError("not a PNG header")
    width, height, bits, colour = struct.unpack(">IIBB", first[16:26])
    return width, height, bits, {0: 1, 2: 3}[colour]


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that to_png() made."""
    width, height, bits, samples = header(data[:HEADER])
    at, packed = HEADER, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * samples * bits // 8)
    if raw[:, 0].any():
        raise ValueError("a filtered line")
    return raw[:, 1:].tobytes()


def feature(width: int, height: int, samples: np.ndarray) -> str:
    """Shape, mean and spread of the samples and a 16-cell average hash of the image."""
    cells = [int(x.mean()) if len(x) else 32 for x in np.array_split(samples, 16)]
    middle = sorted(cells)[8]
    bits = sum((c > middle) << i for i, c in enumerate(cells))
    return f"{width}x{height}:{samples.mean():.3f}:{samples.std():.3f}:{bits:04x}"


class _Shards:
    """Appends to tar shards; gives each payload's place."""

    def __init__(self, folder: str):
        self.fs, self.path = store(folder)
        self.out = None

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.name = unique_name("shard") + ".tar"
            self.out, self.at = self.fs.open_output_stream(f"{self.path}/{self.name}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        start = self.at + len(head)
        body = head + data + b"\0" * (-len(data) % 512)
        self.out.write(body)
        self.at += len(body)
        return self.name, start, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def write_shards(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every payload below `folder`; the manifest, one row per row of df, written there too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = _Shards(folder), {}
        for b in slices(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = payload(t)
                key = hashlib.sha256(data).digest()
                if key not in known:
                    if len(known) > 200_000:
                        known.clear()
                    png = to_png(data)
                    digest = hashlib.sha256(png)
                    known[key] = (digest.digest(), *shards.add(f"{digest.hexdigest()[:2]}/{digest.hexdigest()}.png", png))
                rows.append((i, len(t.encode()), *known[key]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return written(spread(documents(df, id_col, text_col)).mapInArrow(run, MANIFEST), folder, "manifest")


def contents(manifest: DataFrame) -> DataFrame:
    """One address (digest, shard, offset, length) of each content of a manifest, dealt and sorted by it."""
    at = manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return by_file(at.select("digest", "at.shard", "at.offset", "at.length"), "shard", "offset")


class _Reader:
    """Ranged reads of shards; the file last read from stays open."""

    def __init__(self, folder: str):
        self.fs, self.path = store(folder)
        self.name = self.file = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.path}/{shard}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def metadata(addresses: DataFrame, folder: str) -> DataFrame:
    """Addresses (shard and offset among their columns) with width, height, bits and samples, from ranged reads of headers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for b in slices(batches):
            rows = [header(reader.read(shard, offset, HEADER)) for shard, offset in zip(b["shard"].to_pylist(), b["offset"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int32()) for x in zip(*rows))], [*b.schema.names, "width", "height", "bits", "samples"])
        reader.close()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in addresses.schema)
    return addresses.mapInArrow(run, f"{kinds}, {METADATA}")


def read_back(described: DataFrame, folder: str) -> DataFrame:
    """Digests and features of the stored bytes of contents with metadata, read by range from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = _Reader(folder), ("digest", "shard", "offset", "length", "width", "height", "bits", "samples")
        for b in slices(batches):
            rows = []
            for digest, shard, offset, length, *shape in zip(*(b[k].to_pylist() for k in names)):
                png = reader.read(shard, offset, length)
                if hashlib.sha256(png).digest() != digest:
                    raise ValueError(f"{shard} at {offset}: the stored bytes differ from their address")
                data = from_png(png)
                rows.append((digest, len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-16:]), length, feature(*shape[:2], np.frombuffer(data, np.uint8)), *shape))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in f"{READ}, {METADATA}".split(", ")])
        reader.close()

    return described.mapInArrow(run, f"{READ}, {METADATA}")


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all payloads and returns what is read back from the stored bytes, with the metadata columns."""
    folder = shared_folder(df.sparkSession)
    manifest = write_shards(df, folder, id_col, text_col)
    found = read_back(metadata(contents(manifest), folder), folder).withColumnRenamed("digest", "content")
    rows = manifest.select("doc_id", "n_bytes", "digest").join(found, F.col("digest") == F.col("content"))
    digest = lambda name: F.lower(F.hex(name))
    return rows.select("doc_id", "n_bytes", "payload_bytes", digest("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", digest("content").alias("media_sha256"), "feature", "width", "height", "bits", "samples")
