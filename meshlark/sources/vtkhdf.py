"""Unstructured grids in VTKHDF files, for viewers: written and read by executors, a bounded file at a time.

The files are HDF5 of its first, simplest layout (superblock 0, groups as symbol tables, contiguous
datasets), made and parsed here, since no HDF5 library is needed for that much of the format.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cell types of viewers (fixed values) by the kinds of gmsh files: line, triangle, quad, tetrahedron, hexahedron, prism, pyramid.
VTK_TYPES = {1: 3, 2: 5, 3: 9, 4: 10, 5: 12, 6: 13, 7: 14}
#: Cells of a file at most.
CELLS = 1 << 17
# Fixed values of the format: signature, an absent address, symbols of a group's one leaf, children of a tree's node.
SIGNATURE, NONE, LEAF, NODE = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1, 64, 32
_SPACE, _TYPE, _FILL, _LAYOUT, _ATTRIBUTE, _SYMBOLS = 0x01, 0x03, 0x05, 0x08, 0x0C, 0x11


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def _datatype(kind: np.dtype) -> bytes:
    if kind.kind == "f":
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 63, 0, 8, 0, 64, 52, 11, 0, 52, 1023)
    if kind.kind == "S":
        return struct.pack("<BBBBI", 0x13, 1, 0, 0, kind.itemsize)
    return struct.pack("<BBBBIHH", 0x10, 8 if kind.kind == "i" else 0, 0, 0, kind.itemsize, 0, 8 * kind.itemsize)


def _dataspace(shape: tuple[int, ...]) -> bytes:
    return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)


class _Writer:
    """Objects of a file, one after another; members come before the groups that name them."""

    def __init__(self):
        self.out = bytearray(96)  # the superblock

    def put(self, data: bytes) -> int:
        at = len(self.out)
        self.out += _padded(data)
        return at

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(_padded(data)), 0) + _padded(data) for kind, data in messages)
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def dataset(self, values: np.ndarray) -> int:
        at = self.put(values.tobytes()) if values.size else NONE
        return self.header([(_SPACE, _dataspace(values.shape)), (_TYPE, _datatype(values.dtype)), (_FILL, struct.pack("<BBBBI", 2, 2, 2, 1, 0)), (_LAYOUT, struct.pack("<BBQQ", 3, 1, at, values.nbytes))])

    def attribute(self, name: str, value: np.ndarray) -> tuple[int, bytes]:
        kind, space, label = _datatype(value.dtype), _dataspace(value.shape), name.encode() + b"\0"
        return _ATTRIBUTE, struct.pack("<BxHHH", 1, len(label), len(kind), len(space)) + _padded(label) + _padded(kind) + _padded(space) + value.tobytes()

    def group(self, members: dict[str, int], attributes: tuple[tuple[int, bytes], ...] = ()) -> tuple[int, int, int]:
        """(header, tree, heap) of a group; its names are in one leaf."""
        if len(members) > LEAF:
            raise ValueError(f"more than {LEAF} arrays")
        names, entries, last = bytearray(8), b"", 0
        for name in sorted(members):
            last = len(names)
            entries += struct.pack("<QQII16x", last, members[name], 0, 0)
            names += _padded(name.encode() + b"\0")
        data = self.put(bytes(names))
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, data))
        leaf = self.put(b"SNOD" + struct.pack("<BxH", 1, len(members)) + entries.ljust(40 * LEAF, b"\0"))
        tree = self.put((b"TREE" + struct.pack("<BBHQQQQQ", 0, 0, bool(members), NONE, NONE, 0, leaf, last)).ljust(24 + 8 * (2 * NODE + 1), b"\0"))
        return self.header([(_SYMBOLS, struct.pack("<QQ", tree, heap)), *attributes]), tree, heap

    def close(self, root: tuple[int, int, int]) -> bytes:
        head = SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHIQQQQ", LEAF // 2, NODE // 2, 0, 0, NONE, len(self.out), NONE)
        head += struct.pack("<QQII", 0, root[0], 1, 0) + struct.pack("<QQ", root[1], root[2])
        self.out[: len(head)] = head
        return bytes(self.out)


def grid_file(types: np.ndarray, sizes: np.ndarray, points: np.ndarray, cell_data: dict[str, np.ndarray], point_data: dict[str, np.ndarray]) -> bytes:
    """A VTKHDF file of cells: their types and numbers of points, all points (n x 3) and data arrays."""
    w = _Writer()
    one = lambda n: w.dataset(np.array([n], np.int64))
    members = {
        "NumberOfPoints": one(len(points)), "NumberOfCells": one(len(types)), "NumberOfConnectivityIds": one(len(points)),
        "Points": w.dataset(points.astype(np.float64)), "Types": w.dataset(types.astype(np.uint8)),
        "Connectivity": w.dataset(np.arange(len(points), dtype=np.int64)), "Offsets": w.dataset(np.append(0, np.cumsum(sizes)).astype(np.int64)),
        "CellData": w.group({k: w.dataset(v) for k, v in cell_data.items()})[0], "PointData": w.group({k: w.dataset(v) for k, v in point_data.items()})[0],
    }
    grid = w.group(members, (w.attribute("Version", np.array([1, 0], np.int64)), w.attribute("Type", np.array("UnstructuredGrid", "S16"))))
    return w.close(w.group({"VTKHDF": grid[0]}))


class Reader:
    """The groups, datasets and attributes of such a file."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE or data[8] != 0 or data[13:15] != b"\x08\x08":
            raise ValueError("not an HDF5 file of the first layout")
        self.data, self.root = data, struct.unpack_from("<Q", data, 64)[0]

    def messages(self, header: int) -> list[tuple[int, bytes]]:
        version, n, _, size = struct.unpack_from("<BxHII", self.data, header)
        if version != 1:
            raise ValueError("an object header of a later layout")
        out, at = [], header + 16
        for _ in range(n):
            kind, length = struct.unpack_from("<HH", self.data, at)
            out.append((kind, self.data[at + 8 : at + 8 + length]))
            at += 8 + length
        return out

    def members(self, header: int) -> dict[str, int]:
        tree, heap = struct.unpack("<QQ", dict(self.messages(header))[_SYMBOLS][:16])
        names = struct.unpack_from("<Q", self.data, heap + 24)[0]
        used, out = struct.unpack_from("<H", self.data, tree + 6)[0], {}
        for k in range(used):
            leaf = struct.unpack_from("<Q", self.data, tree + 32 + 16 * k)[0]
            for e in range(struct.unpack_from("<H", self.data, leaf + 6)[0]):
                name, member = struct.unpack_from("<QQ", self.data, leaf + 8 + 40 * e)
                start = names + name
                out[self.data[start : self.data.index(b"\0", start)].decode()] = member
        return out

    @staticmethod
    def _kind(message: bytes) -> np.dtype:
        cls, sign, size = message[0] & 15, message[1] & 8, struct.unpack_from("<I", message, 4)[0]
        return np.dtype({0: f"<{'i' if sign else 'u'}{size}", 1: f"<f{size}", 3: f"S{size}"}[cls])

    @staticmethod
    def _shape(message: bytes) -> tuple[int, ...]:
        return struct.unpack_from(f"<{message[1]}Q", message, 8)

    def dataset(self, header: int) -> np.ndarray:
        m = dict(self.messages(header))
        _, layout, at, _ = struct.unpack_from("<BBQQ", m[_LAYOUT])
        if layout != 1:
            raise ValueError("a dataset that is not contiguous")
        kind, shape = self._kind(m[_TYPE]), self._shape(m[_SPACE])
        return np.frombuffer(self.data, kind, int(np.prod(shape)), at if at != NONE else 0).reshape(shape)

    def attributes(self, header: int) -> dict[str, np.ndarray]:
        out = {}
        for kind, m in self.messages(header):
            if kind == _ATTRIBUTE:
                sizes = struct.unpack_from("<HHH", m, 2)
                label, type_, space = (8 + sum(len(_padded(b"\0" * s)) for s in sizes[:k]) for k in range(3))
                at = space + len(_padded(b"\0" * sizes[2]))
                shape = self._shape(m[space:])
                dtype = self._kind(m[type_:])
                out[m[label : label + sizes[0] - 1].decode()] = np.frombuffer(m, dtype, int(np.prod(shape)), at).reshape(shape)
        return out

    def grid(self) -> dict:
        """Types, offsets, points and data arrays of the file's unstructured grid."""
        top = self.members(self.root)["VTKHDF"]
        if self.attributes(top)["Type"].tobytes().rstrip(b"\0") != b"UnstructuredGrid":
            raise ValueError("not an unstructured grid")
        m = self.members(top)
        points = self.dataset(m["Points"])[self.dataset(m["Connectivity"])]
        data = {part: {k: self.dataset(at) for k, at in self.members(m[part]).items()} for part in ("CellData", "PointData")}
        return {"types": self.dataset(m["Types"]), "offsets": self.dataset(m["Offsets"]), "points": points, **data}


def write(df: DataFrame, path: str, cells_per_file: int = CELLS) -> int:
    """Writes cells (kind, points) as VTKHDF files of bounded size below the folder `path`; returns their number.

    kind is the viewer's cell type, points an array of two or three coordinates for each corner in
    the viewer's order. Of the other columns arrays are data of the points and numbers data of the
    cells. The folder must be new. Attempts write beside it; only those that were kept move there.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = files.makeQualified(hadoop).toString()
    uri = target.replace("file:/", "file:///", 1) if target.startswith("file:/") and not target.startswith("file://") else target
    attempts = uri.rstrip("/") + "-attempts"
    arrays = [f.name for f in df.schema if f.name != "points" and f.dataType.typeName() == "array"]
    numbers = [f.name for f in df.schema if f.name not in ("kind", "points", *arrays)]
    whole = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(attempts)
        for b in batches:
            for lo in range(0, b.num_rows, cells_per_file):
                part = b.slice(lo, cells_per_file)
                corners = part["points"].to_pylist()
                points = np.array([[*p, 0.0][:3] for c in corners for p in c], np.float64).reshape(-1, 3)
                cell_data = {n: np.array(part[n].to_pylist(), np.int64 if n in whole else np.float64) for n in numbers}
                point_data = {n: np.array([v for a in part[n].to_pylist() for v in a], np.float64) for n in arrays}
                name = f"grid-{uuid.uuid4().hex}.vtkhdf"
                with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(grid_file(np.array(part["kind"].to_pylist()), np.array([len(c) for c in corners], np.int64), points, cell_data, point_data))
                yield pa.RecordBatch.from_pydict({"name": [name]})

    files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(attempts))
    kept = [r["name"] for r in df.mapInArrow(run, "name string").collect()]  # a name for each file
    files.mkdirs(hadoop)
    for name in kept:
        files.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{attempts}/{name}"), spark._jvm.org.apache.hadoop.fs.Path(f"{uri}/{name}"))
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(attempts), True)
    return len(kept)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(kind, points, cell_data map, point_data map) of the cells of a folder's VTKHDF files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("points", pa.list_(pa.list_(pa.float64()))), ("cell_data", pa.map_(pa.string(), pa.float64())), ("point_data", pa.map_(pa.string(), pa.list_(pa.float64())))])
        for b in batches:
            for data in b.column(0).to_pylist():
                g = Reader(data).grid()
                at = g["offsets"].tolist()
                rows = [{"kind": int(t), "points": g["points"][lo:hi].tolist(), "cell_data": [(n, float(v[k])) for n, v in g["CellData"].items()], "point_data": [(n, v[lo:hi].astype(float).tolist()) for n, v in g["PointData"].items()]} for k, (t, lo, hi) in enumerate(zip(g["types"], at, at[1:]))]
                yield pa.RecordBatch.from_pylist(rows, schema)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.vtkhdf").load(path).select("content")
    return found.mapInArrow(run, "kind int, points array<array<double>>, cell_data map<string,double>, point_data map<string,array<double>>")


def cells_of(outlines: DataFrame, ndim: int) -> DataFrame:
    """(kind, points, cell) of Cartesian cell outlines (cell, corner, x_0..), as quads or hexahedra in the viewer's order."""
    order = [0, 2, 3, 1] if ndim == 2 else [0, 4, 6, 2, 1, 5, 7, 3]
    corners = F.array_sort(F.collect_list(F.struct("corner", F.array(*(F.col(f"x_{d}") for d in range(ndim))).alias("p"))))  # four or eight a cell
    rows = outlines.groupBy("cell").agg(corners.alias("c"))
    return rows.select(F.lit(VTK_TYPES[3 if ndim == 2 else 5]).alias("kind"), F.array(*(F.element_at("c", k + 1)["p"] for k in order)).alias("points"), "cell")
