"""PLY point clouds as a Spark data source, and their cleaning.

``spark.dataSource.register(PlySource)`` and then
``spark.read.format("ply").load(path)``. The header is read once on the
driver through Spark's own file access, so any store Spark reaches will do;
fixed-width binary bodies are read by byte ranges, text bodies by line ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from orthant.functions.scalar import finite, normalize_rgb, sane_color, sh_color, sigmoid

# Type names of the format and their numpy codes.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


@dataclass
class Header:
    form: str  # ascii, binary_little_endian or binary_big_endian
    offset: int  # of the body
    count: int  # of vertices
    columns: list[tuple[str, str]]  # of the vertex element
    before: list[tuple[int, list[str]]]  # elements before it: rows, and types (list:count:item for lists)

    @property
    def dtype(self) -> np.dtype:
        order = ">" if self.form.endswith("big_endian") else "<"
        return np.dtype([(name, order + kind) for name, kind in self.columns])


def read_header(data: bytes) -> Header:
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    offset = data.index(b"\n", end) + 1
    form, elements = "", []
    for line in data[:end].decode("ascii", "replace").splitlines()[1:]:
        word = line.split()
        if not word or word[0] in ("comment", "obj_info"):
            continue
        if word[0] == "format":
            form = word[1]
        elif word[0] == "element":
            elements.append((word[1], int(word[2]), []))
        elif word[0] == "property":
            elements[-1][2].append((word[-1], f"list:{TYPES[word[2]]}:{TYPES[word[3]]}" if word[1] == "list" else TYPES[word[1]]))
    if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown PLY format {form!r}")
    before = []
    for name, count, columns in elements:
        if name == "vertex":
            if any(kind.startswith("list") for _, kind in columns):
                raise ValueError("a vertex with list properties is not supported")
            if not {"x", "y", "z"} <= {c for c, _ in columns}:
                raise ValueError("vertices need x, y and z")
            return Header(form, offset, count, columns, before)
        before.append((count, [kind for _, kind in columns]))
    raise ValueError("the file has no vertices")


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _schema(header: Header) -> StructType:
    """The row number and all properties; a property that is itself called source_index gets a prefix."""
    own = [StructField("ply_source_index" if n == "source_index" else n, DoubleType()) for n, _ in header.columns]
    return StructType([StructField("source_index", LongType(), False), *own])


class PlySource(DataSource):
    """``ply``: one row per vertex, ``source_index`` and all scalar properties as doubles."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def schema(self) -> StructType:
        with open(self._path(), "rb") as f:
            return _schema(read_header(f.read(1 << 16)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PlyReader(self._path(), int(self.options.get("rowsperpartition", 500_000)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PlyWriter(self._path(), [f.name for f in schema.fields])


class _PlyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows
        with open(path, "rb") as f:
            self.header = read_header(f.read(1 << 16))

    def partitions(self) -> list[InputPartition]:
        n = self.header.count
        return [_Range(i, min(n, i + self.rows)) for i in range(0, n, self.rows)] or [_Range(0, 0)]

    def _skip(self, f) -> int:
        """Bytes (binary) or lines (text) of the elements before the vertices."""
        h = self.header
        if h.form == "ascii":
            return sum(count for count, _ in h.before)
        at = h.offset
        order = ">" if h.form.endswith("big_endian") else "<"
        for count, kinds in h.before:
            if not any(k.startswith("list") for k in kinds):
                at += count * sum(np.dtype(k).itemsize for k in kinds)
                continue
            f.seek(at)
            for _ in range(count):
                for k in kinds:
                    if k.startswith("list"):
                        _, size, item = k.split(":")
                        n = int(np.frombuffer(f.read(np.dtype(size).itemsize), order + size)[0])
                        f.seek(n * np.dtype(item).itemsize, 1)
                    else:
                        f.seek(np.dtype(k).itemsize, 1)
            at = f.tell()
        return at

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        h = self.header
        with open(self.path, "rb") as f:
            skip = self._skip(f)
            if h.form == "ascii":
                f.seek(h.offset)
                for _ in range(skip + part.first):
                    f.readline()
                table = np.array([f.readline().split()[: len(h.columns)] for _ in range(part.last - part.first)], dtype=object).reshape(-1, len(h.columns)).astype(float)
                values = [table[:, i] for i in range(len(h.columns))]
            else:
                f.seek(skip + part.first * h.dtype.itemsize)
                raw = np.frombuffer(f.read((part.last - part.first) * h.dtype.itemsize), h.dtype)
                if len(raw) != part.last - part.first:
                    raise ValueError("the file ends before its last vertex")
                values = [raw[n].astype(float) for n, _ in h.columns]
        arrays = [pa.array(np.arange(part.first, part.last)), *[pa.array(v) for v in values]]
        for i in range(0, part.last - part.first, 10_000):
            yield pa.RecordBatch.from_arrays([a[i : i + 10_000] for a in arrays], _schema(h).names)


class _PlyWriter(DataSourceWriter):
    """Writes one binary file from a single partition; the rename at commit makes it appear whole."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import os

        body = bytearray()
        count = 0
        kinds = ["uchar" if n in ("red", "green", "blue") else "int" if n == "source_index" else "double" for n in self.names]
        pack = struct.Struct("<" + "".join({"uchar": "B", "int": "i", "double": "d"}[k] for k in kinds))
        with open(f"{self.path}.part", "wb") as f:
            for row in rows:
                body += pack.pack(*[v if k == "double" else int(v) for v, k in zip(row, kinds)])
                count += 1
                if len(body) > 1 << 20:
                    f.write(body)
                    body.clear()
            f.write(body)
        head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {count}\n" + "".join(f"property {k} {n}\n" for k, n in zip(kinds, self.names)) + "end_header\n"
        with open(f"{self.path}.tmp", "wb") as out, open(f"{self.path}.part", "rb") as f:
            out.write(head.encode())
            while chunk := f.read(1 << 20):
                out.write(chunk)
        os.remove(f"{self.path}.part")
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        import os

        os.replace(f"{self.path}.tmp", self.path)

    def abort(self, messages: list) -> None:
        import os

        for end in (".part", ".tmp"):
            if os.path.exists(self.path + end):
                os.remove(self.path + end)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").load(path)


def write_points(points: DataFrame, path: str) -> None:
    """Points as binary PLY: ``x y z``, colours 0..1 as bytes, ``source_index`` and any other number column."""
    points.sparkSession.dataSource.register(PlySource)
    columns = [F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * 255).alias(n) if c in "rgb" else F.col(c) for c, n in [(c, {"r": "red", "g": "green", "b": "blue"}.get(c, c)) for c in points.columns]]
    points.select(*columns).orderBy("source_index" if "source_index" in points.columns else points.columns[0]).coalesce(1).write.format("ply").mode("append").save(path)


def clean_cloud(raw: DataFrame, min_opacity: float = 0.1, outlier_factor: float = 50.0) -> DataFrame:
    """The cloud that fits work on: ``id, x, y, z, r, g, b, opacity, splat``.

    Rows with a non-finite coordinate go, then splats below the opacity, then
    local outliers. Colour comes from spherical harmonics, else RGB, else grey.
    """
    from orthant.operators.spatial import local_outliers

    if not 0 <= min_opacity <= 1:
        raise ValueError("min_opacity must be from 0 to 1")
    if outlier_factor < 0:
        raise ValueError("outlier_factor must not be negative")
    have = set(raw.columns)
    shape = [*[f"scale_{i}" for i in range(3)], *[f"rot_{i}" for i in range(4)]]
    rows = raw.where(finite("x", "y", "z")).withColumn("id", F.col("source_index"))
    rows = rows.withColumns({a: F.col(a) + 0.0 for a in "xyz"})
    gaussian = {*shape, "opacity"} <= have
    opacity = sigmoid(F.col("opacity")) if gaussian else F.lit(1.0)
    rows = rows.withColumn("opacity", opacity)
    if gaussian:
        rows = rows.where(finite("opacity") & (F.col("opacity") >= min_opacity))
    if {"f_dc_0", "f_dc_1", "f_dc_2"} <= have:
        rows = rows.withColumns({c: sane_color(sh_color(F.col(f"f_dc_{i}"))) for i, c in enumerate("rgb")})
    elif {"red", "green", "blue"} <= have:
        rows = normalize_rgb(rows)
        rows = rows.withColumns({c: sane_color(F.col(n)) for c, n in zip("rgb", ("red", "green", "blue"))})
    else:
        rows = rows.withColumns({c: F.lit(0.65) for c in "rgb"})
    splat = F.struct(F.array(*[F.col(c) for c in shape[:3]]).alias("log_scales"), F.array(*[F.col(c) for c in shape[3:]]).alias("quat_wxyz")) if set(shape) <= have else F.lit(None).cast("struct<log_scales: array<double>, quat_wxyz: array<double>>")
    rows = rows.withColumn("splat", splat).select("id", "x", "y", "z", "r", "g", "b", "opacity", "splat")
    bad = local_outliers(rows, outlier_factor).where("is_outlier").select("x", "y", "z")
    kept = rows.join(bad, ["x", "y", "z"], "left_anti").select(*rows.columns)
    if kept.select("x", "y", "z").distinct().limit(20).count() < 20:
        raise ValueError("at least 20 distinct points must remain")
    return kept
