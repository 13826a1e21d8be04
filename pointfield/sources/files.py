"""Point cloud and mesh files.

Readers go through Spark's own sources, so any store that Spark reads will do. OBJ text is parsed natively: lines are numbered
inside their file, and the n-th normal belongs to the n-th vertex. PLY headers are parsed per file. Writers give ordered text through Spark's
text sink, or one PLY file's bytes for a frame that fits a file.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import predictor


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, word array) of every line, numbered in its file."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    return text.select("file", "at", F.split(F.trim("line"), r"\s+").alias("w"))


def _numbered(lines: DataFrame, *kinds: str) -> DataFrame:
    order = Window.partitionBy("file").orderBy("at")
    return lines.where(F.col("w")[0].isin(*kinds)).withColumn("pid", F.row_number().over(order).cast("long") - 1)


def read_obj_cloud(spark: SparkSession, path: str) -> DataFrame:
    """(file, pid, x, y, z, nx, ny, nz, r, g, b): lines v, vn (normalised) and vt or vc as colours. A file with neither normals nor
    colours is an error."""
    lines = _lines(spark, path)
    n = lambda i: F.col("w")[i].cast("double")
    at = _numbered(lines, "v").select("file", "pid", n(1).alias("x"), n(2).alias("y"), n(3).alias("z"))
    length = F.sqrt(n(1) * n(1) + n(2) * n(2) + n(3) * n(3))
    normals = _numbered(lines, "vn").select("file", "pid", *[(n(i + 1) / F.nullif(length, F.lit(0.0))).alias(c) for i, c in enumerate(("nx", "ny", "nz"))])
    colours = _numbered(lines, "vt", "vc").select("file", "pid", *[F.try_element_at("w", F.lit(i + 2)).cast("double").alias(c) for i, c in enumerate("rgb")])
    out = at.join(normals, ["file", "pid"], "left").join(colours, ["file", "pid"], "left")
    missing = F.when(F.col("nx").isNull() & F.col("r").isNull(), F.raise_error(F.concat(F.lit("neither normals nor colours in "), F.col("file"))).cast("double"))
    return out.withColumn("nx", F.coalesce(F.col("nx"), missing))


def read_obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of one file, numbered from 0; of ``a/b/c`` only a counts."""
    lines = _lines(spark, path)
    vertices = _numbered(lines, "v").select(F.col("pid").alias("vid"), *[F.col("w")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
    corner = lambda i: (F.split(F.col("w")[i], "/")[0].cast("long") - 1).alias(f"v{i - 1}")
    faces = _numbered(lines, "f").select(F.col("pid").alias("fid"), corner(1), corner(2), corner(3))
    return vertices, faces


def _text(rows: DataFrame, path: str) -> None:
    """(block, at, line) as one ordered text file: the format is a single stream."""
    rows.orderBy("block", "at").select("line").coalesce(1).write.mode("overwrite").text(path)


def _words(kind: str, *columns: str):
    return F.concat_ws(" ", F.lit(kind), *[F.col(c).cast("string") for c in columns])


def write_obj_cloud(cloud: DataFrame, path: str) -> None:
    v = cloud.select(F.lit(0).alias("block"), F.col("pid").alias("at"), _words("v", "x", "y", "z").alias("line"))
    n = cloud.select(F.lit(1).alias("block"), F.col("pid").alias("at"), _words("vn", "nx", "ny", "nz").alias("line"))
    _text(v.union(n), path)


def write_obj_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    v = vertices.select(F.lit(0).alias("block"), F.col("vid").alias("at"), _words("v", "x", "y", "z").alias("line"))
    f = faces.select(F.lit(1).alias("block"), F.col("fid").alias("at"), F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in ("v0", "v1", "v2")]).alias("line"))
    _text(v.union(f), path)


PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
PLY_FIELDS = {"x": "x", "y": "y", "z": "z", "nx": "nx", "ny": "ny", "nz": "nz", "red": "r", "green": "g", "blue": "b"}
CLOUD = "file string, pid bigint, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double"


def parse_ply(data: bytes) -> dict[str, np.ndarray]:
    """The vertex columns of a PLY file, ASCII or binary of either byte order; colours of bytes become [0, 1]."""
    end = data.index(b"end_header")
    body = data[data.index(b"\n", end) + 1 :]
    form, count, names, kinds, at = "ascii", 0, [], [], None
    for line in data[:end].decode("ascii", "replace").split("\n"):
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            if at is None and w[1] != "vertex":
                raise ValueError("the vertices must come first")
            at = w[1]
            count = int(w[2]) if at == "vertex" else count
        elif w[:1] == ["property"] and at == "vertex":
            names.append(w[-1])
            kinds.append(PLY_TYPES[w[1]])
    if form == "ascii":
        values = np.array([r.split()[: len(names)] for r in body.decode("ascii").split("\n")[:count]], dtype="f8").reshape(count, len(names))
        got = {n: values[:, i] for i, n in enumerate(names)}
    else:
        order = "<" if "little" in form else ">"
        table = np.frombuffer(body, np.dtype([(n, order + k) for n, k in zip(names, kinds, strict=True)]), count)
        got = {n: table[n].astype("f8") for n in names}
    for n, k in zip(names, kinds, strict=True):
        if n in ("red", "green", "blue") and k == "u1":
            got[n] = got[n] / 255
    return got


def read_ply_cloud(spark: SparkSession, path: str) -> DataFrame:
    def work(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = parse_ply(data)
                n = len(got["x"])
                cols = {"file": pa.array([name] * n), "pid": pa.array(np.arange(n))}
                cols |= {to: pa.array(got[c]) if c in got else pa.nulls(n, pa.float64()) for c, to in PLY_FIELDS.items()}
                yield pa.RecordBatch.from_pydict(cols)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, CLOUD)


def ply_bytes(cloud: DataFrame, ascii: bool = False, faces: DataFrame | None = None) -> bytes:
    """One PLY file of a frame with pid or vid, x, y, z and optionally normals, colours r, g, b in [0, 1], and faces of three or four corners
    (``corners`` array, or v0, v1, v2). The rows pass the driver: a PLY file is one stream."""
    key = "pid" if "pid" in cloud.columns else "vid"
    parts = ["x", "y", "z"] + [c for c in ("nx", "ny", "nz") if c in cloud.columns]
    colours = [c for c in "rgb" if c in cloud.columns]
    rows = [tuple(r) for r in cloud.orderBy(key).select(*parts, *colours).toLocalIterator()]
    named = {"r": "red", "g": "green", "b": "blue"}
    head = ["ply", f"format {'ascii' if ascii else 'binary_little_endian'} 1.0", f"element vertex {len(rows)}"]
    head += [f"property float {c}" for c in parts] + [f"property uchar {named[c]}" for c in colours]
    polygons = []
    if faces is not None:
        corners = F.col("corners") if "corners" in faces.columns else F.array("v0", "v1", "v2")
        polygons = [list(r[0]) for r in faces.orderBy("fid").select(corners).toLocalIterator()]
        if any(len(p) not in (3, 4) for p in polygons):
            raise ValueError("faces must have three or four corners")
        head += [f"element face {len(polygons)}", "property list uchar int vertex_indices"]
    head.append("end_header")
    k = len(parts)
    byte = lambda v: max(0, min(255, round(v * 255)))
    if ascii:
        body = [" ".join([*(repr(float(v)) for v in r[:k]), *(str(byte(v)) for v in r[k:])]) for r in rows]
        body += [" ".join(map(str, [len(p), *p])) for p in polygons]
        return ("\n".join(head + body) + "\n").encode()
    form = struct.Struct(f"<{k}f{len(colours)}B")
    packed = b"".join(form.pack(*r[:k], *map(byte, r[k:])) for r in rows)
    return ("\n".join(head) + "\n").encode() + packed + b"".join(struct.pack(f"<B{len(p)}i", len(p), *p) for p in polygons)


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """By extension: obj and pc text, ply, or a Parquet table."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("obj", "pc"):
        return read_obj_cloud(spark, path)
    return read_ply_cloud(spark, path) if kind == "ply" else spark.read.parquet(path)


def read_stl_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a binary STL file, equal corners merged."""

    def work(batches):
        kind = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])
        for b in batches:
            for data in b.column(0).to_pylist():
                t = np.frombuffer(data, kind, int.from_bytes(data[80:84], "little"), 84)["v"].astype("f8")
                flat = t.reshape(-1, 3)
                at = np.arange(len(flat))
                yield pa.RecordBatch.from_arrays([pa.array(at // 3), pa.array((at % 3).astype("i4")), *(pa.array(flat[:, i]) for i in range(3))], names=["fid", "k", "x", "y", "z"])

    corners = spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "fid bigint, k int, x double, y double, z double")
    vertices = corners.groupBy("x", "y", "z").agg(F.min(F.col("fid") * 3 + F.col("k")).alias("_first"))
    vertices = vertices.withColumn("vid", F.row_number().over(Window.orderBy("_first")).cast("long") - 1).drop("_first")
    faces = corners.join(vertices, ["x", "y", "z"]).groupBy("fid").agg(*[F.max(F.when(F.col("k") == i, F.col("vid"))).alias(f"v{i}") for i in range(3)])
    return vertices.select("vid", "x", "y", "z"), faces


def write_tori(tori: DataFrame, path: str) -> None:
    tori.select("pid", "cx", "cy", "cz", "theta", "phi", "major_r", "minor_r").write.mode("overwrite").parquet(path)


def read_tori(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_shape(text: str, name: str) -> tuple[str, dict]:
    """(kind, parameters) of a plane shape's description: the kind is the part of the file's name before the first dot or underscore,
    each line a parameter and its numbers."""
    kind = name.rsplit("/", 1)[-1].replace(".", "_").split("_")[0].lower()
    out = {}
    for line in text.splitlines():
        w = line.split()
        if w:
            values = tuple(map(float, w[1:]))
            out[w[0]] = values[0] if len(values) == 1 else values
    return kind, out


def write_model(spark: SparkSession, weights: dict, path: str) -> None:
    """A predictor's weights as a Parquet table (name, shape, data), one row an array; their size is the model's."""
    rows = [(name, list(a.shape), a.astype(float).reshape(-1).tolist()) for name, a in predictor.named(weights).items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> dict:
    """Weights that ``write_model`` wrote, or a table of the same form. An error names what is missing, superfluous or of another shape."""
    rows = spark.read.parquet(path).select("name", "shape", "data").collect()
    return predictor.assembled({r.name: np.array(r.data, float).reshape(r.shape) for r in rows})
