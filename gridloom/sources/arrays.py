"""Arrays from the driver and from files, and their storage.

Stored arrays are Parquet folders of coordinates and values with a JSON side
file for the metadata; tiles are partition folders, so that a partial read
prunes to the tiles asked for. Text and binary formats are read by Spark's own
readers, from whatever store the path names.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..array import SPARK_TYPES, GridArray, as_array, coords, dtype_name, session, unravelled
from ..session import shared_dir


def from_numpy(x: np.ndarray, spark: SparkSession | None = None, tile_hint=None) -> GridArray:
    """An array of the driver's, sent out in Arrow batches."""
    spark, x = spark or session(), np.asarray(x)
    dtype = dtype_name(x.dtype)
    flat = np.ascontiguousarray(x).ravel().astype(dtype)
    if not flat.size:
        df = spark.createDataFrame([], ", ".join([*(f"{c} long" for c in coords(x.ndim)), f"v {SPARK_TYPES[dtype]}"]))
        return GridArray(df, x.shape, dtype)
    table = pa.table({"p": pa.array(np.arange(flat.size)), "v": pa.array(flat)})
    df = spark.createDataFrame(table)
    return GridArray(df.select(*unravelled(F.col("p"), x.shape), "v"), x.shape, dtype)


def from_coo(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int], spark: SparkSession | None = None) -> GridArray:
    """A sparse matrix of the driver's; values of equal coordinates add up."""
    spark, dtype = spark or session(), dtype_name(np.asarray(values).dtype)
    table = pa.table({"i0": pa.array(np.asarray(rows, np.int64)), "i1": pa.array(np.asarray(columns, np.int64)), "v": pa.array(np.asarray(values, dtype))})
    df = spark.createDataFrame(table).groupBy("i0", "i1").agg(F.sum("v").cast(SPARK_TYPES[dtype]).alias("v"))
    return GridArray(df, shape, dtype, "v", True)


def _bytes(spark: SparkSession, path: str) -> bytes:
    return spark.read.format("binaryFile").load(path).select("content").first().content


def from_file(path: str, file_type: str = "numpy", sparse: bool = True, spark: SparkSession | None = None, tile_hint=None) -> GridArray:
    """`numpy`: an .npy file, the first member of an .npz file, or with sparse the four files path_row, _col, _data, _shape.npy; `mm`: a Matrix Market file. The NumPy formats pass through the driver."""
    spark = spark or session()
    if file_type == "mm":
        return from_file_parallel(path, "mm", sparse, spark)
    if path.endswith((".npy", ".npz")):
        found = np.load(io.BytesIO(_bytes(spark, path)))
        return from_numpy(found if isinstance(found, np.ndarray) else found[found.files[0]], spark)
    part = {k: np.load(io.BytesIO(_bytes(spark, f"{path}_{k}.npy"))) for k in ("row", "col", "data", "shape")}
    out = from_coo(part["row"], part["col"], part["data"], tuple(int(s) for s in part["shape"]), spark)
    return out if sparse else out.dense()


def from_file_parallel(path: str, file_format: str = "mm", sparse: bool = True, spark: SparkSession | None = None, tile_hint=None) -> GridArray:
    """`mm`: a coordinate Matrix Market text, read and parsed in splits, its repeated entries added up; `numpy`: the four sparse files, parsed in the executors."""
    spark = spark or session()
    if file_format == "numpy":
        return _npy_parallel(path, spark, sparse)
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    head = lines.limit(1).first()
    kinds = (head.line.lower().split() if head and head.line.startswith("%%") else [])[2:]
    kind, symmetry = (kinds + ["coordinate", "real", "general"])[1:3] if kinds else ("real", "general")
    lines = lines.where((F.length("line") > 0) & ~F.startswith("line", F.lit("%")))
    size_line = lines.limit(1).first().line
    size = size_line.split()
    n, m = int(size[0]), int(size[1])
    # the size line is left out by its text; entries that are written like it count, all but that one
    alike = 0 if kind == "pattern" else lines.where(F.col("line") == size_line).count() - 1
    own = lines.where(F.col("line") != size_line).select(F.split("line", r"\s+").alias("p"))
    value = F.lit(1.0) if kind == "pattern" else F.element_at("p", 3).cast("double")
    cells = own.select((F.element_at("p", 1).cast("long") - 1).alias("i0"), (F.element_at("p", 2).cast("long") - 1).alias("i1"), value.alias("v"))
    if alike:
        cells = cells.unionByName(spark.createDataFrame([(n - 1, m - 1, float(size[2]) * alike)], "i0 long, i1 long, v double"))
    cells = cells.groupBy("i0", "i1").agg(F.sum("v").alias("v"))
    if symmetry in ("symmetric", "skew-symmetric"):
        mirror = cells.where("i0 <> i1").select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), (F.col("v") * (-1 if symmetry.startswith("skew") else 1)).alias("v"))
        cells = cells.unionByName(mirror)
    dtype = "int64" if kind == "integer" else "float64"
    out = GridArray(cells.withColumn("v", F.col("v").cast(SPARK_TYPES[dtype])), (n, m), dtype, "v", True)
    return out if sparse else out.dense()


def _npy_parallel(path: str, spark: SparkSession, sparse: bool) -> GridArray:
    """Row, column and value files are parsed where they are read and meet by entry number."""

    def entries(name: str, kind: str) -> DataFrame:
        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content").to_pylist():
                    x = np.load(io.BytesIO(content))
                    for lo in range(0, len(x), 1 << 16):
                        part = x[lo : lo + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.array(part.astype(np.float64 if kind == "double" else np.int64))], names=["p", name])

        return spark.read.format("binaryFile").load(f"{path}_{name}.npy").select("content").mapInArrow(parse, f"p long, {name} {kind}")

    shape = tuple(int(s) for s in np.load(io.BytesIO(_bytes(spark, f"{path}_shape.npy"))))
    df = entries("row", "long").join(entries("col", "long"), "p").join(entries("data", "double"), "p")
    df = df.groupBy(F.col("row").alias("i0"), F.col("col").alias("i1")).agg(F.sum("data").alias("v"))
    out = GridArray(df, shape, "float64", "v", True)
    return out if sparse else out.dense()


def _paths(prefix: str, path: str) -> tuple[str, str]:
    base = f"{path.rstrip('/')}/{prefix}"
    return f"{base}/cells", f"{base}/about"


def save(x: GridArray, prefix: str, path: str = ".", iszip: bool = False, tile: tuple[int, ...] | None = None) -> bool:
    """Write an array; with a tile shape in a folder for each tile of the leading axes."""
    x = as_array(x)
    cells, about = _paths(prefix, path)
    df, parts = x.frame(), []
    for k, t in enumerate(tile or ()):
        df = df.withColumn(f"t{k}", F.call_function("div", f"i{k}", F.lit(t).cast("long")))
        parts.append(f"t{k}")
    df.write.mode("overwrite").option("compression", "zstd" if iszip else "snappy").partitionBy(*parts).parquet(cells)
    meta = json.dumps({"shape": x.shape, "dtype": x.dtype, "sparse": x.sparse, "tile": tile})
    x.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(about)
    return True


def _about(spark: SparkSession, about: str) -> dict:
    return json.loads(spark.read.text(about).first().value)


def load(prefix: str, path: str = ".", iszip: bool = False, spark: SparkSession | None = None) -> GridArray:
    spark = spark or session()
    cells, about = _paths(prefix, path)
    meta = _about(spark, about)
    shape = tuple(meta["shape"])
    return GridArray(spark.read.parquet(cells).select(*coords(len(shape)), "v"), shape, meta["dtype"], "v", meta["sparse"])


def partial_load(extents: list[tuple[tuple[int, int], ...]], prefix: str, path: str = ".", iszip: bool = False, spark: SparkSession | None = None) -> GridArray:
    """Only the elements in some boxes, [low, high) for each axis, at their places; tiles that meet none aren't read."""
    spark = spark or session()
    cells, about = _paths(prefix, path)
    meta = _about(spark, about)
    shape, tile = tuple(meta["shape"]), meta["tile"] or []
    inside, near = F.lit(False), F.lit(False)
    for box in extents:
        a, b = F.lit(True), F.lit(True)
        for k, (low, high) in enumerate(box):
            a = a & (F.col(f"i{k}") >= low) & (F.col(f"i{k}") < high)
            if k < len(tile):
                b = b & (F.col(f"t{k}") >= low // tile[k]) & (F.col(f"t{k}") <= (high - 1) // tile[k])
        inside, near = inside | a, near | b
    df = spark.read.parquet(cells)
    df = df.where(near) if tile else df
    return GridArray(df.where(inside).select(*coords(len(shape)), "v"), shape, meta["dtype"], "v", True)


pickle, unpickle, partial_unpickle = save, load, partial_load


def checkpoint(x: GridArray, mode: str = "disk") -> GridArray:
    """The array as written to the shared checkpoint folder: it survives lost executors, and its lineage ends there."""
    if mode not in ("disk", "replica"):
        raise ValueError("checkpoints are of mode disk or replica")
    x = as_array(x)
    if mode == "replica":
        from pyspark import StorageLevel

        return GridArray(x.frame().persist(StorageLevel.MEMORY_AND_DISK_2), x.shape, x.dtype, "v", x.sparse)
    sc = x.spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(x.spark))
    return GridArray(x.frame().checkpoint(), x.shape, x.dtype, "v", x.sparse)
