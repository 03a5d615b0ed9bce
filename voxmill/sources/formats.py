"""Volume formats. Files are read by Spark's own readers and parsed on the executors."""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.sources import chunked
from voxmill.sources.chunked import voxel_rows
from voxmill.sources.registry import infer_format, is_writable_format, reader_for_format, register_format, writer_for_format
from voxmill.volume import Volume, as_volume, axis_names, block_id, derive_block_shape, from_numpy, register_source, select_blocks, spark_type


def open_volume(spark: SparkSession, path: str, key: str | None = None, format: str | None = None, mode: str = "r", **options) -> Volume:  # noqa: A002
    """Open a path by its extension or a format's name. ``mode`` other than 'r' needs a writable format."""
    name = format or infer_format(path)
    if mode != "r" and not is_writable_format(name):
        raise ValueError(f"format {name!r} is read-only")
    return reader_for_format(name)(spark, path, key, **options)


# -- Parquet, the native store ----------------------------------------------------------------


def save_volume(vol: Volume, path: str, block_shape=None, mode: str = "error") -> None:
    """Voxel rows as Parquet, partitioned by block and clustered by a range of blocks, with a metadata file.

    Reading some blocks prunes partitions. Spark commits whole files.
    """
    block = derive_block_shape(vol.shape, block_shape or vol.block_shape)
    rows = vol.df.select(*vol.axes, "v", block_id(vol, block).alias("block"))
    rows.repartitionByRange("block").write.mode(mode).partitionBy("block").parquet(path + "/voxels")
    meta = json.dumps({"shape": vol.shape, "dtype": vol.dtype, "block_shape": block, "fill": vol.fill, "complete": vol.complete})
    vol.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode(mode).text(path + "/meta")


def _read_parquet(spark, path, key=None, block_ids=None, **_):
    meta = json.loads(spark.read.text(path + "/meta").first()["value"])
    df = spark.read.parquet(path + "/voxels")
    vol = Volume(df.drop("block"), tuple(meta["shape"]), meta["dtype"], tuple(meta["block_shape"]), meta["fill"], meta.get("complete", False))
    if block_ids is None:
        return vol
    if not vol.complete:
        return select_blocks(vol, block_ids)
    return replace(vol, df=df.where(F.col("block").isin([int(b) for b in block_ids])).drop("block"))


# -- arrays in single files ---------------------------------------------------------------------


def parse_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


#: MRC mode -> dtype, fixed by the format.
_MRC = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}


def parse_mrc(data: bytes) -> np.ndarray:
    """MRC2014: a 1024-byte header, an extended one, then values; the y axis is flipped."""
    order = ">" if data[212:214] == b"\x11\x11" else "<"
    nx, ny, nz, mode = struct.unpack(order + "4i", data[:16])
    if mode not in _MRC:
        raise ValueError(f"MRC mode {mode} is not supported")
    skip = 1024 + struct.unpack(order + "i", data[92:96])[0]
    a = np.frombuffer(data, order + _MRC[mode], nx * ny * nz, skip).reshape(nz, ny, nx)
    a = a[:, ::-1] if nz > 1 else a[0, ::-1]
    return a.astype(a.dtype.newbyteorder("="))


#: NIfTI-1 data type code -> dtype, fixed by the format.
_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def parse_nifti(data: bytes) -> np.ndarray:
    """NIfTI-1, gzipped or not; axes in reverse order; a slope or intercept makes it float."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", data[40:56])
    code = struct.unpack(order + "h", data[70:72])[0]
    offset, slope, inter = struct.unpack(order + "3f", data[108:120])
    if code not in _NIFTI:
        raise ValueError(f"NIfTI type {code} is not supported")
    shape = dim[1 : 1 + dim[0]][::-1]
    a = np.frombuffer(data, order + _NIFTI[code], int(np.prod(shape)), int(offset) or 352).reshape(shape)
    a = a.astype(a.dtype.newbyteorder("="))
    return a * np.float64(slope) + inter if slope not in (0.0, 1.0) or (slope and inter) else a


def parse_tiff(data: bytes) -> np.ndarray:
    """Uncompressed grey TIFF in strips; several pages stack along a first axis."""
    order = "<" if data[:2] == b"II" else ">"
    if struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at, pages = struct.unpack(order + "I", data[4:8])[0], []
    size = {1: "B", 3: "H", 4: "I", 16: "Q"}
    while at:
        tags = {}
        for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            e = at + 2 + 12 * i
            tag, kind, n = struct.unpack(order + "HHI", data[e : e + 8])
            if kind not in size:
                continue
            code = f"{order}{n}{size[kind]}"
            w = struct.calcsize(code)
            where = e + 8 if w <= 4 else struct.unpack(order + "I", data[e + 8 : e + 12])[0]
            tags[tag] = struct.unpack(code, data[where : where + w])
        if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
            raise ValueError("only uncompressed single-channel TIFF is supported")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(tags.get(258, (8,))[0] // 8)
        raw = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279]))
        pages.append(np.frombuffer(raw, order + kind).reshape(tags[257][0], tags[256][0]))
        e = at + 2 + 12 * struct.unpack(order + "H", data[at : at + 2])[0]
        at = struct.unpack(order + "I", data[e : e + 4])[0]
    a = np.stack(pages) if len(pages) > 1 else pages[0]
    return a.astype(a.dtype.newbyteorder("="))


def _probe(files: DataFrame, parse) -> tuple[tuple[int, ...], str]:
    """Shape and dtype of the first file, found on an executor."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                a = parse(data)
                yield pd.DataFrame({"shape": [",".join(map(str, a.shape))], "dtype": [a.dtype.name]})

    row = files.orderBy("path").limit(1).select("content").mapInPandas(run, "shape string, dtype string").first()
    if row is None:
        raise ValueError("no file was found")
    return tuple(int(n) for n in row["shape"].split(",")), row["dtype"]


def _single(parse, default_key=None):
    def read(spark, path, key=None, block_shape=None, **_):
        if key not in (None, default_key):
            raise ValueError(f"{path!r} has no dataset {key!r}")
        files = spark.read.format("binaryFile").load(path)
        shape, dtype = _probe(files, parse)

        def run(batches):
            for pdf in batches:
                for data in pdf["content"]:
                    a = parse(data)
                    step = max(1, 1_000_000 // max(1, int(np.prod(a.shape[1:]))))
                    for i in range(0, a.shape[0], step):
                        yield voxel_rows(a[i : i + step], [i] + [0] * (a.ndim - 1))

        schema = ", ".join(f"{x} bigint" for x in axis_names(len(shape))) + f", v {spark_type(dtype)}"
        return Volume(files.select("content").mapInPandas(run, schema), shape, dtype, tuple(block_shape) if block_shape else None, complete=True)

    return read


def _read_stack(spark, path, key=None, parse=parse_tiff, **_):
    """Images of a folder that match the glob ``key``, stacked by name along a first axis; a task per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", key or "*.tif*").load(path)
    names = sorted(r["path"] for r in files.select("path").collect())
    plane, dtype = _probe(files, parse)
    number = {n: i for i, n in enumerate(names)}

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                a = parse(data)
                if a.shape != plane:
                    raise ValueError(f"{name}: shape {a.shape} is not {plane}")
                yield voxel_rows(a[None], [number[name]] + [0] * a.ndim)

    shape = (len(names), *plane)
    schema = ", ".join(f"{x} bigint" for x in axis_names(len(shape))) + f", v {spark_type(dtype)}"
    return Volume(files.select("path", "content").mapInPandas(run, schema), shape, dtype, complete=True)


def _read_knossos(spark, path, key=None, cube: int = 128, **_):
    """Raw (or Spark-readable image) cubes in x####/y####/z#### folders, 8 bits a voxel, side ``cube``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = r"x(\d+)/y(\d+)/z(\d+)"
    ids = [[int(v) for v in re.search(at, r["path"]).groups()] for r in files.select("path").where(F.rlike("path", F.lit(at))).collect()]
    if not ids:
        raise ValueError(f"{path!r} holds no cubes")
    shape = tuple((max(i[k] for i in ids) + 1) * cube for k in (2, 1, 0))

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                x, y, z = (int(v) for v in re.search(at, name).groups())
                yield voxel_rows(np.frombuffer(data, np.uint8).reshape((cube,) * 3), [z * cube, y * cube, x * cube])

    return Volume(files.where(F.rlike("path", F.lit(at))).select("path", "content").mapInPandas(run, "z bigint, y bigint, x bigint, v smallint"), shape, "uint8", (cube,) * 3)


def _folder(spark, path, key=None, **how):
    """A folder without a suffix: cubes if it has their layout, else a stack of images."""
    try:
        return _read_knossos(spark, path, key, **how)
    except ValueError:
        return _read_stack(spark, path, key, **how)


def _optional(module: str, opener, chunked_by: bool = True):
    """A reader through a package: tasks read regions, or the driver reads the whole if the format has none."""

    def read(spark, path, key=None, block_shape=None, **options):
        chunked.needs(module)
        if chunked_by:
            return chunked.read_regions(spark, lambda: opener(path, key, **options), block_shape)
        return as_volume(opener(path, key, **options), spark)

    return read


def _msr(path, key, **_):
    """A stack by its number or name (the first by default), or all stacks of one shape along a first axis for the key '*'."""
    from msr_reader import OBFFile

    with OBFFile(path) as f:
        names = [str(n) for n in getattr(f, "stack_names", range(len(f.shapes)))]
        if key == "*":
            return np.stack([f.read_stack(i) for i in range(len(names))])
        return f.read_stack(names.index(str(key)) if str(key) in names else int(key or 0))


def _writer(module: str, write):
    def run(vol, path, key=None, **options):
        chunked.needs(module)
        write(vol, path, key, **options)

    return run


def write_volume(vol: Volume, path: str, key: str | None = None, format: str | None = None, **options) -> None:  # noqa: A002
    """Write to a path by its extension or a format's name: Parquet, Zarr and N5 task by task, HDF5 by one writer."""
    writer_for_format(format or infer_format(path))(vol, path, key, **options)


def _write_parquet(vol, path, key=None, block_shape=None, mode: str = "error"):
    save_volume(vol, path, block_shape, mode)


register_format("parquet", [".parquet", ".vox"], _read_parquet, writer=_write_parquet)
register_format("npy", [".npy"], _single(parse_npy))
register_format("mrc", [".mrc", ".rec"], _single(parse_mrc, "data"))
register_format("nifti", [".nii", ".nii.gz"], _single(parse_nifti, "data"))
register_format("tiff", [".tif", ".tiff"], _single(parse_tiff, ""))
register_format("stack", [], _read_stack)
register_format("knossos", [], _read_knossos)
register_format("folder", [""], _folder)
register_format("hdf5", [".h5", ".hdf", ".hdf5"], _optional("h5py", chunked.open_hdf5), writer=_writer("h5py", chunked.write_hdf5))
register_format("zarr", [".zarr", ".zr"], _optional("zarr", chunked.open_zarr), writer=_writer("zarr", chunked.write_zarr))
register_format("n5", [".n5"], _optional("z5py", chunked.open_n5), writer=_writer("z5py", chunked.write_n5))
register_format("msr", [".msr"], _optional("msr_reader", _msr, chunked_by=False))
register_format("cloudvolume", [], _optional("cloudvolume", lambda path, key, **how: chunked.open_cloudvolume(path, **how)))
register_format("webknossos", [], _optional("webknossos", chunked.open_webknossos))


def _is_module(obj, module: str) -> bool:
    return type(obj).__module__.split(".")[0] == module


def _reopened(spark, o):
    """An open dataset: tasks open its file again."""
    path, key = o.file.filename, o.name
    return chunked.read_regions(spark, lambda: chunked.open_hdf5(path, key))


register_source(lambda o: _is_module(o, "h5py") and hasattr(o, "shape"), _reopened)
register_source(lambda o: _is_module(o, "cloudvolume"), lambda spark, o: from_numpy(spark, np.asarray(o[:, :, :])[..., 0].T))


# -- tables ---------------------------------------------------------------------------------


#: Rows of a sheet below its header.
SHEET_ROWS = 1_048_575


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A .csv by Spark, or an .xlsx or .xls sheet by pandas on the driver (a sheet has a million rows at most)."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith((".xlsx", ".xls")):
        return spark.createDataFrame(pd.read_excel(path))
    raise ValueError(f"{path!r} is no table; use .csv or .xlsx")


def write_table(df: DataFrame, path: str) -> None:
    if path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
    elif path.endswith((".xlsx", ".xls")):
        # a row more than fits tells that it would not; the driver never holds more
        rows = df.limit(SHEET_ROWS + 1).toPandas()
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"a sheet holds {SHEET_ROWS} rows and the table has more; use .csv")
        rows.to_excel(path, index=False)
    else:
        raise ValueError(f"{path!r} is no table; use .csv or .xlsx")


# -- chunks and regions ---------------------------------------------------------------------


def chunks_overlapping(roi, chunks, shape) -> list[tuple[int, ...]]:
    """Grid positions of the chunks that a box of slices meets, in C order."""
    spans = [range(s.start // c, -(-min(s.stop, n) // c)) for s, c, n in zip(roi, chunks, shape)]
    grid = np.stack(np.meshgrid(*spans, indexing="ij"), -1).reshape(-1, len(spans))
    return [tuple(int(i) for i in p) for p in grid]


def chunk_to_roi(position, roi, chunks):
    """(part of the chunk, part of the box) that overlap."""
    inner, outer = [], []
    for p, s, c in zip(position, roi, chunks):
        low, high = max(p * c, s.start), min((p + 1) * c, s.stop)
        inner.append(slice(low - p * c, high - p * c))
        outer.append(slice(low - s.start, high - s.start))
    return tuple(inner), tuple(outer)
