"""Chunked stores: each task opens the store itself and reads or writes some of its blocks.

The driver only sees shapes, types and chunks. An opener gives an object with ``shape``,
``dtype``, ``chunks`` (or None) and slicing, on the driver and on the executors alike, so paths
have to be ones that all of them reach.
"""

from __future__ import annotations

import importlib.util
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voxmill.volume import Volume, axis_names, block_grid, block_id, derive_block_shape, spark_type

#: Voxels that a task reads, about.
TASK_VOXELS = 8_000_000


def voxel_rows(a: np.ndarray, offset: Sequence[int]) -> pd.DataFrame:
    kind = {"smallint": "int16", "int": "int32", "bigint": "int64", "tinyint": "int8"}.get(spark_type(a.dtype), a.dtype)
    return pd.DataFrame({x: (c + o).ravel() for x, c, o in zip(axis_names(a.ndim), np.indices(a.shape, dtype=np.int64), offset)} | {"v": a.ravel().astype(kind)})


def regions(number: int, shape: Sequence[int], block: Sequence[int]) -> tuple[slice, ...]:
    """The box of a block by its number."""
    at = np.unravel_index(number, block_grid(shape, block))
    return tuple(slice(int(i) * b, min((int(i) + 1) * b, n)) for i, b, n in zip(at, block, shape))


def _pieces(box: tuple[slice, ...], most: int = 1_000_000):
    """Boxes along the first axis that hold about ``most`` voxels each."""
    step = max(1, most // max(1, math.prod(s.stop - s.start for s in box[1:])))
    for i in range(box[0].start, box[0].stop, step):
        yield (slice(i, min(i + step, box[0].stop)), *box[1:])


def needs(module: str) -> None:
    if importlib.util.find_spec(module) is None:
        raise ImportError(f"this format needs the package {module}")


def read_regions(spark: SparkSession, opener: Callable, block_shape=None) -> Volume:
    """The array of ``opener()`` as a volume; tasks read whole blocks, which follow its chunks."""
    source = opener()
    shape, dtype = tuple(int(n) for n in source.shape), np.dtype(source.dtype).name
    chunks = getattr(source, "chunks", None)
    block = derive_block_shape(shape, block_shape, tuple(chunks) if chunks else None)
    n = math.prod(block_grid(shape, block))
    tasks = max(1, min(n, -(-math.prod(shape) // TASK_VOXELS)))

    def run(batches):
        held = None
        for pdf in batches:
            for number in pdf["id"]:
                held = opener() if held is None else held
                for box in _pieces(regions(int(number), shape, block)):
                    yield voxel_rows(np.asarray(held[box]), [s.start for s in box])

    schema = ", ".join(f"{a} bigint" for a in axis_names(len(shape))) + f", v {spark_type(dtype)}"
    return Volume(spark.range(0, n, 1, tasks).mapInPandas(run, schema), shape, dtype, block, complete=True)


def write_regions(vol: Volume, opener: Callable, block: Sequence[int]) -> int:
    """Write a volume to the array of ``opener()``, block by block, and return the number of blocks.

    ``block`` is a multiple of the store's chunks, so no two tasks touch a chunk, and a task that
    runs again writes the same. Blocks without any row are left as the store was made.
    """
    axes, shape, fill, dtype = vol.axes, vol.shape, vol.fill, vol.dtype

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        box = regions(int(key[0]), shape, block)
        arr = np.full([s.stop - s.start for s in box], fill, dtype)
        arr[tuple(pdf[a].to_numpy(np.int64) - s.start for a, s in zip(axes, box))] = pdf["v"].to_numpy()
        opener()[box] = arr
        return pd.DataFrame({"n": [len(pdf)]})

    done = vol.df.withColumn("_block", block_id(vol, block)).groupBy("_block").applyInPandas(run, "n bigint")
    return done.agg(F.count("n")).first()[0]


class Zyx:
    """A Z, Y, X view of a store that slices in X, Y, Z: ``take`` gets three (start, stop) pairs from the view's corner."""

    def __init__(self, size: Sequence[int], dtype, take: Callable, chunks=None):
        self.shape, self.dtype = tuple(int(n) for n in reversed(size)), np.dtype(dtype)
        self.chunks = tuple(int(c) for c in reversed(chunks)) if chunks is not None else None
        self._take = take

    def __getitem__(self, box):
        return self._take(*[(s.start, s.stop) for s in reversed(box)])


def open_hdf5(path: str, key: str):
    import h5py

    if not key:
        raise ValueError("a container needs a dataset key")
    return h5py.File(path, "r")[key]


def open_zarr(path: str, key: str | None, mode: str = "r"):
    import zarr

    return zarr.open(f"{path.rstrip('/')}/{key.strip('/')}" if key else path, mode=mode)


def open_n5(path: str, key: str, mode: str = "r"):
    import z5py

    if not key:
        raise ValueError("a container needs a dataset key")
    return z5py.File(path, mode)[key]


def open_cloudvolume(path: str, mip: int = 0, fill_missing: bool = False, bounded: bool = True, offset=None, size=None, **how) -> Zyx:
    """One channel of a layer; ``offset`` and ``size`` are X, Y, Z at this mip, the whole layer by default."""
    from cloudvolume import CloudVolume

    cv = CloudVolume(path, mip=mip, fill_missing=fill_missing, bounded=bounded, progress=False, **how)
    if int(cv.shape[3]) != 1:
        raise ValueError("only one channel is supported")
    low = [int(v) for v in (cv.voxel_offset if offset is None else offset)]

    def take(*spans):
        box = tuple(slice(o + a, o + b) for o, (a, b) in zip(low, spans))
        return np.asarray(cv[box])[..., 0].T

    return Zyx(cv.volume_size if size is None else size, cv.dtype, take, cv.chunk_size)


def open_webknossos(path: str, key: str, organization_id=None, mag: int = 1, offset=None, size=None) -> Zyx:
    """A layer at a magnification; ``offset`` and ``size`` are X, Y, Z at magnification 1, the layer's box by default."""
    import webknossos as wk

    layer = wk.Dataset.open_remote(path, organization_id).get_layer(key)
    low, full = (layer.bounding_box.topleft, layer.bounding_box.size) if offset is None and size is None else (offset or layer.bounding_box.topleft, size or layer.bounding_box.size)
    low, view = [int(v) for v in low], layer.get_mag(mag)

    def take(*spans):
        box = {"absolute_offset": tuple(o + a * mag for o, (a, _) in zip(low, spans)), "size": tuple((b - a) * mag for a, b in spans)}
        return np.asarray(view.read(**box))[0].T

    return Zyx([int(n) // mag for n in full], layer.dtype_per_channel if hasattr(layer, "dtype_per_channel") else layer.dtype, take)


# -- writers --------------------------------------------------------------------------------


def _blocks_of(vol: Volume, chunks: Sequence[int], block_shape) -> tuple[int, ...]:
    """Blocks to write at a time: the given ones, which chunks must divide, or the chunks themselves."""
    block = tuple(block_shape or chunks)
    if any(b % c and b < n for b, c, n in zip(block, chunks, vol.shape)):
        raise ValueError(f"blocks of {block} do not hold whole chunks of {tuple(chunks)}")
    return block


def write_zarr(vol: Volume, path: str, key: str | None = None, chunks=None, block_shape=None, shards=None, **how) -> None:
    """A new array of the volume's shape. With ``shards`` tasks write whole shards."""
    import zarr

    chunks = derive_block_shape(vol.shape, chunks or vol.block_shape)
    if key:
        zarr.open_group(path, mode="a")
    extra = {"shards": tuple(shards)} if shards else {}
    store = f"{path.rstrip('/')}/{key.strip('/')}" if key else path
    zarr.open_array(store, mode="w", shape=vol.shape, chunks=chunks, dtype=vol.dtype, fill_value=vol.fill, **extra, **how)
    write_regions(vol, lambda: open_zarr(path, key, "r+"), _blocks_of(vol, shards or chunks, block_shape))


def write_n5(vol: Volume, path: str, key: str | None = None, chunks=None, block_shape=None, **how) -> None:
    """A new dataset of the volume's shape. Such a store holds zeros where nothing is written."""
    import z5py

    if not key:
        raise ValueError("a container needs a dataset key")
    chunks = derive_block_shape(vol.shape, chunks or vol.block_shape)
    z5py.File(path, "a").create_dataset(key, shape=vol.shape, chunks=chunks, dtype=vol.dtype, **how)
    write_regions(vol.objects(), lambda: open_n5(path, key, "a"), _blocks_of(vol, chunks, block_shape))


def write_hdf5(vol: Volume, path: str, key: str | None = None, chunks=None, block_shape=None, **how) -> None:
    """A new dataset of the volume's shape. One file has one writer: the driver takes a block at a time."""
    import h5py

    if not key:
        raise ValueError("a container needs a dataset key")
    chunks = derive_block_shape(vol.shape, chunks or vol.block_shape)
    block, axes, shape, fill, dtype = _blocks_of(vol, chunks, block_shape), vol.axes, vol.shape, vol.fill, vol.dtype

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        box = regions(int(k[0]), shape, block)
        arr = np.full([s.stop - s.start for s in box], fill, dtype)
        arr[tuple(pdf[a].to_numpy(np.int64) - s.start for a, s in zip(axes, box))] = pdf["v"].to_numpy()
        return pd.DataFrame({"number": [int(k[0])], "data": [arr.tobytes()]})

    parts = vol.df.withColumn("_block", block_id(vol, block)).groupBy("_block").applyInPandas(run, "number bigint, data binary")
    with h5py.File(path, "a") as f:
        out = f.create_dataset(key, shape=shape, chunks=chunks, dtype=dtype, fillvalue=fill, **how)
        for r in parts.toLocalIterator():
            box = regions(r["number"], shape, block)
            out[box] = np.frombuffer(r["data"], dtype).reshape([s.stop - s.start for s in box])
