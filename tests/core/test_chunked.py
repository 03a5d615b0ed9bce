"""Chunked stores through stand-ins for their packages: what is read and written where."""

import json
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill import sources
from voxmill.operators import components
from voxmill.sources import chunked
from voxmill.volume import as_volume, from_numpy

#: An array on disk that notes each box that is read or written.
STORE = """
import builtins, io, json, os
import numpy as np


def note(path, what, box):
    with io.open(path + "/log", "a") as f:
        f.write(json.dumps([what, [[s.start, s.stop] for s in box]]) + chr(10))


class Array:
    def __init__(self, path):
        with io.open(path + "/meta.json") as f:
            meta = json.load(f)
        self.path, self.shape, self.chunks, self.dtype = path, tuple(meta["shape"]), tuple(meta["chunks"]), np.dtype(meta["dtype"])
        self.name = os.path.basename(path)

    def __getitem__(self, box):
        note(self.path, "read", box)
        return np.array(np.load(self.path + "/data.npy", mmap_mode="r")[box])

    def __setitem__(self, box, value):
        note(self.path, "write", box)
        np.lib.format.open_memmap(self.path + "/data.npy", mode="r+")[box] = value


def make(path, shape, chunks, dtype, fill=0):
    os.makedirs(path, exist_ok=True)
    with io.open(path + "/meta.json", "w") as f:
        json.dump({"shape": list(shape), "chunks": list(chunks), "dtype": str(np.dtype(dtype))}, f)
    np.save(path + "/data.npy", np.full(shape, fill, dtype))
    return Array(path)
"""
MODULES = {
    "voxstore": STORE,
    "zarr": """
        import os, voxstore
        open = lambda path, mode="r": voxstore.Array(path)
        open_group = lambda path, mode: os.makedirs(path, exist_ok=True)
        open_array = lambda path, mode, shape, chunks, dtype, fill_value, **_: voxstore.make(path, shape, chunks, dtype, fill_value)
    """,
    "z5py": """
        import voxstore
        class File:
            def __init__(self, path, mode): self.path = path
            def __getitem__(self, key): return voxstore.Array(self.path + "/" + key)
            def create_dataset(self, key, shape, chunks, dtype): return voxstore.make(self.path + "/" + key, shape, chunks, dtype)
    """,
    "h5py": """
        import voxstore
        class File:
            def __init__(self, path, mode): self.path = self.filename = path
            def __enter__(self): return self
            def __exit__(self, *_): pass
            def __getitem__(self, key):
                out = Dataset(self.path + "/" + key.strip("/"))
                out.file = self
                return out
            def create_dataset(self, key, shape, chunks, dtype, fillvalue): return voxstore.make(self.path + "/" + key, shape, chunks, dtype, fillvalue)
        class Dataset(voxstore.Array):
            pass
    """,
    "cloudvolume": """
        import numpy as np, voxstore
        class CloudVolume:
            def __init__(self, path, mip, fill_missing, bounded, progress):
                self.array = voxstore.Array(path)  # x, y, z, c with an origin of (100, 0, 7)
                self.shape, self.dtype, self.voxel_offset, self.volume_size, self.chunk_size = self.array.shape, "uint8", (100, 0, 7), self.array.shape[:3], (4, 4, 4)
            def __getitem__(self, box):
                return self.array[tuple(slice(s.start - o, s.stop - o) for s, o in zip(box, self.voxel_offset)) + (slice(0, 1),)]
    """,
    "webknossos": """
        import types, voxstore
        class View:
            def __init__(self, path): self.array = voxstore.Array(path)
            def read(self, absolute_offset, size):
                box = [slice(o // 2 - b, o // 2 - b + s // 2) for o, s, b in zip(absolute_offset, size, (5, 0, 0))]
                return self.array[tuple(box)][None]
        class Layer:
            dtype_per_channel = "uint8"
            def __init__(self, path):
                self.path, array = path, voxstore.Array(path)
                self.bounding_box = types.SimpleNamespace(topleft=(10, 0, 0), size=tuple(2 * n for n in array.shape))
            def get_mag(self, mag): return View(self.path)
        class Dataset:
            @staticmethod
            def open_remote(path, organization_id): return types.SimpleNamespace(get_layer=lambda key: Layer(path + "/" + key))
    """,
}


@pytest.fixture(scope="module")
def stand_ins(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("modules")
    for name, code in MODULES.items():
        (folder / f"{name}.py").write_text(textwrap.dedent(code))
        spark.sparkContext.addPyFile(str(folder / f"{name}.py"))
    import voxstore

    return voxstore


@pytest.fixture(scope="module")
def array():
    return np.random.default_rng(2).integers(0, 200, (9, 10, 11)).astype("uint8")


def boxes(path, what):
    lines = [json.loads(x) for x in (path / "log").read_text().splitlines()]
    return [tuple(map(tuple, box)) for kind, box in lines if kind == what]


@pytest.mark.parametrize("ext", [".zarr", ".n5", ".h5"])
def test_written_and_read_by_blocks(spark, stand_ins, array, tmp_path, ext):
    path = tmp_path / f"a{ext}"
    sources.write_volume(from_numpy(spark, array), str(path), "raw", chunks=(4, 5, 6))
    wrote = boxes(path / "raw", "write")
    assert len(wrote) == len(set(wrote)) == 3 * 2 * 2 and {b[0] for b in wrote} == {(0, 4), (4, 8), (8, 9)}
    vol = sources.open_volume(spark, str(path), "raw")
    assert vol.shape == array.shape and vol.dtype == "uint8" and vol.block_shape == (4, 5, 6) and not (path / "raw" / "log").read_text().count("read")
    assert (vol.to_numpy() == array).all()
    read = boxes(path / "raw", "read")
    assert sorted(set(read)) == sorted(set(wrote)) and max(np.prod([b - a for a, b in box]) for box in read) <= 120
    with pytest.raises(ValueError):
        sources.write_volume(from_numpy(spark, array), str(tmp_path / f"b{ext}"), "raw", chunks=(4, 5, 6), block_shape=(6, 5, 6))
    if ext != ".zarr":
        with pytest.raises(ValueError):
            sources.open_volume(spark, str(path))


def test_sparse_volumes_and_shards(spark, stand_ins, tmp_path):
    a = np.zeros((8, 8), "uint8")
    a[1:3, 1:4], a[6, 6] = 1, 1
    objects = components.label(from_numpy(spark, a))
    sources.write_volume(objects, str(tmp_path / "l.zarr"), chunks=(2, 2), shards=(4, 4))
    assert sorted(boxes(tmp_path / "l.zarr", "write")) == [((0, 4), (0, 4)), ((4, 8), (4, 8))]
    assert (sources.open_volume(spark, str(tmp_path / "l.zarr")).to_numpy() == objects.to_numpy()).all()
    tens = objects.with_values(F.col("v") + 10)
    sources.write_volume(tens, str(tmp_path / "t.n5"), "x", chunks=(4, 4))
    assert (sources.open_volume(spark, str(tmp_path / "t.n5"), "x").to_numpy() == objects.to_numpy() + 10).all()


def test_open_datasets_are_read_by_tasks(spark, stand_ins, array, tmp_path):
    import h5py

    sources.write_volume(from_numpy(spark, array), str(tmp_path / "a.h5"), "raw", chunks=(4, 5, 6))
    assert (as_volume(h5py.File(str(tmp_path / "a.h5"), "r")["raw"], spark).to_numpy() == array).all()


def test_cloud_sources_by_regions(spark, stand_ins, array, tmp_path):
    stand_ins.make(str(tmp_path / "cv"), (11, 10, 9, 1), (4, 4, 4, 1), "uint8")[tuple(slice(0, n) for n in (11, 10, 9, 1))] = array.T[..., None]
    vol = sources.open_volume(spark, str(tmp_path / "cv"), format="cloudvolume")
    assert vol.shape == array.shape and vol.block_shape == (4, 4, 4) and (vol.to_numpy() == array).all()
    part = sources.open_volume(spark, str(tmp_path / "cv"), format="cloudvolume", offset=(102, 1, 8), size=(5, 6, 4))
    assert part.shape == (4, 6, 5) and (part.to_numpy() == array[1:5, 1:7, 2:7]).all()
    stand_ins.make(str(tmp_path / "wk" / "em"), (11, 10, 9), (4, 4, 4), "uint8")[tuple(slice(0, n) for n in (11, 10, 9))] = array.T
    vol = sources.open_volume(spark, str(tmp_path / "wk"), "em", format="webknossos", mag=2, block_shape=(4, 4, 4))
    assert vol.shape == array.shape and (vol.to_numpy() == array).all()
    part = sources.open_volume(spark, str(tmp_path / "wk"), "em", format="webknossos", mag=2, offset=(14, 2, 4), size=(8, 6, 4))
    assert part.shape == (2, 3, 4) and (part.to_numpy() == array[2:4, 1:4, 2:6]).all()


def test_regions():
    assert chunked.regions(5, (9, 10), (4, 5)) == (slice(8, 9), slice(5, 10))
    assert sources.is_writable_format("zarr") and not sources.is_writable_format("tiff")
    with pytest.raises(ValueError):
        sources.write_volume(None, "a.tif")
    with pytest.raises(ImportError):
        chunked.needs("no_such_package")
