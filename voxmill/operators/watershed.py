"""Seeded watershed by priority flooding, block by block."""

from __future__ import annotations

import heapq

import numpy as np

from voxmill.operators.distance import neighbours
from voxmill.operators.stencil import map_blocks
from voxmill.volume import Volume, same_shape


def flood(height: np.ndarray, seeds: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Labels grow from the seeds in the order of (height, arrival); ties go to the earlier."""
    labels = np.where(inside, seeds, 0).astype(np.int64)
    wide = tuple(slice(1, -1) for _ in range(height.ndim))
    lab, open_ = np.zeros([n + 2 for n in height.shape], np.int64), np.zeros([n + 2 for n in height.shape], bool)
    h = np.zeros(lab.shape)
    lab[wide], open_[wide], h[wide] = labels, inside & (labels == 0), height
    strides = [int(np.prod(lab.shape[i + 1 :])) for i in range(lab.ndim)]
    steps = [sum(d * s for d, s in zip(step, strides)) for step in neighbours(lab.ndim)]
    flat_l, flat_o, flat_h = lab.ravel(), open_.ravel(), h.ravel()
    heap = [(flat_h[i], k, int(i)) for k, i in enumerate(np.flatnonzero(flat_l))]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        level, _, i = heapq.heappop(heap)
        for s in steps:
            j = i + s
            if flat_o[j]:
                flat_o[j] = False
                flat_l[j] = flat_l[i]
                heapq.heappush(heap, (max(level, flat_h[j]), count, j))
                count += 1
    return lab[wide]


def watershed(height: Volume, seeds: Volume, halo=None, block_shape=None, mask: Volume | None = None) -> Volume:
    """Each voxel gets the label of the seed that floods it first. Seeds keep their ids.

    Blocks flood their halo too, on their own: with more than one block a halo is required, and
    basins wider than it may differ from those of the whole.
    """
    from voxmill.volume import block_grid, derive_block_shape

    same_shape(height, seeds)
    if np.dtype(seeds.dtype).kind not in "iu":
        raise ValueError("seeds are integers")
    blocks = np.prod(block_grid(height.shape, derive_block_shape(height.shape, block_shape or height.block_shape)))
    if halo is None and blocks > 1:
        raise ValueError("a halo is required for more than one block")
    return map_blocks(height, lambda h, s, m: flood(h, s, m), block_shape, halo or 0, others=[seeds], mask=mask, dtype="int64")
