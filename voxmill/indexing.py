"""Basic indexing: integers, unit-step slices and one ellipsis, resolved against a shape."""

from __future__ import annotations

from collections.abc import Sequence


def slice_bounds(s: slice, size: int) -> slice:
    if s.step not in (None, 1):
        raise ValueError("only steps of one are supported")
    start, stop = (0 if s.start is None else int(s.start)), (size if s.stop is None else int(s.stop))
    start = start + size if start < 0 else start
    stop = stop + size if stop < 0 else stop
    start, stop = max(0, min(start, size)), max(0, min(stop, size))
    return slice(start, max(start, stop))


def int_bounds(i: int, size: int) -> slice:
    j = i + size if i < 0 else i
    if not 0 <= j < size:
        raise ValueError(f"index {i} is out of range for size {size}")
    return slice(j, j + 1)


def normalize_index(index, shape: Sequence[int]) -> tuple[tuple[slice, ...], tuple[int, ...]]:
    """In-bounds slices for all axes, and the axes that integers picked."""
    parts = list(index) if isinstance(index, tuple) else [index]
    dots = [i for i, p in enumerate(parts) if p is Ellipsis]
    if len(dots) > 1:
        raise ValueError("an index has at most one ellipsis")
    if dots:
        fill = len(shape) - (len(parts) - 1)
        parts[dots[0] : dots[0] + 1] = [slice(None)] * max(0, fill)
    if len(parts) > len(shape):
        raise ValueError(f"too many indices for {len(shape)} axes")
    parts += [slice(None)] * (len(shape) - len(parts))
    out, squeezed = [], []
    for axis, (p, n) in enumerate(zip(parts, shape)):
        if isinstance(p, slice):
            out.append(slice_bounds(p, n))
        else:
            out.append(int_bounds(int(p), n))
            squeezed.append(axis)
    return tuple(out), tuple(squeezed)
