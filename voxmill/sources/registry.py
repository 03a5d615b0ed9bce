"""Formats by name and extension; the first claim on an extension holds."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence

_READERS: dict[str, Callable] = {}
_EXTENSIONS: dict[str, str] = {}
_WRITERS: dict[str, Callable] = {}


def register_format(name: str, extensions: Sequence[str], reader: Callable, writer: Callable | None = None) -> None:
    """``reader(spark, path, key, **options)`` returns a Volume; ``writer(vol, path, key, **options)`` writes one."""
    _READERS[name] = reader
    for e in extensions:
        _EXTENSIONS.setdefault(e.lower(), name)
    if writer is not None:
        _WRITERS[name] = writer


def supported_formats() -> list[str]:
    return sorted(_READERS)


def supported_extensions() -> list[str]:
    return sorted(_EXTENSIONS)


def format_for_extension(ext: str) -> str | None:
    return _EXTENSIONS.get(ext.lower())


def reader_for_format(name: str) -> Callable:
    if name not in _READERS:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(supported_formats())}")
    return _READERS[name]


def is_writable_format(name: str) -> bool:
    return name in _WRITERS


def writer_for_format(name: str) -> Callable:
    if name not in _WRITERS:
        raise ValueError(f"format {name!r} cannot be written; these can: {', '.join(sorted(_WRITERS))}")
    return _WRITERS[name]


def infer_extension(path: str) -> str:
    """The suffix, of which .nii.gz has two; none means a folder."""
    base = posixpath.basename(path.rstrip("/")).lower()
    return ".nii.gz" if base.endswith(".nii.gz") else posixpath.splitext(base)[1]


def infer_format(path: str) -> str:
    name = format_for_extension(infer_extension(path))
    if name is None:
        raise ValueError(f"no format claims {path!r}")
    return name
