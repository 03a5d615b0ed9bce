"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.plans.durable import connected_components, drop_tables, materialize, scratch, table_path, unused, with_prefix, with_row_key, work_root

__all__ = ["connected_components", "drop_tables", "forget", "materialize", "scratch", "table_path", "text_bytes", "unused", "with_prefix", "with_row_key", "work_root"]


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text as binary; a null text has none."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


_WORKER: dict = {}


def worker_cache(key, make):
    """What a worker process keeps between tasks: one thing at a time.

    Another key drops the last one, so a worker that serves one operator after the other never
    holds the tables of both; freed memory goes back to the system.
    """
    if key not in _WORKER:
        if _WORKER:
            _WORKER.clear()
            _trim()
        _WORKER[key] = make()
    return _WORKER[key]


def forget() -> None:
    """Drop what a worker keeps: for operators that need no tables of their own."""
    if _WORKER:
        _WORKER.clear()
        _trim()


def _trim() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
