"""Incremental runs: block ledgers, resuming, and voxel streams."""

from voxmill.streaming.ledger import BlockExecutionError, BlockLedger, map_items
from voxmill.streaming.voxels import stream_label_counts, stream_summary

__all__ = ["BlockExecutionError", "BlockLedger", "map_items", "stream_label_counts", "stream_summary"]
