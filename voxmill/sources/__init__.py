"""Readers and writers of volumes, and the registry of formats."""

from voxmill.sources.formats import open_volume, read_table, save_volume, write_table, write_volume
from voxmill.sources.registry import format_for_extension, infer_extension, infer_format, is_writable_format, register_format, supported_extensions, supported_formats

__all__ = ["format_for_extension", "infer_extension", "infer_format", "is_writable_format", "open_volume", "read_table", "register_format", "save_volume", "supported_extensions", "supported_formats", "write_table", "write_volume"]
