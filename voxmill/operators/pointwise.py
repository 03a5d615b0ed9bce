"""Pointwise operations: array with scalar, array with array, and broadcasting."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.functions import expr
from voxmill.volume import Volume, constant, same_shape, side_by_side, spark_type, write_masked


def _result_dtype(name: str, x: Volume, y) -> str:
    """What numpy gives for one element each; a Python scalar does not widen an array."""
    a = np.ones(1, x.dtype)
    with np.errstate(all="ignore"):
        if y is None:
            return getattr(np, name)(a).dtype.name
        b = np.ones(1, y.dtype) if isinstance(y, Volume) else y
        return getattr(np, name)(a, b).dtype.name


def _call(name: str, a: Column, b: Column | None, dtype: str, inputs: list[str]) -> Column:
    if name in expr.EXACT:
        integers = all(np.dtype(d).kind in "iub" for d in inputs)
        value = expr.EXACT[name](a, b, integers)
        return expr.wrap(value, dtype) if integers else value.cast(spark_type(dtype))
    return (expr.UNARY[name](a) if b is None else expr.BINARY[name](a, b)).cast(spark_type(dtype))


def apply_operation(x: Volume, y=None, operation: str | Callable = "add", output: Volume | None = None, mask: Volume | None = None, dtype: str | None = None) -> Volume:
    """``operation(x, y)`` voxel by voxel.

    ``y`` is a scalar, a volume of the same shape, or one with axes of length one that are
    repeated. ``operation`` names a function of ``voxmill.functions.expr`` or is a callable of
    two columns. With a mask, voxels outside keep the values of ``output``, or zero.
    """
    named = isinstance(operation, str)
    if named and operation not in (expr.UNARY if y is None else expr.BINARY | expr.EXACT):
        raise ValueError(f"unknown operation {operation!r}")
    if isinstance(y, Volume):
        if y.ndim != x.ndim:
            raise ValueError(f"{y.ndim} axes do not fit {x.ndim}")
        stretched = [i for i in range(x.ndim) if y.shape[i] == 1 != x.shape[i]]
        if any(y.shape[i] not in (1, x.shape[i]) for i in range(x.ndim)):
            raise ValueError(f"shape {y.shape} cannot be broadcast to {x.shape}")
        if stretched and mask is not None:
            raise NotImplementedError("a mask does not go with broadcasting")
        if stretched:
            x, y = x.dense(), y.dense()
            on = [a for i, a in enumerate(x.axes) if i not in stretched]
            other = y.df.select(*on, F.col("v").alias("_b"))
            # Spark picks the join by size: a stretched operand is small, one of full size is not
            both, complete = x.df.join(other, on) if on else x.df.withColumn("_b", F.lit(y.df.first()["v"])), True
        else:
            both, complete = side_by_side(x, y)
            both = both.withColumnsRenamed({"_v0": "v", "_v1": "_b"})
        b, blank_b = F.col("_b"), y.blank
    else:
        both, complete, b, blank_b = x.df, x.complete, None if y is None else F.lit(y), None
    if named:
        dtype = dtype or _result_dtype(operation, x, y)
        kinds = [x.dtype] + ([y.dtype] if isinstance(y, Volume) else [] if y is None else [np.result_type(np.dtype(x.dtype), y).name])
        if b is not None and not isinstance(y, Volume) and x.dtype == "float32" and np.dtype(dtype) == "float32" and operation not in expr.EXACT:
            b = F.lit(float(np.float32(y)))
        value = _call(operation, F.col("v"), b, dtype, kinds)
    else:
        dtype = dtype or x.dtype
        value = (operation(F.col("v"), b) if b is not None else operation(F.col("v"))).cast(spark_type(dtype))
    fill = x.fill if complete else constant(x.spark, value, v=x.blank, **({} if blank_b is None else {"_b": blank_b}))
    new = replace(x, df=both.select(*x.axes, value.alias("v")), dtype=np.dtype(dtype).name, fill=fill, complete=complete)
    return write_masked(new, mask, output)


add, subtract, multiply, divide, greater, greater_equal, less, less_equal, minimum, maximum = (
    partial(apply_operation, operation=n) for n in ("add", "subtract", "multiply", "divide", "greater", "greater_equal", "less", "less_equal", "minimum", "maximum")
)


def isin(x: Volume, test_values, output: Volume | None = None, mask: Volume | None = None, most_inline: int = 1000) -> Volume:
    """Whether each value is among ``test_values``: inline if these are few, else by a join that Spark sizes."""
    values = np.unique(np.asarray(list(test_values)))
    values = values[~np.isnan(values)] if values.dtype.kind == "f" else values
    if len(values) <= most_inline:
        hit = F.col("v").isin(values.tolist()) if len(values) else F.lit(False)
        return write_masked(x.with_values(hit, "bool"), mask, output)
    table = x.spark.createDataFrame([(v,) for v in values.tolist()], f"t {'double' if values.dtype.kind == 'f' else 'bigint'}").withColumn("hit", F.lit(True))
    both = x.df.join(table, x.df["v"] == table["t"], "left")
    return write_masked(replace(x, df=both.select(*x.axes, F.coalesce("hit", F.lit(False)).alias("v")), dtype="bool", fill=bool(np.isin(x.fill, values))), mask, output)


def copy(x: Volume, output: Volume | None = None, dtype: str | None = None, mask: Volume | None = None) -> Volume:
    """The values cast to ``dtype`` (or that of ``output``); integers wrap, outside a mask old values stay."""
    if output is x:
        raise ValueError("a volume cannot be copied onto itself")
    if output is not None:
        same_shape(x, output)
    dtype = np.dtype(dtype or (output.dtype if output else x.dtype)).name
    value = F.col("v")
    if np.dtype(dtype).kind in "iu" and np.dtype(x.dtype).kind in "iuf":
        value = expr.wrap(F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)) if np.dtype(x.dtype).kind == "f" else value, dtype)
    return write_masked(x.with_values(value, dtype), mask, output)
