"""Column arithmetic with array semantics: NaN, division by zero and wrap-around of integers.

Spark compares NaN as the greatest value and raises on overflow and on division by zero;
arrays compare with NaN as false, let it pass through, wrap integers and divide to infinities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.volume import spark_type


def _nan() -> Column:
    return F.lit(float("nan"))


def _ordered(a: Column, b: Column, test: Column) -> Column:
    """False where either side is NaN."""
    return test & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


def greater(a, b):
    return _ordered(a, b, a > b)


def greater_equal(a, b):
    return _ordered(a, b, a >= b)


def less(a, b):
    return _ordered(a, b, a < b)


def less_equal(a, b):
    return _ordered(a, b, a <= b)


def equal(a, b):
    return _ordered(a, b, a == b)


def not_equal(a, b):
    return ~equal(a, b)


def _either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a.cast("double")) | F.isnan(b.cast("double"))


def minimum(a, b):
    return F.when(_either_nan(a, b), _nan()).otherwise(F.least(a, b))


def maximum(a, b):
    return F.when(_either_nan(a, b), _nan()).otherwise(F.greatest(a, b))


def divide(a, b):
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), _nan()).when((a > 0) == ~F.atan2(F.lit(0.0), b).between(3, 4), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def floor_divide(a, b):
    return F.when(b == 0, F.lit(0)).otherwise(F.floor(F.try_divide(a.cast("double"), b.cast("double"))))


def mod(a, b):
    return F.when(b == 0, F.lit(0)).otherwise(F.try_mod(F.try_mod(a, b) + b, b))


def wrap(value: Column, dtype) -> Column:
    """Cast an exact decimal result to an integer dtype modulo its range; other dtypes are plain casts."""
    d = np.dtype(dtype)
    if d.kind not in "iu":
        return value.cast(spark_type(d))
    span = F.lit(str(1 << (8 * d.itemsize))).cast("decimal(38,0)")
    low = F.lit(str(int(np.iinfo(d).min))).cast("decimal(38,0)")
    exact = value.cast("decimal(38,0)")
    shifted = F.pmod(exact - low, span) + low
    return F.when(exact.between(int(np.iinfo(d).min), min(int(np.iinfo(d).max), (1 << 63) - 1)), exact).otherwise(shifted).cast(spark_type(d))


def _exact(op):
    """Add, subtract or multiply: doubles as they are, integers in decimals so that they cannot overflow."""

    def run(a, b, integers):
        return op(a.cast("decimal(19,0)"), b.cast("decimal(19,0)")) if integers else op(a.cast("double"), b.cast("double"))

    return run


def _logical(a: Column) -> Column:
    return (a.cast("double") != 0) | F.isnan(a.cast("double"))


#: Name -> function of two columns.
BINARY = {
    "divide": divide, "true_divide": divide, "greater": greater, "greater_equal": greater_equal, "less": less, "less_equal": less_equal, "equal": equal, "not_equal": not_equal,
    "minimum": minimum, "maximum": maximum, "floor_divide": floor_divide, "mod": mod, "remainder": mod,
    "power": lambda a, b: F.pow(a.cast("double"), b.cast("double")),
    "logical_and": lambda a, b: _logical(a) & _logical(b), "logical_or": lambda a, b: _logical(a) | _logical(b), "logical_xor": lambda a, b: _logical(a) != _logical(b),
    "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
}
#: The three that wrap integers.
EXACT = {"add": _exact(lambda a, b: a + b), "subtract": _exact(lambda a, b: a - b), "multiply": _exact(lambda a, b: a * b)}
#: Name -> function of one column.
UNARY = {
    "sqrt": lambda a: F.when(a < 0, _nan()).otherwise(F.sqrt(a.cast("double"))), "exp": lambda a: F.exp(a.cast("double")),
    "log": lambda a: F.when(a > 0, F.log(a.cast("double"))).when(a == 0, F.lit(float("-inf"))).otherwise(_nan()), "log2": lambda a: F.when(a > 0, F.log2(a.cast("double"))).when(a == 0, F.lit(float("-inf"))).otherwise(_nan()),
    "abs": F.abs, "sign": F.sign, "floor": F.floor, "ceil": F.ceil, "negative": lambda a: -a, "rint": lambda a: F.rint(a.cast("double")),
    "logical_not": lambda a: ~_logical(a), "isnan": lambda a: F.isnan(a.cast("double")), "square": lambda a: a * a,
}
