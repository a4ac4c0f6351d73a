"""Type rules of the expression layer, over Spark's own data types."""

from __future__ import annotations

from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, INTEGRAL)


def is_floating(t: T.DataType) -> bool:
    return isinstance(t, FLOATING)


def is_numeric(t: T.DataType) -> bool:
    return is_integral(t) or is_floating(t)


def is_string(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def arithmetic_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """Result of + - * / %: double if either side floats, else bigint; the null type takes the other side's kind."""
    if is_null(left) and is_null(right):
        return T.NullType()
    for side in (left, right):
        if not (is_numeric(side) or is_null(side)):
            raise TypeError(f"non-numeric operand in arithmetic: {side.simpleString()}")
    return T.DoubleType() if is_floating(left) or is_floating(right) else T.LongType()


def comparison_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """The type both sides are cast to before a comparison; None where they are compared as they are."""
    if is_null(left) or is_null(right) or (is_string(left) and is_string(right)):
        return None
    number = lambda t: is_numeric(t) or isinstance(t, T.BooleanType)
    if number(left) and number(right):
        if type(left) is type(right):
            return None
        return T.DoubleType() if is_floating(left) or is_floating(right) else T.LongType()
    if left == right:
        return None
    raise TypeError(f"cannot compare {left.simpleString()} with {right.simpleString()}")
