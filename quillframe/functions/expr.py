"""Deferred column expressions.

An ``Expr`` is a small immutable tree. Nothing is known about operand types until the
expression meets a frame; ``resolve`` then walks the tree once against the frame's schema
and returns a Spark ``Column`` with its data type. No job runs, and what comes out is made
of built-in functions only, so Catalyst sees (and optimizes) the whole expression.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import types as rules

ARITHMETIC = ("+", "-", "*", "/", "%")
COMPARISON = ("==", "!=", "<", "<=", ">", ">=")
BOOLEAN = ("&", "|")
AGGREGATES = ("sum", "mean", "count", "min", "max")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _wrap(value: Any) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


class Expr:
    """Base of all expressions; carries the operators and the fluent methods."""

    def children(self) -> tuple[Expr, ...]:
        return ()

    def walk(self) -> Iterator[Expr]:
        yield self
        for child in self.children():
            yield from child.walk()

    def columns(self) -> list[str]:
        """Names of the columns it reads, in order of appearance."""
        return list(dict.fromkeys(e.name for e in self.walk() if isinstance(e, ColumnRef)))

    def resolve(self, schema: T.StructType) -> tuple[Column, T.DataType]:
        raise NotImplementedError

    def infer_type(self, schema: T.StructType) -> T.DataType:
        return self.resolve(schema)[1]

    def alias(self, name: str) -> Expr:
        return Alias(self, name)

    def abs(self) -> Expr:
        return Unary("abs", self)

    def is_null(self) -> Expr:
        return Unary("is_null", self)

    def is_not_null(self) -> Expr:
        return Unary("is_not_null", self)

    def length(self) -> Expr:
        return StringFn("length", self)

    def to_lower(self) -> Expr:
        return StringFn("lower", self)

    def to_upper(self) -> Expr:
        return StringFn("upper", self)

    def contains(self, needle: str) -> Expr:
        return StringFn("contains", self, needle)

    def starts_with(self, prefix: str) -> Expr:
        return StringFn("starts_with", self, prefix)

    def ends_with(self, suffix: str) -> Expr:
        return StringFn("ends_with", self, suffix)

    def sum(self) -> Expr:
        return Aggregate("sum", self)

    def mean(self) -> Expr:
        return Aggregate("mean", self)

    def count(self) -> Expr:
        return Aggregate("count", self)

    def min(self) -> Expr:
        return Aggregate("min", self)

    def max(self) -> Expr:
        return Aggregate("max", self)

    def __add__(self, other):
        return Binary("+", self, _wrap(other))

    def __radd__(self, other):
        return Binary("+", _wrap(other), self)

    def __sub__(self, other):
        return Binary("-", self, _wrap(other))

    def __rsub__(self, other):
        return Binary("-", _wrap(other), self)

    def __mul__(self, other):
        return Binary("*", self, _wrap(other))

    def __rmul__(self, other):
        return Binary("*", _wrap(other), self)

    def __truediv__(self, other):
        return Binary("/", self, _wrap(other))

    def __rtruediv__(self, other):
        return Binary("/", _wrap(other), self)

    def __mod__(self, other):
        return Binary("%", self, _wrap(other))

    def __rmod__(self, other):
        return Binary("%", _wrap(other), self)

    def __eq__(self, other):  # type: ignore[override]
        return Binary("==", self, _wrap(other))

    def __ne__(self, other):  # type: ignore[override]
        return Binary("!=", self, _wrap(other))

    def __lt__(self, other):
        return Binary("<", self, _wrap(other))

    def __le__(self, other):
        return Binary("<=", self, _wrap(other))

    def __gt__(self, other):
        return Binary(">", self, _wrap(other))

    def __ge__(self, other):
        return Binary(">=", self, _wrap(other))

    def __and__(self, other):
        return Binary("&", self, _wrap(other))

    def __rand__(self, other):
        return Binary("&", _wrap(other), self)

    def __or__(self, other):
        return Binary("|", self, _wrap(other))

    def __ror__(self, other):
        return Binary("|", _wrap(other), self)

    def __invert__(self):
        return Unary("not", self)

    def __neg__(self):
        return Unary("negate", self)

    __hash__ = object.__hash__

    def __bool__(self):
        raise TypeError("an expression has no truth value; combine conditions with &, | and ~")


@dataclass(frozen=True, eq=False)
class ColumnRef(Expr):
    name: str

    def resolve(self, schema):
        # Names are case-sensitive, whatever spark.sql.caseSensitive says.
        for field in schema.fields:
            if field.name == self.name:
                return F.col(quoted(self.name)), field.dataType
        raise ValueError(f"Column not found: {self.name}")

    def __str__(self):
        return self.name


@dataclass(frozen=True, eq=False)
class Literal(Expr):
    value: bool | int | float | str

    def resolve(self, schema):
        if isinstance(self.value, bool):
            return F.lit(self.value), T.BooleanType()
        if isinstance(self.value, int):
            return F.lit(self.value).cast("bigint"), T.LongType()
        if isinstance(self.value, float):
            return F.lit(self.value).cast("double"), T.DoubleType()
        return F.lit(self.value), T.StringType()

    def __str__(self):
        return repr(self.value)


@dataclass(frozen=True, eq=False)
class Alias(Expr):
    inner: Expr
    name: str

    def children(self):
        return (self.inner,)

    def resolve(self, schema):
        return self.inner.resolve(schema)

    def __str__(self):
        return f"{self.inner} AS {self.name}"


@dataclass(frozen=True, eq=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self):
        return (self.left, self.right)

    def resolve(self, schema):
        (a, left), (b, right) = self.left.resolve(schema), self.right.resolve(schema)
        if self.op in BOOLEAN:
            for side in (left, right):
                if not isinstance(side, (T.BooleanType, T.NullType)):
                    raise TypeError(f"{self.op} needs boolean operands, not {side.simpleString()}")
            return (a & b if self.op == "&" else a | b), T.BooleanType()
        if self.op in COMPARISON:
            common = rules.comparison_type(left, right)
            if common is not None:
                a, b = a.cast(common), b.cast(common)
            by_op = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
            return by_op[self.op], T.BooleanType()
        result = rules.arithmetic_type(left, right)
        if rules.is_null(result):
            return F.lit(None), result
        a, b = a.cast(result), b.cast(result)
        if self.op == "/":
            # Integers truncate toward zero; a zero divisor gives null for either kind.
            whole = F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))
            return (whole if rules.is_integral(result) else F.try_divide(a, b)), result
        if self.op == "%":
            return F.try_mod(a, b), result
        return {"+": a + b, "-": a - b, "*": a * b}[self.op], result

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True, eq=False)
class Unary(Expr):
    op: str
    child: Expr

    def children(self):
        return (self.child,)

    def resolve(self, schema):
        c, kind = self.child.resolve(schema)
        if self.op in ("is_null", "is_not_null"):
            return (c.isNull() if self.op == "is_null" else c.isNotNull()), T.BooleanType()
        if self.op == "not":
            if not isinstance(kind, (T.BooleanType, T.NullType)):
                raise TypeError(f"~ needs a boolean operand, not {kind.simpleString()}")
            return ~c.cast("boolean"), T.BooleanType()
        if rules.is_null(kind):
            return c, kind
        if not rules.is_numeric(kind):
            raise TypeError(f"{self.op} needs a numeric operand, not {kind.simpleString()}")
        return (F.abs(c) if self.op == "abs" else F.negative(c)).cast(kind), kind

    def __str__(self):
        return f"{self.op}({self.child})"


def _ascii_case(c: Column, whole: Callable[[Column], Column], old: str, new: str) -> Column:
    """Case of A to Z only. Text that is ASCII throughout takes Spark's own function, which is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), whole(c)).otherwise(F.translate(c, old, new))


@dataclass(frozen=True, eq=False)
class StringFn(Expr):
    fn: str
    child: Expr
    arg: str = ""

    def children(self):
        return (self.child,)

    def resolve(self, schema):
        c, kind = self.child.resolve(schema)
        if not rules.is_string(kind):
            raise ValueError(f"{self.fn} needs a string operand, not {kind.simpleString()}")
        if self.fn == "length":
            return F.octet_length(c).cast("bigint"), T.LongType()
        if self.fn == "lower":
            return _ascii_case(c, F.lower, string.ascii_uppercase, string.ascii_lowercase), T.StringType()
        if self.fn == "upper":
            return _ascii_case(c, F.upper, string.ascii_lowercase, string.ascii_uppercase), T.StringType()
        test = {"contains": c.contains, "starts_with": c.startswith, "ends_with": c.endswith}[self.fn]
        return test(F.lit(self.arg)), T.BooleanType()

    def __str__(self):
        return f"{self.fn}({self.child})"


@dataclass(frozen=True, eq=False)
class Aggregate(Expr):
    """Only meaningful inside ``agg``; ``resolve`` refuses it, ``resolve_aggregate`` builds it."""

    fn: str
    child: Expr

    def children(self):
        return (self.child,)

    def resolve(self, schema):
        raise ValueError(f"{self} can only be used in agg()")

    def resolve_aggregate(self, schema: T.StructType) -> tuple[Column, T.DataType]:
        c, kind = self.child.resolve(schema)
        if self.fn == "count":
            return F.count(c), T.LongType()
        if not rules.is_numeric(kind):
            raise TypeError(f"{self} requires numeric input, not {kind.simpleString()}")
        if self.fn == "mean" and rules.is_integral(kind):
            # F.count is 0 only for a group without values, whose sum is null.
            made = F.call_function("div", F.sum(c), F.nullif(F.count(c), F.lit(0).cast("bigint")))
        else:
            made = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[self.fn](c)
        return made.cast(kind), kind

    def infer_type(self, schema):
        return self.resolve_aggregate(schema)[1]

    def __str__(self):
        return f"{self.fn}({self.child})"


def col(name: str) -> Expr:
    return ColumnRef(name)


def lit(value: bool | int | float | str) -> Expr:
    if not isinstance(value, (bool, int, float, str)):
        raise TypeError(f"no literal of type {type(value).__name__}")
    return Literal(value)


def output_name(expr: Expr, default: str) -> str:
    """Alias, else the column's own name, else the default."""
    return expr.name if isinstance(expr, (Alias, ColumnRef)) else default
