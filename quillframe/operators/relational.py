"""Relational operators as functions from DataFrame to DataFrame.

Each checks its arguments against the schema when it is called, then states the plan with
built-in DataFrame operations and leaves the physical choice to Catalyst and AQE.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions.expr import AGGREGATES, Aggregate, Alias, Expr, col, output_name, quoted

JOIN_TYPES = ("inner", "left", "right", "outer")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    known = set(df.columns)
    for name in names:
        if name not in known:
            raise ValueError(f"Column not found: {name}")


def select(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require_columns(df, names)
    return df.select(*[F.col(quoted(n)) for n in names])


def select_exprs(df: DataFrame, exprs: Sequence[Expr]) -> DataFrame:
    return df.select(*[e.resolve(df.schema)[0].alias(output_name(e, f"expr_{i}")) for i, e in enumerate(exprs)])


def filter_rows(df: DataFrame, predicate: Expr) -> DataFrame:
    condition, kind = predicate.resolve(df.schema)
    if not isinstance(kind, T.BooleanType):
        raise TypeError(f"filter needs a boolean predicate, not {kind.simpleString()}")
    return df.filter(condition)


def with_column(df: DataFrame, name: str, expr: Expr) -> DataFrame:
    made = expr.resolve(df.schema)[0].alias(name)
    kept = [made if n == name else F.col(quoted(n)) for n in df.columns]
    return df.select(*kept, *([] if name in df.columns else [made]))


def head(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("head needs n >= 0")
    return df.limit(n)


def sort(df: DataFrame, names: Sequence[str], ascending: bool = True) -> DataFrame:
    require_columns(df, names)
    if not names:
        return df
    keys = [F.col(quoted(n)) for n in names]
    return df.orderBy(*[k.asc_nulls_last() if ascending else k.desc_nulls_first() for k in keys])


def aggregate(df: DataFrame, keys: Sequence[str], exprs: Sequence[Expr]) -> DataFrame:
    """Every aggregation goes through here: keys first, then one column for each expression.

    Without keys the result is one row, or none where the input has no rows.
    """
    require_columns(df, keys)
    made = []
    for i, e in enumerate(exprs):
        inner = e.inner if isinstance(e, Alias) else e
        if not isinstance(inner, Aggregate):
            raise ValueError(f"agg needs aggregates or aliased aggregates, not {e}")
        made.append(inner.resolve_aggregate(df.schema)[0].alias(e.name if isinstance(e, Alias) else f"agg_{i}"))
    if keys:
        grouped = df.groupBy(*[F.col(quoted(k)) for k in keys])
        return grouped.agg(*made) if made else df.select(*[F.col(quoted(k)) for k in keys]).distinct()
    # A row count beside the aggregates tells an empty input; no grouping key, so no shuffle by one.
    rows = "__rows"
    while rows in df.columns:
        rows += "_"
    whole = df.agg(F.count(F.lit(1)).alias(rows), *made)
    return whole.filter(F.col(rows) > 0).drop(rows)


def named_aggregates(spec) -> list[Expr]:
    """From [(column, function)] or [(name, aggregate expression)]."""
    out: list[Expr] = []
    for name, what in spec.items() if isinstance(spec, Mapping) else spec:
        if isinstance(what, Expr):
            if isinstance(what, Alias):
                raise ValueError(f"{what} already has a name")
            out.append(what.alias(name))
        elif what in AGGREGATES:
            out.append(Aggregate(what, col(name)).alias(f"{name}_{what}"))
        else:
            raise ValueError(f"Unknown aggregate function: {what}")
    return out


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns of identical type.

    Output: keys in the order of ``on`` (coalesced for outer joins), left's other columns,
    right's other columns, with ``_right`` added to names that left also has. A null key
    matches nothing. Sides are not hinted: the planner broadcasts by measured size.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"Unknown join type: {how}")
    on = list(on)
    if not on:
        raise ValueError("join needs at least one key")
    require_columns(left, on)
    require_columns(right, on)
    for key in on:
        a, b = left.schema[key].dataType, right.schema[key].dataType
        if a != b:
            raise ValueError(f"join key {key} is {a.simpleString()} on the left and {b.simpleString()} on the right")
    taken = set(left.columns)
    renamed = [n if n in on else f"{n}_right" if n in taken else n for n in right.columns]
    out = [*on, *[n for n in left.columns if n not in on], *[n for n in renamed if n not in on]]
    if len(set(out)) < len(out):
        raise ValueError(f"join would repeat a column name: {sorted({n for n in out if out.count(n) > 1})}")
    # New names for every right column, so that a self-join has no shared attributes.
    fresh = [f"__r{i}" for i in range(len(renamed))]
    other = right.select(*[F.col(quoted(n)).alias(f) for n, f in zip(right.columns, fresh, strict=True)])
    of = dict(zip(renamed, fresh, strict=True))
    base = left.select(*[F.col(quoted(n)).alias(f"__l{i}") for i, n in enumerate(left.columns)])
    left_of = {n: f"__l{i}" for i, n in enumerate(left.columns)}
    condition = None
    for key in on:
        equal = F.col(left_of[key]) == F.col(of[key])
        condition = equal if condition is None else condition & equal
    joined = base.join(other, condition, how)
    key_column = {
        "inner": lambda k: F.col(left_of[k]),
        "left": lambda k: F.col(left_of[k]),
        "right": lambda k: F.col(of[k]),
        "outer": lambda k: F.coalesce(F.col(left_of[k]), F.col(of[k])),
    }[how]
    return joined.select(
        *[key_column(k).alias(k) for k in on],
        *[F.col(left_of[n]).alias(n) for n in left.columns if n not in on],
        *[F.col(of[n]).alias(n) for n in renamed if n not in on],
    )
