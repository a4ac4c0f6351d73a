"""Frames: a fluent surface over Spark DataFrames, in a lazy and an eager mode.

``LazyFrame`` only adds to the plan. ``EagerFrame`` has the same operators and runs each
result at once, keeping it in executor memory or disk (``persist``), from where lost blocks
are recomputed; it is given back when the frame is collected, or by ``release``. Neither holds an
engine or an optimizer of its own.
"""

from __future__ import annotations

import contextlib
import weakref
from collections.abc import Mapping, Sequence
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillframe.functions.expr import Expr
from quillframe.operators import relational as R
from quillframe.plans import explain as plans
from quillframe.sources import writers


class _Frame:
    def __init__(self, df: DataFrame):
        if not isinstance(df, DataFrame):
            raise ValueError("a frame needs a Spark DataFrame")
        self._df = df

    def _new(self, df: DataFrame):
        return type(self)(df)

    @property
    def df(self) -> DataFrame:
        """The Spark DataFrame below."""
        return self._df

    def select(self, names: Sequence[str]):
        return self._new(R.select(self._df, names))

    def select_exprs(self, exprs: Sequence[Expr]):
        return self._new(R.select_exprs(self._df, exprs))

    def filter(self, predicate: Expr):
        return self._new(R.filter_rows(self._df, predicate))

    def with_column(self, name: str, expr: Expr):
        return self._new(R.with_column(self._df, name, expr))

    def sort(self, names: Sequence[str], ascending: bool = True):
        return self._new(R.sort(self._df, names, ascending))

    def join(self, other: _Frame, on: Sequence[str], how: str = "inner"):
        return self._new(R.join(self._df, other._df, on, how))

    def group_by(self, keys: Sequence[str]) -> GroupedFrame:
        return GroupedFrame(self, keys)

    def agg(self, exprs: Sequence[Expr]):
        return self.group_by([]).agg(exprs)

    def aggregate(self, spec: Sequence[tuple[str, str | Expr]]):
        return self.group_by([]).aggregate(spec)

    def aggregate_map(self, spec: Mapping[str, str]):
        return self.group_by([]).aggregate_map(spec)

    def schema(self) -> T.StructType:
        return self._df.schema

    def column_names(self) -> list[str]:
        return self._df.columns


class GroupedFrame:
    """A frame and its keys, waiting for aggregates."""

    def __init__(self, frame: _Frame, keys: Sequence[str]):
        R.require_columns(frame.df, keys)
        self._frame, self._keys = frame, list(keys)

    def agg(self, exprs: Sequence[Expr]):
        return self._frame._new(R.aggregate(self._frame.df, self._keys, exprs))

    def aggregate(self, spec: Sequence[tuple[str, str | Expr]]):
        """[(column, "sum|mean|count|min|max")] gives <column>_<function>; [(name, expression)] gives name."""
        return self.agg(R.named_aggregates(spec))

    def aggregate_map(self, spec: Mapping[str, str]):
        """{column: function}, in the order of the column names."""
        return self.agg(R.named_aggregates(sorted(spec.items())))


class LazyFrame(_Frame):
    def head(self, n: int) -> LazyFrame:
        return self._new(R.head(self._df, n))

    def collect(self) -> EagerFrame:
        """Runs the plan; rows stay on the executors."""
        return EagerFrame(self._df)

    def sink_csv(self, path: str, **options: Any) -> None:
        writers.write_csv(self._df, path, **options)

    def sink_parquet(self, path: str, **options: Any) -> None:
        writers.write_parquet(self._df, path, **options)

    def plan(self) -> str:
        """The logical plan as written, before optimization."""
        return plans.logical_text(self._df)

    def optimize(self) -> str:
        """The plan after Catalyst's rules."""
        return plans.optimized_text(self._df)

    def explain(self, path: str | None = None, optimized: bool = False) -> str:
        """DOT text of the plan; written to path, rendered where a Graphviz binary exists and path ends in .png."""
        return plans.explain(self._df, path, optimized)


def _unpersist(df: DataFrame) -> None:
    with contextlib.suppress(Py4JError, OSError, AttributeError):  # the session may have ended first
        df.unpersist()


class EagerFrame(_Frame):
    """df: a Spark DataFrame, an Arrow table, or nothing for an empty frame."""

    def __init__(self, df: DataFrame | pa.Table | None = None):
        if df is None or isinstance(df, pa.Table):
            from quillframe.sources.readers import active_session

            df = active_session().createDataFrame([], T.StructType([])) if df is None or not df.num_columns else active_session().createDataFrame(df)
        super().__init__(df)
        self._release = None
        if not df.is_cached:
            df.persist(StorageLevel.MEMORY_AND_DISK)
            self._release = weakref.finalize(self, _unpersist, df)
            self._release.atexit = False
        self._rows = df.count()

    def release(self) -> None:
        """Gives back what is kept; later uses compute it anew."""
        if self._release is not None:
            self._release()

    def lazy(self) -> LazyFrame:
        return LazyFrame(self._df)

    def head(self, n: int = 10) -> EagerFrame:
        return self._new(R.head(self._df, n))

    def num_rows(self) -> int:
        return self._rows

    def num_cols(self) -> int:
        return len(self._df.columns)

    num_columns = num_cols

    def table(self):
        """The rows as a pyarrow Table in the driver's memory: for results known to be small."""
        return self._df.toArrow()

    def print(self, max_rows: int = 10) -> None:
        print(f"{self._rows} rows x {self.num_cols()} columns")
        self._df.printSchema()
        self._df.show(max(0, max_rows), truncate=False)

    def write_csv(self, path: str, **options: Any) -> None:
        writers.write_csv(self._df, path, **options)

    def write_parquet(self, path: str, chunk_size: int = 64 * 1024, **options: Any) -> None:
        writers.write_parquet(self._df, path, chunk_size=chunk_size, **options)
