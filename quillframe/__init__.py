"""A PySpark-native dataframe engine: fluent lazy and eager frames over Spark DataFrames."""

from quillframe.functions.expr import Expr, col, lit
from quillframe.operators.frame import EagerFrame, GroupedFrame, LazyFrame
from quillframe.sources.readers import from_columns, read_csv, read_parquet, scan_csv, scan_parquet

__all__ = ["EagerFrame", "Expr", "GroupedFrame", "LazyFrame", "col", "from_columns", "lit", "read_csv", "read_parquet", "scan_csv", "scan_parquet"]
