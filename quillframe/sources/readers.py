"""Sources: CSV, Parquet and columns in memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions.expr import quoted

#: Spellings of null in CSV columns that are not text.
NULL_SPELLINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")


def active_session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def csv_frame(path: str, schema: T.StructType | None = None, spark: SparkSession | None = None, multi_line: bool = False) -> DataFrame:
    """Reads a CSV with a header. With a schema there is no inference pass.

    Files are split among tasks at line ends. A file with line ends inside quoted fields needs
    multi_line, and is then one task's, however large. Without a schema, every column is read as text and its type decided from all its values in one
    aggregate: null spellings count as null, whole numbers become bigint, times have no zone,
    and an empty field of a text column stays the empty string.
    """
    spark = spark or active_session()
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    text = reader.option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    if not text.columns:
        return text
    text = text.select(*[F.coalesce(F.col(quoted(c)), F.lit("")).alias(c) for c in text.columns])
    names = [quoted(c) for c in text.columns]
    tests = []
    for i, n in enumerate(names):
        value = F.when(~F.col(n).isin(*NULL_SPELLINGS), F.col(n))
        day = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr(f"try_cast({n} as date)").isNotNull()
        moment = value.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$") & F.expr(f"try_cast({n} as timestamp_ntz)").isNotNull()
        kinds = {
            "bigint": value.rlike(r"^-?\d+$") & F.expr(f"try_cast({n} as bigint)").isNotNull(),
            "boolean": F.lower(value).isin("true", "false"),
            "date": day,
            "timestamp_ntz": moment | day,
            "double": value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
        }
        tests.append(F.struct(F.count(value).alias("n"), *[F.coalesce(F.bool_and(F.when(value.isNotNull(), t)), F.lit(False)).alias(k) for k, t in kinds.items()]).alias(f"c{i}"))
    found = text.agg(*tests).first()
    out = []
    for i, (c, n) in enumerate(zip(text.columns, names, strict=True)):
        kind = next((k for k in ("bigint", "boolean", "date", "timestamp_ntz", "double") if found[i][k]), "string")
        if not found[i]["n"]:
            out.append(F.lit(None).cast("void").alias(c))
        elif kind == "string":
            out.append(F.col(n).alias(c))
        else:
            out.append(F.when(~F.col(n).isin(*NULL_SPELLINGS), F.col(n)).cast(kind).alias(c))
    return text.select(*out)


def parquet_frame(path: str, spark: SparkSession | None = None) -> DataFrame:
    return (spark or active_session()).read.parquet(path)


def scan_csv(path: str, schema: T.StructType | None = None, spark: SparkSession | None = None, multi_line: bool = False):
    from quillframe.operators.frame import LazyFrame

    return LazyFrame(csv_frame(path, schema, spark, multi_line))


def scan_parquet(path: str, spark: SparkSession | None = None):
    from quillframe.operators.frame import LazyFrame

    return LazyFrame(parquet_frame(path, spark))


def read_csv(path: str, schema: T.StructType | None = None, spark: SparkSession | None = None, multi_line: bool = False):
    from quillframe.operators.frame import EagerFrame

    return EagerFrame(csv_frame(path, schema, spark, multi_line))


def read_parquet(path: str, spark: SparkSession | None = None):
    from quillframe.operators.frame import EagerFrame

    return EagerFrame(parquet_frame(path, spark))


def columns_frame(columns: Sequence[tuple[str, Sequence]] | Mapping[str, Sequence], spark: SparkSession | None = None) -> DataFrame:
    """From pairs of name and values, in that order, or from a mapping, in the order of its names."""
    pairs = sorted(columns.items()) if isinstance(columns, Mapping) else list(columns)
    if not pairs:
        raise ValueError("from_columns needs at least one column")
    if any(v is None for _, v in pairs):
        raise ValueError("from_columns got no array for a column")
    arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for _, v in pairs]
    if len({len(a) for a in arrays}) > 1:
        raise ValueError("from_columns needs columns of equal length")
    names = [n for n, _ in pairs]
    if len(set(names)) < len(names):
        raise ValueError("from_columns got a name twice")
    return (spark or active_session()).createDataFrame(pa.table(arrays, names=names))


def from_columns(columns, spark: SparkSession | None = None):
    from quillframe.operators.frame import EagerFrame

    return EagerFrame(columns_frame(columns, spark))
