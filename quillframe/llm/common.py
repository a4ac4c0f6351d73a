"""What the operators share: tables in the shared folder, fresh names, and texts as flat numpy arrays."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy block holds; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


#: Setting under which Spark removes a query's shuffle files when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in the folder that driver and executors share (spark.checkpoint.dir).

    ``keep`` writes a DataFrame there and reads it back: lineage is cut at files that outlive any
    executor, and the shuffle files that made the table go when it is written. ``drop`` removes a table
    that no later step reads, ``close`` all that are left; what nobody closes goes when the driver ends.
    Where the setting is missing, a local master gets a temporary folder; any other is an error, since
    executors elsewhere could not read it.
    """

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = _own_folder()
        self.spark, self.path, self._n, self._at = spark, f"{base}/{name}-{uuid.uuid4().hex}", 0, {}
        self._files = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self.opened.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        path, self._n = f"{self.path}/{self._n:03d}", self._n + 1
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(self._at.pop(id(df))[0])

    def close(self) -> None:
        """Removes every table. Only once no result that reads them is to be computed any more."""
        if self in self.opened:
            self.opened.remove(self)
            self._at.clear()
            self._delete(self.path)

    def _delete(self, path: str) -> None:
        make, conf = self._files
        target = make(path)
        target.getFileSystem(conf).delete(target, True)


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="scratch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@atexit.register
def _close_all() -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended first
        for scratch in list(Scratch.opened):
            scratch.close()


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, base: str) -> str:
    """A name like base that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def columns_of(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns that an operator reads, under its own names: others cannot clash."""
    return df.select(*[df[f"`{source}`"].alias(own) for own, source in names.items()])


def picked(df: DataFrame, keep: tuple[str, ...], column: str, own: str) -> DataFrame:
    """The kept columns as k0, k1, ... and one more under an operator's own name, which thus clashes with none."""
    return df.select(*[df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)], df[f"`{column}`"].alias(own))


#: A key with more than one in HOT of all rows is hot; there are fewer than HOT of those.
HOT = 1000


def join_hot(rows: DataFrame, table: DataFrame, on: dict[str, str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has each key once, with the number of rows that have it as weight.

    on: the rows' columns and the table's, none of which is null. Hot keys, fewer than HOT entries of the
    table at any input size, are broadcast, so that no task gets all rows of one; others meet in a shuffle.
    """
    hot = F.col(weight) * F.lit(HOT) > F.lit(total)
    same = F.lit(True)
    for a, b in on.items():
        same = same & (F.col(a) == F.col(b))
    few = F.broadcast(table.filter(hot))
    return rows.join(few, same).unionByName(rows.join(few.select(*on.values()), same, "left_anti").join(table.filter(~hot), same))


def unit_hash(*columns: Column, seed: int) -> Column:
    """Evenly spread in [0, 1), the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / F.lit(float(1 << 53))


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once for each Spark context, through the driver's file server."""
    context = spark.sparkContext
    if getattr(context, "_quillframe_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="package-")  # the driver's own; the file server reads it as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "quillframe.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._quillframe_shipped = True


def in_arrow(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """mapInArrow where fn yields dicts of column name to array-like, in the schema's types."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows with about size bytes of text.

    Gives the rows, their texts' UTF-8 bytes end to end (null as nothing), and len + 1 offsets.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        _, ends, chars = texts.buffers()
        all_offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(chars, np.uint8) if chars is not None and chars.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(all_offsets, all_offsets[at] + size, side="right")) - 1)
            o = all_offsets[at : upto + 1]
            yield batch.slice(at, upto - at), data[o[0] : o[-1]], o - o[0]
            at = upto


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def row_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(offsets, at, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than space, tab to carriage return."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, row_of(offsets, starts)


_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Longer spans are hashed as a whole: sums modulo 2^64 cannot tell some long patterns of two bytes apart.
LONG = 32


class SpanHashes:
    """64-bit hashes of any spans of a block, from one running sum; those of more than LONG bytes one by one."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _powers(_INVERSE, len(data)), out=self.sums[1:])
        self.scale = _powers(_BASE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = mix((self.sums[ends] - self.sums[starts]) * self.scale[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]])
        return out

    def rolling(self, n: int) -> np.ndarray:
        """Hash of the n bytes from each position on."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.scale[: len(self.sums) - n] + np.uint64(n * 0xC2B2AE3D27D4EB4F % 2**64))


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive items within a row, and the index of each window's first item."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[n - 1 :] == rows[: len(rows) - n + 1])
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + hashes[at + i]
    return mix(out), at
