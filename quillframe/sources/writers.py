"""Sinks. A path is replaced; it becomes a folder of part files, or one file with single_file=True."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def _to_one_file(df: DataFrame, path: str, write) -> None:
    """Writes one part next to the path and moves it there, through Hadoop's file system: works on any store."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    beside = f"{path}.{uuid.uuid4().hex}.parts"
    write(df.coalesce(1), beside)
    folder = jvm.org.apache.hadoop.fs.Path(beside)
    part = next(s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))
    files.delete(target, True)
    files.rename(part, target)
    files.delete(folder, True)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    def write(frame: DataFrame, to: str) -> None:
        frame.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').option("escape", '"').csv(to)

    _to_one_file(df, path, write) if single_file else write(df, path)


def write_parquet(df: DataFrame, path: str, chunk_size: int | None = None, single_file: bool = False) -> None:
    """chunk_size: most rows of a row group; Parquet's writer also closes one by size."""

    def write(frame: DataFrame, to: str) -> None:
        writer = frame.write.mode("overwrite")
        if chunk_size:
            writer = writer.option("parquet.block.row.count.limit", chunk_size)
        writer.parquet(to)

    if chunk_size is not None and chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    _to_one_file(df, path, write) if single_file else write(df, path)
