"""Quality rules: base statistics, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed byte n-grams are counted: one over every document (raw corpus), one
over the trusted documents (target). A document's verdict is the mean of log(target / raw) over
all its n-grams, so it does not depend on length, against a fixed threshold: deterministic, with
no sampling. Two passes over the texts, the first with one shuffle of them to the trusted ids; what
crosses between them is a table of a fixed number of cells, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import SpanHashes, blocks, columns_of, in_arrow, row_of, windows, words

CELLS = 1 << 16
GRAM = 3
#: Pseudo-counts that the target gets in the raw corpus's proportions.
PRIOR = 2000.0
#: Mean log ratio, in nats an n-gram, from which a document stays.
THRESHOLD = -0.75
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every GRAM consecutive bytes of a text, and the position of the first."""
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.ones(len(data) + 1, bool)
    for k in range(1, GRAM):
        inside[np.maximum(offsets[1:] - k, 0)] = False  # a text shorter than k touches its neighbour's end, which is outside too
    at = np.flatnonzero(inside[: len(data) - GRAM + 1])
    d = data.astype(np.uint32)
    packed = d[at] | d[at + 1] << np.uint32(8) | d[at + 2] << np.uint32(16)
    return ((packed * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), at


def base_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a block."""
    n = len(offsets) - 1
    per = lambda rows, weights=None: np.bincount(rows, weights, minlength=n).astype(np.int64)
    starts, ends, of = words(data, offsets)
    spans = SpanHashes(data)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = {"n_words": per(of), "word_chars": per(of, letters[ends] - letters[starts])}
    out["n_symbols"] = per(row_of(offsets, np.flatnonzero(SYMBOLS[data])))
    # Lines with a word that equal an earlier one of their text.
    breaks = np.flatnonzero(data == 0x0A)
    full = np.flatnonzero(np.diff(offsets))
    begin = np.sort(np.concatenate([offsets[:-1][full], breaks + 1]))
    end = np.sort(np.concatenate([offsets[1:][full], breaks]))
    keep = np.searchsorted(starts, end) > np.searchsorted(starts, begin)  # a word starts in it
    begin, end = begin[keep], end[keep]
    rows = row_of(offsets, begin)
    out["n_dup_lines"] = per(rows[_later(rows, spans.of(begin, end))])
    # Words in 5-word windows found twice or more.
    found, at = windows(spans.of(starts, ends), of, 5)
    cover = np.zeros(len(starts) + 1, np.int64)
    if len(found):
        key = found ^ (of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + 5, -1)
    out["n_repeat_words"] = per(of[np.cumsum(cover[:-1]) > 0])
    return out


def _later(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one of the same row."""
    key = keys ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


def count_grams(df: DataFrame, trusted_ids: DataFrame | list[int], id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts over all documents and over the trusted ones, CELLS of each. A table of trusted ids has one column, id.

    The ids, however many, meet the documents in a shuffle of both, whatever the size. Each task adds
    up its own rows; the shuffle of counts has at most CELLS rows a task, and CELLS rows reach the
    driver.
    """
    if not isinstance(trusted_ids, DataFrame):
        trusted_ids = df.sparkSession.createDataFrame([(str(i),) for i in trusted_ids], "id string")
    flags = trusted_ids.select(F.col("id").cast("string").alias("id")).filter("id IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    rows = columns_of(df, doc_id=id_col, text=text_col)
    # Rows without an id match nothing; their text spreads them over the partitions.
    keyed = rows.withColumn("at", F.coalesce(F.col("doc_id").cast("string"), F.hex(F.xxhash64("text"))))
    flagged = keyed.join(flags.hint("merge"), F.col("at") == F.col("id"), "left").select(F.coalesce(F.col("trusted") & F.col("doc_id").isNotNull(), F.lit(False)).alias("trusted"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        raw, target = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for rows, data, offsets in blocks(batches):
            cells, at = grams(data, offsets)
            raw += np.bincount(cells, minlength=CELLS)
            chosen = rows.column(0).to_numpy(zero_copy_only=False)
            target += np.bincount(cells[chosen[row_of(offsets, at)]], minlength=CELLS)
        some = np.flatnonzero(raw)
        if len(some):
            yield {"cell": some, "raw": raw[some], "target": target[some]}

    counted = in_arrow(flagged, run, "cell int, raw long, target long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = counted.toPandas()
    raw, target = np.zeros(CELLS), np.zeros(CELLS)
    raw[found["cell"]], target[found["cell"]] = found["raw"], found["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / raw) of each cell; 0 everywhere without trusted documents, and in unseen cells."""
    if not target.sum():
        return np.zeros(len(raw))
    share = (raw + 1e-9) / (raw + 1e-9).sum()
    return np.where(raw > 0, np.log((target + PRIOR * share) / (target.sum() + PRIOR)) - np.log(share), 0.0)


def assess(df: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", trusted_id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    trusted names the trusted documents by id, compared as text; all of them count, repeated ones once
    for each row. Null ids there are ignored. Other columns, whatever their names, are not read. A null
    or empty text has zero of everything, llr 0, and fails the base rules (fewer than 10 words).
    Without trusted documents the base rules alone decide. Repeated rows are judged each. An empty
    table gives an empty result.
    """
    judge = _judge(df, trusted, threshold, id_col, text_col, trusted_id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, data, offsets in blocks(batches):
            yield {"doc_id": rows.column(0)} | judge(data, offsets)

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(columns_of(df, doc_id=id_col, text=text_col), run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean")


def keep_good(df: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", trusted_id_col: str = "doc_id") -> DataFrame:
    """The rows of df, with all their columns, that ``assess`` would keep. Repeated rows stay or go together;
    columns may have any names. Rows stay where they are: no shuffle. An empty table gives an empty result."""
    judge = _judge(df, trusted, threshold, id_col, text_col, trusted_id_col)
    place = df.columns.index(text_col)
    names = [f"c{i}" for i in range(len(df.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, data, offsets in blocks(batches, names[place]):
            kept = rows.filter(pa.array(judge(data, offsets)["kept"]))
            yield {n: kept.column(i) for i, n in enumerate(names)}

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema, strict=True)])
    return in_arrow(df.toDF(*names), run, schema).toDF(*df.columns)


def _judge(df: DataFrame, trusted: DataFrame, threshold: float, id_col: str, text_col: str, trusted_id_col: str):
    """Counts both multinomials; gives the function that judges a block of texts."""
    ids = trusted.select(F.col(f"`{trusted_id_col}`").alias("id"))
    shared = df.sparkSession.sparkContext.broadcast(log_ratios(*count_grams(df, ids, id_col, text_col)))

    def judge(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        out, n = base_statistics(data, offsets), len(offsets) - 1
        cells, at = grams(data, offsets)
        of = row_of(offsets, at)
        llr = np.bincount(of, shared.value[cells], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)
        failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
        return out | {"base_failed": failed, "llr": llr, "kept": ~failed & (llr >= threshold)}

    return judge
