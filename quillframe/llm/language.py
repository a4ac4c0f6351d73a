"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained by follow-the-regularised-leader with elastic-net penalties, then calibrated.

Document frequencies are counted over every training document, in one pass that keeps one array
for each task. The regression is fitted on the driver on a bounded sample: at most ``per_language``
documents of a language, chosen by hash, whose sparse counts are computed on the executors. The L1
penalty leaves three of four weights that training has touched at zero. A temperature is then fitted
on short pieces of documents that training did not see, since whole ones are too easy to tell how far
a score can be trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import blocks, columns_of, in_arrow, picked, unit_hash

CELLS = 1 << 14
ORDERS = (1, 2, 3)
#: Sampled training documents of a language, and languages, at most.
PER_LANGUAGE = 1500
MAX_LANGUAGES = 1000
#: Bytes that the sample may take on the driver if every document had every cell.
MAX_BYTES = 400 << 20
#: Characters of the pieces that the temperature is fitted on.
PIECE = 40
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)


def cells_of(text: str) -> np.ndarray:
    """Cell of every character n-gram of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * _MULTIPLIERS[k]
                h ^= h >> np.uint64(15)
            out.append((h >> np.uint64(7)) & np.uint64(CELLS - 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def counts_of(text: str) -> np.ndarray:
    return np.bincount(cells_of(text), minlength=CELLS)


def weighted(cells: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + log count) * idf, scaled to length 1."""
    x = (1 + np.log(counts)) * idf[cells]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


class FollowTheLeader:
    """Per-coordinate FTRL-Proximal for the softmax loss, with L1 and L2 penalties."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 1e-4):
        self.z, self.n = np.zeros((CELLS, classes)), np.zeros((CELLS, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[cells], self.n[cells]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, cells: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(cells)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[cells] + g * g) - np.sqrt(self.n[cells])) / self.alpha
        self.z[cells] += g - sigma * w
        self.n[cells] += g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The t in [0.02, 20] at which softmax(logits / t) has the least log loss; golden-section search."""
    if not len(labels):
        return 1.0
    loss = lambda u: -np.log(np.maximum(softmax(logits / np.exp(u))[np.arange(len(labels)), labels], 1e-12)).mean()
    lo, hi, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each cell occurs, and the number of texts. Tasks add up first; CELLS + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen, n = np.zeros(CELLS, np.int64), 0
        for rows, _, _ in blocks(batches):
            for text in rows.column(0).to_pylist():
                seen += counts_of(text or "") > 0
                n += 1
        if n:
            some = np.flatnonzero(seen)
            yield {"cell": np.append(some, CELLS), "n": np.append(seen[some], n)}

    found = in_arrow(training.select("text"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS + 1, np.int64)
    out[found["cell"]] = found["n"]
    return out[:CELLS], int(out[CELLS])


class LanguageModel:
    """languages, idf, weights (CELLS x languages) and a temperature; small enough to broadcast."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights, heat

    def logits(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighted(cells, counts, self.idf) @ self.weights[cells]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        counts = counts_of(text)
        cells = np.flatnonzero(counts)
        p = softmax(self.logits(cells, counts[cells]) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(df: DataFrame, per_language: int = PER_LANGUAGE, max_bytes: int = MAX_BYTES, epochs: int = 2, seed: int = 6, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits a model on df's rows with a language and a text; without any, the model knows no language.

    per_language documents of a language at most, and no more of them than max_bytes hold at CELLS
    cells each, are fitted on: the first by a hash of id and text, of rows that repeat both one. Null
    ids count as ids. Every row counts in the document frequencies. Other columns, whatever their names,
    are not read. Ties in the score go to the first language by code point.
    """
    rows = columns_of(df, doc_id=id_col, text=text_col, lang=lang_col).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("u", unit_hash(F.col("doc_id"), F.col("text"), seed=seed))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("u").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(CELLS), np.zeros((CELLS, 0)), 1.0)
    seen, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + seen)) + 1
    few = max(1, min(per_language, max_bytes // (4 * CELLS * len(languages))))
    # Twice as many as are wanted by a hash below a language's rate; of those the first.
    rate: Column = F.lit(0.0)
    for lang in languages:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * few / max(sizes[lang], 1)))).otherwise(rate)
    near = rows.filter(F.col("u") < rate).dropDuplicates(["u", "lang"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("u")))
    sample = near.filter(F.col("place") <= few).select("text", "place", "lang")

    def sparse(text: str) -> tuple[bytes, bytes]:
        counts = counts_of(text)
        cells = np.flatnonzero(counts)
        return cells.astype("<u2").tobytes(), np.minimum(counts[cells], 65535).astype("<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, _, _ in blocks(batches):
            texts = block.column(0).to_pylist()
            whole, pieces = ([sparse(t) for t in x] for x in (texts, [t[len(t) // 3 :][:PIECE] for t in texts]))
            yield {"place": block.column(1), "lang": block.column(2), "cells": [x for x, _ in whole], "counts": [x for _, x in whole], "piece_cells": [x for x, _ in pieces], "piece_counts": [x for _, x in pieces]}

    taken = in_arrow(sample, run, "place int, lang string, cells binary, counts binary, piece_cells binary, piece_counts binary").collect()
    taken.sort(key=lambda r: (r["place"], r["lang"]))
    label, read = {x: i for i, x in enumerate(languages)}, lambda x: np.frombuffer(x, "<u2").astype(np.int64)
    held, learnt = taken[::6] if len(taken) > 60 else [], [x for i, x in enumerate(taken) if len(taken) <= 60 or i % 6]
    leader = FollowTheLeader(len(languages))
    examples = [(cells := read(r["cells"]), weighted(cells, read(r["counts"]), idf), label[r["lang"]]) for r in learnt]
    for _ in range(epochs):
        for example in examples:
            leader.learn(*example)
    model = LanguageModel(languages, idf, leader.weights(), 1.0)
    hard = [r for r in held if r["piece_cells"]]
    if hard:
        model.heat = temperature(np.array([model.logits(read(r["piece_cells"]), read(r["piece_counts"])) for r in hard]), np.array([label[r["lang"]] for r in hard]))
    return model


def predict(df: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score for each row. A null text, or one without a letter, is
    ``und`` with score 0, and so is every text if nothing could be learned. Repeated rows are scored
    each; an empty table gives an empty result."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = picked(df, keep, text_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, _, _ in blocks(batches):
            found = [shared.value.predict(t) for t in block.column(len(keep)).to_pylist()]
            yield {f"k{i}": block.column(i) for i in range(len(keep))} | {"lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return in_arrow(rows, run, T.StructType([*rows.schema.fields[:-1], *made])).toDF(*keep, "lang_pred", "score")
