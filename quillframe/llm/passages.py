"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded; gated attention,
learned from document labels alone, weighs the passages; the weighted representation is scored.
Training runs on the driver, on a bounded sample of labelled documents whose passage features the
executors compute. Scoring is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import blocks, columns_of, in_arrow, picked, row_of, unit_hash, words

PASSAGE = 64
CELLS = 192
#: Labelled documents that a model is fitted on, and passages of one of those, at most. Scoring reads all.
MAX_LABELLED, MAX_PASSAGES = 4000, 64
HIDDEN, ATTENTION = 32, 16

_KIND = np.zeros(256, np.int64)  # kinds of bytes: other, lower, upper, digit, beyond ASCII, end of sentence, symbol
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4
_KIND[list(b".,;:'\"()-")] = 5
_KIND[list(b"#*$%&|<>!@=_{}[]/\\^~`+?")] = 6
KINDS = 7
FEATURES = CELLS + KINDS + 6


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a block, and each passage's row. A text without words has one empty passage."""
    n = len(offsets) - 1
    starts, ends, of = words(data, offsets)
    first = np.searchsorted(of, np.arange(n))
    rank = np.arange(len(of)) - first[of] if len(of) else np.zeros(0, np.int64)
    per_row = np.maximum(1, -(-np.bincount(of, minlength=n) // PASSAGE))
    base = np.concatenate([[0], np.cumsum(per_row)])
    rows = np.repeat(np.arange(n), per_row)
    passage = base[of] + rank // PASSAGE
    p = int(base[-1])
    out = np.zeros((p, FEATURES), np.float32)
    if not len(data):
        return out, rows
    owner = row_of(offsets, np.arange(len(data)))
    mine = base[owner]  # where a text is white space only
    if len(starts):
        # Bytes between words belong to the passage of the word before; those in front of a text's first word, to its first passage.
        word = np.searchsorted(starts, np.arange(len(data)), side="right") - 1
        after = (word >= 0) & (of[word] == owner)
        mine[after] = passage[word[after]]
    length = np.maximum(np.bincount(mine, minlength=p), 1)
    pairs = mine[1:] == mine[:-1]
    cell = (((data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % CELLS
    out[:, :CELLS] = np.sqrt(np.bincount(mine[1:][pairs] * CELLS + cell[pairs], minlength=p * CELLS).reshape(p, CELLS) / length[:, None])
    out[:, CELLS : CELLS + KINDS] = np.bincount(mine * KINDS + _KIND[data], minlength=p * KINDS).reshape(p, KINDS) / length[:, None]
    count = np.maximum(np.bincount(passage, minlength=p), 1)
    size = ends - starts
    last = _KIND[data[ends - 1]]
    for k, x in enumerate((size / 8, (size > 12), _KIND[data[starts]] == 2, last == 5, last == 6)):
        out[:, CELLS + KINDS + k] = np.bincount(passage, x, minlength=p) / count
    out[:, -1] = np.bincount(mine, data == 0x0A, minlength=p) / count
    return out, rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Encoder W, attention V and gate U with weights a, head c; a document is the attention-weighted mean of its codes."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, rows: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["w0"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, rows, e)
        e = np.exp(e - top[rows])
        weight = e / np.bincount(rows, e, minlength=n)[rows]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, rows, weight[:, None] * h)
        return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "score": _sigmoid(z @ p["c"] + p["c0"][0])}

    def score(self, x: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return self._forward(x, rows, n)["score"]

    def gradients(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        f, p = self._forward(x, rows, len(y)), self.p
        d = (f["score"] - y) * weight / weight.sum()
        dz = d[:, None] * p["c"][None, :]
        dh = f["weight"][:, None] * dz[rows]
        gain = (f["h"] * dz[rows]).sum(1)
        de = f["weight"] * (gain - np.bincount(rows, f["weight"] * gain, minlength=len(y))[rows])
        dtg = de[:, None] * p["a"][None, :]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {"W": ((x - self.mean) / self.scale).T @ dpre, "w0": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "c0": np.array([d.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 5) -> AttentionModel | None:
    """Adam on the log loss of documents; classes weigh the same. None if the labels have one class only."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags)
    shapes = {"W": (FEATURES, HIDDEN), "w0": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "c0": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("w0", "c0") else np.zeros(s) for k, s in shapes.items()}
    model = AttentionModel(everything.mean(0, dtype=np.float64), everything.std(0, dtype=np.float64) + 0.02, p)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weights = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), batch):
            chosen = order[at : at + batch]
            x = np.concatenate([bags[i] for i in chosen]).astype(np.float64)
            rows = np.repeat(np.arange(len(chosen)), [len(bags[i]) for i in chosen])
            step += 1
            for k, g in model.gradients(x, rows, labels[chosen], weights[chosen]).items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(df: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_passages: int = MAX_PASSAGES, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel | None:
    """Fits on the labelled rows of df: the max_labelled first ids by hash, of whose passages max_passages
    at most, evenly spaced, go into the fit. What reaches the driver is thus no more than max_labelled *
    max_passages * FEATURES * 4 bytes: 209 MB as it is set, 13 MB as a rule.

    Labels other than 0 and 1, null ids and ids with both labels are ignored. Ids are compared as text.
    Of several texts of one id the first by code point counts, null as empty. None if there are no
    documents with labels of both kinds.
    """
    clean = labels.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    one = clean.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).filter("y = y1")
    known = {r["id"]: r["y"] for r in one.orderBy(unit_hash(F.col("id"), seed=seed), "id").limit(max_labelled).select("id", "y").collect()}
    if not known:
        return None
    chosen = df.sparkSession.createDataFrame([(i,) for i in known], "chosen string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, data, offsets in blocks(batches):
            x, rows = features(data, offsets)
            bounds = np.searchsorted(rows, np.arange(len(block) + 1))
            bags = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                n = min(b - a, max_passages)
                bags.append(x[a + np.arange(n) * (b - a) // n].tobytes())
            yield {"id": block.column(0), "x": bags}

    # max_labelled ids at most: small enough to broadcast at any input size.
    rows = columns_of(df, id=id_col, text=text_col).select(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    taken = rows.join(F.broadcast(chosen), F.col("id") == F.col("chosen"), "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    found = {r["id"]: (r["x"], known[r["id"]]) for r in in_arrow(taken, run, "id string, x binary").collect()}
    keys = sorted(found)
    return fit([np.frombuffer(found[k][0], np.float32).reshape(-1, FEATURES) for k in keys], np.array([found[k][1] for k in keys]))


def score(df: DataFrame, model: AttentionModel | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns and score (0 to 1) for each row. A null text counts as empty; a text without words
    is one empty passage. Without a model every score is 0.5. Repeated rows are scored each; an empty
    table gives an empty result."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = picked(df, keep, text_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, data, offsets in blocks(batches):
            if shared.value is None:
                found = np.full(len(block), 0.5)
            else:
                x, of = features(data, offsets)
                found = shared.value.score(x, of, len(block))
            yield {f"k{i}": block.column(i) for i in range(len(keep))} | {"score": found}

    return in_arrow(rows, run, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])).toDF(*keep, "score")
