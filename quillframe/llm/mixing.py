"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule of weight over training time t in [0, 1], given at knots and linear
between them. Its integral up to t, scaled to the source's target, is the number of words the
mix has demanded from the source by t. A document copy covers an interval of its source's word
line; the training position is the time at which the demand reaches the interval's middle,
found by inverting the piecewise quadratic demand. Documents are then range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import Scratch, columns_of, in_arrow, unit_hash
from quillframe.llm.ranking import running_sum

#: Times a document may be taken at most.
MAX_REPEATS = 3
#: Sources that a mix may name; their totals and schedules fit in the driver. More is an error.
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def cycled_weights(i: int, _name: str | None) -> float:
    return (5.0, 2.0, 1.0)[i % 3]


def ramp(weight: float) -> list[tuple[float, float]]:
    """Knots (t, weight): heavy sources fade from 1.5 to 0.5 times their weight, light ones rise, others stay."""
    first = 1.5 if weight >= 5 else 0.5 if weight <= 1 else 1.0
    return [(0.0, weight * first), (0.5, weight), (1.0, weight * (2 - first))]


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MAX_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; what exceeds most times a size is shared again by weight among the others."""
    total, capped = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        for i, (s, w) in enumerate(zip(sizes, weights, strict=True)):
            out[i] = most * s if capped[i] else left * w / weight
        over = [i for i, s in enumerate(sizes) if not capped[i] and out[i] > most * s]
        if not over:
            return out
        for i in over:
            capped[i] = True


class Demand:
    """Cumulative demand of one source, and its inverse."""

    def __init__(self, knots: Sequence[tuple[float, float]], target: float):
        self.t, self.w = (np.array(x, float) for x in zip(*knots, strict=True))
        area = np.diff(self.t) * (self.w[1:] + self.w[:-1]) / 2
        scale = target / area.sum() if area.sum() else 0.0
        self.w = self.w * scale
        self.cum = np.concatenate([[0.0], np.cumsum(area * scale)])

    def position(self, x: np.ndarray) -> np.ndarray:
        """The t at which the demand is x."""
        k = np.clip(np.searchsorted(self.cum, x, side="right") - 1, 0, len(self.t) - 2)
        rest, width = np.maximum(x - self.cum[k], 0), self.t[k + 1] - self.t[k]
        a, b = (self.w[k + 1] - self.w[k]) / (2 * width), self.w[k]
        root = np.sqrt(np.maximum(b * b + 4 * a * rest, 0))
        with np.errstate(invalid="ignore", divide="ignore"):  # 0 / 0 where nothing is demanded
            step = np.where(b + root > 0, 2 * rest / (b + root), 0.0)
        return self.t[k] + np.clip(step, 0, width)


def mix_sources(df: DataFrame, scratch: Scratch, weights: Callable[[int, str | None], float] = cycled_weights, schedule: Callable[[float], list[tuple[float, float]]] = ramp, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 8) -> DataFrame:
    """One row for each row of df: doc_id, source, size (words), source_size, target, taken, and
    copies, an array of (epoch, taken, position), one for each time the document is taken.

    Documents of a source are taken in a hashed order, whole, pass after pass, until the target is
    reached; the last one is cut there, so a source's sum is its target rounded down. A source can
    be null (last in order). A null or empty text has size 0 and is never taken. Repeated rows
    count each; null ids come first among equal hashes. Other columns, whatever their names, are not
    read. An empty table gives an empty result.
    """
    rows = scratch.keep(
        columns_of(df, doc_id=id_col, text=text_col, source=source_col).select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), unit_hash(F.col("doc_id"), seed=seed).alias("u")
        )
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # By code point (Python's own order of strings), null last.
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    of_source = [weights(i, r["source"]) for i, r in enumerate(sums)]
    goal = targets([r["n"] for r in sums], of_source) if sums else []
    plan = {r["source"]: (r["n"], t, schedule(w)) for r, t, w in zip(sums, goal, of_source, strict=True)}
    placed = running_sum(rows, scratch, ["source"], ["u", "doc_id", "size"], "size", "start")

    def place(batches):
        known = {s: (n, t, Demand(knots, t)) for s, (n, t, knots) in plan.items()}
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            size, start, codes = cols["size"].to_numpy(), cols["start"].to_numpy(), cols["source"].dictionary_encode()
            names = [*codes.dictionary.to_pylist(), None]
            code = codes.indices.fill_null(len(names) - 1).to_numpy()
            by_source = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[by_source], np.arange(len(names) + 1))
            own, goal, took = np.zeros(len(size), np.int64), np.zeros(len(size)), np.zeros((len(size), MAX_REPEATS), np.int64)
            where = np.zeros((len(size), MAX_REPEATS))
            for i, s in enumerate(names):
                at = by_source[ends[i] : ends[i + 1]]
                if not len(at):
                    continue
                total, target, demand = known[s]
                own[at], goal[at] = total, target
                for e in range(MAX_REPEATS):
                    begin = e * total + start[at]
                    took[at, e] = np.clip(int(target) - begin, 0, size[at])
                    where[at, e] = demand.position(begin + took[at, e] / 2)
            row, epoch = np.nonzero(took)
            each = pa.StructArray.from_arrays([pa.array(epoch, pa.int32()), pa.array(took[row, epoch]), pa.array(where[row, epoch])], ["epoch", "taken", "position"])
            copies = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(size) + 1)), pa.int32()), each)
            yield {"doc_id": cols["doc_id"], "source": cols["source"], "size": size, "source_size": own, "target": goal, "taken": took.sum(1), "copies": copies}

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(placed.drop("u"), place, f"doc_id {kind}, source string, size long, source_size long, target double, taken long, copies array<struct<epoch:int,taken:long,position:double>>")


def arrange(mixed: DataFrame) -> DataFrame:
    """The training order: one row for each copy, range-sorted by position."""
    copies = mixed.select("doc_id", "source", "size", F.explode("copies").alias("copy")).select("doc_id", "source", "size", "copy.*")
    return copies.repartitionByRange("position").sortWithinPartitions("position", "doc_id", "epoch")
