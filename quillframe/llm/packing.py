"""Vector bin packing of examples into sequences, by the dot-product heuristic.

An example is a run of token ids, of which those from ``prompt`` on bear loss. A sequence is a
bin with three limits at once: tokens, segments and loss-bearing tokens. A bin is filled by
taking, again and again, the unplaced example that fits and whose demand vector has the largest
dot product with what the bin has left. When none fits and there is room, the largest is cut to
fill it; examples may be cut anywhere.

Each task packs its own rows in blocks of a fixed number of examples, so nothing is shuffled and
memory does not grow with the table. A block leaves at most a bin or so unfilled. The price is
that sequence ids, though unique and the same on every run over the same file splits, are not
gapless. Where rows say which place they have in a written table, ids rise with that place from
block to block, whichever task reads which file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillframe.llm.common import blocks, columns_of, in_arrow
from quillframe.llm.tokens import Encoder

END_ID = 1
#: Bits of an ordered sequence id for the block's first row and for the sequence in the block; the file has the others.
ROW_BITS, SEQUENCE_BITS = 24, 19
LIMITS = {"tokens": 2048, "segments": 64, "loss_tokens": 2048}


def pack(lengths: np.ndarray, prompts: np.ndarray, tokens: int, segments: int, loss_tokens: int) -> list[list[tuple[int, int, int]]]:
    """Bins as lists of pieces (example, start, length). Example i has lengths[i] tokens; the first
    prompts[i] of them bear no loss. Every token is in exactly one piece."""
    n = len(lengths)
    start, left = np.zeros(n, np.int64), lengths.astype(np.int64).copy()
    prompts = np.asarray(prompts, np.int64)
    loss = np.maximum(0, lengths - np.minimum(prompts, lengths)).astype(np.int64)
    open_ = left > 0
    bins: list[list[tuple[int, int, int]]] = []

    def cut(i: int, k: int) -> tuple[int, int, int]:
        piece = (i, int(start[i]), k)
        start[i] += k
        left[i] -= k
        loss[i] = max(0, start[i] + left[i] - max(start[i], prompts[i]))
        open_[i] = left[i] > 0
        return piece

    # What fills a bin by itself goes first; this leaves less than a bin of every example.
    for i in np.flatnonzero(left >= tokens):
        while left[i] >= tokens:
            k = _longest(int(start[i]), tokens, int(prompts[i]), loss_tokens)
            bins.append([cut(int(i), k)])
    todo = np.flatnonzero(open_)
    while len(todo):
        room, room_loss, held = tokens, loss_tokens, []
        while room and len(held) < segments and len(todo):
            t, l = left[todo], loss[todo]
            fits = (t <= room) & (l <= room_loss)
            if fits.any():
                # The shares of a bin that an example takes, against the shares still free.
                free = segments - len(held)
                value = (t / tokens) * (room / tokens) + (1 / segments) * (free / segments) + (l / loss_tokens) * (room_loss / loss_tokens)
                at = int(np.argmax(np.where(fits, value, -1.0)))
                i = int(todo[at])
                k = int(left[i])
            else:
                at = int(np.argmax(t))
                i = int(todo[at])
                k = _longest(int(start[i]), min(room, int(left[i])), int(prompts[i]), room_loss)
                if k == 0:  # no loss-bearing token has room; prompts of others may
                    break
            before = int(loss[i])
            held.append(cut(i, k))
            room, room_loss = room - k, room_loss - (before - int(loss[i]))
            if not open_[i]:
                todo = np.delete(todo, at)
        bins.append(held)
    return bins


def _longest(start: int, room: int, prompt: int, room_loss: int) -> int:
    """Most tokens from start within both limits."""
    return min(room, max(0, prompt - start) + room_loss)


def _ordered(file: int, row: int) -> int:
    """Id of the first sequence of the block that begins with this row."""
    if not (0 <= file < 1 << 63 - ROW_BITS - SEQUENCE_BITS and 0 <= row < 1 << ROW_BITS):
        raise ValueError(f"row {row} of file {file} is out of the range of ordered ids")
    return (file << ROW_BITS | row) << SEQUENCE_BITS


def _consecutive(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows that follow each other in a file."""
    file, row = (block.column(block.schema.get_field_index(c)).to_numpy() for c in ("file", "row"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(row) != 1)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
        yield block.slice(a, b - a)


def pack_documents(df: DataFrame, tokenizer: str, tokens: int = LIMITS["tokens"], segments: int = LIMITS["segments"], loss_tokens: int = LIMITS["loss_tokens"], examples: int = 4096, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, order_cols: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids, with with_ids).

    A text is encoded whole, then END_ID is added; a null or empty text is END_ID alone. prompt_col
    gives the number of leading tokens without loss (null: 0). order_cols name the number of a row's
    file and of the row in it, whole numbers that no two rows share: a block then holds consecutive rows
    of a file, and sequence ids rise with (file, first row) of their block. More than 2^20 files, 2^24 rows
    of a file or 2^19 sequences of a block are then an error. Repeated rows are packed each. An empty
    table gives an empty result.
    """
    names = {"doc_id": id_col, "text": text_col} | ({"prompt": prompt_col} if prompt_col else {}) | (dict(zip(("file", "row"), order_cols, strict=True)) if order_cols else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, made, part = Encoder.at(tokenizer), 0, TaskContext.get().partitionId()
        doc_ids, ids, prompts = [], [], []
        first, after = (0, 0), None  # place of the block's first row, and of the row that would continue the block

        def flush() -> dict:
            nonlocal made, doc_ids, ids, prompts
            base, made = (_ordered(*first), 0) if order_cols else (part << 33, made)
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for held in pack(lengths, np.array(prompts, np.int64), tokens, segments, loss_tokens):
                at = 0
                for i, s, k in held:
                    piece = ids[i][4 * s : 4 * (s + k)]
                    for name, x in zip(out, (doc_ids[i], s, k, zlib.crc32(piece), int(lengths[i]), base + made, at, piece), strict=True):
                        out[name].append(x)
                    at += k
                made += 1
            if order_cols and made >> SEQUENCE_BITS:
                raise ValueError("a block has too many sequences for ordered ids")
            if with_ids:
                out["ids"] = [np.frombuffer(x, "<u4").astype(np.int32) for x in out["ids"]]
            doc_ids, ids, prompts = [], [], []
            return out

        held = 0
        for rows in (r for block, _, _ in blocks(batches) for r in (_consecutive(block) if order_cols else [block])):
            cols = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
            if order_cols:
                here = cols["file"][0].as_py(), cols["row"][0].as_py()
                if ids and here != after:
                    held = 0
                    yield flush()
                first, after = first if ids else here, (here[0], here[1] + len(rows))
            more = [x + END_ID.to_bytes(4, "little") for x in encoder.ids(cols["text"].to_pylist())]
            doc_ids += cols["doc_id"].to_pylist()
            ids += more
            prompts += [x or 0 for x in cols["prompt"].to_pylist()] if prompt_col else [0] * len(more)
            held += sum(map(len, more))
            if len(ids) >= examples or held >= 64 << 20:
                held = 0
                yield flush()
        if ids:
            yield flush()

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(columns_of(df, **names), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else ""))
