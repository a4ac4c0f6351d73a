"""Exact removal of repeated byte strings by suffix order.

Every window of WINDOW bytes chooses an anchor: of its GRAM-byte substrings, the one with the least
hash. The choice depends on the window's bytes alone, so equal windows, wherever they are, have equal
anchors. A text falls into runs of windows with the same anchor; the bytes under a run are a segment.
Windows need only be compared within an anchor, which is what makes the suffix sort distributed:

1. A pass over the texts gives (anchor, segment hash) of every run; equal segments are counted first.
   The windows of a segment that occurs twice repeat as a whole.
2. Where an anchor has several different segments, one of each is fetched and the anchors are dealt
   to partitions. There the difference-cover algorithm sorts all suffixes of the segments (sampled
   triples, recursion on names, merge of the rest), and neighbours in that order are compared over
   WINDOW bytes.
3. An anchor with more than HOT_BYTES of different segments, as a very common line can have, would be
   one task's work. Its windows are dealt by their own hash instead; equal ones meet and are counted.

All three are exact for windows (hashes that decide equality have 128 bits), every window takes one
of them, and none needs a task that holds an unbounded group.

Where repeats of two lengths are asked for, the shorter windows are searched in all texts. Every window
of a longer string that repeats repeats too, so the longer ones are then searched only inside the runs
that the shorter ones cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import Scratch, SpanHashes, blocks, columns_of, in_arrow, join_hot, spread
from quillframe.llm.suffixes import agree, order

WINDOW = 400
GRAM = 200
#: Bytes of a shorter repeat, about 50 short words, and the anchors' length for it.
PASSAGE, PASSAGE_GRAM = 256, 100
HOT_BYTES = 8 << 20
#: Bytes that one suffix sort takes, but for an anchor that alone has more.
SORT_BYTES = 1 << 20
#: Longest stretch of a block that is scanned at once; longer texts are scanned in overlapping stretches.
STRETCH = 1 << 23


def _least_in_window(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: the anchor's hash, first window's start, and the segment's end."""
    out = []
    for begin in range(0, max(1, len(data) - window + 1), STRETCH):
        part = data[begin : begin + STRETCH + window - 1]
        if len(part) < window:
            continue
        spans = SpanHashes(part)
        h = spans.rolling(gram)
        # 40 bits of hash, then the position: of equal ones the first.
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        anchor = (_least_in_window(key, window - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        inside = np.ones(len(anchor), bool)
        for end in offsets[1:][(offsets[1:] > begin) & (offsets[1:] < begin + len(part))]:
            inside[max(0, end - begin - window + 1) : end - begin] = False  # these windows would reach into the next text
        start = np.flatnonzero(inside)
        if not len(start):
            continue
        mine = anchor[start]
        new = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(start)]]) - 1
        out.append((h[mine[new]], start[new] + begin, start[last] + begin + window))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _runs_inside(spans: pa.ListArray, data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As runs, of the windows that lie within one of their text's spans; the spans' bytes alone are read."""
    first, last = (x.to_numpy() + np.repeat(offsets[:-1], spans.value_lengths().to_numpy()) for x in spans.flatten().flatten())
    first, last = first[last - first >= window], last[last - first >= window]
    base = np.concatenate([[0], np.cumsum(last - first)])
    inside = np.concatenate([data[:0], *(data[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True))])
    anchors, starts, ends = runs(inside, base, window, gram)
    moved = (first - base[:-1])[np.searchsorted(base, starts, side="right") - 1]
    return anchors, starts + moved, ends + moved


def _list_runs(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """rows: doc_id and text; with a third column, spans, only windows within one of them are listed."""
    within = len(rows.columns) > 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, data, offsets in blocks(batches):
            anchors, starts, ends = _runs_inside(block.column(2), data, offsets, window, gram) if within else runs(data, offsets, window, gram)
            view = memoryview(data.tobytes())
            of = np.searchsorted(offsets, starts, side="right") - 1
            keys = {i: hashlib.md5(view[offsets[i] : offsets[i + 1]]).digest() for i in np.unique(of)}
            yield {
                "anchor": anchors.view(np.int64),
                "segment": [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
                "text_key": [keys[i] for i in of],
                "doc_id": block.column(0).take(pa.array(of)),
                "start": starts - offsets[of],
                "n": ends - starts,
            }

    return in_arrow(rows, run, f"anchor long, segment binary, text_key binary, doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, n long")


def _sort_segments(reps: DataFrame, window: int) -> DataFrame:
    """reps: anchor, text_key, start, times and the segment's bytes, all of an anchor in one partition
    and in order of anchor. Gives the runs of repeated windows of the segments that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if held and held[-1][:3] == row[:3]:  # of a repeated row
                    continue
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield from emit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield from emit(held)

    def emit(held: list[tuple]) -> Iterator[dict]:
        if not held:
            return
        lengths = np.array([len(r[4]) for r in held])
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        # Bytes count from 2; 1 stands between segments.
        flat = np.frombuffer(b"\x00".join(r[4] for r in held) + b"\x00", np.uint8)
        symbols = flat.astype(np.int16) + 2
        symbols[base[1:] - 1] = 1
        starts_here = np.zeros(len(flat), bool)
        for b, n in zip(base[:-1], lengths, strict=True):
            starts_here[b : b + n - window + 1] = True
        sorted_starts = order(symbols, 258, window)
        sorted_starts = sorted_starts[starts_here[sorted_starts]]
        same = agree(flat, sorted_starts[:-1], sorted_starts[1:], window)
        repeated = np.zeros(len(flat) + 1, bool)
        repeated[sorted_starts[:-1][same]] = repeated[sorted_starts[1:][same]] = True
        edge = np.flatnonzero(repeated[1:] != repeated[:-1]) + 1
        edge = np.concatenate([[0], edge]) if repeated[0] else edge
        first, end = edge[::2], edge[1::2]  # runs of repeated window starts; one never crosses a segment's end
        of = np.searchsorted(base, first, side="right") - 1
        once = np.array([r[3] == 1 for r in held])[of]
        first, end, of = first[once], end[once], of[once]
        begin = np.array([r[2] for r in held], np.int64)[of] + first - base[of]
        yield {"text_key": [held[i][1] for i in of], "start": begin, "end": begin + (end - first) + window - 1}

    return in_arrow(reps, run, "text_key binary, start long, end long")


def find_repeats(df: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, hot_bytes: int = HOT_BYTES, id_col: str = "doc_id", text_col: str = "text", within: DataFrame | None = None) -> DataFrame:
    """text_key (md5 of the text's bytes) and spans, an array of (start, end) in bytes: the maximal runs of
    what the repeated windows of that text cover. Texts without one have no row.

    within: the result for a shorter window over the same df, which holds every repeat of this one; the
    search is then confined to it."""
    rows = columns_of(df, doc_id=id_col, text=text_col)
    texts = rows.filter(F.octet_length("text") >= window).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    if within is None:
        listed = scratch.keep(_list_runs(rows, window, gram))
    else:
        long = within.filter(F.exists("spans", lambda s: s["end"] - s["start"] >= window))
        listed = scratch.keep(_list_runs(texts.join(long, F.col("key") == F.col("text_key")).select("doc_id", "text", "spans"), window, gram))
    kinds = scratch.keep(listed.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("text_key", "doc_id", "start", "n")).alias("rep")))
    again = kinds.filter("times > 1").select(F.col("anchor").alias("a"), F.col("segment").alias("s"), "times")
    whole = join_hot(listed, again, {"anchor": "a", "segment": "s"}, "times", listed.count())
    marks = scratch.keep(whole.select("text_key", "start", (F.col("start") + F.col("n")).alias("end")))
    scratch.drop(listed)

    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("rep.n").alias("bytes")).filter("kinds > 1").select(F.col("anchor").alias("a"), (F.col("bytes") > hot_bytes).alias("hot"))
    wanted = kinds.join(several, F.col("anchor") == F.col("a")).select("rep.text_key", "rep.doc_id", F.struct("anchor", "rep.start", "rep.n", "times", "hot").alias("r"))
    # As many entries as a text has runs at most.
    by_text = scratch.keep(wanted.groupBy("text_key", "doc_id").agg(F.collect_list("r").alias("wanted")))
    scratch.drop(kinds)
    found = by_text.join(texts.withColumnRenamed("doc_id", "id"), (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("text_key", "text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, data, offsets in blocks(batches):
            view = memoryview(data.tobytes())
            out: dict[str, list] = {k: [] for k in ("anchor", "text_key", "start", "times", "bytes", "hot", "segment")}
            for i, (key, wanted) in enumerate(zip(block.column(0).to_pylist(), block.column(2).to_pylist(), strict=True)):
                for r in wanted:
                    begin = int(offsets[i]) + r["start"]
                    if r["hot"]:
                        for w in range(r["n"] - window + 1):
                            digest = xxhash.xxh3_128_digest(view[begin + w : begin + w + window])
                            for name, x in zip(out, (0, key, r["start"] + w, r["times"], None, True, digest), strict=True):
                                out[name].append(x)
                    else:
                        for name, x in zip(out, (r["anchor"], key, r["start"], r["times"], bytes(view[begin : begin + r["n"]]), False, None), strict=True):
                            out[name].append(x)
            yield out

    pieces = scratch.keep(in_arrow(found, cut, "anchor long, text_key binary, start long, times long, bytes binary, hot boolean, segment binary"))
    scratch.drop(by_text)
    dealt = pieces.filter("NOT hot").select("anchor", "text_key", "start", "times", "bytes")
    dealt = dealt.repartition(spread(scratch.spark), "anchor").sortWithinPartitions("anchor", "text_key", "start")
    sorted_ = _sort_segments(dealt, window)
    single = pieces.filter("hot").select("segment", "text_key", "start").distinct()
    twice = single.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("segment").alias("s"))
    by_window = single.join(twice, F.col("segment") == F.col("s")).select("text_key", "start", (F.col("start") + F.lit(window)).alias("end"))
    every = marks.unionByName(sorted_).unionByName(by_window).distinct()
    spans = scratch.keep(_merge_spans(every, scratch))
    scratch.drop(pieces, marks)
    return spans


def _merge_spans(every: DataFrame, scratch: Scratch) -> DataFrame:
    """text_key, spans: what the rows (text_key, start, end) cover, as a text's maximal runs."""
    dealt = every.repartition(spread(scratch.spark), "text_key").sortWithinPartitions("text_key", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, spans = None, []
        for batch in batches:
            out: dict[str, list] = {"text_key": [], "spans": []}
            for key, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != now:
                    if spans:
                        out["text_key"].append(now)
                        out["spans"].append(spans)
                    now, spans = key, []
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], end)
                else:
                    spans.append({"start": start, "end": end})
            yield out
        if spans:
            yield {"text_key": [now], "spans": [spans]}

    return in_arrow(dealt, run, "text_key binary, spans array<struct<start:long,end:long>>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def whole_characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without a character that it covers only in part."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def remove_repeats(df: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, hot_bytes: int = HOT_BYTES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), passages: tuple[int, int] | None = None) -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text;
    with keep, those columns of df in front; with passages, passage_bytes and n_passages behind.

    Removes each byte of a text that lies under a string of window bytes which also starts anywhere
    else in the table, in the same text too. Null counts as an empty text; texts shorter than window
    lose nothing; equal texts of window bytes or more, repeated rows among them, lose everything.
    kept_text leaves characters whole: it keeps one of which only some bytes repeat. n_removed and
    kept_sha256 go by bytes. An empty table gives an empty result.

    passages, a shorter window and its gram, also reports the repeats of that length: how many bytes of
    the text lie under them, and in how many maximal runs. Nothing is removed for them.
    """
    if passages and passages[0] > window:
        raise ValueError(f"passages of {passages[0]} bytes are longer than the window of {window}")
    if passages:
        shorter = find_repeats(df, scratch, *passages, hot_bytes, id_col, text_col)
        spans = find_repeats(df, scratch, window, gram, hot_bytes, id_col, text_col, shorter)
        spans = shorter.select(F.col("text_key").alias("of"), F.col("spans").alias("passages")).join(spans, F.col("of") == F.col("text_key"), "left").drop("text_key")
    else:
        spans = find_repeats(df, scratch, window, gram, hot_bytes, id_col, text_col).withColumnRenamed("text_key", "of")
    found_in = ["spans", "passages"] if passages else ["spans"]
    own = [f"k{i}" for i in range(len(keep))]
    rows = columns_of(df, doc_id=id_col, text=text_col, **dict(zip(own, keep, strict=True)))
    rows = rows.withColumn("key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    joined = rows.join(spans, F.col("key") == F.col("of"), "left").select("doc_id", "text", *found_in, *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, data, offsets in blocks(batches):
            out: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept_text")}
            for i, found in enumerate(block.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                cut = merged([(s["start"], s["end"]) for s in found or []])
                kept, whole, at, to = [], [], 0, 0
                for a, b in cut:
                    kept.append(text[at:a])
                    at = b
                    a, b = whole_characters(text, a, b)
                    whole.append(text[to:a])
                    to = b
                kept, whole = b"".join([*kept, text[at:]]), b"".join([*whole, text[to:]])
                for name, x in zip(out, (len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), whole.decode()), strict=True):
                    out[name].append(x)
            if passages:
                shorter = [[s["end"] - s["start"] for s in found or []] for found in block.column(3).to_pylist()]
                out |= {"passage_bytes": [sum(x) for x in shorter], "n_passages": [len(x) for x in shorter]}
            yield {c: block.column(2 + len(found_in) + i) for i, c in enumerate(own)} | {"doc_id": block.column(0), "n_bytes": np.diff(offsets)} | out

    made = T.StructType([*[T.StructField(n, df.schema[c].dataType) for n, c in zip(own, keep, strict=True)], T.StructField("doc_id", df.schema[id_col].dataType)])
    results = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "kept_text": T.StringType()}
    if passages:
        results |= {"passage_bytes": T.LongType(), "n_passages": T.LongType()}
    for name, kind in results.items():
        made = made.add(name, kind)
    return in_arrow(joined, run, made).toDF(*keep, "doc_id", *results)
