"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

One pass over the texts sketches each shingle set: BANDS * ROWS minima, of which a band's give the
band's key and the low BITS bits of all are packed into a signature. Texts with the same set form a
class; classes that share a band's key are candidates. No rows are made of the pairs of a bucket:

1. In every bucket each class is paired with one leader. Of a class's leaders the one with the best
   signature estimate is tested on the full sets, and the links found give components.
2. What that leaves open goes round by round. A class outside its bucket's largest component meets the
   bucket in blocks of signatures, in memory, and names its best few candidates in other components.
   Those are tested, components grow, and who had more candidates takes up where it left off, with
   longer lists. A class is done when no untested candidate in another component is left.
3. Tests go by chunks of classes: a chunk's texts and the texts that ask for them meet in one task,
   which passes over pairs that its own links have joined already. Chunks are bounded in classes and
   bytes, and one that many ask for is dealt to several tasks.

So the components are those of all candidate pairs, whatever the sizes of buckets and groups, while a
round's rows grow with classes and memory with the fixed sizes of blocks and chunks.

Estimates count equal bits of packed signatures, corrected for chance collisions: a lane of BITS bits
agrees with probability J + (1 - J) / 2^BITS. The LANES minima of the first signature only pass over
pairs more than MARGIN below the threshold, five standard errors. Pairs that remain are judged by a
second signature, low bits of the minima in WIDE parts of the hashes' range. The hashes that it samples
of a union are a random choice without replacement, so that its five standard errors shrink with the
sets, and what it leaves for full sets is little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import LOWER, Scratch, SpanHashes, blocks, columns_of, in_arrow, mix, spread, windows, words
from quillframe.llm.components import connected

BANDS, ROWS, BITS = 24, 4, 4
LANES = BANDS * ROWS
MARGIN = 0.2
#: Lanes of the second signature, of BITS bits: 0 where its part of the range holds no hash, else 1 to 15.
WIDE = 512
#: Classes that a block of a bucket holds, that a task streams past it, and that a chunk of texts holds.
BLOCK, STREAM, CHUNK = 2048, 1 << 16, 1024
#: Bytes of texts in a chunk, and of the texts that ask for it in one task, but for a longer single text.
CHUNK_BYTES = 8 << 20
#: Candidates that a class names in the first round, by how much later rounds have more, and the most.
FIRST, MORE, MOST = 8, 16, 1024
_LANE = 0x1111111111111111


@dataclass(frozen=True)
class Rule:
    """Link texts whose sets of shingles of ``words`` words have intersection * den >= union * num."""

    words: int = 5
    num: int = 80
    den: int = 100


_RANDOM = np.random.default_rng(20230917)
_FACTORS = _RANDOM.integers(0, 2**64, (LANES, 1), dtype=np.uint64) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**64, (LANES, 1), dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer than n words make one shingle, none make none."""
    lower = LOWER[data]
    starts, ends, of = words(lower, offsets)
    hashes = SpanHashes(lower).of(starts, ends)
    found, at = windows(hashes, of, n)
    bounds = np.searchsorted(of[at], np.arange(len(offsets)))
    first = np.searchsorted(of, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        count = first[i + 1] - first[i]
        if 0 < count < n:
            mine = hashes[first[i] : first[i + 1]]
            out.append(windows(mine, np.zeros(count, np.int64), count)[0] + np.uint64(count))
        else:
            out.append(np.unique(found[bounds[i] : bounds[i + 1]]))
    return out


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the packed low bits of the minima."""
    minima = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        minima = np.minimum(minima, (shingles[None, at : at + 4096] * _FACTORS + _TERMS).min(axis=1))
    minima >>= np.uint64(32)  # the high half is what multiply-shift hashing spreads well
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[r::ROWS])
    low = (minima & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return key.view(np.int64), packed.view(np.int64)


def sketch(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (of equal sets; null for the empty set), text_key, bands, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, data, offsets in blocks(batches):
            out: dict[str, list] = {k: [] for k in ("n_shingles", "class_id", "text_key", "bands", "packed")}
            for i, s in enumerate(shingle_sets(data, offsets, rule.words)):
                bands, packed = signature(s) if len(s) else (None, None)
                made = (len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes()).digest(), bands, packed)
                for name, x in zip(out, made, strict=True):
                    out[name].append(x)
            yield {"doc_id": block.column(0)} | out

    rows = columns_of(df, doc_id=id_col, text=text_col)
    return in_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, class_id binary, text_key binary, bands array<long>, packed array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity by the equal lanes of two packed signatures, corrected for chance."""
    differ = F.lit(0)
    for i in range(LANES * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_LANE)))
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(LANES) - F.lit(chance)) / F.lit(1 - chance)


def wide_signature(shingles: np.ndarray) -> bytes:
    """Low bits of the least hash in each of WIDE equal parts of the hashes' range, packed; hashes come sorted."""
    part = (shingles >> np.uint64(64 - WIDE.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    lanes = np.zeros(WIDE, np.uint64)
    lanes[part[first]] = np.uint64(1) + shingles[first] % np.uint64((1 << BITS) - 1)
    return (lanes.reshape(-1, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).astype("<u8").tobytes()


def _filled(wide: np.ndarray) -> np.ndarray:
    """One bit for each lane, set where the lane is not 0."""
    x = wide | wide >> np.uint64(2)
    return (x | x >> np.uint64(1)) & np.uint64(_LANE)


def wide_estimate(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of signatures, pair by pair, and whether it may be as high as least.

    Of the lanes that either fills, those with the same minimum count, less what agrees by chance where
    both fill one. sizes are the sums of both sets' sizes: at similarity least they tell the union's.
    """
    fa, fb = _filled(a), _filled(b)
    either = np.bitwise_count(fa | fb).sum(1, dtype=np.int64)
    both = np.bitwise_count(fa & fb).sum(1, dtype=np.int64)
    differ = np.bitwise_count(_filled(a ^ b)).sum(1, dtype=np.int64)
    chance = 1 / ((1 << BITS) - 1)
    same = both - (differ - (either - both))
    found = (same - both * chance) / (1 - chance)
    union = np.maximum(sizes / (1 + least), either)
    spread_ = either * least * (1 - least) * (union - either) / np.maximum(union - 1, 1) + either * (1 - least) * chance / (1 - chance)
    return found / np.maximum(either, 1), found >= least * either - 5 * np.sqrt(spread_) - 1


def _arena(members: DataFrame, scratch: Scratch) -> DataFrame:
    """band, class_id, inside, blocks, parts: the members of every bucket that lies in several components.

    members: band, class_id, root. Those of the largest component are inside; every other is to meet
    the whole bucket, in one of its blocks. Who meets whom stays as it is here in all rounds.
    """
    sizes = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    bucket = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    blocks_, parts = F.ceil((F.col("n") - F.col("most")) / F.lit(BLOCK)), F.ceil(F.col("n") / F.lit(STREAM))
    open_ = bucket.filter("most < n").select(F.col("band").alias("of"), "main", blocks_.alias("blocks"), parts.alias("parts"))
    rows = members.join(open_, F.col("band") == F.col("of"))
    return scratch.keep(rows.select("band", "class_id", (F.col("root") == F.col("main")).alias("inside"), "blocks", "parts"))


def _meet(arena: DataFrame, live: DataFrame, placed: DataFrame, scratch: Scratch, few: int, rule: Rule) -> DataFrame:
    """a, root, more, found: the few best untested candidates of each live class in each of its buckets.

    live: class_id, last (of the candidates tested so far; null: none). found holds (d, id, chunk) in
    order of d, the estimated distance, then id; more tells that there are others behind them.
    """
    state = placed.select(F.col("class_id").alias("id"), "root", "chunk", "packed", "wide", "n_shingles")
    own = arena.filter("NOT inside").join(live.select(F.col("class_id").alias("asks"), "last"), F.col("class_id") == F.col("asks"))
    own = own.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks"))).select("band", "block", "parts", "inside", "class_id", "last")
    busy = own.select(F.col("band").alias("of"), "block").distinct()
    there = arena.join(busy, F.col("band") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")))
    there = there.select("band", "block", "part", "inside", "class_id", F.lit(None).cast("struct<d:int,id:binary>").alias("last"), F.lit(True).alias("streamed"))
    asking = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asking = asking.select("band", "block", "part", "inside", "class_id", "last", F.lit(False).alias("streamed"))
    both = there.union(asking).join(state, F.col("class_id") == F.col("id"))
    dealt = both.select("band", "block", "part", "streamed", "inside", "class_id", "root", "chunk", "packed", "wide", "n_shingles", F.col("last.d").alias("d"), F.col("last.id").alias("last"))
    dealt = dealt.repartition(spread(scratch.spark), "band", "block", "part").sortWithinPartitions("band", "block", "part", "streamed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, table = None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                rows = batch.slice(at, to - at)
                if not keys[at, 3]:
                    if key is None or (key != keys[at, :3]).any():
                        if table is not None:
                            yield from table.best()
                        key, table = keys[at, :3], _Table(few, rule)
                    table.seat(rows)
                elif key is not None and (key == keys[at, :3]).all():
                    table.meet(rows)
        if table is not None:
            yield from table.best()

    return in_arrow(dealt, run, _NAMED)


def _best_of(met: DataFrame, scratch: Scratch, few: int) -> DataFrame:
    """a, root, chunk, found, more, d, last: for each class that asks, the ids of its few best in all of its
    buckets, a row for each chunk of them; the first row tells whether there are more, behind (d, last)."""
    dealt = met.repartition(spread(scratch.spark), "a").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, root, more, found = None, None, False, {}

        def best() -> dict:
            chosen, by_chunk = sorted(found)[:few], {}
            for x in chosen:
                by_chunk.setdefault(found[x], []).append(x[1])
            n = len(by_chunk)
            return {"a": [now] * n, "root": [root] * n, "chunk": [*by_chunk], "found": [*by_chunk.values()], "more": [more or len(found) > few] + [False] * (n - 1), "d": [chosen[-1][0]] * n, "last": [chosen[-1][1]] * n}

        for batch in batches:
            keys, roots, others = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(3)
            d, ids, chunks = (lists.flatten().field(i).to_pylist() for i in range(3))
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, a in enumerate(keys):
                if a != now:
                    if now is not None:
                        yield best()
                    now, root, more, found = a, roots[i], False, {}
                more |= others[i]
                here = slice(ends[i], ends[i + 1])
                found.update(zip(zip(d[here], ids[here], strict=True), chunks[here], strict=True))
        if now is not None:
            yield best()

    return in_arrow(dealt, run, "a binary, root binary, chunk long, found array<binary>, more boolean, d int, last binary")


_NAMED = "a binary, root binary, more boolean, found array<struct<d:int,id:binary,chunk:long>>"


def _halves(ids: pa.Array) -> np.ndarray:
    """16-byte ids as two numbers that sort like the bytes."""
    return np.frombuffer(b"".join(ids.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)


class _Table:
    """A block of classes, and the best candidates met so far by each."""

    def __init__(self, few: int, rule: Rule):
        self.few, self.rule, self.seats = few, rule, []
        least = rule.num / rule.den - MARGIN
        self.differ = LANES * (1 - least * (1 - 2.0**-BITS) - 2.0**-BITS)  # most lanes of the first signature that may differ

    @staticmethod
    def _read(rows: pa.RecordBatch) -> list:
        packed = np.array(rows.column(8).to_pylist(), np.int64).view(np.uint64)
        wide = np.frombuffer(b"".join(rows.column(9).to_pylist()), "<u8").reshape(len(rows), -1)
        return [_halves(rows.column(5)), _halves(rows.column(6)), packed, wide, rows.column(4).to_numpy(zero_copy_only=False), rows.column(7).to_numpy(), rows.column(10).to_numpy()]

    def seat(self, rows: pa.RecordBatch) -> None:
        last = [x or b"\0" * 16 for x in rows.column(12).to_pylist()]
        self.seats.append([*self._read(rows), rows.column(11).fill_null(-1).to_numpy(), _halves(pa.array(last))])

    def _sit(self) -> None:
        """Once all have come: nobody has met anyone yet."""
        if isinstance(self.seats, list):
            self.seats = tuple(np.concatenate(x) for x in zip(*self.seats, strict=True))
            self.found = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros((0, 2), np.uint64)]  # who, distance, chunk, id
            self.worst = np.full(len(self.seats[0]), np.iinfo(np.int64).max)
            self.more = np.zeros(len(self.seats[0]), bool)

    def meet(self, rows: pa.RecordBatch) -> None:
        self._sit()
        met = self._read(rows)
        ids, roots, packed, _, _, _, size, *_ = self.seats
        for at in range(0, len(rows), 256):
            part = [x[at : at + 256] for x in met]
            other_ids, other_roots, other_packed, _, other_inside, _, other_size = part
            differ = np.zeros((len(ids), len(other_ids)), np.uint8)
            for w in range(packed.shape[1]):
                x = packed[:, w, None] ^ other_packed[None, :, w]
                x |= x >> np.uint64(2)
                x |= x >> np.uint64(1)
                differ += np.bitwise_count(x & np.uint64(_LANE))
            hit = (differ <= self.differ) & (roots[:, None, :] != other_roots[None, :, :]).any(axis=2)
            hit &= self.rule.den * np.minimum(size[:, None], other_size[None, :]) >= self.rule.num * np.maximum(size[:, None], other_size[None, :])
            # Of two classes that are both outside, the one with the less id asks.
            less = (ids[:, None, 0] < other_ids[None, :, 0]) | (ids[:, None, 0] == other_ids[None, :, 0]) & (ids[:, None, 1] < other_ids[None, :, 1])
            i, j = np.nonzero(hit & (other_inside[None, :] | less))
            for cut in range(0, len(i), 1 << 16):
                self._judge(i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)], part)

    def _judge(self, i: np.ndarray, j: np.ndarray, part: list) -> None:
        _, _, _, wide, _, _, size, d, last = self.seats
        other_ids, _, _, other_wide, _, chunks, other_size = part
        similar, near = wide_estimate(wide[i], other_wide[j], size[i] + other_size[j], self.rule.num / self.rule.den)
        far = np.rint((1 - similar) * 10_000).astype(np.int64)
        id_ = other_ids[j]
        behind = (id_[:, 0] > last[i, 0]) | (id_[:, 0] == last[i, 0]) & (id_[:, 1] > last[i, 1])
        after = near & ((far > d[i]) | (far == d[i]) & behind)
        beaten = after & (far > self.worst[i])
        self.more[i[beaten]] = True
        after &= ~beaten
        if not after.any():
            return
        who, distance, chunk, id_ = (np.concatenate(x) for x in zip(self.found, (i[after], far[after], chunks[j[after]], id_[after]), strict=True))
        order = np.lexsort((id_[:, 1], id_[:, 0], distance, who))
        who, distance, chunk, id_ = who[order], distance[order], chunk[order], id_[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        self.more[who[place >= self.few]] = True
        kept = place < self.few
        self.found = [who[kept], distance[kept], chunk[kept], id_[kept]]
        full = place == self.few - 1
        self.worst[who[full]] = distance[full]

    def best(self) -> Iterator[dict]:
        self._sit()
        who, distance, chunk, id_ = self.found
        if not len(who):
            return
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        of = who[first]
        each = pa.StructArray.from_arrays([pa.array(distance, pa.int32()), pa.array(_bytes(id_), pa.binary()), pa.array(chunk)], ["d", "id", "chunk"])
        found = pa.ListArray.from_arrays(pa.array(np.append(first, len(who)), pa.int32()), each)
        yield {"a": _bytes(self.seats[0][of]), "root": _bytes(self.seats[1][of]), "more": self.more[of], "found": found}


def _bytes(halves: np.ndarray) -> list[bytes]:
    flat = halves.astype(">u8").tobytes()
    return [flat[i : i + 16] for i in range(0, len(flat), 16)]


def _test_chunks(asked: DataFrame, members: DataFrame, texts: DataFrame, scratch: Scratch, rule: Rule) -> DataFrame:
    """Links (a, b) of roots among the asked pairs, enough of them to join all that belongs together.

    asked: a, root, chunk, found (ids of that chunk), a row for each a and chunk. members: class_id,
    root, chunk. A chunk that many texts ask for is dealt to several tasks, each with its members.
    """
    own = texts.select(F.col("class_id").alias("id"), "n_bytes", "text")
    asks = asked.join(own.drop("text"), F.col("a") == F.col("id")).drop("id")
    used = asks.groupBy("chunk").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_bytes") / F.lit(CHUNK_BYTES))).alias("parts")).select(F.col("chunk").alias("used"), "parts")
    there = members.join(used, F.col("chunk") == F.col("used"))
    there = there.select("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "class_id", "root", F.lit(None).cast("array<binary>").alias("found"))
    asking = asked.join(used, F.col("chunk") == F.col("used")).select("chunk", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.lit(True).alias("asks"), F.col("a").alias("class_id"), "root", "found")
    both = there.union(asking).join(own, F.col("class_id") == F.col("id")).select("chunk", "part", "asks", "class_id", "root", "text", "found")
    dealt = both.repartition(spread(scratch.spark), "chunk", "part").sortWithinPartitions("chunk", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held, parent = None, {}, {}

        def top(x: bytes) -> bytes:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for block, data, offsets in blocks(batches):
            at, asks = list(zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True)), block.column(2).to_pylist()
            ids, roots, found = (block.column(i).to_pylist() for i in (3, 4, 6))
            sets, links = shingle_sets(data, offsets, rule.words), {"a": [], "b": []}
            for i, mine in enumerate(sets):
                if at[i] != now:
                    now, held, parent = at[i], {}, {}
                if not asks[i]:
                    held[ids[i]] = (roots[i], mine)
                    continue
                for other in found[i]:
                    root, theirs = held[other]
                    low, high = sorted((len(mine), len(theirs)))
                    if top(roots[i]) == top(root) or rule.den * low < rule.num * high:
                        continue
                    common = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if rule.den * common >= rule.num * (low + high - common):
                        links["a"].append(roots[i])
                        links["b"].append(root)
                        parent[top(roots[i])] = top(root)
            if links["a"]:
                yield links

    return in_arrow(dealt, run, "a binary, b binary")


def _rejoin(placed: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """placed with the roots that the links between its roots give."""
    roots = connected(links, scratch).select("node", F.col("root").alias("then"))
    rest = [c for c in placed.columns if c != "root"]
    return scratch.keep(placed.join(roots, F.col("root") == F.col("node"), "left").select(*rest, F.coalesce("then", "root").alias("root")))


def _texts(rows: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """class_id, n_bytes, wide, text of the text that stands for each class."""
    wanted = signed.select("class_id", F.col("rep.text_key").alias("rep_key"), F.col("rep.doc_id").alias("rep_id"))
    there = rows.filter("text IS NOT NULL").withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = there.join(wanted, (F.col("key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("class_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[bytes] = set()  # rows that repeat an id and a text lie in one task
        for block, data, offsets in blocks(batches):
            ids = block.column(0).to_pylist()
            new = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
            wide = [wide_signature(s) for s in shingle_sets(data, offsets, rule.words)]
            kept = block.take(pa.array(new, pa.int64()))
            yield {"class_id": kept.column(0), "n_bytes": np.diff(offsets)[new], "wide": [wide[i] for i in new], "text": kept.column(1)}

    return in_arrow(found, run, "class_id binary, n_bytes long, wide binary, text string")


def group_duplicates(df: DataFrame, scratch: Scratch, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", with_keys: bool = False) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, kept; with_keys, also text_key and root.

    Words are lower-cased for A-Z and split at spaces, tabs and line ends. component_id is the least
    doc_id reachable over links, kept whether it is the row's own. A text without words, null too, has
    the empty set and links with nothing: its component is itself. Repeated rows and equal texts link.
    Null ids count as larger than any other: a component has a null id only if all its ids are null.
    text_key is the md5 of the text's bytes. root names the component apart from ids, which may repeat:
    rows have the same root where they link, and null where the text has no words. An empty table gives
    an empty result.
    """
    rows = columns_of(df, doc_id=id_col, text=text_col)
    sketched = scratch.keep(sketch(rows, rule))
    full = sketched.filter("class_id IS NOT NULL")
    # One text stands for a class: the least key, and the least id among its rows.
    classes = scratch.keep(full.groupBy("class_id").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("text_key", "doc_id")).alias("rep"), F.min("packed").alias("packed"), F.min("bands").alias("bands"), F.min("n_shingles").alias("n_shingles")))
    in_bucket = classes.select("class_id", F.explode("bands").alias("band"))
    buckets = in_bucket.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("leader")).filter("n > 1").select(F.col("band").alias("of"), "leader")
    active = scratch.keep(in_bucket.join(buckets, F.col("band") == F.col("of")).select("band", "class_id", "leader"))
    signed = scratch.keep(classes.join(active.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "rep", "packed", "n_shingles"))
    texts = scratch.keep(_texts(rows, signed, rule))

    # 1. Everyone's most promising leader.
    stars = active.filter("class_id <> leader").select(F.col("class_id").alias("a"), F.col("leader").alias("b")).distinct()
    left = signed.select(F.col("class_id").alias("a"), F.col("packed").alias("pa"))
    right = signed.select(F.col("class_id").alias("b"), F.col("packed").alias("pb"))
    judged = stars.join(left, "a").join(right, "b").withColumn("e", estimate("pa", "pb")).filter(F.col("e") >= rule.num / rule.den - MARGIN)
    best = scratch.keep(judged.groupBy("a").agg(F.max_by("b", F.struct("e", "b")).alias("b")))
    chunk = F.xxhash64("b")
    leaders = best.select("b").distinct().select(F.col("b").alias("class_id"), F.col("b").alias("root"), chunk.alias("chunk"))
    links = scratch.keep(_test_chunks(best.select("a", F.col("a").alias("root"), chunk.alias("chunk"), F.array("b").alias("found")), leaders, texts, scratch, rule))
    roots = scratch.keep(connected(links, scratch))
    # Classes of one component, and those whose leader is in it, are likely to meet: they share chunks.
    placed = signed.select("class_id", "packed", "n_shingles").join(texts.select(F.col("class_id").alias("id"), "n_bytes", "wide"), F.col("class_id") == F.col("id")).drop("id")
    placed = placed.join(roots, F.col("class_id") == F.col("node"), "left").select("class_id", "packed", "n_shingles", "n_bytes", "wide", F.coalesce("root", "class_id").alias("root"))
    led = best.join(roots.select(F.col("node").alias("n"), F.col("root").alias("its_root")), F.col("b") == F.col("n"), "left").select(F.col("a").alias("of"), F.coalesce("its_root", "b").alias("near"))
    placed = scratch.keep(placed.join(led, F.col("class_id") == F.col("of"), "left").select("class_id", "packed", "n_shingles", "n_bytes", "wide", "root", F.when(F.col("root") == F.col("class_id"), F.coalesce("near", "root")).otherwise(F.col("root")).alias("near")))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(CHUNK), F.sum("n_bytes") / F.lit(CHUNK_BYTES)))
    many = placed.groupBy("near").agg(parts.alias("parts")).select(F.col("near").alias("l"), "parts")
    placed = placed.join(many, F.col("near") == F.col("l")).select("class_id", "packed", "n_shingles", "wide", "root", F.xxhash64("near", F.pmod(F.xxhash64("class_id"), F.col("parts"))).alias("chunk"))
    placed = scratch.keep(placed)
    scratch.drop(best, links, roots)

    # 2. and 3. All that those links left open.
    arena = _arena(active.select("band", "class_id").join(placed.select("class_id", "root"), "class_id"), scratch)
    scratch.drop(active)
    live = arena.filter("NOT inside").select("class_id", F.lit(None).cast("struct<d:int,id:binary>").alias("last")).distinct()
    few = FIRST
    while not live.isEmpty():
        met = scratch.keep(_meet(arena, live, placed, scratch, few, rule))
        named = scratch.keep(_best_of(met, scratch, few))
        more = scratch.keep(_test_chunks(named.select("a", "root", "chunk", "found"), placed.select("class_id", "root", "chunk"), texts, scratch, rule))
        if not more.isEmpty():
            placed = _rejoin(placed, more, scratch)
        live = scratch.keep(named.filter("more").select(F.col("a").alias("class_id"), F.struct("d", F.col("last").alias("id")).alias("last")))
        scratch.drop(met, named, more)
        few = min(few * MORE, MOST)

    roots = placed.select(F.col("class_id").alias("node"), "root")
    scratch.drop(arena, texts, signed)
    labels = classes.join(roots, F.col("class_id") == F.col("node"), "left").select("class_id", "first_id", F.coalesce("root", "class_id").alias("root"))
    least_id = labels.groupBy("root").agg(F.min("first_id").alias("component"))
    labels = labels.join(least_id, "root").select(F.col("class_id").alias("of_class"), "component", "root")
    joined = sketched.select("doc_id", "n_shingles", "class_id", "text_key").join(labels, F.col("class_id") == F.col("of_class"), "left")
    component = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    keys = ("text_key", "root") if with_keys else ()
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *keys)
