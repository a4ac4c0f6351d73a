import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from quillframe.llm import queries
from quillframe.llm.sharding import longest_first, shard_documents


def brute(sizes, shards):
    """Loads by one step of a heap for each group."""
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return {s: load for load, s in heap}


def loads(plan, shards):
    return {s: sum(size * took[s] for size, took in plan) for s in range(shards)}


def test_longest_first():
    assert longest_first([(4, 2), (7, 1), (5, 1)], 2) == [(7, [1, 0]), (5, [0, 1]), (4, [1, 1])]
    assert longest_first([], 3) == []


@pytest.mark.parametrize("seed", range(6))
def test_loads_are_those_of_single_steps(seed):
    rng = random.Random(seed)
    histogram = {rng.choice([1, 2, 3, 10**9, 10**12, *range(5, 400)]): rng.choice([1, 2, 5, 40, 3000]) for _ in range(60)}
    for shards in (1, 2, 8, 13):
        plan = longest_first(list(histogram.items()), shards)
        assert {size: sum(took) for size, took in plan} == histogram
        assert loads(plan, shards) == brute([s for s, n in histogram.items() for _ in range(n)], shards)


def test_many_groups_of_a_size():
    """As many groups as no loop over groups could deal."""
    plan = longest_first([(10**13, 3), (1000, 10**11), (999, 7)], 8)
    found = loads(plan, 8)
    assert sum(found.values()) == 3 * 10**13 + 10**14 + 6993 and max(found.values()) - min(found.values()) <= 1000


def check(found, rows, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, of_shard = defaultdict(list), Counter()
    for r in found:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        of_shard[r["shard"]] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    groups = Counter()
    for _, t in rows:
        groups[t] += len((t or "").encode()) + 1
    assert {s: n for s, n in of_shard.items() if n} == {s: n for s, n in brute(groups.values(), shards).items() if n}


def test_awkward_table(odd, rows, empty, scratch):
    found = shard_documents(odd, scratch, shards=3).collect()
    check(found, [(r[1], r[2]) for r in rows], 3)
    where = defaultdict(set)
    for r in found:
        where[r["size"], r["text_crc32"], r["size"] > 1].add(r["shard"])
    assert all(len(s) == 1 for k, s in where.items() if k[2])
    assert shard_documents(empty, scratch).collect() == []


def test_copies_and_equal_sizes(spark, scratch):
    """A third of the rows are one text; most other texts have the same length."""
    rng = random.Random(1)
    rows = [(i, "x" * 300 if i % 3 == 0 else f"{rng.randrange(10**9):09d}" if i % 3 == 1 else "y" * rng.randint(0, 300) + str(rng.randrange(1500))) for i in range(3000)]
    found = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), scratch, shards=4).collect()
    check(found, rows, 4)
    texts, by_id = defaultdict(set), dict(rows)
    for r in found:
        texts[by_id[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in texts.values())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    found = queries.op2_shards(spark, sf).collect()
    check(found, rows, 8)
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}
