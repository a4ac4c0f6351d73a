import random
import re
from collections import Counter

import numpy as np
import pytest

from quillframe.llm import neardup
from quillframe.llm.components import connected
from quillframe.llm.neardup import Rule, group_duplicates


def sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(ids, texts, rule):
    found, parent = sets(texts, rule.words), list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            common = len(a & found[j])
            if a and rule.den * common >= rule.num * (len(a) + len(found[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    for i, d in enumerate(ids):
        c = least[root(i)] if found[i] else d
        yield d, len(found[i]), c, d == c


@pytest.mark.parametrize("rule", [Rule(3, 85, 100), Rule(5, 80, 100), Rule(1, 1, 2)])
def test_awkward_table(odd, rows, scratch, rule):
    found = group_duplicates(odd, scratch, rule).collect()
    assert Counter(map(tuple, found)) == Counter(brute([r[1] for r in rows], [r[2] for r in rows], rule))


def test_empty(empty, scratch):
    assert group_duplicates(empty, scratch).collect() == []


def test_drifting_group(spark, scratch):
    """A large group in which only some pairs are near enough, so that later rounds and the last step matter."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    ids = rng.sample(range(10**6), len(texts))
    rule = Rule(3, 85, 100)
    found = group_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), scratch, rule).collect()
    assert Counter(map(tuple, found)) == Counter(brute(ids, texts, rule))


def test_estimate(spark):
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    pairs, real = [], []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        a = pool[:1000]
        common = int(2 * 1000 * share / (1 + share))
        b = np.concatenate([a[:common], pool[1000 : 2000 - common]])
        real.append(common / (2000 - common))
        pairs.append((neardup.signature(a)[1].tolist(), neardup.signature(b)[1].tolist()))
    found = spark.createDataFrame(pairs, "a array<long>, b array<long>").select(neardup.estimate("a", "b")).collect()
    assert [r[0] for r in found] == pytest.approx(real, abs=neardup.MARGIN)
    assert found[-1][0] == pytest.approx(1.0)


def test_components(spark, scratch):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long"), scratch).collect()))
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_wide_estimate():
    """Near the true similarity, and at the threshold never passed over in thousands of pairs."""
    rng = np.random.default_rng(3)
    missed = 0
    for n in (10, 60, 150, 400, 3000):
        for _ in range(400):
            common = -(-85 * n // 100)
            pool = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n:]]))
            wide = [np.frombuffer(neardup.wide_signature(x), "<u8")[None] for x in (a, b)]
            real = common / len(pool)
            found, near = neardup.wide_estimate(*wide, np.array([2 * n]), real)
            missed += not near[0]
            assert abs(found[0] - real) < 0.2
    assert missed == 0


@pytest.mark.parametrize("few", [(1, 1, 1), (2, 3, 4)])
def test_lists_of_any_length(spark, scratch, monkeypatch, few):
    """Short lists take more rounds and give the same components; so do small blocks, streams and chunks."""
    for name, x in zip(("FIRST", "MORE", "MOST"), few, strict=True):
        monkeypatch.setattr(neardup, name, x)
    for name, x in (("BLOCK", 7), ("STREAM", 11), ("CHUNK", 5), ("CHUNK_BYTES", 4000)):
        monkeypatch.setattr(neardup, name, x)
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(90)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    ids, rule = rng.sample(range(10**6), len(texts)), Rule(3, 85, 100)
    found = group_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), scratch, rule).collect()
    assert Counter(map(tuple, found)) == Counter(brute(ids, texts, rule))
