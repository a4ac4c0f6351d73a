import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillframe.llm.mixing import Demand, arrange, mix_sources, targets


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert targets([1, 1, 1000], [5, 2, 1]) == pytest.approx([3, 3, 996])
    assert targets([0, 0], [5, 2]) == [0, 0]
    assert targets([1, 1], [5, 2])[0] == pytest.approx(10 / 7)


def test_demand_inverts():
    d = Demand([(0, 3.0), (0.25, 1.0), (1, 0.0)], 80.0)
    t = np.linspace(0, 1, 50)
    fine = np.linspace(0, 1, 200_001)
    rate = np.interp(fine, d.t, d.w)
    drawn = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(fine))])
    assert drawn[-1] == pytest.approx(80)
    assert d.position(np.interp(t, fine, drawn)) == pytest.approx(t, abs=1e-3)
    assert Demand([(0, 1.0), (1, 1.0)], 0.0).position(np.array([0.0])).tolist() == [0.0]


def check(found, rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter((i, s, words(t)) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(c["taken"] for c in r["copies"])
        assert all(0 <= c["position"] <= 1 for c in r["copies"])
        taken[r["source"]] += r["taken"]
    assert all(int(want[s] + 1e-9) - taken[s] in (0, 1) for s in names)


def test_awkward_table(odd, rows, empty, scratch):
    mixed = mix_sources(odd, scratch)
    found = mixed.collect()
    check(found, [(r[1], r[2], r[4]) for r in rows])
    order = [r["position"] for r in arrange(mixed).collect()]
    assert order == sorted(order) and len(order) == sum(len(r["copies"]) for r in found)
    assert mix_sources(empty, scratch).collect() == []


def test_repeatable(spark, scratch):
    rows = [(i, "w " * (i % 40), "abc"[i % 7 % 3]) for i in range(600)]
    make = lambda parts: mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts), scratch).collect()
    one, two = make(2), make(5)
    check(one, rows)
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_positions(spark, scratch):
    """A copy's position is the time at which its source's scheduled demand reaches the middle of its words."""
    rows = [(i, "w " * (1 + i % 40), "abc"[i % 7 % 3]) for i in range(300)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch).collect()
    knots = {"a": [1.5, 1.0, 0.5], "b": [1.0, 1.0, 1.0], "c": [0.5, 1.0, 1.5]}
    for s in "abc":
        copies = sorted((c["position"], c["taken"]) for r in found if r["source"] == s for c in r["copies"])
        goal, before = next(r["target"] for r in found if r["source"] == s), 0
        t = np.linspace(0, 1, 20_001)
        rate = np.interp(t, [0, 0.5, 1], knots[s])
        share = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        for position, taken in copies:
            assert abs(np.interp(position, t, share / share[-1]) * goal - (before + taken / 2)) < 0.01 * goal
            before += taken
