import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillframe.llm.suffixes import agree, order


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_order(symbols, depth):
    s = np.array(symbols)
    whole = order(s, 4, 10**6).tolist()
    assert whole == sorted(range(len(s)), key=lambda i: symbols[i:])
    prefixes = [symbols[i : i + depth] for i in order(s, 4, depth)]
    assert prefixes == sorted(prefixes)


def test_long_repeats():
    rng = np.random.default_rng(2)
    unit = rng.integers(1, 200, 500)
    s = np.concatenate([unit, rng.integers(1, 200, 777), unit, unit[:300]])
    prefixes = [s[i : i + 100].tobytes() for i in order(s, 200, 100)]
    keys = [s[i : i + 100].tolist() for i in order(s, 200, 100)]
    assert keys == sorted(keys)
    same = [i for i in range(len(prefixes) - 1) if prefixes[i] == prefixes[i + 1]]
    assert same


def test_agree():
    data = np.frombuffer(b"abcdefghijkabcdefghijXabcdefghijk", np.uint8)
    a, b = np.array([0, 0, 11]), np.array([11, 22, 22])
    for depth in (1, 7, 8, 9, 10, 11):
        want = [bytes(data[x : x + depth]) == bytes(data[y : y + depth]) for x, y in zip(a, b, strict=True)]
        assert agree(data, a, b, depth).tolist() == want
