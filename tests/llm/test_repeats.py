import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillframe.llm import queries, repeats
from quillframe.llm.repeats import merged, remove_repeats, whole_characters

from .conftest import prose


def brute(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        spans = merged([(i, i + window) for i in range(len(t) - window + 1) if seen[t[i : i + window]] > 1])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        kept += t[at:]
        yield len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("window", "gram", "hot"), [(400, 200, 8 << 20), (400, 200, 0), (40, 20, 8 << 20), (40, 25, 0), (40, 40, 100)])
def test_against_brute_force(odd, rows, scratch, window, gram, hot):
    found = remove_repeats(odd, scratch, window, gram, hot).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found)
    texts = [(r[2] or "").encode() for r in rows]
    assert got == Counter((r[1], *w) for r, w in zip(rows, brute(texts, window), strict=True))


def test_kept_text(odd, rows, scratch, empty):
    found = remove_repeats(odd, scratch, 40, 20, keep=("key", "lang", "start")).collect()
    texts = [(r[2] or "").encode() for r in rows]
    seen = Counter(t[i : i + 40] for t in texts for i in range(len(t) - 39))
    want = Counter()
    for r, t in zip(rows, texts, strict=True):
        kept, at = b"", 0
        for a, b in merged([(i, i + 40) for i in range(len(t) - 39) if seen[t[i : i + 40]] > 1]):
            a, b = whole_characters(t, a, b)
            kept, at = kept + t[at:a], b
        want[r[6], r[3], r[7], r[1], (kept + t[at:]).decode()] += 1
    assert Counter((r["key"], r["lang"], r["start"], r["doc_id"], r["kept_text"]) for r in found) == want
    assert remove_repeats(empty, scratch).collect() == []


def test_query(spark):
    """op9 over a whole table; its text and its hash say the same where no character is cut."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    found = queries.op9_repeats(spark, sf).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found)
    assert got == Counter((i, *w) for (i, _), w in zip(rows, brute([(t or "").encode() for _, t in rows], 400), strict=True))
    assert sum(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in found) > 0.9 * len(found)


@pytest.mark.parametrize(("window", "gram", "hot", "passages"), [(400, 200, 8 << 20, (256, 100)), (90, 40, 8 << 20, (40, 20)), (90, 40, 0, (40, 20)), (40, 20, 8 << 20, (40, 25))])
def test_passages(odd, rows, scratch, empty, window, gram, hot, passages):
    """Both lengths against brute force: the longer strings are searched inside the shorter ones' runs."""
    found = remove_repeats(odd, scratch, window, gram, hot, passages=passages).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["passage_bytes"], r["n_passages"]) for r in found)
    texts = [(r[2] or "").encode() for r in rows]
    both = zip(rows, brute(texts, window), brute(texts, passages[0]), strict=True)
    assert got == Counter((r[1], *long, *short[1:3]) for r, long, short in both)
    assert remove_repeats(empty, scratch, window, gram, passages=passages).collect() == []
    with pytest.raises(ValueError, match="longer than the window"):
        remove_repeats(odd, scratch, window, gram, passages=(window + 1, gram))


def test_query_reports_short_passages(spark, tmp_path):
    """Passages of over 50 words have fewer than 400 bytes: op9 leaves them, as its contract says, and reports them."""
    rng = random.Random(5)
    shared = prose(rng, 55)
    assert 256 <= len(shared) < 400
    texts = [f"{prose(rng, 80)} {shared} {prose(rng, 30)}", f"{prose(rng, 20)} {shared}", *(prose(rng, 120) for _ in range(4)), shared[:200], None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op9_repeats(spark, str(tmp_path)).collect()}
    assert all(found[i]["n_removed"] == 0 and found[i]["kept_text"] == (t or "") for i, t in enumerate(texts))
    assert [found[i]["n_passages"] for i in range(len(texts))] == [1, 1, 0, 0, 0, 0, 0, 0]
    assert all(len(shared) <= found[i]["passage_bytes"] <= len(shared) + 4 for i in (0, 1))


def test_whole_characters():
    text = "aéb".encode()
    assert whole_characters(text, 0, 2) == (0, 1)
    assert whole_characters(text, 2, 4) == (3, 4)
    assert whole_characters(text, 2, 3) == (3, 3)


def test_runs_in_stretches(monkeypatch):
    data = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 700, 750, 5000, 5000])
    whole = repeats.runs(data, offsets, 60, 30)
    starts = np.concatenate([np.arange(a, b - 59) for a, b, *_ in zip(whole[1], whole[2], strict=True)])
    assert starts.tolist() == [i for a, b in zip(offsets[:-1], offsets[1:], strict=True) for i in range(a, b - 59)]
    monkeypatch.setattr(repeats, "STRETCH", 512)
    cut = repeats.runs(data, offsets, 60, 30)
    each = lambda r: {i: int(h) for h, a, b in zip(*r, strict=True) for i in range(a, b - 59)}
    assert each(cut) == each(whole)
