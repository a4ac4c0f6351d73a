import random
import re
from collections import Counter

import numpy as np

from quillframe.llm import quality, queries


def brute(text):
    t = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, dup, seen = t.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {i + k for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for k in range(5)}
    failed = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_base_statistics(spark, odd, rows, empty):
    nobody = spark.createDataFrame([(None,)], "doc_id long")
    found = quality.assess(odd, nobody).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found)
    assert got == Counter((r[1], *brute(r[2])) for r in rows)
    assert all(r["llr"] == 0 and r["kept"] != r["base_failed"] for r in found)
    assert quality.assess(empty, nobody).collect() == []
    kept = quality.keep_good(odd, nobody)
    assert kept.columns == odd.columns
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if not brute(r[2])[-1])


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    for i in range(n):
        text = [word() for _ in range(rng.randint(20, 200))]
        yield i, " ".join(text) if i % 5 else " ".join(f"{w.upper()}##" for w in text)


def test_verdict(spark):
    docs = spark.createDataFrame(list(corpus(400, 1)), "doc_id long, text string")
    trusted = docs.filter("doc_id % 5 = 1").select("doc_id")
    found = quality.assess(docs, trusted).collect()
    assert all(r["kept"] == (r["doc_id"] % 5 != 0) for r in found)


def test_counts_and_ratios(spark):
    docs = spark.createDataFrame([(1, "abcd"), (2, "ab"), (3, "xabc"), (None, "abc")], "doc_id long, text string").repartition(2)
    raw, target = quality.count_grams(docs, [1])
    assert raw.sum() == 5 and target.sum() == 2
    table = quality.log_ratios(raw, target)
    share, cell = raw / raw.sum(), int(np.argmax(raw))
    want = np.log((target[cell] + quality.PRIOR * share[cell]) / (target.sum() + quality.PRIOR) / share[cell])
    assert abs(table[cell] - want) < 1e-6
    assert not quality.log_ratios(raw, target * 0).any()


def test_every_trusted_document_counts(spark):
    """More trusted documents than any sample: with all of them trusted, target and raw corpus are the same."""
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("etaoinshrdlu ") for _ in range(24))) for i in range(20_200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert max(abs(r["llr"]) for r in quality.assess(docs, docs).select("llr").collect()) < 1e-6
    raw, target = quality.count_grams(docs, docs.select(docs["doc_id"].alias("id")))
    assert (raw == target).all()


def test_trusted_ids_join_as_flags(spark):
    """Null and repeated trusted ids add nothing; rows without an id are never trusted."""
    docs = spark.createDataFrame([(1, "abcd"), (1, "xabc"), (2, "abcd"), (None, "abcd"), (None, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (None,), (9,)], "id long")
    raw, target = quality.count_grams(docs, ids)
    assert raw.sum() == 8 and target.sum() == 4


def test_texts_that_sums_confuse():
    """Two different lines and words of two letters that a sum modulo 2^64 over powers cannot tell apart."""
    t = [0]
    while len(t) < 1024:
        t += [1 - x for x in t]
    one, two = ("".join(letters[x] for x in t) for letters in ("ab", "ba"))
    text = f"{one}\n{two}\n" + " ".join([one, *"cdef", two, *"cdef"])
    data = np.frombuffer(text.encode(), np.uint8)
    found = {k: int(v[0]) for k, v in quality.base_statistics(data, np.array([0, len(data)])).items()}
    assert tuple(found.values()) == brute(text)[:5]


def test_query_by_loops(spark):
    """Base counts, both multinomials and every verdict of op4 over a whole table."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    trusted = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}

    def cells(text):
        b = (text or "").encode()
        return [((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(b) - 2)]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(found := cells(t))
        target.update(found if i in trusted else ())
    n, m = raw.total(), target.total()
    ratio = {c: np.log((target[c] + quality.PRIOR * k / n) / (m + quality.PRIOR)) - np.log(k / n) for c, k in raw.items()}
    want = {}
    for i, t in rows:
        *base, failed = brute(t)
        found = cells(t)
        llr = sum(ratio[c] for c in found) / max(len(found), 1)
        want[i] = (*base, failed, round(llr, 5), not failed and llr >= quality.THRESHOLD)
    got = {r["doc_id"]: (*(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), round(r["llr"], 5), r["kept"]) for r in queries.op4_quality(spark, sf).collect()}
    assert got == want


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("a", "abcd"), ("b", "xyzw"), (None, "abcd")], "doc_id string, text string")
    raw, target = quality.count_grams(docs, spark.createDataFrame([("a",)], "id string"))
    assert raw.sum() == 6 and target.sum() == 2
