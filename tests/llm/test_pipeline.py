"""Each stage against a plain version, on a small table with all that is awkward."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quillframe.llm import mixing, quality
from quillframe.llm.common import unit_hash
from quillframe.llm.packing import END_ID
from quillframe.llm.repeats import merged, whole_characters
from quillframe.llm.tokens import default_path

from .conftest import awkward
from .test_neardup import brute as components
from .test_quality import brute as statistics


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, 1, 0) for i in (5, 6, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(awkward(), "size long, doc_id long, text string, lang string, source string, n_chars long, `key` string, start double, band string, U string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "source_mixing", "sequence_packing"]


def test_quality(spark, docs, sf, rows):
    out = P.quality_rules(spark, docs, sf)
    assert out.columns == docs.columns
    kept = Counter(map(tuple, out.collect()))
    good = Counter(r for r in rows if not statistics(r[2])[-1])
    assert not kept - good and any(r[2] == rows[5][2] for r in kept)


def test_quality_keeps_exactly_these(spark, docs, sf, rows):
    """Both multinomials and every verdict by plain counting."""

    def cells(text):
        b = (text or "").encode()
        return [((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(b) - 2)]

    found = [cells(r[2]) for r in rows]
    raw = Counter(c for f in found for c in f)
    target = Counter(c for r, f in zip(rows, found, strict=True) if r[1] in (5, 6, 9) for c in f)
    share = {c: n / raw.total() for c, n in raw.items()}
    ratio = {c: math.log((target[c] + quality.PRIOR * x) / (target.total() + quality.PRIOR) / x) for c, x in share.items()}
    llr = [sum(ratio[c] for c in f) / max(len(f), 1) for f in found]
    want = Counter(r for r, x in zip(rows, llr, strict=True) if not statistics(r[2])[-1] and x >= quality.THRESHOLD)
    assert 0 < want.total() < len(rows)
    assert Counter(map(tuple, P.quality_rules(spark, docs, sf).collect())) == want


def test_near_dedup(spark, docs, sf, rows):
    out = P.near_dedup(spark, docs, sf)
    assert out.columns == docs.columns
    made = list(components([r[1] for r in rows], [r[2] for r in rows], P.neardup.Rule()))
    want = {(r[1], r[2]) for r, m in zip(rows, made, strict=True) if m[3]}
    assert (None, "no id here") in want  # also where another row of its id goes
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(want)


def test_near_dedup_repeated_ids(spark, sf):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    table = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (None, a + " z"), (None, c), (None, c + " v"), (None, d), (4, d + " w"), (5, "of 5"), (5, "of 5"), (6, None), (6, ""), (None, "alone")]
    out = Counter(map(tuple, P.near_dedup(spark, spark.createDataFrame(table, "doc_id long, text string").repartition(3), sf).collect()))
    one_of_c = min(c, c + " v", key=lambda t: hashlib.md5(t.encode()).digest())
    assert out == Counter([(1, a), (2, b), (None, one_of_c), (4, d + " w"), (5, "of 5"), (6, None), (6, ""), (None, "alone")])


def test_suffix_dedup_texts(spark, docs, sf, rows):
    """Every row's text, and its n_chars, as brute force leaves them; characters stay whole."""
    texts = [(r[2] or "").encode() for r in rows]
    seen = Counter(t[i : i + P.PASSAGE_BYTES] for t in texts for i in range(len(t) - P.PASSAGE_BYTES + 1))
    want = Counter()
    for r, t in zip(rows, texts, strict=True):
        spans = merged([(i, i + P.PASSAGE_BYTES) for i in range(len(t) - P.PASSAGE_BYTES + 1) if seen[t[i : i + P.PASSAGE_BYTES]] > 1])
        kept, at = b"", 0
        for a, b in (whole_characters(t, *x) for x in spans):
            kept, at = kept + t[at:a], b
        kept = (kept + t[at:]).decode()
        want[r[1], kept, len(kept) if spans else r[5]] += 1
    assert any(not x[1] for x in want) and any(len(x[1]) > P.PASSAGE_BYTES for x in want)
    out = P.suffix_dedup(spark, docs, sf)
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == want


def test_mixing(spark, docs, sf, rows):
    out = P.source_mixing(spark, docs, sf)
    assert out.columns == docs.columns
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[4]] += words(r[2])
    for r in out.collect():
        taken[r["source"]] += words(r["text"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert [taken[s] for s in names] == [int(t) for t in want]


def test_whole_run(spark, sf, rows):
    out = P.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"} <= set(out.columns)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r[1] for r in rows}


def test_whole_run_packs_every_token(spark, sf):
    """The packed ids are those of the mixed texts, each token once, and pieces of a sequence do not overlap."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = P.Scratch(spark, "by_hand").keep(stage(spark, docs, sf))
    model = Tokenizer.from_file(default_path())
    want, got, held = Counter(), Counter(), Counter()
    for r in docs.collect():
        ids = model.encode(r["text"], add_special_tokens=False).ids if r["text"] else []
        want.update((r["doc_id"], k, x) for k, x in enumerate([*ids, END_ID]))
    for r in P.run(spark, sf).collect():
        got.update((r["doc_id"], r["start"] + k, x) for k, x in enumerate(r["ids"]))
        held.update((r["sequence_id"], r["offset"] + k) for k in range(r["length"]))
    assert want and got == want
    assert max(held.values()) == 1 and all(at < 2048 for _, at in held)


CLASHES = ("gone", "of", "key", "root", "__id", "__text", "__size", "__of", "__copy", "kept_text", "spans", "size", "n", "words", "copy", "position", "taken", "k0", "a.b")


def test_columns_that_clash(spark, sf):
    """Extra columns named like helpers come through every stage as they are."""
    rng = random.Random(9)
    table = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(60)), "ab"[i % 2], 7, *(f"{c}{i}" for c in CLASHES)) for i in range(12)]
    columns = ["doc_id", "text", "source", "n_chars", *CLASHES]
    docs = spark.createDataFrame(table, ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in columns))
    for stage in (P.quality_rules, P.near_dedup, P.suffix_dedup):
        out = stage(spark, docs, sf)
        assert out.columns == columns
        assert Counter(map(tuple, out.collect())) == Counter(table)
    mixed = P.source_mixing(spark, docs, sf)
    extra = {r[0]: r[4:] for r in table}
    assert mixed.columns == columns and all(tuple(r)[4:] == extra[r["doc_id"]] for r in mixed.collect())
    assert P.sequence_packing(spark, docs, sf).count() >= 12


def test_mixing_rows(spark, sf):
    """Every copy, with its text: whole passes, then whole documents in the order of the hash, the last one cut."""
    rng = random.Random(4)
    table = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 30))), "aabc"[i % 4]) for i in range(80)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    u = {r[0]: r[1] for r in docs.select("doc_id", unit_hash(F.col("doc_id"), seed=8)).collect()}
    sizes = {s: sum(len(t.split()) for _, t, x in table if x == s) for s in "abc"}
    goal = dict(zip("abc", mixing.targets([sizes[s] for s in "abc"], [5, 2, 1]), strict=True))
    want = Counter()
    for s in "abc":
        left = int(goal[s])
        order = sorted((r for r in table if r[2] == s), key=lambda r: (u[r[0]], r[0]))
        while left:
            for i, t, _ in order:
                take = min(left, len(t.split()))
                left -= take
                if take:
                    want[i, " ".join(t.split()[:take]), s] += 1
    assert Counter(map(tuple, P.source_mixing(spark, docs, sf).collect())) == want


def test_packing_stage(spark, docs, sf, rows):
    model, want, got = Tokenizer.from_file(default_path()), Counter(), Counter()
    for r in rows:
        want.update((r[1], k, x) for k, x in enumerate([*(model.encode(r[2], add_special_tokens=False).ids if r[2] else []), END_ID]))
    for r in P.sequence_packing(spark, docs, sf).collect():
        assert r["length"] == len(r["ids"]) and r["offset"] + r["length"] <= 2048
        got.update((r["doc_id"], r["start"] + k, x) for k, x in enumerate(r["ids"]))
    assert got == want


def test_packing_keeps_training_order(spark, sf, tmp_path):
    """Sequence ids follow the order of the part files, though the scan reads the largest first."""
    table = [(i, "w " * (5 + i * i // 3), "a", i) for i in range(40)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string, file long")
    docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    found = P.sequence_packing(spark, mixed, sf).collect()
    assert sum(r["length"] for r in found) == sum(r["doc_tokens"] for r in found if r["start"] == 0)
    of = {}
    for r in found:
        of.setdefault(r["sequence_id"] >> P.packing.SEQUENCE_BITS, set()).add(r["doc_id"])
    blocks = [of[k] for k in sorted(of)]
    assert len(blocks) == 4 and all(max(a) < min(b) for a, b in zip(blocks[:-1], blocks[1:], strict=True))


def test_empty_run(spark, sf, tmp_path, docs):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
