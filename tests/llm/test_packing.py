import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillframe.llm.lengths import length_histogram, length_report
from quillframe.llm.packing import END_ID, ROW_BITS, SEQUENCE_BITS, pack, pack_documents
from quillframe.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def model():
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


def test_encoder_is_the_tokenizer(spark, rows, model):
    encoder = Encoder(default_path())
    texts = [r[2] for r in rows] + [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["a  b\n c\t\t d", "<|endoftext|>", "a <|endoftext|>\n  <|endoftext|><|endoftext|> b<|endoftext","'s don't I'LL", "x\x1cy \x85 z", " " * 2_000_000, "a" * 100_000]
    assert encoder.fast is not None
    for text, found in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == model(text)
    assert np.frombuffer(encoder.ids(["<|endoftext|>"])[0], "<u4").tolist() == [50256]


@pytest.mark.parametrize(("tokens", "segments", "loss"), [(50, 4, 50), (50, 3, 30), (64, 64, 10), (7, 1, 7)])
def test_limits(tokens, segments, loss):
    rng = np.random.default_rng(tokens)
    lengths = rng.integers(0, 160, 300)
    prompts = np.minimum(rng.integers(0, 160, 300), lengths) if loss < tokens else np.zeros(300, int)
    bins = pack(lengths, prompts, tokens, segments, loss)
    taken = defaultdict(list)
    for b in bins:
        assert 0 < len(b) <= segments and sum(k for *_, k in b) <= tokens
        assert sum(max(0, s + k - max(s, prompts[i])) for i, s, k in b) <= loss
        for i, s, k in b:
            assert k > 0
            taken[i].append((s, k))
    for i, n in enumerate(lengths):
        at = 0
        for s, k in sorted(taken[i]):
            assert s == at
            at += k
        assert at == n
    if loss >= tokens and segments >= 4:
        assert len(bins) <= -(-lengths.sum() // tokens) * 1.02 + 1


def test_pieces(odd, rows, empty, model):
    found = pack_documents(odd, default_path(), tokens=256, segments=8, with_ids=True).collect()
    want = defaultdict(list)
    for r in rows:
        want[r[1]].append([*model(r[2]), END_ID])
    bins = defaultdict(list)
    for p in found:
        assert any(w[p["start"] : p["start"] + p["length"]] == p["ids"] and len(w) == p["doc_tokens"] for w in want[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sum(p["length"] for p in found) == sum(len(w) for x in want.values() for w in x)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256 and len(b) <= 8
    assert pack_documents(empty, default_path()).collect() == []


def test_prompts_without_loss(spark):
    df = spark.createDataFrame([(i, "a b c d e f g h", None if i == 3 else 4) for i in range(40)], "doc_id long, text string, prompt int")
    found = pack_documents(df, default_path(), tokens=27, segments=9, loss_tokens=12, prompt_col="prompt").collect()
    loss = defaultdict(int)
    for p in found:
        prompt = 0 if p["doc_id"] == 3 else 4
        loss[p["sequence_id"]] += max(0, p["start"] + p["length"] - max(p["start"], prompt))
    assert max(loss.values()) <= 12


def test_ordered_ids(spark, model):
    """Ids rise with file and row from block to block, in whatever order tasks meet the files."""
    places = [(f, r) for f, rows in ((2, range(10)), (0, range(5, 10)), (1, range(20)), (0, range(5))) for r in rows]
    table = [(100 * f + r, f"{f} {r} " * (1 + 7 * r % 40), f, r) for f, r in places]
    df = spark.createDataFrame(table, "doc_id long, text string, part long, at long").repartition(1)
    for rows in (df, spark.createDataFrame(table, df.schema).coalesce(3)):
        found = pack_documents(rows, default_path(), tokens=32, segments=3, examples=4, order_cols=("part", "at")).orderBy("sequence_id", "offset").collect()
        assert sum(p["length"] for p in found) == sum(len(model(t)) + 1 for _, t, *_ in table)
        held, of = defaultdict(list), defaultdict(set)
        for p in found:
            held[p["sequence_id"]].append((p["offset"], p["length"]))
            of[p["sequence_id"] >> SEQUENCE_BITS].add(p["doc_id"])
        assert all(o == sum(n for _, n in b[:i]) for b in held.values() for i, (o, _) in enumerate(b))
        blocks = [of[k] for k in sorted(of)]
        assert len(blocks) >= 4 and all(max(a) < min(b) for a, b in zip(blocks[:-1], blocks[1:], strict=True))
        assert sorted(x for b in blocks for x in b) == sorted(r[0] for r in table)
    far = spark.createDataFrame([(1, "a", 0, 1 << ROW_BITS)], df.schema)
    with pytest.raises(Exception, match="range of ordered ids"):
        pack_documents(far, default_path(), order_cols=("part", "at")).collect()


def test_lengths(odd, rows, empty, scratch, model):
    lengths = [len(model(r[2])) for r in rows]
    found = length_report(length_histogram(odd, default_path()), scratch).collect()
    assert sorted(r["n_tokens"] for r in found) == sorted(set(lengths))
    for r in found:
        n = r["n_tokens"]
        low, high = [x for x in lengths if x <= n], [x for x in lengths if x > n]
        assert (r["n_docs"], r["docs_up_to"], r["docs_over"]) == (lengths.count(n), len(low), len(high))
        assert (r["tokens_up_to"], r["tokens_over"], r["tokens_truncated"]) == (sum(low), sum(high), sum(min(x, n) for x in lengths))
        assert r["share_up_to"] == len(low) / len(lengths)
    assert length_report(length_histogram(empty, default_path()), scratch).collect() == []
