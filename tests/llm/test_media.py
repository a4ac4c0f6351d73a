import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from quillframe.llm import media, queries


def png(rows, kinds, color, width, height, extra=b""):
    step = media.CHANNELS[color]
    raw = bytearray()
    above = bytes(width * step)
    for kind, row in zip(kinds, rows, strict=True):
        raw.append(kind)
        for i, x in enumerate(row):
            left = row[i - step] if i >= step else 0
            corner = above[i - step] if i >= step else 0
            p = left + above[i] - corner
            near = min((abs(p - left), 0, left), (abs(p - above[i]), 1, above[i]), (abs(p - corner), 2, corner))[2]
            raw.append((x - (0, left, above[i], (left + above[i]) // 2, near)[kind]) % 256)
        above = row
    data = zlib.compress(bytes(raw))
    return b"".join([media.SIGNATURE, media._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)), extra, media._chunk(b"IDAT", data[:9]), media._chunk(b"IDAT", data[9:]), media._chunk(b"IEND", b"")])


@pytest.mark.parametrize("color", [0, 2, 4, 6])
def test_every_filter(color):
    rng, step = np.random.default_rng(color), media.CHANNELS[color]
    rows = [rng.integers(0, 256, 7 * step, dtype=np.uint8).tobytes() for _ in range(10)]
    made = png(rows, [0, 1, 2, 3, 4] * 2, color, 7, 10, media._chunk(b"tEXt", b"note"))
    assert media.read_png(made).tobytes() == b"".join(rows)
    assert len(media.cosine_hash(media.read_png(made))) == 16


def test_written_rows_are_filtered(monkeypatch):
    """Reading back what is written undoes a filter in every row."""
    seen, undo = [], media.unfilter
    monkeypatch.setattr(media, "unfilter", lambda kinds, rows, step: seen.append(kinds.copy()) or undo(kinds, rows, step))
    payload = media.payload_of(np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8).tobytes())
    assert media.read_png(media.write_png(payload)).tobytes() == payload
    assert len(seen) == 1 and len(seen[0]) == media.shape_of(len(payload))[0] and seen[0].all()


def test_damage():
    made = media.write_png(media.payload_of(b"some text"))
    for at in (3, 20, 50, len(made) - 6):
        broken = bytearray(made)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.read_png(bytes(broken))
    for cut in (0, 8, 30, len(made) - 1):
        with pytest.raises(ValueError):
            media.read_png(made[:cut])
    with pytest.raises(ValueError, match="another length"):
        media.read_png(png([b"\0" * 7] * 3, [0] * 3, 0, 7, 3).replace(struct.pack(">II", 7, 3), struct.pack(">II", 7, 3)) if False else b"".join([media.SIGNATURE, media._chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 9, 8, 0, 0, 0, 0)), media._chunk(b"IDAT", zlib.compress(b"\0" * 89)), media._chunk(b"IEND", b"")]))


def test_round_trip(odd, rows):
    found = media.read_media(media.encode_media(odd), with_payload=True).collect()
    assert len(found) == len(rows)
    want = {}
    for r in rows:
        text = (r[2] or "").encode()
        padded = text + b"\xff" * (576 - len(text) if len(text) < 576 and not text else -len(text) % 576)
        want.setdefault((r[1], hashlib.sha256(padded).hexdigest()), (len(text), len(padded), zlib.crc32(padded[-32:])))
    for r in found:
        assert want[(r["doc_id"], r["payload_sha256"])] == (r["n_bytes"], r["payload_bytes"], r["tail_crc32"])
        assert r["error"] is None and r["payload_bytes"] % 576 == 0 and len(r["feature"]) == 16
    assert len({(r["media_sha256"], r["media_bytes"], r["feature"]) for r in found}) == len({r["payload_sha256"] for r in found})


def test_bad_media(spark, empty):
    df = spark.createDataFrame([(1, 0, bytearray(b"junk")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    bad, none = media.read_media(df).orderBy("doc_id").collect()
    assert bad["error"] == "not a PNG" and bad["media_bytes"] == 4 and bad["feature"] is None
    assert none["error"] is None and none["media_bytes"] is None
    assert media.read_media(media.encode_media(empty)).collect() == []


def plain_hash(samples):
    """Every mean and every cosine sum by loops."""
    grid, low = 16, 8
    h, w = samples.shape[:2]
    cut = lambda n: [(i * n // grid, max((i + 1) * n // grid, i * n // grid + 1)) for i in range(grid)]
    small = [[float(samples[a:b, c:d].mean()) for c, d in cut(w)] for a, b in cut(h)]
    cos = lambda k, x: math.cos(math.pi * (2 * x + 1) * k / (2 * grid))
    found = [round(sum(small[y][x] * cos(v, y) * cos(u, x) for y in range(grid) for x in range(grid)), 6) for v in range(low) for u in range(low)]
    middle = sorted(found[1:])[31]
    bits = [False] + [x > middle for x in found[1:]]
    return bytes(sum(bit << (7 - i) for i, bit in enumerate(bits[at : at + 8])) for at in range(0, 64, 8)).hex()


def test_hash_by_loops():
    rng = np.random.default_rng(6)
    for h, w in ((24, 24), (48, 24), (72, 48), (16, 40)):
        samples = rng.integers(0, 256, (h, w, 1), dtype=np.uint8)
        assert media.cosine_hash(samples) == plain_hash(samples[:, :, 0])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r[0]: r[1] or "" for r in queries.documents(spark, sf).select("doc_id", "text").collect()}
    found = queries.op1_media(spark, sf).collect()
    assert {r["doc_id"] for r in found} == set(rows) and len(found) == len(rows)
    for r in found:
        text = rows[r["doc_id"]].encode()
        payload = text + b"\xff" * (-len(text) % 576 if text else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(text), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()


def test_names_that_need_quotes(spark):
    df = spark.createDataFrame([(1, "x", bytearray(media.write_png(media.payload_of(b"t"))))], "doc_id long, `a.b` string, __media binary")
    out = media.read_media(df, "__media", keep=("a.b", "doc_id"))
    assert out.columns[:2] == ["a.b", "doc_id"] and out.first()["feature"]
