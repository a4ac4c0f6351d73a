"""Documents as images in a binary column: PNG written and read here, and a cosine-transform hash.

The writer makes an 8-bit greyscale PNG of the payload. The reader takes any 8-bit PNG without
interlacing: it walks the chunks, tests each checksum, joins and inflates the zlib data and undoes
the row filters in numpy. Both run row by row in the tasks that read the documents; there is no
shuffle and a task holds one image at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillframe.llm.common import blocks, columns_of, in_arrow, picked

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: A payload is a whole number of squares of this side.
SIDE = 24
PAD = b"\xff"
#: Most bytes of one data chunk.
CHUNK = 1 << 20
GRID, LOW = 16, 8


def payload_of(text: bytes) -> bytes:
    """The text, padded to a positive multiple of SIDE * SIDE."""
    unit = SIDE * SIDE
    return text + PAD * (-len(text) % unit if text else unit)


def shape_of(n: int) -> tuple[int, int]:
    """Height and width for n bytes, the widest whole rows that are no wider than high."""
    squares = n // (SIDE * SIDE)
    wide = next(w for w in range(int(squares**0.5), 0, -1) if squares * SIDE % w == 0)
    return n // (SIDE * wide), SIDE * wide


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG. Of the differences to the left and upwards, each row has those with the
    least sum of absolute values."""
    height, width = shape_of(len(payload))
    plain = np.frombuffer(payload, np.uint8).reshape(height, width)
    forms = np.stack([np.diff(plain, axis=1, prepend=np.uint8(0)), np.diff(plain, axis=0, prepend=np.uint8(0))])
    kinds = np.abs(forms.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kinds + 1, forms[kinds, np.arange(height)]
    data = zlib.compress(rows.tobytes(), level)
    parts = [_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def read_png(media: bytes) -> np.ndarray:
    """Samples as a (height, width, channels) array; ValueError says what is wrong with other input."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(media):
            raise ValueError("cut off")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(media):
            raise ValueError("cut off")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 0x20:
            raise ValueError(f"unknown chunk {kind!r}")
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in CHANNELS or any(head[4:]):
        raise ValueError("only 8-bit samples without palette and interlacing")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    stride = width * channels
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(data), height * (stride + 1) + 1)
    except zlib.error as e:
        raise ValueError(f"zlib data: {e}") from e
    if len(raw) != height * (stride + 1):
        raise ValueError("zlib data of another length")
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    return unfilter(rows[:, 0], rows[:, 1:], channels).reshape(height, width, channels)


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the five row filters; step is the bytes of a pixel."""
    if not kinds.any():
        return rows
    if kinds.max() > 4:
        raise ValueError("unknown filter")
    if kinds.max() > 2:
        return _by_diagonals(kinds, rows, step)
    out, left = rows.copy(), kinds == 1
    out[left] = np.cumsum(rows[left].reshape(left.sum(), -1, step), axis=1, dtype=np.uint8).reshape(-1, rows.shape[1])
    for y in np.flatnonzero(kinds[1:] == 2) + 1:
        out[y] += out[y - 1]
    return out


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """All five filters, diagonal by diagonal: what a pixel's guess needs lies on the two before its own."""
    h, w = len(rows), rows.shape[1] // step
    out, raw = np.zeros((h + 1, w + 1, step), np.int16), rows.reshape(h, w, step)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) // 2, nearest])
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(rows.shape)


_K = np.arange(GRID)
_COSINES = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:LOW, None] / (2 * GRID))


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which low frequencies of the image, averaged to GRID x GRID, exceed their median."""
    grey = samples.astype(np.int64).sum(2) if samples.shape[2] > 1 else samples[:, :, 0]
    h, w = grey.shape
    ys, xs = np.arange(GRID) * h // GRID, np.arange(GRID) * w // GRID
    sums = np.add.reduceat(np.add.reduceat(grey, ys, axis=0, dtype=np.int64), xs, axis=1)
    heights, widths = np.maximum(np.diff(ys, append=h), 1), np.maximum(np.diff(xs, append=w), 1)
    low = _COSINES @ (sums / (heights[:, None] * widths[None, :] * samples.shape[2])) @ _COSINES.T
    flat = np.round(low.ravel(), 6)
    bits = flat > np.median(flat[1:])
    bits[0] = False  # the mean says nothing about the form
    return np.packbits(bits).tobytes().hex()


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) as a PNG in a binary column.

    Equal texts give equal media; repeated rows are encoded each. Other columns, whatever their names,
    are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, data, offsets in blocks(batches):
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield {"doc_id": rows.column(0), "n_bytes": np.diff(offsets), "media": [write_png(payload_of(t)) for t in texts]}

    return in_arrow(columns_of(df, doc_id=id_col, text=text_col), run, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def read_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes"), with_payload: bool = False) -> DataFrame:
    """The kept columns and what the stored bytes give: payload_bytes, payload_sha256, tail_crc32 (of
    the last 32 bytes), media_bytes, media_sha256, feature, error (and payload, with with_payload).

    Bytes that are no sound PNG give their own size and hash, the error, and null for the rest; null
    media give nulls and no error. Equal bytes give equal values. An empty table gives an empty result.
    """
    rows = picked(df, keep, media_col, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, data, offsets in blocks(batches, "media"):
            stored = block.column(len(keep))
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", "payload")}
            for i in range(len(block)):
                row = dict.fromkeys(out)
                if stored[i].is_valid:
                    media = data[offsets[i] : offsets[i + 1]].tobytes()
                    row |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
                    try:
                        samples = read_png(media)
                        payload = samples.tobytes()
                        row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "feature": cosine_hash(samples), "payload": payload}
                    except ValueError as e:
                        row["error"] = str(e)
                for k in out:
                    out[k].append(row[k])
            yield {f"k{i}": block.column(i) for i in range(len(keep))} | out

    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string" + (", payload binary" if with_payload else "")
    kind = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string(made).fields])
    return in_arrow(rows, run, kind).toDF(*keep, *kind.names[len(keep) :])
