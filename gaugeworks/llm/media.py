"""Media columns: texts as PNG images in binary columns, and hashes of their low cosine frequencies.

A payload becomes an 8-bit RGB image, 64 pixels (192 bytes) a row. The writer compares
unfiltered rows with rows filtered by None, Sub or Up (least sum of absolute differences) and keeps what zlib makes
shorter; the reader tests every chunk's CRC-32, the chunk order, the zlib
stream's Adler-32 and the sample count, and undoes all five row filters in numpy. The feature is the sign, against
the median, of the 8 x 8 lowest frequencies of the 32 x 32 area-averaged image.

Defined cases: a null or empty text is a payload of 192 spaces; damaged media raise MediaError; equal payloads
give equal media; an empty table gives an empty result; repeated rows give repeated results; other columns are
ignored. One row's image is held in memory at a time, Arrow batches are bounded by Spark's byte limit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, whole

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 20


class MediaError(ValueError):
    """The stored bytes are not the PNG that they should be."""


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub = rows.copy()
    sub[:, 3:] -= rows[:, :-3]
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (rows, sub, up)])
    kind = cost.argmin(0).astype(np.uint8)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.where((kind == 0)[:, None], rows, np.where((kind == 1)[:, None], sub, up))
    plain = np.zeros_like(lines)
    plain[:, 1:] = rows
    body = min((zlib.compress(x.tobytes(), level) for x in (plain, lines)), key=len)
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *(_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)), _chunk(b"IEND", b"")])


def chunks_of(media: bytes) -> list[tuple[bytes, bytes]]:
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    out, at = [], 8
    while at < len(media):
        if at + 12 > len(media):
            raise MediaError("cut chunk")
        (n,), kind = struct.unpack_from(">I", media, at), bytes(media[at + 4 : at + 8])
        body = media[at + 8 : at + 8 + n]
        if at + 12 + n > len(media) or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"checksum of {kind!r}")
        out.append((kind, bytes(body)))
        at += 12 + n
    if not out or out[0][0] != b"IHDR" or out[-1] != (b"IEND", b""):
        raise MediaError("chunk order")
    return out


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered lines (first byte: filter). Runs of None, Sub and Up rows are undone at once."""
    kind, rows = lines[:, 0], lines[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise MediaError("unknown row filter")
    cuts = np.flatnonzero(np.diff(kind)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(kind)]):
        above = rows[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind[a] == 1:
            run = rows[a:b].reshape(b - a, -1, step)
            rows[a:b] = np.cumsum(run, axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind[a] == 2:
            rows[a] += above
            np.cumsum(rows[a:b], axis=0, dtype=np.uint8, out=rows[a:b])
        elif kind[a] >= 3:
            for r in range(a, b):
                _unfilter_row(rows[r], rows[r - 1] if r else np.zeros_like(rows[0]), int(kind[r]), step)
    return rows


def _unfilter_row(row: np.ndarray, above: np.ndarray, kind: int, step: int) -> None:
    left = corner = np.zeros(step, np.int16)
    for x in range(0, len(row), step):
        up = above[x : x + step].astype(np.int16)
        if kind == 3:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            pa, pb, pc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        row[x : x + step] += guess.astype(np.uint8)
        left, corner = row[x : x + step].astype(np.int16), up


def decode_png(media: bytes) -> np.ndarray:
    """Samples as (height, width, channels)."""
    parts = chunks_of(media)
    width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", parts[0][1])
    if (depth, rest) != (8, [0, 0, 0]) or colour not in (0, 2, 4, 6):
        raise MediaError("unsupported layout")
    step = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    try:
        raw = zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT"))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width * step + 1):
        raise MediaError("sample count")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), step).reshape(height, width, step)


def _dct(n: int, rows: int) -> np.ndarray:
    k, x = np.arange(rows)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


DCT = _dct(32, 8)


def _shrink(m: np.ndarray, size: int = 32) -> np.ndarray:
    """Area means along the first axis; short axes repeat their rows."""
    if len(m) < size:
        return m[np.arange(size) * len(m) // size]
    edge = np.arange(size + 1) * len(m) // size
    return np.add.reduceat(m, edge[:-1], axis=0) / np.diff(edge)[:, None]


def cosine_hash(samples: np.ndarray) -> bytes:
    grey = samples.mean(axis=2, dtype=np.float64)
    low = (DCT @ _shrink(_shrink(grey).T).T @ DCT.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the PNG as binary column media."""

    def write(batches):
        import pandas as pd

        for b in batches:
            made = [payload_of(t) for t in b["_text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [n for n, _ in made], "media": [encode_png(p) for _, p in made]})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).mapInPandas(write, f"doc_id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the media column back: payload facts, media facts and the hash as binary column feature."""

    def read(batches):
        import pandas as pd

        for b in batches:
            out = []
            for m in b["media"]:
                m = bytes(m)
                samples = decode_png(m)
                p = samples.tobytes()
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(samples)))
            cols = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pd.concat([b[["doc_id", "n_bytes"]].reset_index(drop=True), pd.DataFrame(out, columns=cols)], axis=1)

    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "n_bytes", "media").mapInPandas(
        read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature binary"
    )


def op1_media_columns(spark, sf_dir):
    found = media_features(encode_column(documents(spark, sf_dir)))
    return found.withColumn("feature", F.lower(F.hex("feature")))
