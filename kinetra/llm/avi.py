"""Media columns: AVI files of motion-JPEG frames.

``encode_avi`` stores bytes losslessly in the unit of the format, the quantised coefficient: 64 bytes are
one 8 x 8 block in zigzag order, each byte a coefficient of size category 8 whose extra bits are the byte.
With one 8-bit Huffman code for that category, entropy-coded data is byte-aligned and is written and read
by array operations; all other baseline streams are decoded code by code. A reader follows the RIFF index
to the frames, decodes them, and cuts shots where histogram differences stand out from those before.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinetra.llm.kernel import slices
from kinetra.llm.scratch import bound_batches

SIDE, FPS = 64, 25
BLOCKS = (SIDE // 8) ** 2
FRAME_BYTES = BLOCKS * 64

# Fixed values of the format: zigzag order of an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

_DATA, _END = 0, 1  # the codes of category 8 and of category 0 / end of block
_K = np.arange(8)
_BASIS = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
#: Zigzag coefficients -> samples, row-major.
_INVERSE = np.kron(_BASIS, _BASIS)[ZIGZAG]


# ---- JPEG frames ------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, symbols: bytes) -> bytes:
    return bytes([kind]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + symbols


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([1] * 64))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, _huffman(0x00, bytes([8, 0])) + _huffman(0x10, bytes([8, 0])))
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
_RESTART = np.array([[0xFF, 0xD0 + i % 8] for i in range(BLOCKS)], np.uint8)


def encode_frame(data: bytes) -> bytes:
    """A JPEG with the blocks of ``data`` (a multiple of 64 bytes, ``FRAME_BYTES`` at most), then empty blocks."""
    n = len(data) // 64
    units = np.zeros((n, 130), np.uint8)
    units[:, 1:128:2] = np.frombuffer(data, np.uint8).reshape(n, 64)
    units[:, 128:] = _RESTART[:n]
    if 0xFF in data:  # a byte 0xFF in entropy-coded data is followed by 0
        body = b"".join(u[:128].tobytes().replace(b"\xff", b"\xff\x00") + u[128:].tobytes() for u in units)
    else:
        body = units.tobytes()
    body += b"".join(bytes([_END, _END]) + _RESTART[i].tobytes() for i in range(n, BLOCKS))
    return _HEAD + body[:-2] + b"\xff\xd9"


def _tables(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    while body:
        kind, counts = body[0], body[1:17]
        symbols, body = body[17 : 17 + sum(counts)], body[17 + sum(counts) :]
        code, at, table = 0, 0, {}
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                table[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        yield kind, table


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("entropy-coded data ends early")
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Quantised coefficients (blocks, 64) in zigzag order of the first component, its quantisers, and (height, width).

    Baseline frames with any tables, restarts, components and sampling; others raise ValueError.
    """
    at, quant, huff, restart, frame = 2, {}, {}, 0, None
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            huff.update(_tables(body))
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: (huff[body[2 + 2 * i] >> 4], huff[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0])}
            break
    data = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    lone = len(frame) == 1
    most_h, most_v = max(c[1] for c in frame), max(c[2] for c in frame)
    across = -(-width // 8) if lone else -(-width // (8 * most_h))
    down = -(-height // 8) if lone else -(-height // (8 * most_v))
    ours = {(8, 0): 8, (8, 1): 0}
    q = quant[frame[0][3]]
    if lone and restart == 1 and all(t == ours for t in scan[frame[0][0]]):
        return _aligned(data, across * down), q, (height, width)
    found: list[np.ndarray] = []
    parts = _restarts(data) if restart else [data]
    for k, part in enumerate(parts):
        bits, before = _Bits(part.replace(b"\xff\x00", b"\xff")), {c[0]: 0 for c in frame}
        for _ in range(min(restart, across * down - k * restart) if restart else across * down):
            for name, h, v, _ in frame:
                for _ in range(1 if lone else h * v):
                    dc, ac = scan[name]
                    block = np.zeros(64, np.int64)
                    before[name] += bits.signed(bits.symbol(dc))
                    block[0] = before[name]
                    i = 1
                    while i < 64:
                        s = bits.symbol(ac)
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            block[i] = bits.signed(s & 15)
                        i += 1
                    if name == frame[0][0]:
                        found.append(block)
    return np.array(found), q, (height, width)


def _restarts(data: bytes) -> list[bytes]:
    out, begin, at = [], 0, data.find(b"\xff")
    while at >= 0:
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[begin:at])
            begin = at + 2
        at = data.find(b"\xff", at + 2)
    return [*out, data[begin:]]


def _aligned(data: bytes, blocks: int) -> np.ndarray:
    """Blocks of a stream whose codes are all one byte and whose blocks are restarted each."""
    out = np.zeros((blocks, 64), np.int64)
    full = len(data) // 130 + 1
    raw = np.frombuffer(data, np.uint8)
    plain = 0  # the leading full blocks without stuffing
    if len(data) >= 128:
        n = min(full, blocks, (len(data) + 2) // 130)
        grid = np.frombuffer(data[: 130 * n - 2] + b"\xff\xd0", np.uint8).reshape(n, 130)
        good = (grid[:, 0:128:2] == _DATA).all(1) & (grid[:, 128] == 0xFF) & ((grid[:, 129] >= 0xD0) & (grid[:, 129] <= 0xD7)) & ~(grid[:, 1:128:2] == 0xFF).any(1)
        plain = n if good.all() else int(np.argmin(good))
        v = grid[:plain, 1:128:2].astype(np.int64)
        out[:plain] = np.where(v >= 128, v, v - 255)
    for i, part in enumerate(_restarts(raw[130 * plain :].tobytes()), plain):
        v = np.frombuffer(part.replace(b"\xff\x00", b"\xff"), np.uint8)
        if len(v) == 128:
            v = v[1::2].astype(np.int64)
            out[i] = np.where(v >= 128, v, v - 255)
        elif v.tolist() not in ([_END, _END], []):
            raise ValueError("a block is neither full nor empty")
    return out


def frame_payload(coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode_frame`` stored; empty blocks hold none."""
    full = coefficients[(coefficients != 0).any(1)]
    return np.where(full > 0, full, full + 255).astype(np.uint8).tobytes()


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples (blocks, 64) by the inverse cosine transform."""
    return np.clip(np.rint((coefficients * quant).astype(float) @ _INVERSE + 128), 0, 255).astype(np.uint8)


# ---- AVI container ----------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], comment: bytes = b"", fps: int = FPS, side: int = SIDE) -> bytes:
    """A RIFF AVI with one motion-JPEG stream, an INFO comment and an idx1 index."""
    most = max((len(f) for f in frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment + b"\0"))
    chunks = [_chunk(b"00dc", f) for f in frames]
    at = np.cumsum([4, *map(len, chunks)])
    index = b"".join(struct.pack("<4sIII", b"00dc", 0x10, a, len(f)) for a, f in zip(at.tolist(), frames))
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index)
    return _chunk(b"RIFF", body)


def read_avi(media: bytes) -> tuple[float, bytes, list[bytes]]:
    """Seconds a frame, the comment, and the frames that the index lists; a broken file raises ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, comment, movi, index = 1 / FPS, b"", None, b""

    def walk(at: int, end: int) -> None:
        nonlocal rate, comment, movi, index
        while at + 8 <= end:
            name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    walk(at + 12, at + 8 + size)
            elif name == b"strh" and media[at + 8 : at + 12] == b"vids":
                scale, per = struct.unpack("<II", media[at + 28 : at + 36])
                rate = scale / per
            elif name == b"ICMT":
                comment = media[at + 8 : at + 8 + size].rstrip(b"\0")
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + size]
            at += 8 + size + size % 2

    walk(12, min(len(media), 8 + int.from_bytes(media[4:8], "little")))
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    for name, _, at, size in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            if media[movi + at : movi + at + 4] != name:
                raise ValueError("the index does not point at a frame")
            frames.append(media[movi + at + 8 : movi + at + 8 + size])
    return rate, comment, frames


# ---- shots ------------------------------------------------------------------------------------

BINS, WINDOW, SPREAD, LEAST = 16, 12, 3.0, 0.05


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) frames of each shot: a cut is where the histogram difference is over the mean
    of the ``WINDOW`` differences before it by ``SPREAD`` deviations, and over ``LEAST``."""
    n = len(histograms)
    if not n:
        return []
    share = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
    d = np.abs(np.diff(share, axis=0)).sum(1) / 2
    starts = [0]
    for i in range(1, n):
        past = d[max(starts[-1], i - 1 - WINDOW) : i - 1]
        limit = past.mean() + SPREAD * past.std() if len(past) >= 2 else 2 * LEAST
        if d[i - 1] > max(limit, LEAST):
            starts.append(i)
    return list(zip(starts, [*starts[1:], n]))


def encode_avi(payload: bytes, comment: bytes = b"") -> bytes:
    """An AVI that stores ``payload``, whose length is a multiple of 64."""
    return write_avi([encode_frame(payload[i : i + FRAME_BYTES]) for i in range(0, len(payload), FRAME_BYTES)], comment)


def decode_avi(media: bytes) -> tuple[float, bytes, list[bytes], np.ndarray]:
    """Seconds a frame, the comment, each frame's stored bytes, and each frame's histogram of samples."""
    rate, comment, frames = read_avi(media)
    stored, hist = [], []
    for f in frames:
        coefficients, quant, _ = decode_frame(f)
        stored.append(frame_payload(coefficients))
        hist.append(np.bincount(samples(coefficients, quant).ravel() >> 4, minlength=BINS))
    return rate, comment, stored, np.array(hist, np.int64).reshape(-1, BINS)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def with_media(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: each text (null: empty) as UTF-8, padded with 0 to a positive multiple of 64, in an AVI.

    Every row of ``docs(doc_id, text, ...)`` gives a row, also one with a null or repeated doc_id; equal texts give equal
    files. Other columns are ignored; an empty table gives an empty result."""

    def run(batches):
        for batch in slices(batches, most=1 << 20):
            media = [encode_avi(p, str(n).encode()) for n, p in map(padded, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """``media(doc_id, media)`` -> a row per shot: ``doc_id, clip, first_frame, frames, start_s, end_s, error``.

    Null media has no rows; a file that can't be read gives one row with ``error`` and nulls else; one without
    frames has no rows. Null and repeated doc_ids are kept as they are. Other columns are ignored; an empty table
    gives an empty result.
    """

    def run(batches):
        for batch in slices(batches, "media", 4 << 20):
            out = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                if raw is None:
                    continue
                try:
                    rate, _, _, hist = decode_avi(raw)
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    out.append((doc, None, None, None, None, None, str(e)))
                    continue
                out += [(doc, *clip, None) for clip in timed(rate, hist)]
            if out:
                cols = list(zip(*out))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s", "error"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame long, frames long, start_s double, end_s double, error string")


CLIPS = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def timed(rate: float, histograms: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """``clip, first_frame, frames, start_s, end_s`` of each shot."""
    return [(k, a, b - a, a * rate, b * rate) for k, (a, b) in enumerate(shots(histograms))]


def _digest(media: bytes) -> tuple:
    rate, comment, stored, hist = decode_avi(media)
    sha, total, tail = hashlib.sha256(), 0, b""
    for part in stored:
        sha.update(part)
        total += len(part)
        tail = (tail + part)[-64:]
    clips = timed(rate, hist)
    feature = f"frames={len(stored)};clips={','.join(f'{a:.2f}-{b:.2f}' for *_, a, b in clips)};histogram={','.join(map(str, hist.sum(0)))}"
    return int(comment), total, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, [dict(zip((f.name for f in CLIPS.value_type), c)) for c in clips]


def op3_avi(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``clips``: the timed clip rows of the document's media."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), CLIPS]

    def run(batches):
        for batch in slices(batches, "media", 4 << 20):
            rows = [(d, *_digest(m)) for d, m in zip(batch.column("doc_id").to_pylist(), (x.as_py() for x in batch.column("media")))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    media = with_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    clips = "array<struct<clip: int, first_frame: bigint, frames: bigint, start_s: double, end_s: double>>"
    return media.mapInArrow(run, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips {clips}")
