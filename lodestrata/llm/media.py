"""Motion-JPEG media columns: AVI files in a binary column.

parse_riff() walks the RIFF chunks and finds frames by the idx1 index (by the movi list where there
is none, or where it points elsewhere than at frames). decode_jpeg() decodes baseline intra frames,
grey or colour with any sampling: Huffman symbols by table look-up (the standard's tables where a
frame brings none, as motion-JPEG's frames do), dequantising and the inverse cosine transform, in
integers, so results are equal on every machine. shots() cuts where the difference of neighbouring
frames' histograms of brightness stands out from those around it.

store_bytes() writes any bytes as such a file, without loss: each run of 64 bytes is one 8x8 block,
each byte one coefficient of the block in zigzag order. A byte b is the amplitude bits of an
8-bit coefficient (b itself if b >= 128, else b - 255), quantisation is 1 throughout, and restart
intervals of one block keep the first coefficient free of prediction. The files are ordinary
baseline JPEG frames; read_bytes() takes the coefficients back out of the entropy-coded data.

Every document is worked on alone, in slices of a batch: no shuffle, no group.

Defined results: a null media value has no frames and no clips; a text that is null counts as empty
and stores one block of zeros. A file that can't be read (cut off, not baseline, not a JPEG or AVI)
gives one clip row with its error and nothing else, so no row ends a job; decode_jpeg() and
parse_riff() themselves raise ValueError. A frame of length 0 repeats the one before.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, map_rows, table

SIDE, FPS = 32, 10
BLOCKS = (SIDE // 8) ** 2
BINS = 16


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient of the zigzag order."""
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * i + j for i, j in order])


def _inverse_dct() -> np.ndarray:
    """(zigzag coefficient, pixel) matrix in units of 2 ** -22; with integer coefficients all sums stay below 2 ** 53."""
    k = np.arange(8)
    one = np.round(np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k + 1) * k[:, None] * np.pi / 16) * 2**11)
    return np.kron(one, one)[_zigzag()]


ZIGZAG, IDCT = _zigzag(), _inverse_dct()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, symbol: int) -> bytes:
    """A Huffman table whose only code is the bit 0."""
    return _segment(0xC4, bytes([kind, 1, *[0] * 15, symbol]))


def jpeg_of(samples: np.ndarray) -> bytes:
    """A SIDE x SIDE baseline frame whose coefficients hold BLOCKS * 64 bytes."""
    head = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    head += _one_code(0x00, 8) + _one_code(0x10, 8) + _segment(0xDD, b"\0\1") + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits = np.zeros((BLOCKS, 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(samples.reshape(BLOCKS, 64, 1), axis=2)
    coded = np.packbits(bits.reshape(BLOCKS, 576), axis=1).tobytes()
    parts = [coded[i : i + 72].replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (i // 72) % 8]) for i in range(0, len(coded), 72)]
    return head + b"".join(parts)[:-2] + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def store_bytes(payload: bytes) -> bytes:
    """An AVI file that holds payload; a chunk 'plen' has its length, for the last frame is filled up."""
    size = BLOCKS * 64
    data = np.frombuffer(payload + b"\0" * (-len(payload) % size), np.uint8).reshape(-1, size)
    frames = [jpeg_of(f) for f in data]
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    at = np.cumsum([4, *map(len, chunks)]).tolist()
    index = b"".join(b"00dc" + struct.pack("<III", 0x10, a, len(f)) for a, f in zip(at, frames))
    body = hdrl + _chunk(b"plen", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index)
    return _chunk(b"RIFF", b"AVI " + body)


def parse_riff(media: bytes) -> tuple[list[bytes], float, int | None]:
    """The frames of the first video stream, frames a second, and the length that 'plen' gives."""
    try:
        return _parse_riff(media)
    except struct.error as e:
        raise ValueError(f"not a whole AVI file: {e}") from e


def _parse_riff(media: bytes) -> tuple[list[bytes], float, int | None]:
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    if 8 + struct.unpack_from("<I", media, 4)[0] > len(media):
        raise ValueError("an AVI file that is cut off")
    fps, plen, movi, index, todo = 25.0, None, None, None, [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    walked = []
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                kind = media[body : body + 4]
                if kind == b"movi":
                    movi = (body, min(end, body + size))
                else:
                    todo.append((body + 4, min(end, body + size)))
            elif name == b"avih":
                fps = 1e6 / max(1, struct.unpack_from("<I", media, body)[0])
            elif name == b"plen":
                plen = struct.unpack_from("<Q", media, body)[0]
            elif name == b"idx1":
                index = (body, min(end, body + size))
            at = body + size + size % 2
    if movi is None:
        raise ValueError("an AVI file without a movi list")
    entries = [e for e in struct.iter_unpack("<4sIII", media[index[0] : index[0] + (index[1] - index[0]) // 16 * 16]) if e[0][2:] in (b"dc", b"db")] if index else []
    for base in (movi[0], 0):  # some count from the file's start
        spots = [(base + at + 8, size) for _, _, at, size in entries]
        if entries and all(media[a - 8 : a - 4] == e[0] and a + n <= len(media) for (a, n), e in zip(spots, entries)):
            walked = [media[a : a + n] for a, n in spots]
            break
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":  # rec lists hold frames
                at += 12
                continue
            if name[2:] in (b"dc", b"db"):
                if at + 8 + size > len(media):
                    raise ValueError("a frame is cut off")
                walked.append(media[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    for k, frame in enumerate(walked):
        if not frame and k:
            walked[k] = walked[k - 1]
    return walked, fps, plen


#: The standard's Huffman tables (number of codes of each length, symbols), by the byte that names them.
STANDARD = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a53"
        "5455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9"
        "cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a53"
        "5455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8"
        "c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}
_PEEK = 16


@lru_cache(64)
def _look_up(counts: bytes, symbols: bytes) -> list[int]:
    """For each next 16 bits: length << 8 | symbol of the code they begin with, 0 where there is none."""
    table_, code, k = np.zeros(1 << _PEEK, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table_[code << (_PEEK - length) : (code + 1) << (_PEEK - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table_.tolist()


class Part(NamedTuple):
    """A colour component: sampling factors, blocks in a row, quantised coefficients (blocks, 64) in zigzag
    order, quantisation."""

    h: int
    v: int
    across: int
    coefs: np.ndarray
    quant: np.ndarray


def _decode_run(data: bytes, units: list, out: list, slots) -> None:
    """Decodes the blocks of one restart interval: units are (component, dc table, ac table) of an MCU, slots
    the places of each MCU's blocks."""
    data, acc, have, at = data + b"\xff" * 8, 0, 0, 0
    end, last = 8 * (len(data) - 8), [0] * len(out)
    for places in slots:
        for (c, dc, ac), place in zip(units, places):
            row, k = out[c][place], 0
            while k < 64:
                while have < 32:
                    acc, have, at = (acc << 8 | (data[at] if at < len(data) else 255)) & 0xFFFFFFFFFFFF, have + 8, at + 1
                found = (ac if k else dc)[acc >> (have - _PEEK) & 0xFFFF]
                if not found:
                    raise ValueError("a code that no table has")
                have -= found >> 8
                symbol = found & 255
                size = symbol & 15 if k else symbol
                if size > 11 + 4 * (k > 0):
                    raise ValueError("a coefficient of too many bits")
                if k and not size and symbol != 0xF0:
                    break  # end of block
                k += symbol >> 4 if k else 0
                v = 0
                if size:
                    have -= size
                    v = acc >> have & ((1 << size) - 1)
                    if not v >> (size - 1):
                        v -= (1 << size) - 1
                if k > 63:
                    raise ValueError("a block of more than 64 coefficients")
                if k == 0:
                    last[c] += v
                    v = last[c]
                row[k] = v
                k += 1
            if 8 * at - have > end:
                raise ValueError("a frame is cut off")


def components(frame: bytes) -> tuple[list[Part], int, int]:
    """A frame's components, width and height."""
    try:
        return _components(frame)
    except (IndexError, KeyError, struct.error, TypeError) as e:
        raise ValueError(f"not a whole JPEG frame: {e!r}") from e


def _components(frame: bytes) -> tuple[list[Part], int, int]:
    at, huff, quant, scan, every, parts = 2, {k: (bytes.fromhex(a), bytes.fromhex(b)) for k, (a, b) in STANDARD.items()}, {}, None, 0, None
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while scan is None:
        if frame[at] != 0xFF:
            raise ValueError("no marker where one must be")
        if frame[at + 1] == 0xFF:  # filling
            at += 1
            continue
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            for k in range(0, len(body), 65):
                if body[k] >> 4:
                    raise ValueError("16-bit quantisation is not baseline")
                quant[body[k] & 15] = np.frombuffer(body, np.uint8, 64, k + 1).astype(np.int64)
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3) or not width or not height:
                raise ValueError("only 8-bit frames of one or three components are decoded")
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if any(not 1 <= h <= 4 or not 1 <= v <= 4 for h, v, _ in parts.values()):
                raise ValueError("sampling factors out of range")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huff[body[k]] = body[k + 1 : k + 17], body[k + 17 : k + 17 + n]
                k += 17 + n
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = body
        at += 2 + size
    if parts is None or scan[0] != len(parts):
        raise ValueError("only frames of one interleaved scan are decoded")
    end = frame.rfind(b"\xff\xd9")
    if end < at:
        raise ValueError("a frame is cut off")
    runs = [x.replace(b"\xff\0", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", frame[at:end])]
    if len(parts) == 1:
        ((name, (_, _, q)),) = parts.items()
        parts = {name: (1, 1, q)}
        dc, ac = huff[scan[2] >> 4], huff[0x10 | scan[2] & 15]
        if every == 1 and dc == ac == (b"\1" + b"\0" * 15, b"\x08") and all(len(x) == 72 for x in runs):
            bits = np.unpackbits(np.frombuffer(b"".join(runs), np.uint8)).reshape(-1, 64, 9)
            if not bits[:, :, 0].any() and len(bits) == -(-width // 8) * -(-height // 8):  # each symbol is the bit 0 and eight amplitude bits
                v = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int64)
                return [Part(1, 1, -(-width // 8), np.where(v < 128, v - 255, v), quant[q])], width, height
    most = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
    if any(most[0] % h or most[1] % v for h, v, _ in parts.values()):
        raise ValueError("sampling factors that don't divide each other")
    wide, high = -(-width // (8 * most[0])), -(-height // (8 * most[1]))  # in MCUs
    tables = {scan[1 + 2 * k]: scan[2 + 2 * k] for k in range(scan[0])}
    units, spots, out = [], [], []
    mcu = np.arange(wide * high)
    for c, (name, (h, v, _)) in enumerate(parts.items()):
        out.append([[0] * 64 for _ in range(wide * high * h * v)])
        dc, ac = _look_up(*huff[tables[name] >> 4]), _look_up(*huff[0x10 | tables[name] & 15])
        for y in range(v):
            for x in range(h):
                units.append((c, dc, ac))
                spots.append((mcu // wide * v + y) * wide * h + mcu % wide * h + x)
    slots = np.stack(spots, 1).tolist()
    every = every or len(slots)
    if len(runs) < -(-len(slots) // every):
        raise ValueError("a frame is cut off")
    for k, first in enumerate(range(0, len(slots), every)):
        _decode_run(runs[k], units, out, slots[first : first + every])
    return [Part(h, v, wide * h, np.array(own, np.int64), quant[q]) for own, (h, v, q) in zip(out, parts.values())], width, height


def decode_blocks(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Pixels (blocks, 64) from 0 to 255."""
    return np.clip(np.floor((coefs * quant).astype(float) @ IDCT / 2**22 + 0.5) + 128, 0, 255).astype(np.uint8)


def _plane(part: Part) -> np.ndarray:
    return decode_blocks(part.coefs, part.quant).reshape(-1, part.across, 8, 8).swapaxes(1, 2).reshape(-1, part.across * 8)


def brightness(frame: bytes) -> np.ndarray:
    """The frame's brightness (height, width): its first component."""
    parts, width, height = components(frame)
    return _spread(parts, 0)[:height, :width]


def _spread(parts: list[Part], k: int) -> np.ndarray:
    """A component's plane in the size of the largest, each sample repeated."""
    plane = _plane(parts[k])
    return plane.repeat(max(p.v for p in parts) // parts[k].v, 0).repeat(max(p.h for p in parts) // parts[k].h, 1)


def decode_jpeg(frame: bytes) -> np.ndarray:
    """The frame's pixels (height, width), or (height, width, 3) in red, green, blue."""
    parts, width, height = components(frame)
    y, *rest = (_spread(parts, k)[:height, :width].astype(np.int64) for k in range(len(parts)))
    if not rest:
        return y.astype(np.uint8)
    b, r = (x - 128 for x in rest)
    rgb = np.stack([y + (91881 * r + 32768 >> 16), y - (22554 * b + 46802 * r + 32768 >> 16), y + (116130 * b + 32768 >> 16)], 2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def read_bytes(media: bytes) -> bytes:
    """What store_bytes() has stored."""
    frames, _, plen = parse_riff(media)
    if plen is None:
        raise ValueError("a file without stored bytes")
    return b"".join(_samples(components(f)[0][0].coefs).tobytes() for f in frames)[:plen]


def _samples(coefs: np.ndarray) -> np.ndarray:
    return np.where(coefs < 0, coefs + 255, coefs).astype(np.uint8)


def histogram(pixels: np.ndarray) -> np.ndarray:
    return np.bincount((pixels >> 4).ravel(), minlength=BINS)[:BINS]


def _median(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the n finite values of each row; the others are infinite."""
    rows, at = np.sort(rows, axis=1), np.arange(len(rows))
    return (rows[at, (n - 1) // 2] + rows[at, n // 2]) / 2


def shots(hists: np.ndarray, around: int = 8, factor: float = 2.5, least: float = 0.02, sure: float = 0.5) -> list[tuple[int, int]]:
    """(first frame, end frame) of each shot. A cut is a frame whose histogram's distance from the
    one before is at least `least` and `factor` deviations over the mean of the distances around it, or
    twice that over their median in median deviations (of `least` at least), which other cuts nearby
    don't raise; or a distance of `sure`, whatever is around it."""
    n = len(hists)
    if n == 0:
        return []
    d = np.abs(np.diff(hists, axis=0)).sum(1) / (2 * np.maximum(1, hists[1:].sum(1)))
    total, square = (np.concatenate([[0], np.cumsum(x)]) for x in (d, d * d))
    k = np.arange(len(d))
    a, b = np.maximum(0, k - around), np.minimum(len(d), k + around + 1)
    m = np.maximum(1, b - a - 1)
    mean = (total[b] - total[a] - d) / m
    dev = np.sqrt(np.maximum(0, (square[b] - square[a] - d * d) / m - mean**2))
    near = np.lib.stride_tricks.sliding_window_view(np.pad(d, around, constant_values=np.inf), 2 * around + 1).copy() if len(d) else d[:, None]
    near[:, around : around + 1] = np.inf
    known = np.isfinite(near)
    level = _median(near, m)
    spread = 1.4826 * _median(np.where(known, np.abs(np.where(known, near, 0) - level[:, None]), np.inf), m) if len(d) else d
    out = (d > mean + factor * dev) | (d > level + 2 * factor * np.maximum(spread, least))
    cuts = (np.flatnonzero((d >= sure) | (d >= least) & out & (m > 1)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n]))


def clips_of(media: bytes | None) -> list[tuple[int, int, int, int, str]]:
    """(first frame, end frame, start ms, end ms, mean histogram) of each shot."""
    if media is None:
        return []
    frames, fps, _ = parse_riff(media)
    hists = np.array([histogram(brightness(f)) for f in frames]).reshape(-1, BINS)
    return _clip_rows(hists, fps)


def _clip_rows(hists: np.ndarray, fps: float) -> list[tuple[int, int, int, int, str]]:
    rows = []
    for a, b in shots(hists):
        total = hists[a:b].sum(0)
        share = total * 255 // max(1, int(total.sum()))
        rows.append((a, b, round(1000 * a / fps), round(1000 * b / fps), bytes(share.tolist()).hex()))
    return rows


def clip_rows(files: DataFrame, file_id: str, media: str) -> DataFrame:
    """One row per shot of each file: (id, clip, first_frame, end_frame, start_ms, end_ms, histogram, error); a
    file that can't be read has one row, with all but id and error null."""
    schema = fields("clip int, first_frame int, end_frame int, start_ms long, end_ms long, histogram string, error string")

    def cut(ids, blobs):
        rows = []
        for i, blob in zip(ids, blobs):
            try:
                rows += [(i, k, *c, None) for k, c in enumerate(clips_of(blob))]
            except ValueError as e:
                rows.append((i, *[None] * 6, str(e)))
        return list(zip(*rows)) or [[]] * 8

    picked = files.select(F.col(file_id).alias("id"), F.col(media).alias("media"))
    out = type(schema)([picked.schema["id"], *schema.fields])
    return map_rows(picked, cut, out, 64)


def stored_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as UTF-8, filled with zeros to whole blocks, as an AVI file."""

    def write(ids, texts):
        raw = [(t or "").encode() for t in texts]
        return ids, [len(r) for r in raw], [store_bytes(r + b"\0" * (-len(r) % 64 if r else 64)) for r in raw]

    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = fields("n_bytes long, media binary")
    return map_rows(picked, write, type(schema)([picked.schema["id"], *schema.fields]), 128)


def media_features(files: DataFrame) -> DataFrame:
    """Reads the stored bytes and the shots back from (id, n_bytes, media)."""

    def read(ids, sizes, blobs):
        rows = []
        for i, n, blob in zip(ids, sizes, blobs):
            frames, fps, plen = parse_riff(blob)
            parts = [components(f)[0][0] for f in frames]
            payload = b"".join(_samples(p.coefs).tobytes() for p in parts)[:plen]
            pixels = decode_blocks(np.concatenate([p.coefs for p in parts]), parts[0].quant).reshape(len(parts), -1)
            at = (pixels >> 4) + (np.arange(len(parts), dtype=np.int64) * BINS)[:, None]
            hists = np.bincount(at.ravel(), minlength=BINS * len(parts)).reshape(-1, BINS)
            clips = ",".join(f"{c[2]}-{c[3]}:{c[4]}" for c in _clip_rows(hists, fps))
            rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), f"{len(frames)} frames;{clips}"))
        return list(zip(*rows)) or [[]] * 8

    schema = fields("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return map_rows(files, read, type(schema)([files.schema["id"], *schema.fields]), 128)


def op3_media_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return media_features(stored_media(docs)).withColumnRenamed("id", "doc_id")
