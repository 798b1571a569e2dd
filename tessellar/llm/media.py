"""Progressive JPEG columns: scans accumulate into coefficient arrays, numpy inverts the transform.

The decoder takes any 8-bit progressive file: spectral selection, successive approximation, interleaved and single
scans, subsampled components and restart intervals. Entropy-coded data are read symbol by symbol, except in scans whose
Huffman table has one code only: there every symbol has the same length, and a whole band is read as one array.

Texts are stored in the format's own unit, the quantised coefficient: 192 bytes make one MCU of three 8x8 blocks.
The first byte of a block is its DC coefficient plus 128. Every other byte b is the AC coefficient whose eight
additional bits are b in size category 8: b from 128 on stands for itself, smaller b for b - 255.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import by_bytes, small_batches

UNIT = 192
FILLER = 32
BATCH_BYTES = 4_000_000


@cache
def zigzag() -> np.ndarray:
    """Natural index (row * 8 + column) of each place of the zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


@cache
def basis() -> np.ndarray:
    """Pixels of a block are its 64 zigzag coefficients times this matrix."""
    u = np.arange(8)
    c = np.cos((2 * u[:, None] + 1) * u[None, :] * math.pi / 16) * np.where(u == 0, math.sqrt(1 / 8), 0.5)  # pixel x frequency
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return full[zigzag()].astype(np.float32)


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks a row, with the padding of whole MCUs
    high: int = 0
    own_wide: int = 0  # blocks a row in scans of this component alone
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]
    comment: bytes


class Huffman:
    """Codes of one table, by their bits as text; ``single`` is its only symbol, if there is one only and its code is one bit long."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[str, int] = {}
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[f"{code:0{length}b}"] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.lengths = sorted({len(c) for c in self.codes})
        self.single = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


class Bits:
    """Reads bits of unstuffed data, held as text of 0 and 1."""

    def __init__(self, data: bytes):
        self.text, self.at = f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}" if data else "", 0

    def take(self, k: int) -> int:
        if k == 0:
            return 0
        self.at += k
        if self.at > len(self.text):
            raise ValueError("the data end inside a scan")
        return int(self.text[self.at - k : self.at], 2)

    def symbol(self, table: Huffman) -> int:
        for length in table.lengths:
            if (s := table.codes.get(self.text[self.at : self.at + length])) is not None:
                self.at += length
                return s
        raise ValueError("no such code")


def extend(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


@lru_cache(64)
def _own(wide: int, own_wide: int, own_high: int) -> np.ndarray:
    """Indices of the blocks of a scan of one component alone, in order, one row for each."""
    return (np.arange(own_high)[:, None] * wide + np.arange(own_wide)).reshape(-1, 1)


@lru_cache(64)
def _within(wide: int, h: int, v: int, across: int, down: int) -> np.ndarray:
    """Indices of a component's blocks in a scan of several components, one row for each MCU."""
    mcu = np.arange(across * down)
    y, x = mcu // across, mcu % across
    return (y[:, None] * v + np.repeat(np.arange(v), h)) * wide + x[:, None] * h + np.tile(np.arange(h), v)


def _order(picture: Picture, part: list[Component]) -> list[np.ndarray]:
    """For each component of a scan, the indices of its blocks: one row for each MCU."""
    if len(part) == 1:
        c = part[0]
        return [_own(c.wide, c.own_wide, c.own_high)]
    return [_within(c.wide, c.h, c.v, c.wide // c.h, c.high // c.v) for c in part]


def _dc_first(data: bytes, part: list[Component], order: list[np.ndarray], tables: dict, shift: int) -> None:
    bits, codes = Bits(data), [tables[c.name] for c, o in zip(part, order, strict=True) for _ in range(o.shape[1])]
    text, at, differences = bits.text, 0, []
    for _ in range(len(order[0])):
        for table in codes:
            for length in table.lengths:
                if (size := table.codes.get(text[at : at + length])) is not None:
                    break
            else:
                raise ValueError("no such code")
            at += length
            differences.append(extend(int(text[at : at + size], 2), size) if size else 0)
            at += size
    if at > len(text):
        raise ValueError("the data end inside a scan")
    d, k = np.array(differences, np.int64).reshape(len(order[0]), -1), 0
    for c, o in zip(part, order, strict=True):
        n = o.shape[1]
        c.coefficients[o.ravel(), 0] = np.cumsum(d[:, k : k + n].ravel()) << shift
        k += n


def _dc_refine(data: bytes, part: list[Component], order: list[np.ndarray], shift: int) -> None:
    """One bit for each coefficient, read as one array."""
    per, k = sum(o.shape[1] for o in order), 0
    bit = np.unpackbits(np.frombuffer(data, np.uint8))[: per * len(order[0])].reshape(-1, per).astype(np.int16) << shift
    for c, o in zip(part, order, strict=True):
        c.coefficients[o, 0] |= bit[:, k : k + o.shape[1]]
        k += o.shape[1]


def _ac_first(bits: Bits, c: Component, blocks: list[int], table: Huffman, low: int, high: int, shift: int) -> None:
    run = 0
    for b in blocks:
        if run:
            run -= 1
            continue
        k = low
        while k <= high:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                c.coefficients[b, k] = extend(bits.take(size), size) * (1 << shift)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _ac_first_even(data: bytes, c: Component, own: np.ndarray, symbol: int, low: int, high: int, shift: int) -> None:
    """A band in which every coefficient has the same symbol: no zeros before it, one size."""
    size, wide = symbol & 15, high - low + 1
    n = len(own) * wide
    raw = np.frombuffer(data, np.uint8)
    if size == 7:
        v = raw[:n].astype(np.int16)
    else:
        v = np.unpackbits(raw, count=n * (1 + size)).reshape(n, 1 + size)[:, 1:].astype(np.int16) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int16))
    v += (v < (1 << (size - 1))) * np.int16(1 - (1 << size))
    v <<= shift
    if len(own) == len(c.coefficients):
        c.coefficients[:, low : high + 1] = v.reshape(-1, wide)
    else:
        c.coefficients[own, low : high + 1] = v.reshape(-1, wide)


def _ac_refine(bits: Bits, c: Component, blocks: list[int], table: Huffman, low: int, high: int, shift: int) -> None:
    run, step = 0, 1 << shift
    for b in blocks:
        row, k = c.coefficients[b], low

        def correct(k: int) -> None:
            if bits.take(1):
                row[k] += step if row[k] > 0 else -step

        while not run and k <= high:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            value = (step if bits.take(1) else -step) if size else 0
            while k <= high:
                if row[k]:
                    correct(k)
                elif zeros == 0:
                    if value:
                        row[k] = value
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if run:
            for j in range(k, high + 1):
                if row[j]:
                    correct(j)
            run -= 1


def _ac_refine_even(data: bytes, c: Component, own: np.ndarray, symbol: int, low: int, high: int, shift: int) -> None:
    """A refinement in which nothing becomes non-zero: runs of ended blocks, each followed by its correction bits."""
    more = symbol >> 4
    bit = np.unpackbits(np.frombuffer(data, np.uint8))
    band, at, b = c.coefficients[own, low : high + 1], 0, 0
    while b < len(own):
        extra = int("0" + "".join(map(str, bit[at + 1 : at + 1 + more].tolist())), 2)
        to, at = min(len(own), b + (1 << more) + extra), at + 1 + more
        piece = band[b:to]
        known = piece != 0
        n = int(np.count_nonzero(known))
        if n == piece.size:
            piece += np.sign(piece) * (bit[at : at + n].astype(np.int16) << shift).reshape(piece.shape)
        else:
            piece[known] += np.sign(piece[known]) * (bit[at : at + n].astype(np.int16) << shift)
        at, b = at + n, to
    if len(own) == len(c.coefficients):
        c.coefficients[:, low : high + 1] = band
    else:
        c.coefficients[own, low : high + 1] = band


_END_OF_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _scan(picture: Picture, part: list[Component], dc: dict, ac: dict, head: bytes, body: bytes, interval: int) -> None:
    low, high, shift, refine = head[0], head[1], head[2] & 15, bool(head[2] >> 4)
    order = _order(picture, part)
    plain = [p.replace(b"\xff\x00", b"\xff") if b"\xff" in p else p for p in (_RESTART.split(body) if interval else [body])]
    for k, data in enumerate(plain):
        own = [o[k * interval : (k + 1) * interval] for o in order] if interval else order
        if not len(own[0]):
            break
        c = part[0]
        if low == 0:
            _dc_refine(data, part, own, shift) if refine else _dc_first(data, part, own, dc, shift)
            continue
        table, blocks = ac[c.name], own[0].ravel()
        symbol = -1 if table.single is None else table.single
        if not refine and 0 < symbol < 16:
            _ac_first_even(data, c, blocks, symbol, low, high, shift)
        elif refine and symbol >= 0 and not symbol & 15 and symbol >> 4 < 15:
            _ac_refine_even(data, c, blocks, symbol, low, high, shift)
        elif refine:
            _ac_refine(Bits(data), c, blocks.tolist(), table, low, high, shift)
        else:
            _ac_first(Bits(data), c, blocks.tolist(), table, low, high, shift)


def decode(data: bytes) -> Picture:
    """All scans of a progressive file, accumulated; ValueError for other bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    picture, at, interval, comment = None, 2, 0, b""
    tables: dict[int, np.ndarray] = {}
    codes: dict[int, Huffman] = {}
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError("no marker where one should be")
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xD9:
            break
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                tables[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float32)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if body[0] != 8 or not width or not height or not parts:
                raise ValueError("not 8-bit samples, or no size")
            picture, h, v = Picture(width, height, parts, tables, b""), max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                c.wide, c.high = -(-width // (8 * h)) * c.h, -(-height // (8 * v)) * c.v
                c.own_wide, c.own_high = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
            if sum(c.own_wide * c.own_high for c in parts) > 8 * len(data):  # a block takes a bit at least
                raise ValueError("a frame too large for its file")
            for c in parts:
                c.coefficients = np.zeros((c.wide * c.high, 64), np.int16)
        elif kind == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            comment = body
        elif kind == 0xDA:
            if picture is None:
                raise ValueError("a scan before the frame")
            n = body[0]
            by_name = {c.name: c for c in picture.components}
            part = [by_name[body[1 + 2 * i]] for i in range(n)]
            dc, ac = ({c.name: codes.get(base + (body[2 + 2 * i] >> 4 * up & 15)) for i, c in enumerate(part)} for base, up in ((0, 1), (16, 0)))
            end = _END_OF_SCAN.search(data, at)
            stop = end.start() if end else len(data)
            _scan(picture, part, dc, ac, body[1 + 2 * n : 4 + 2 * n], data[at:stop], interval)
            at = stop
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not a progressive frame")
    if picture is None:
        raise ValueError("no frame")
    picture.comment = comment
    return picture


def to_rgb(picture: Picture) -> np.ndarray:
    """Height x width x 3 bytes: inverse transform, chroma repeated up to full resolution, colours converted."""
    h, v = max(c.h for c in picture.components), max(c.v for c in picture.components)
    planes = []
    for c in picture.components:
        q = picture.tables[c.table]
        pixels = c.coefficients.astype(np.float32) @ (basis() * q[:, None])
        plane = pixels.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)
        if (h, v) != (c.h, c.v):
            plane = plane.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1)
        planes.append(np.clip(plane[: picture.height, : picture.width] + np.float32(128), 0, 255))
    if len(planes) == 1:
        planes *= 3
    else:
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        planes = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
    out = np.empty((*planes[0].shape, 3), np.uint8)
    for k, plane in enumerate(planes):
        out[..., k] = np.clip(np.rint(plane), 0, 255)
    return out


def _segment(kind: int, body: bytes) -> bytes:
    return bytes((255, kind)) + (len(body) + 2).to_bytes(2, "big") + body


def _codes(place: int, symbols: list[int], length: int) -> bytes:
    return _segment(0xC4, bytes([place, *(len(symbols) if k == length else 0 for k in range(1, 17)), *symbols]))


def _start(parts: list[int], low: int, high: int, back: int, shift: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *(x for p in parts for x in (p, 0)), low, high, back << 4 | shift]))


def _packed(bit: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: filled up with ones, 255 stuffed."""
    rest = -len(bit) % 8
    if rest:
        bit = np.concatenate([bit, np.ones(rest, np.uint8)])
    return np.packbits(bit).tobytes().replace(b"\xff", b"\xff\x00")


_FRAME = _segment(0xDB, bytes([0] + [1] * 64))
_DC_CODES = _codes(0, list(range(8)), 4)
_AC_CODES = _codes(16, [7], 1)


@cache
def _sizes() -> np.ndarray:
    return np.array([abs(d).bit_length() for d in range(-127, 128)])


def encode_payload(payload: bytes) -> bytes:
    """A progressive file whose coefficients are the payload, a positive multiple of 192 bytes."""
    n = len(payload) // UNIT
    wide = math.isqrt(n - 1) + 1
    high = -(-n // wide)
    raw = np.full((wide * high, 3, 64), FILLER, np.uint8)
    raw.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    out = [b"\xff\xd8", _segment(0xFE, str(len(payload)).encode()), _FRAME]
    out.append(_segment(0xC2, bytes([8]) + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # DC coefficients without their last bit, as differences
    dc = raw[:, :, 0].astype(np.int64) - 128
    half = dc >> 1
    d = np.diff(half, axis=0, prepend=0).ravel()
    size = _sizes()[d + 127]
    word, length = (size << size) | np.where(d < 0, d + (1 << size) - 1, d), 4 + size
    place = np.repeat(np.cumsum(length), length) - 1 - np.arange(int(length.sum()))
    out += [_DC_CODES, _start([1, 2, 3], 0, 0, 0, 1), _packed((np.repeat(word, length) >> place & 1).astype(np.uint8))]
    # AC coefficients without their last bit: one code bit and seven more each
    out.append(_AC_CODES)
    for part, low, last in ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63)):
        out += [_start([part], low, last, 0, 1), (raw[:, part - 1, low : last + 1] >> 1).tobytes()]
    # the last bits
    out += [_start([1, 2, 3], 0, 0, 1, 0), _packed((dc & 1).astype(np.uint8).ravel())]
    bit = raw[:, :, 1:]
    bit = (bit ^ (bit < 128)) & 1
    runs = []
    left = wide * high
    while left:
        more = min(left.bit_length() - 1, 14)
        runs.append((more, min(left, (1 << more + 1) - 1)))
        left -= runs[-1][1]
    for part in (1, 2, 3):
        at = 0
        if len({more for more, _ in runs}) == 1:
            more, pieces = runs[0][0], []
            for _, blocks in runs:
                head = np.array([int(x) for x in "0" + (f"{blocks - (1 << more):0{more}b}" if more else "")], np.uint8)
                pieces += [head, bit[at : at + blocks, part - 1].ravel()]
                at += blocks
            out += [_codes(16, [more << 4], 1), _start([part], 1, 63, 1, 0), _packed(np.concatenate(pieces))]
        else:  # long pictures: runs of several lengths need several codes
            kinds = sorted({more for more, _ in runs})
            pieces = []
            for more, blocks in runs:
                head = np.array([int(x) for x in f"{kinds.index(more):04b}" + (f"{blocks - (1 << more):0{more}b}" if more else "")], np.uint8)
                pieces += [head, bit[at : at + blocks, part - 1].ravel()]
                at += blocks
            out += [_codes(16, [more << 4 for more in kinds], 4), _start([part], 1, 63, 1, 0), _packed(np.concatenate(pieces))]
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(picture: Picture) -> bytes:
    """The bytes that ``encode_payload`` stored."""
    c = np.stack([p.coefficients for p in picture.components], 1)
    c = c + np.int16(255) * (c < 0)
    for k, p in enumerate(picture.components):
        c[:, k, 0] = p.coefficients[:, 0] + 128
    return c.astype(np.uint8).tobytes()[: int(picture.comment)]


def padded(raw: bytes) -> bytes:
    """The text's bytes filled with spaces up to a positive multiple of 192."""
    return raw + bytes([FILLER]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _store(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, BATCH_BYTES):
            raws = [x.encode("utf-8") if x is not None else b"" for x in batch.column(text).to_pylist()]
            rest = [batch.column(c) for c in batch.schema.names if c != text]
            names = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(map(len, raws), pa.int64()), pa.array([encode_payload(padded(r)) for r in raws], pa.binary())], [*names, "n_bytes", "media"])

    return run


def texts_to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns with n_bytes (UTF-8 bytes of the text, 0 if null) and media (a progressive JPEG file of it).

    Empty and null texts are stored as 192 spaces. Repeated rows are stored each. Columns n_bytes and media of the input are replaced.
    """
    docs = docs.drop(*({"n_bytes", "media"} - {text}))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), "n_bytes long, media binary"])
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_store(text), schema)


def _read(media: str, tensors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, media, BATCH_BYTES):
            names, made = [c for c in batch.schema.names if c != media], []
            for data in batch.column(media):
                raw = data.as_py()
                made.append(_features(raw, tensors) if raw is not None else _NOTHING)
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (t for _, t in _MADE), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *(n for n, _ in _MADE)])

    return run


_MADE = [("width", pa.int32()), ("height", pa.int32()), ("tensor", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_NOTHING = (None,) * len(_MADE)


def _features(data: bytes, tensors: bool) -> tuple:
    """Size, tensor, the stored payload's figures, and mean red, green and blue; only the file's own figures if it can't be read."""
    own = (len(data), hashlib.sha256(data).hexdigest())
    try:
        picture = decode(data)
        rgb = to_rgb(picture)
    except (ValueError, IndexError, KeyError, AttributeError):
        return (None,) * 6 + own + (None,)
    mean = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (picture.width * picture.height)
    payload = payload_of(picture) if picture.comment.isdigit() else None
    stored = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) if payload is not None else (None,) * 3
    return (picture.width, picture.height, rgb.tobytes() if tensors else None, *stored, *own, f"{picture.width}x{picture.height}:" + ",".join(f"{m:.3f}" for m in mean))


def read_media(rows: DataFrame, media: str = "media", tensors: bool = True) -> DataFrame:
    """The other columns with width, height, tensor (RGB bytes, row by row; null unless ``tensors``), the figures of the file and of a text stored in it, and a feature string.

    Null media give nulls; bytes that aren't a progressive JPEG file give nulls but for media_bytes and media_sha256.
    """
    rows = rows.drop(*({n for n, _ in _MADE} - {media}))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != media]
    made = ["width int", "height int", "tensor binary", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"]
    small_batches(rows.sparkSession)
    return rows.mapInArrow(_read(media, tensors), ", ".join([*kept, *made]))
