import hashlib
import zlib

import numpy as np
import pytest

from tessellar.llm.media import _codes, _packed, _segment, basis, decode, encode_payload, padded, payload_of, read_media, texts_to_media, to_rgb, zigzag


@pytest.mark.parametrize("n", [192, 384, 192 * 7, 192 * 33, 192 * 16390])
def test_payload_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    data = encode_payload(payload)
    picture = decode(data)
    assert payload_of(picture) == payload
    assert to_rgb(picture).shape == (picture.height, picture.width, 3)


def test_zigzag_and_inverse_transform():
    assert zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert sorted(zigzag()) == list(range(64))
    b = basis().astype(float)
    assert np.allclose(b @ b.T, np.eye(64), atol=1e-5)  # orthonormal


class Writer:
    """A plain encoder of any coefficients: subsampled components, several Huffman codes, zero runs, restarts."""

    def __init__(self, sampling, width, height, blocks):
        self.sampling, self.width, self.height, self.blocks = sampling, width, height, blocks  # blocks: per component (high, wide, 64)
        self.h, self.v = max(s[0] for s in sampling), max(s[1] for s in sampling)

    def order(self, parts):
        if len(parts) == 1:
            p = parts[0]
            sh, sv = self.sampling[p]
            w, h = -(-(-(-self.width * sh // self.h)) // 8), -(-(-(-self.height * sv // self.v)) // 8)
            return [[(p, y, x)] for y in range(h) for x in range(w)]
        across, down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        return [[(p, my * self.sampling[p][1] + y, mx * self.sampling[p][0] + x) for p in parts for y in range(self.sampling[p][1]) for x in range(self.sampling[p][0])] for my in range(down) for mx in range(across)]

    @staticmethod
    def bits(v, size):
        return f"{v if v >= 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    def scan(self, parts, low, high, back, shift, restart=0):
        symbols = sorted({s for s in range(256)} - {0xFF})
        code = lambda s: f"{symbols.index(s):09b}"  # noqa: E731  all symbols in codes of nine bits
        order = self.order(parts)
        pieces, out, last, ended, pending = [], "", {}, 0, ""

        def end_run():
            nonlocal out, ended, pending
            if ended:
                r = min(ended.bit_length() - 1, 14)
                out += code(r << 4) + (f"{ended - (1 << r):0{r}b}" if r else "") + pending
                ended, pending = 0, ""

        for i, mcu in enumerate(order):
            if restart and i and i % restart == 0:
                end_run()
                pieces.append(out)
                out, last = "", {}
            for p, y, x in mcu:
                c = self.blocks[p][y, x].tolist()
                if low == 0:
                    if back:
                        out += str(c[0] >> shift & 1)
                        continue
                    v = c[0] >> shift
                    d = v - last.get(p, 0)
                    last[p] = v
                    size = abs(d).bit_length()
                    out += code(size) + self.bits(d, size)
                    continue
                now = [(abs(c[k]) >> shift) * (1 if c[k] > 0 else -1) for k in range(low, high + 1)]
                if not back:
                    zeros = 0
                    if any(now):
                        end_run()
                    top = max((k for k, v in enumerate(now) if v), default=-1)
                    for v in now[: top + 1]:
                        if not v:
                            zeros += 1
                            continue
                        while zeros > 15:
                            out += code(0xF0)
                            zeros -= 16
                        size = abs(v).bit_length()
                        out += code(zeros << 4 | size) + self.bits(v, size)
                        zeros = 0
                    ended += top < len(now) - 1
                else:
                    fresh = max((k for k, v in enumerate(now) if abs(v) == 1), default=-1)
                    if fresh >= 0:
                        end_run()
                    zeros, corrections = 0, ""
                    for v in now[: fresh + 1]:
                        if abs(v) > 1:
                            corrections += str(abs(v) & 1)
                        elif v == 0:
                            if zeros == 15:
                                out += code(0xF0) + corrections
                                zeros, corrections = 0, ""
                            else:
                                zeros += 1
                        else:
                            out += code(zeros << 4 | 1) + ("1" if v > 0 else "0") + corrections
                            zeros, corrections = 0, ""
                    tail = corrections + "".join(str(abs(v) & 1) for v in now[fresh + 1 :] if abs(v) > 1)
                    if fresh < len(now) - 1:
                        ended += 1
                        pending += tail
                    else:
                        assert not tail
        end_run()
        pieces.append(out)
        raw = [_packed(np.array(list(map(int, p)), np.uint8)) for p in pieces]
        data = raw[0] + b"".join(bytes([255, 0xD0 + k % 8]) + r for k, r in enumerate(raw[1:]))
        tables = _codes(0, symbols, 9) + _codes(16, symbols, 9) + _segment(0xDD, restart.to_bytes(2, "big"))
        head = bytes([len(parts), *(x for p in parts for x in (p + 1, 0)), low, high, back << 4 | shift])
        return tables + _segment(0xDA, head) + data

    def file(self, scans, tables):
        frame = bytes([8]) + self.height.to_bytes(2, "big") + self.width.to_bytes(2, "big") + bytes([len(self.sampling), *(x for i, (h, v) in enumerate(self.sampling) for x in (i + 1, h << 4 | v, 0))])
        return b"\xff\xd8" + _segment(0xDB, bytes([0, *tables])) + _segment(0xC2, frame) + b"".join(self.scan(*s) for s in scans) + b"\xff\xd9"


@pytest.mark.parametrize(("sampling", "restart"), [([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 0), ([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 3)])
def test_real_scans(sampling, restart):
    """Subsampled chroma, sparse coefficients, bands and three refinements, against the coefficients that were written."""
    r = np.random.default_rng(5)
    width, height = 61, 43
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    blocks = []
    for sh, sv in sampling:
        c = r.integers(-60, 61, (down * sv, across * sh, 64)) * (r.random((down * sv, across * sh, 64)) < 0.15)
        c[..., 0] = r.integers(-200, 200, c.shape[:2])
        c[: down * sv // 2, :, 1:] = 0
        blocks.append(c)
    w = Writer(sampling, width, height, blocks)
    every = list(range(len(sampling)))
    scans = [(every, 0, 0, 0, 1, restart)]
    for back, shift in ((0, 2), (2, 1), (1, 0)):
        scans += [([p], low, high, back, shift, restart) for p in every for low, high in ((1, 5), (6, 63))]
    scans.insert(5, (every, 0, 0, 1, 0, restart))
    tables = r.integers(1, 4, 64).tolist()
    picture = decode(w.file(scans, tables))
    for p, c in enumerate(picture.components):
        got, want = c.coefficients.reshape(c.high, c.wide, 64), blocks[p].copy()
        want[c.own_high :, :, 1:] = 0  # blocks of padding have no AC scans
        want[:, c.own_wide :, 1:] = 0
        assert (got == want).all()
    rgb = to_rgb(picture)
    assert rgb.shape == (height, width, 3)
    # pixels by the definition, for one place
    y, x = 20, 30
    value = []
    for c in picture.components:
        cy, cx = y * c.v // v, x * c.h // h
        f = np.zeros(64)
        f[zigzag()] = c.coefficients[cy // 8 * c.wide + cx // 8] * np.array(tables)
        s = sum((0.125 if u == w_ == 0 else 0.25 if u and w_ else 0.25 / 2**0.5) * f[w_ * 8 + u] * np.cos((2 * (cx % 8) + 1) * u * np.pi / 16) * np.cos((2 * (cy % 8) + 1) * w_ * np.pi / 16) for u in range(8) for w_ in range(8))
        value.append(min(255, max(0, s + 128)))
    want = [value[0]] * 3 if len(value) == 1 else [value[0] + 1.402 * (value[2] - 128), value[0] - 0.344136 * (value[1] - 128) - 0.714136 * (value[2] - 128), value[0] + 1.772 * (value[1] - 128)]
    assert np.abs(rgb[y, x] - np.clip(want, 0, 255)).max() <= 1


def test_texts_through_media(spark):
    texts = [None, "", "a", "a", "é" * 300, "x" * 192, "long " * 40_000]
    df = spark.createDataFrame([(i, t, 5, b"m") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, media binary")
    rows = {r.doc_id: r for r in read_media(texts_to_media(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want, r = padded(raw), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert len(r.tensor) == r.width * r.height * 3
    assert rows[0].media_sha256 == rows[1].media_sha256 and rows[2].media_sha256 == rows[3].media_sha256 != rows[1].media_sha256
    odd = spark.createDataFrame([(1, None), (2, b"no picture"), (3, b"\xff\xd8\xff")], "id long, media binary")
    got = {r.id: (r.width, r.media_bytes, r.feature) for r in read_media(odd).collect()}
    assert got == {1: (None, None, None), 2: (None, 10, None), 3: (None, 3, None)}
    assert texts_to_media(df.limit(0)).count() == 0
