"""The JPEG codec against a plain scalar writer of progressive scans, and exact round trips."""

import random

import numpy as np
import pytest

from foliograph.llm import media
from foliograph.llm import progressive_jpeg as jpeg


class Bits:
    def __init__(self):
        self.bits: list[int] = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def bytes(self):
        b = self.bits + [1] * (-len(self.bits) % 8)
        out = bytearray()
        for i in range(0, len(b), 8):
            out.append(int("".join(map(str, b[i : i + 8])), 2))
            if out[-1] == 0xFF:
                out.append(0)
        return bytes(out)


def size_bits(v):
    n = abs(v).bit_length()
    return n, (v if v >= 0 else v + (1 << n) - 1)


class Writer:
    """Scans of coefficient blocks, one symbol after the other, with runs of ended blocks."""

    def __init__(self, table):
        self.code, self.length = jpeg.huffman(table).code, jpeg.huffman(table).length
        self.out = Bits()
        self.run, self.held = 0, []

    def symbol(self, s):
        assert self.length[s]
        self.out.put(int(self.code[s]), int(self.length[s]))

    def flush_run(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.symbol(n << 4)
            self.out.put(self.run - (1 << n), n)
            for b in self.held:
                self.out.put(b, 1)
            self.run, self.held = 0, []

    def first(self, block, a, z, low):
        run = 0
        v = [int(np.sign(c)) * (abs(int(c)) >> low) for c in block]
        for k in range(a, z + 1):
            if v[k] == 0:
                run += 1
                continue
            self.flush_run()
            while run > 15:
                self.symbol(0xF0)
                run -= 16
            n, bits = size_bits(v[k])
            self.symbol(run << 4 | n)
            self.out.put(bits, n)
            run = 0
        if run:
            self.run += 1
            if self.run == 0x7FFF:
                self.flush_run()

    def refine(self, block, a, z, low):
        v = [abs(int(c)) >> low for c in block]
        last = max((k for k in range(a, z + 1) if v[k] == 1), default=-1)
        run, held = 0, []
        for k in range(a, z + 1):
            if v[k] == 0:
                run += 1
                continue
            while run > 15 and k <= last:
                self.flush_run()
                self.symbol(0xF0)
                run -= 16
                for b in held:
                    self.out.put(b, 1)
                held = []
            if v[k] > 1:
                held.append(v[k] & 1)
                continue
            self.flush_run()
            self.symbol(run << 4 | 1)
            self.out.put(int(block[k] > 0), 1)
            for b in held:
                self.out.put(b, 1)
            run, held = 0, []
        if run or held:
            self.run += 1
            self.held += held


def write(parts, width, height, precision, restart, script):
    """parts: (h, v, quantizer, blocks in rows as stored); every scan of the script: parts, first, last, high, low."""
    frame = bytes([precision]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)])
    for i, (h, v, _, _) in enumerate(parts):
        frame += bytes([i + 1, h << 4 | v, i])
    out = b"\xff\xd8"
    for i, (_, _, q, _) in enumerate(parts):
        out += jpeg._segment(jpeg.DQT, bytes([i]) + bytes(q))
    out += jpeg._segment(jpeg.SOF2, frame) + jpeg._segment(jpeg.DHT, b"\x00" + jpeg.DC_TABLE + b"\x10" + jpeg.AC_TABLE)
    out += jpeg._segment(jpeg.DRI, restart.to_bytes(2, "big"))
    hm, vm = max(p[0] for p in parts), max(p[1] for p in parts)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    for which, a, z, high, low in script:
        out += jpeg._segment(jpeg.SOS, bytes([len(which), *[x for i in which for x in (i + 1, 0)], a, z, high << 4 | low]))
        if len(which) == 1:
            h, v, _, _ = parts[which[0]]
            own = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
            units = [[(which[0], y * across * h + x)] for y in range(own[1]) for x in range(own[0])]
        else:
            units = [[(i, (my * parts[i][1] + y) * across * parts[i][0] + mx * parts[i][0] + x) for i in which for y in range(parts[i][1]) for x in range(parts[i][0])] for my in range(down) for mx in range(across)]
        for n, at in enumerate(range(0, len(units), restart or len(units))):
            w, before = Writer(jpeg.DC_TABLE if a == 0 else jpeg.AC_TABLE), dict.fromkeys(which, 0)
            for unit in units[at : at + (restart or len(units))]:
                for i, b in unit:
                    block = parts[i][3][b]
                    if a == 0 and high == 0:
                        s, bits = size_bits((int(block[0]) >> low) - before[i])
                        w.symbol(s)
                        w.out.put(bits, s)
                        before[i] = int(block[0]) >> low
                    elif a == 0:
                        w.out.put((int(block[0]) >> low) & 1, 1)
                    elif high == 0:
                        w.first(block, a, z, low)
                    else:
                        w.refine(block, a, z, low)
            w.flush_run()
            out += (bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + w.out.bytes()
    return out + b"\xff\xd9"


def random_part(rng, h, v, across, down, density):
    n = across * h * down * v
    c = np.where(rng.random((n, 64)) < density, rng.integers(-40, 41, (n, 64)), 0)
    c[:, 0] = rng.integers(-200, 201, n)
    c[rng.random(n) < 0.4, 1:] = 0
    return c


@pytest.mark.parametrize("seed,sampling,restart,density", [(0, [(2, 2), (1, 1), (1, 1)], 0, 0.1), (1, [(1, 1)], 3, 0.02), (2, [(2, 1), (1, 1), (1, 1)], 5, 0.5), (3, [(1, 1)] * 3, 2, 0.01)])
def test_decoder_reads_every_kind_of_scan(seed, sampling, restart, density):
    rng = np.random.default_rng(seed)
    files, wanted, sizes = [], [], []
    for width, height in [(37, 21), (8, 8), (64, 50)]:
        hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
        across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
        parts = [(h, v, rng.integers(1, 20, 64).tolist(), random_part(rng, h, v, across, down, density)) for h, v in sampling]
        every = tuple(range(len(parts)))
        script = [(every, 0, 0, 0, 1)] + [((i,), 1, 5, 0, 2) for i in every] + [((i,), 6, 63, 0, 2) for i in every] + [((i,), 1, 63, 2, 1) for i in every] + [(every, 0, 0, 1, 0)] + [((i,), 1, 63, 1, 0) for i in every]
        files.append(write(parts, width, height, 8, restart, script))
        wanted.append(parts)
        sizes.append((width, height))
    images, found = jpeg.coefficients(files)
    for image, parts, (width, height) in zip(images, wanted, sizes, strict=True):
        for p, (h, v, _, blocks) in zip(image.parts, parts, strict=True):
            own = found[p.base : p.base + p.wide * p.tall].copy()
            inside = np.zeros(len(own), bool).reshape(p.tall, p.wide)
            inside[: p.own_tall, : p.own_wide] = True
            keep = inside.ravel()
            assert (own[keep] == blocks[keep]).all()  # padding blocks carry no AC
            assert (own[:, 0] == blocks[:, 0]).all() or len(parts) == 1
    for t, (width, height) in zip(jpeg.decode(files), sizes, strict=True):
        assert t[0].shape == (height, width, 3)


def test_transform_and_colour_against_sums():
    rng = np.random.default_rng(5)
    q = [3] * 64
    blocks = [rng.integers(-20, 21, (4, 64)), rng.integers(-9, 10, (1, 64)), rng.integers(-9, 10, (1, 64))]
    parts = [(2, 2, q, blocks[0]), (1, 1, q, blocks[1]), (1, 1, q, blocks[2])]
    data = write(parts, 16, 16, 8, 0, [((0, 1, 2), 0, 0, 0, 0)] + [((i,), 1, 63, 0, 0) for i in range(3)])
    got = jpeg.decode([data])[0][0]

    def plane(b):
        f = np.zeros(64)
        f[jpeg.ZIGZAG] = b * 3.0
        f = f.reshape(8, 8)
        c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
        return np.array([[sum(c(u) * c(w) * f[u, w] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * w * np.pi / 16) for u in range(8) for w in range(8)) / 4 for x in range(8)] for y in range(8)])

    y = np.block([[plane(blocks[0][0]), plane(blocks[0][1])], [plane(blocks[0][2]), plane(blocks[0][3])]]) + 128
    cb, cr = (plane(b[0]).repeat(2, 0).repeat(2, 1) for b in blocks[1:])
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    assert np.abs(got.astype(int) - np.clip(np.rint(rgb), 0, 255)).max() <= 1


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 17, 100])
def test_payloads_come_back(n):
    rng = random.Random(n)
    payloads = [bytes(64 * n), b"\xff" * 64 * n, rng.randbytes(64 * n), (b"text of words and spaces. " * 64 * n)[: 64 * n], (b"\x00\xff" * 32 * n)]
    files = media.to_files(payloads)
    for p, f, t in zip(payloads, files, media.from_files(files), strict=True):
        assert t.shape == (n, 64, 3) and all(t[:, :, i].tobytes() == p for i in range(3))
        assert media.to_files([p]) == [f]  # alone or among others, the same file


def test_long_payloads_take_several_images():
    p = random.Random(0).randbytes(64) * (jpeg.MOST_ROWS + 5)
    files = media.to_files([p, bytes(64)])
    assert files[0].count(b"\xff\xd8\xff\xdb") == 2
    back = media.from_files(files)
    assert back[0][:, :, 0].tobytes() == p and back[1].shape == (1, 64, 3)


def test_step_is_wide_enough_for_the_quantizer():
    worst = np.abs(jpeg._BASIS).sum(axis=0).max() ** 2 * jpeg.QUANT / 2
    assert worst < jpeg.STEP / 2


def test_other_frames_are_refused():
    with pytest.raises(ValueError):
        jpeg.decode([b"\xff\xd8" + jpeg._segment(0xC0, bytes(15)) + b"\xff\xd9"])
