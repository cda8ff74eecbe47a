"""Progressive JPEG in numpy: scans to coefficient arrays, coefficients to full-resolution RGB.

The decoder takes many images at once. It reads each image's frame, tables and scans, then works scan
after scan: the stretches between restart markers, of all images, are decoded side by side, one symbol
of each in a step. Spectral selection and successive approximation fill one coefficient array
(8 or 12 bits a sample, any sampling factors that divide the largest); that is dequantized and
inverse-transformed by two matrix products, chroma is repeated to full resolution and turned to RGB.

The encoder writes payloads as 12-bit luma rows of 64 samples, a byte to a sample in steps of 16, with
neutral 4:2:0 chroma. With quantizers of 2, no sample is off by more than 2/2 times the largest row sum
of the two-dimensional basis, 7.0, less than half a step: the bytes come back exactly.

Fixed values of the format (markers, zigzag rule, colour matrix) are those of ITU-T T.81 and JFIF.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

SOI, EOI, SOF2, DHT, DQT, DRI, SOS = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA
WIDTH, MOST_ROWS = 64, 65_528
STEP, QUANT, PRECISION, RESTART = 16, 2, 12, 8

#: Zigzag place -> row-major place: along the anti-diagonals, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))
_BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: The two-dimensional basis in whole numbers of 2**-SCALE: products of samples and coefficients with it are exact in
#: 64-bit floats, so a block's transform does not depend on the blocks beside it. Row: sample; column: zigzag place.
SCALE = 20
_WHOLE = np.rint(np.kron(_BASIS, _BASIS).T * (1 << SCALE))[:, ZIGZAG]


# ---------------------------------------------------------------------------------------------- tables


def code_lengths(weights: dict[int, float], most: int = 16) -> dict[int, int]:
    """Huffman code lengths of at most ``most`` bits, with the all-ones code left free."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))]
    heap.append((0.0, len(heap), (-1,)))  # takes the all-ones code
    heapq.heapify(heap)
    length = dict.fromkeys([*weights, -1], 0)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
    count = [0] * (max(length.values()) + 1)
    for v in length.values():
        count[v] += 1
    # Too long codes move up in pairs: one takes its pair's prefix, the other parts a shorter code.
    for v in range(len(count) - 1, most, -1):
        while count[v]:
            j = v - 2
            while not count[j]:
                j -= 1
            count[v] -= 2
            count[v - 1] += 1
            count[j + 1] += 2
            count[j] -= 1
    order = sorted(weights, key=lambda s: (length[s], -weights[s], s))
    sizes = [v for v in range(1, min(len(count), most + 1)) for _ in range(count[v])]
    return dict(zip(order, sizes, strict=False))


def _table_bytes(lengths: dict[int, int]) -> bytes:
    by = [[s for s in lengths if lengths[s] == v] for v in range(1, 17)]
    return bytes(map(len, by)) + bytes(s for own in by for s in own)


@dataclass
class Huffman:
    lookup: np.ndarray  # 16 bits ahead -> length | symbol << 8
    code: np.ndarray
    length: np.ndarray


@lru_cache(maxsize=256)
def huffman(spec: bytes) -> Huffman:
    """From 16 counts and the symbols."""
    lookup = np.zeros(1 << 16, np.int64)
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    code, at = 0, 16
    for v in range(1, 17):
        for s in spec[at : at + spec[v - 1]]:
            lookup[code << (16 - v) : (code + 1) << (16 - v)] = v | s << 8
            codes[s], lengths[s] = code, v
            code += 1
        at += spec[v - 1]
        code <<= 1
    return Huffman(lookup, codes, lengths)


def _own_tables() -> tuple[bytes, bytes]:
    dc = {s: 2.0 ** -abs(s - 9) + 2.0**-6 * (s == 0) for s in range(16)}
    ac = {r << 4 | s: 2.0 ** (-6 * r - abs(s - 8) * (1.0 if s < 8 else 1.5)) for r in range(16) for s in range(1, 15)}
    ac |= {r << 4: 2.0 ** -(6 + 2 * r) for r in range(15)} | {0xF0: 2.0**-8}
    return _table_bytes(code_lengths(dc)), _table_bytes(code_lengths(ac))


DC_TABLE, AC_TABLE = _own_tables()


# --------------------------------------------------------------------------------------------- encoder


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float32))[1].astype(np.int64)


def _magnitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The extra bits of a value of that size."""
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def _pack(value: np.ndarray, length: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit cells to bytes. ``last`` is the end (in cells) of each restart stretch, ``number`` its number
    in its scan. Gives the stuffed bytes, a marker behind each stretch, and the end of each stretch."""
    length, value = length.ravel(), value.ravel()
    upto = np.cumsum(length)
    bits = np.diff(upto[last - 1], prepend=0)
    size = (bits + 7) >> 3
    byte_start = np.cumsum(size) - size
    shift = 8 * byte_start - (upto[last - 1] - bits)
    own = np.flatnonzero(length)
    cells = np.searchsorted(own, last)  # used cells up to each end
    offset = (upto - length)[own] + np.repeat(shift, np.diff(cells, prepend=0))
    value, length = value[own], length[own]
    total = int(size.sum())
    words = np.zeros((total >> 3) + 2, np.uint64)
    word = offset >> 6
    room = 64 - (offset & 63) - length
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[starts]] = np.bitwise_or.reduceat(high, starts)
    over = np.flatnonzero(room < 0)  # at most one cell crosses into a word
    words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    data = words.byteswap().view(np.uint8)[:total].copy()
    data[byte_start + size - 1] |= ((1 << ((8 - bits % 8) % 8)) - 1).astype(np.uint8)
    # Stuffing: a zero behind each 0xFF; two more bytes behind each stretch for its marker.
    extra = np.ones(total, np.int64)
    extra[data == 0xFF] = 2
    ends = byte_start + size - 1
    extra[ends] += 2
    place = np.cumsum(extra) - extra
    out = np.zeros(int(extra.sum()), np.uint8)
    out[place] = data
    stop = place[ends] + extra[ends] - 2
    out[stop] = 0xFF
    out[stop + 1] = 0xD0 + number % 8
    return out, stop


def _dc_cells(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table = huffman(DC_TABLE)
    size = _bit_length(np.abs(v))
    return table.code[size] << size.astype(np.uint64) | _magnitude(v, size), table.length[size] + size


def _ac_cells(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a band's first scan, a row for each block, the last column for the end of block."""
    table = huffman(AC_TABLE)
    n, width = v.shape
    there = v != 0
    place = np.where(there, np.arange(width), -1)
    before = np.maximum.accumulate(place, axis=1)
    run = np.arange(width) - 1
    run = run - np.concatenate([np.full((n, 1), -1), before[:, :-1]], axis=1)
    size = _bit_length(np.abs(v))
    symbol = (run & 15) << 4 | size
    value = table.code[symbol] << size.astype(np.uint64) | _magnitude(v, size)
    length = table.length[symbol] + size
    if (run[there] > 15).any():
        skip, skip_length = table.code[0xF0], table.length[0xF0]
        for k in (3, 2, 1):  # sixteens of zeros before a value
            far = there & (run >> 4 == k)
            prefix = sum(int(skip) << int(skip_length * i) for i in range(k))
            value[far] |= np.uint64(prefix) << length[far].astype(np.uint64)
            length[far] += k * skip_length
    length[~there] = 0
    ended = before[:, -1] < width - 1
    return np.concatenate([value, np.full((n, 1), table.code[0])], axis=1), np.concatenate([length, np.where(ended, table.length[0], 0)[:, None]], axis=1)


def _ac_refine_cells(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the last bit of a narrow band whose higher bits have gone before."""
    table = huffman(AC_TABLE)
    n, width = v.shape
    value, length = np.zeros((n, width + 1), np.uint64), np.zeros((n, width + 1), np.int64)
    run, bits, held = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(width):
        size = np.abs(v[:, k])
        old, new = size > 1, size == 1
        bits = np.where(old, bits << np.uint64(1) | (size & 1).astype(np.uint64), bits)
        held = held + old
        symbol = run << 4 | 1
        own = (table.code[symbol] << np.uint64(1) | (v[:, k] > 0).astype(np.uint64)) << held.astype(np.uint64) | bits
        value[:, k] = own
        length[:, k] = np.where(new, table.length[symbol] + 1 + held, 0)
        run = np.where(new, 0, run + (size == 0))
        bits, held = np.where(new, np.uint64(0), bits), np.where(new, 0, held)
    value[:, width] = table.code[0] << held.astype(np.uint64) | bits
    length[:, width] = np.where((run > 0) | (held > 0), table.length[0] + held, 0)
    return value, length


def _header(rows: int) -> bytes:
    frame = bytes([PRECISION]) + rows.to_bytes(2, "big") + WIDTH.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return (
        bytes([0xFF, SOI]) + _segment(DQT, bytes([0] + [QUANT] * 64)) + _segment(SOF2, frame)
        + _segment(DHT, b"\x00" + DC_TABLE) + _segment(DHT, b"\x10" + AC_TABLE) + _segment(DRI, RESTART.to_bytes(2, "big"))
    )


#: (components, first and last coefficient, high and low bit) of each scan, in order.
SCRIPT = (((1,), 0, 0, 0, 1), ((2, 3), 0, 0, 0, 0), ((1,), 1, 5, 0, 1), ((1,), 6, 63, 0, 0), ((1,), 0, 0, 1, 0), ((1,), 1, 5, 1, 0))
_SCAN_HEADS = [_segment(SOS, bytes([len(c), *[x for i in c for x in (i, 0)], a, z, h << 4 | low])) for c, a, z, h, low in SCRIPT]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload of 1 to MOST_ROWS rows of WIDTH bytes."""
    rows = np.array([len(p) // WIDTH for p in payloads])
    tall = -(-rows // 8)  # rows of blocks
    samples = np.zeros((int(tall.sum()) * 8, WIDTH), np.uint8)
    at = 0
    for p, r, t in zip(payloads, rows, tall, strict=True):
        samples[at : at + r] = np.frombuffer(p, np.uint8).reshape(-1, WIDTH)
        samples[at + r : at + 8 * t] = samples[at + r - 1]
        at += 8 * t
    blocks = samples.reshape(-1, 8, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 64).astype(np.float64)
    blocks *= STEP
    blocks -= 1 << (PRECISION - 1)
    c = blocks @ _WHOLE
    c *= 2.0**-SCALE / QUANT
    c = np.rint(c, out=c).astype(np.int64)
    n = len(c)
    dc = c[:, 0] >> 1
    steps = np.diff(dc, prepend=0)
    steps[::RESTART] = dc[::RESTART]
    half = np.sign(c[:, 1:6]) * (np.abs(c[:, 1:6]) >> 1)
    luma = [_dc_cells(steps)[i][:, None] for i in (0, 1)]
    scans = [luma, None, _ac_cells(half), _ac_cells(c[:, 6:]), ((c[:, :1] & 1).astype(np.uint64), np.ones((n, 1), np.int64)), _ac_refine_cells(c[:, 1:6])]
    # Stretches of the luma scans are the rows of blocks; of the chroma scan, two rows of four blocks each.
    number = np.concatenate([np.arange(t) for t in tall])
    chroma_units = 4 * -(-rows // 16)
    chroma_tall = -(-chroma_units // RESTART)
    units = np.concatenate([np.append(np.full(t - 1, RESTART), u - RESTART * (t - 1)) for t, u in zip(chroma_tall, chroma_units, strict=True)])
    zero = huffman(DC_TABLE)
    chroma = np.full(2 * int(units.sum()), zero.code[0]), np.full(2 * int(units.sum()), zero.length[0])
    parts = []
    for k, cells in enumerate(scans):
        if cells is None:
            data, stop = _pack(*chroma, np.cumsum(2 * units), np.concatenate([np.arange(t) for t in chroma_tall]))
            last = np.cumsum(chroma_tall) - 1
        else:
            data, stop = _pack(*cells, np.arange(1, n // 8 + 1) * (8 * cells[0].shape[1]), number)
            last = np.cumsum(tall) - 1
        ends = stop[last]
        parts.append((_SCAN_HEADS[k], data.tobytes(), np.concatenate([[0], ends[:-1] + 2]).tolist(), ends.tolist()))
    return [_header(int(r)) + b"".join(head + data[start[i] : end[i]] for head, data, start, end in parts) + bytes([0xFF, EOI]) for i, r in enumerate(rows)]


# --------------------------------------------------------------------------------------------- decoder


@dataclass
class Component:
    h: int
    v: int
    quant: np.ndarray
    wide: int = 0  # blocks, as stored
    tall: int = 0
    own_wide: int = 0  # blocks that carry samples
    own_tall: int = 0
    base: int = 0  # of all images' blocks


@dataclass
class Scan:
    parts: list[int]  # component numbers
    tables: list[tuple[bytes, bytes]]
    first: int
    last: int
    high: int
    low: int
    restart: int
    starts: np.ndarray = field(default=None)  # bytes, in all files together
    ends: np.ndarray = field(default=None)


@dataclass
class Image:
    rows: int = 0
    columns: int = 0
    precision: int = 8
    parts: list[Component] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    end: int = 0
    owner: int = 0  # number of its file

    @property
    def most(self) -> tuple[int, int]:
        return max(p.h for p in self.parts), max(p.v for p in self.parts)


@lru_cache(maxsize=64)
def _quantizers(body: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(body, ">u2" if wide else np.uint8).astype(np.float32)


def _read(data: bytes, at: int, marks: list[int], restarts: np.ndarray) -> Image:
    """The frame and scans of the file that starts at ``at``. ``marks``: places of all markers but restarts."""
    image, quant, tables, names, restart = Image(), {}, {}, {}, 0
    at += 2
    while True:
        code = data[at + 1]
        if code == EOI:
            image.end = at + 2
            return image
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if code == DQT:
            i = 0
            while i < len(body):
                wide, name = body[i] >> 4 > 0, body[i] & 15
                size = 128 if wide else 64
                quant[name] = _quantizers(body[i + 1 : i + 1 + size], wide)
                i += 1 + size
        elif code == DHT:
            i = 0
            while i < len(body):
                size = 16 + sum(body[i + 1 : i + 17])
                tables[body[i]] = body[i + 1 : i + 1 + size]
                i += 1 + size
        elif code == DRI:
            restart = int.from_bytes(body[:2], "big")
        elif code == SOF2:
            image.precision, image.rows, image.columns = body[0], int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for k in range(body[5]):
                name, hv, q = body[6 + 3 * k : 9 + 3 * k]
                names[name] = k
                image.parts.append(Component(hv >> 4, hv & 15, quant[q]))
            hm, vm = image.most
            across, down = -(-image.columns // (8 * hm)), -(-image.rows // (8 * vm))
            for p in image.parts:
                p.wide, p.tall = across * p.h, down * p.v
                p.own_wide, p.own_tall = -(-(-(-image.columns * p.h // hm)) // 8), -(-(-(-image.rows * p.v // vm)) // 8)
        elif code == SOS:
            k = body[0]
            parts = [names[body[1 + 2 * i]] for i in range(k)]
            pick = [(tables.get(body[2 + 2 * i] >> 4), tables.get(16 | body[2 + 2 * i] & 15)) for i in range(k)]
            scan = Scan(parts, pick, body[1 + 2 * k], body[2 + 2 * k], body[3 + 2 * k] >> 4, body[3 + 2 * k] & 15, restart)
            stop = marks[bisect_left(marks, at)]
            inside = restarts[np.searchsorted(restarts, at) : np.searchsorted(restarts, stop)]
            scan.starts, scan.ends = np.concatenate([[at], inside + 2]), np.concatenate([inside, [stop]])
            image.scans.append(scan)
            at = stop
        elif 0xC0 <= code <= 0xCF and code not in (0xC8, 0xCC):
            raise ValueError(f"not a progressive image: frame 0x{code:02x}")


@lru_cache(maxsize=4096)
def _order(shapes: tuple[tuple[int, int, int, int, int, int, int], ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in coding order (of each part from 0), their parts, and blocks to a unit.
    A shape: h, v, wide, tall, own_wide, own_tall, units across."""
    if len(shapes) == 1:
        _, _, wide, _, own_wide, own_tall, _ = shapes[0]
        return (np.arange(own_tall)[:, None] * wide + np.arange(own_wide)).ravel(), np.zeros(own_tall * own_wide, np.int64), 1
    across = shapes[0][6]
    down = shapes[0][3] // shapes[0][1]
    blocks, parts = [], []
    for i, (h, v, wide, _, _, _, _) in enumerate(shapes):
        y, x = np.divmod(np.arange(h * v), h)
        unit_y, unit_x = np.divmod(np.arange(across * down), across)
        blocks.append((unit_y[:, None] * v + y) * wide + unit_x[:, None] * h + x)
        parts.append(np.full(h * v, i))
    size = sum(b.shape[1] for b in blocks)
    return np.concatenate(blocks, axis=1).ravel(), np.tile(np.concatenate(parts), across * down), size


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images of all files (a file may hold several, one behind the other) and all their coefficients,
    a row of 64 in zigzag order for each block."""
    data = b"".join(files)
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(raw[:-1] == 0xFF)
    nxt = raw[at + 1]
    is_restart = (nxt >= 0xD0) & (nxt <= 0xD7)
    restarts = at[is_restart]
    marks = at[(nxt != 0) & (nxt != 0xFF) & ~is_restart].tolist()
    images, place = [], 0
    for k, f in enumerate(files):
        stop = place + len(f)
        while place < stop:
            images.append(_read(data, place, marks, restarts))
            images[-1].owner, place = k, images[-1].end
    base = 0
    for image in images:
        for p in image.parts:
            p.base, base = base, base + p.wide * p.tall
    # Entropy-coded bytes alone, without stuffing; where each stretch starts there.
    change = np.zeros(len(raw) + 1, np.int64)
    for image in images:
        for s in image.scans:
            change[s.starts] += 1
            change[s.ends] -= 1
    keep = np.cumsum(change[:-1]) > 0
    stuffed = at[nxt == 0] + 1
    keep[stuffed[keep[stuffed - 1]]] = False
    new_place = np.cumsum(keep) - keep
    bytes_ = np.concatenate([raw[keep], np.zeros(16, np.uint8)])
    ahead = np.lib.stride_tricks.as_strided(bytes_, (len(bytes_) - 7, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    found = np.zeros((base, 64), np.int32)
    for k in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict[tuple[bool, bool], list[tuple[Image, Scan]]] = {}
        for image in images:
            if k < len(image.scans):
                s = image.scans[k]
                kinds.setdefault((s.first == 0, s.high == 0), []).append((image, s))
        for (dc, first), own in kinds.items():
            streams = _Streams(own, new_place)
            (_dc_first if dc and first else _dc_refine if dc else _ac_first if first else _ac_refine)(streams, ahead, bytes_, found)
    return images, found


class _Streams:
    """The stretches of one scan of each of many images, as arrays with an entry for each."""

    def __init__(self, own: list[tuple[Image, Scan]], new_place: np.ndarray):
        order, part, starts, specs, known = [], [], [], [], {}
        sizes, each, units = [], [], []
        self.luts: list[np.ndarray] = []
        for image, s in own:
            hm, _ = image.most
            across = -(-image.columns // (8 * hm))
            shapes = tuple((p.h, p.v, p.wide, p.tall, p.own_wide, p.own_tall, across) for p in (image.parts[i] for i in s.parts))
            blocks, of, unit = _order(shapes)
            order.append(blocks + (np.array([image.parts[i].base for i in s.parts])[of] if len(s.parts) > 1 else image.parts[s.parts[0]].base))
            part.append(of)
            sizes.append(len(blocks))
            each.append(s.restart * unit or max(1, len(blocks)))
            units.append((s.low, s.first, s.last))
            tables = []
            for dc_spec, ac_spec in s.tables:
                spec = dc_spec if s.first == 0 else ac_spec
                if spec is not None and spec not in known:
                    known[spec] = len(self.luts)
                    self.luts.append(huffman(spec).lookup)
                tables.append(known.get(spec, 0))
            specs.append(tables + [0] * (4 - len(tables)))
            starts.append(s.starts[: -(-len(blocks) // each[-1])])
        sizes, each = np.array(sizes), np.array(each)
        count = -(-sizes // each)
        image_of = np.repeat(np.arange(len(own)), count)
        number = np.arange(len(image_of)) - np.repeat(np.cumsum(count) - count, count)
        self.order, self.part = np.concatenate(order), np.concatenate(part)
        self.start = (np.cumsum(sizes) - sizes)[image_of] + number * each[image_of]
        self.length = np.minimum(each[image_of], sizes[image_of] - number * each[image_of])
        self.bit = 8 * new_place[np.concatenate(starts)]
        self.low, self.first, self.last = np.array(units)[image_of].T
        self.table = np.array(specs)[image_of]
        self.lut = np.concatenate(self.luts) if self.luts else np.zeros(1 << 16, np.int64)


def _peek(ahead: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return ahead[bit >> 3] << (bit & 7).astype(np.uint64)


def _extra(word: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` bits behind the ``used`` first ones; none for size 0."""
    return ((word << used.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _dc_first(s: _Streams, ahead: np.ndarray, _: np.ndarray, found: np.ndarray) -> None:
    bit, i = s.bit.copy(), np.arange(len(s.start))
    sums = np.zeros((len(i), 4), np.int64)
    for k in range(int(s.length.max(initial=0))):
        i = i[s.length[i] > k]
        at = s.start[i] + k
        part = s.part[at]
        word = _peek(ahead, bit[i])
        entry = s.lut[(s.table[i, part] << 16) + (word >> np.uint64(48)).astype(np.int64)]
        used, size = entry & 255, entry >> 8
        sums[i, part] += _extend(_extra(word, used, size), size)
        found[s.order[at], 0] = sums[i, part] << s.low[i]
        bit[i] += used + size


def _dc_refine(s: _Streams, _: np.ndarray, bytes_: np.ndarray, found: np.ndarray) -> None:
    stream = np.repeat(np.arange(len(s.start)), s.length)
    at = np.arange(len(stream)) - np.repeat(np.cumsum(s.length) - s.length, s.length)
    bit = s.bit[stream] + at
    value = (bytes_[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
    found[s.order[s.start[stream] + at], 0] |= value.astype(np.int32) << s.low[stream].astype(np.int32)


def _ac_first(s: _Streams, ahead: np.ndarray, _: np.ndarray, found: np.ndarray) -> None:
    flat = found.reshape(-1)
    bit, at, end = s.bit.copy(), s.start.copy(), s.start + s.length
    low, first, last, table = s.low, s.first, s.last, s.table[:, 0] << 16
    k = first.copy()
    base = s.order[np.minimum(at, len(s.order) - 1)] * 64
    while len(at):
        word = _peek(ahead, bit)
        entry = s.lut[table + (word >> np.uint64(48)).astype(np.int64)]
        used, symbol = entry & 255, entry >> 8
        run, size = symbol >> 4, symbol & 15
        plain = size > 0
        if plain.all():
            k = k + run
            flat[base + k] = _extend(_extra(word, used, size), size) << low
            bit = bit + used + size
            k = k + 1
            over = k > last
            step = over.astype(np.int64)
        else:
            ends = ~plain & (run < 15)
            width = np.where(ends, run, size)
            extra = _extra(word, used, width)
            k = k + run
            flat[(base + k)[plain]] = (_extend(extra, size) << low)[plain]
            bit = bit + used + width
            k = np.where(ends, last, k) + 1
            over = k > last
            step = np.where(ends, (1 << width) + extra, over)
        if over.any():
            at = at + step
            k = np.where(over, first, k)
            going = at < end
            if not going.all():
                bit, at, end, low, first, last, table, k = (x[going] for x in (bit, at, end, low, first, last, table, k))
            base = s.order[at] * 64


def _ac_refine(s: _Streams, ahead: np.ndarray, bytes_: np.ndarray, found: np.ndarray) -> None:
    bit, at, end = s.bit.copy(), s.start.copy(), s.start + s.length
    low, first, last, table = s.low, s.first, s.last, s.table[:, 0] << 16
    k, ended = first.copy(), np.zeros(len(at), np.int64)
    while len(at):
        fresh = ended == 0
        word = _peek(ahead, bit)
        entry = s.lut[table + (word >> np.uint64(48)).astype(np.int64)]
        used, symbol = entry & 255, entry >> 8
        run, size = symbol >> 4, symbol & 15
        ends = fresh & (size == 0) & (run < 15)
        width = np.where(ends, run, (size > 0).astype(np.int64))
        extra = _extra(word, used, width)
        bit = bit + np.where(fresh, used + width, 0)
        ended = np.where(ends, (1 << width) + extra, ended)
        whole = ended > 0  # to the end of the block
        a, z = int(first.min()), int(last.max()) + 1
        block = s.order[at]
        rows = found[block, a:z]
        place = np.arange(a, z)
        ahead_of = (place >= k[:, None]) & (place <= last[:, None])
        zeros = (rows == 0) & ahead_of
        nth = np.cumsum(zeros, axis=1) == (run + 1)[:, None]
        hit = nth & zeros
        target = np.where(hit.any(axis=1), a + hit.argmax(axis=1), last + 1)
        target = np.where(whole, last + 1, target)
        mend = (rows != 0) & ahead_of & (place < target[:, None])
        count = np.cumsum(mend, axis=1)
        src = (bit[:, None] + count - 1)[mend]
        bits = (bytes_[src >> 3] >> (7 - (src & 7)).astype(np.uint8)) & 1
        values = rows[mend]
        rows[mend] = values + np.sign(values) * (bits.astype(np.int32) << np.broadcast_to(low[:, None], mend.shape)[mend].astype(np.int32))
        bit = bit + count[:, -1]
        new = ~whole & (size > 0) & (target <= last)
        rows[new, target[new] - a] = np.where(extra[new] > 0, 1, -1) << low[new]
        found[block, a:z] = rows
        k = target + 1
        over = k > last
        at = at + over
        ended = np.where(whole & over, ended - 1, ended)
        k = np.where(over, first, k)
        going = at < end
        if not going.all():
            bit, at, end, low, first, last, table, k, ended = (x[going] for x in (bit, at, end, low, first, last, table, k, ended))


def samples(images: list[Image], found: np.ndarray) -> np.ndarray:
    """Inverse transform of all blocks: (block, 8, 8), at the images' own precision, unrounded."""
    sizes = [p.wide * p.tall for i in images for p in i.parts]
    quants = [p.quant for i in images for p in i.parts]
    if all(q is quants[0] for q in quants):
        out = found.astype(np.float64) @ (_WHOLE * quants[0]).T
    else:
        out = (found * np.repeat(np.stack(quants), sizes, axis=0).astype(np.float64)) @ _WHOLE.T
    out *= 2.0**-SCALE
    return out.astype(np.float32).reshape(-1, 8, 8)


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """The image as (rows, columns, 3) bytes; grey if it has one component."""
    hm, vm = image.most
    planes = []
    for p in image.parts:
        own = blocks[p.base : p.base + p.wide * p.tall].reshape(p.tall, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(p.tall * 8, p.wide * 8)
        own = own[: -(-image.rows * p.v // vm), : -(-image.columns * p.h // hm)]
        if hm > p.h or vm > p.v:
            own = own.repeat(vm // p.v, axis=0).repeat(hm // p.h, axis=1)
        planes.append(own[: image.rows, : image.columns])
    scale = np.float32(2.0 ** (8 - image.precision))
    y = planes[0] * scale + np.float32(128)
    out = np.empty((image.rows, image.columns, 3), np.uint8)
    if len(planes) < 3:
        out[:] = _bytes(y)[:, :, None]
        return out
    cb, cr = planes[1] * scale, planes[2] * scale
    out[:, :, 0] = _bytes(y + np.float32(1.402) * cr)
    out[:, :, 1] = _bytes(y - np.float32(0.344136) * cb - np.float32(0.714136) * cr)
    out[:, :, 2] = _bytes(y + np.float32(1.772) * cb)
    return out


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def decode(files: list[bytes]) -> list[list[np.ndarray]]:
    """The RGB tensors of the images in each file."""
    images, found = coefficients(files)
    blocks = samples(images, found) if images else None
    out: list[list[np.ndarray]] = [[] for _ in files]
    for image in images:
        out[image.owner].append(rgb(image, blocks))
    return out
