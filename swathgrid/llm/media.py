"""Media columns: progressive JPEG, written and read in numpy.

Reading gathers all scans into coefficient arrays (spectral selection gives a band of each block,
successive approximation adds a bit to coefficients that are there), then turns the coefficients into
samples, widens the chroma planes to full size and gives an H x W x 3 tensor of 8-bit RGB.

A text is stored in such a picture without loss: the format's unit is the quantised coefficient, so
byte x of the payload becomes coefficient x - 128, in zigzag order, block after block of Y, Cb and Cr.
The picture is 4:2:0; blocks beyond the payload are zero and a comment holds the payload's length.

Bits are read in bulk: a table over all 16-bit windows gives code and length at every bit, a short walk
finds where the symbols begin, and the rest is array arithmetic.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, per_batch

UNIT = 192


def _zigzag() -> np.ndarray:
    """Place in the 8 x 8 block (row by row) of each coefficient in zigzag order."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()
_COS = np.array([[np.sqrt((1 + (u > 0)) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_INVERSE = np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64).astype(np.float32)


# ---- Huffman tables


def _canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """[(symbol, code, length)] of a table as a DHT segment gives it."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            out.append((s, code, length))
            code += 1
        k += n
        code <<= 1
    return out


def _table(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(1 for s in symbols if lengths[s] == n) for n in range(1, 17)], symbols


def _even(size: int, least: int) -> int:
    """The shortest code of at least `least` bits that makes code and extra bits a multiple of 4 together."""
    return least + -(least + size) % 4


#: Coefficients in text are rarely zero: short codes for (no run, size), long ones for runs. Code and extra
#: bits of a symbol are a multiple of 4 bits, so that a reader need only look at every fourth bit.
_AC = _table(
    {s: 8 - s for s in range(1, 7)} | {s: _even(s, 4) for s in range(7, 11)} | {0x00: 4, 0xF0: 8} | {n << 4: _even(n, 6) for n in range(1, 15)}
    | {r << 4 | s: _even(s, 12) for r in range(1, 16) for s in range(1, 11)}
)
_DC = _table({0: 4} | {s: 8 - s for s in range(1, 7)} | {s: _even(s, 5) for s in range(7, 12)})


@functools.lru_cache
def _coder(kind: str) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, n in _canonical(*(_AC if kind == "ac" else _DC)):
        code[s], length[s] = c, n
    return code, length


@functools.lru_cache(maxsize=64)
def _reader(counts: bytes, symbols: bytes, dc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Over all 16-bit windows: symbol, length of its code, units up to the next symbol (0: no code); and bits in a unit."""
    symbol, length, step = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint8)
    unit = 8
    for s, c, n in _canonical(list(counts), list(symbols)):
        more = s if dc else (s & 15) or ((s >> 4) if s >> 4 < 15 else 0)
        at = slice(c << (16 - n), (c + 1) << (16 - n))
        symbol[at], length[at], step[at] = s, n, n + more
        unit = math.gcd(unit, n + more)
    return symbol, length, step // np.uint8(unit), unit


# ---- bits


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., then from starts[1] on, and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _pack(values: np.ndarray, lengths: np.ndarray, picture: np.ndarray, n: int) -> list[bytes]:
    """For each of n pictures its bits: values[i] in lengths[i] bits, filled up with ones, 0xFF stuffed. picture ascends."""
    ends = np.searchsorted(picture, np.arange(n), "right")
    total = np.concatenate([[0], np.cumsum(lengths)])[ends]
    fill = -np.diff(total, prepend=0) % 8
    values, lengths = np.insert(values, ends, (1 << fill) - 1), np.insert(lengths, ends, fill)
    to = np.cumsum(lengths)
    if not len(to) or not to[-1]:
        return [b""] * n
    # each symbol lies in a 64-bit window that begins with one of the 32-bit words; symbols of one word come together
    begin = to - lengths
    word = begin >> 5
    bits = values.astype(np.uint64) << (64 - (begin & 31) - lengths).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    bits, word = np.bitwise_or.reduceat(bits, first), word[first]
    words = np.zeros(word[-1] + 2, np.uint32)
    words[word] = bits >> np.uint64(32)
    words[word + 1] |= (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    octets = words.astype(">u4").tobytes()
    cuts = [0, *((total + np.cumsum(fill)) // 8).tolist()]
    return [octets[i:j].replace(b"\xff", b"\xff\x00") for i, j in zip(cuts, cuts[1:], strict=False)]


class _Bits:
    """Data of several scans with ones between and after them; starts: the bit where each begins."""

    def __init__(self, data: list[bytes]) -> None:
        gap = b"\xff\xff\xff"
        sizes = np.fromiter(map(len, data), np.int64, len(data)) + len(gap)
        self.starts = (8 * (np.cumsum(sizes) - sizes)).tolist()
        b = np.frombuffer(gap.join([*data, gap]), np.uint8).astype(np.int64)
        self.three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]

    def every(self, unit: int) -> np.ndarray:
        """The 16 bits from every unit-th bit on."""
        return (self.three[:, None] >> np.arange(8, 0, -unit) & 0xFFFF).ravel()

    def at(self, place: np.ndarray) -> np.ndarray:
        """The 16 bits from each place on."""
        return self.three[place >> 3] >> (8 - (place & 7)) & 0xFFFF


_BITS_OF = np.array([i.bit_length() for i in range(1 << 15)], np.int64)


def _category(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return _BITS_OF[np.abs(v)]


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _extended(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((raw < (1 << np.maximum(size - 1, 0))) & (size > 0), raw - (1 << size) + 1, raw)


def _units(rows: np.ndarray, cols: np.ndarray, h: int, v: int) -> np.ndarray:
    """Of pictures whose planes lie one after another, the blocks of each unit: shape (units, v * h)."""
    units = rows * cols
    at = _ranges(np.zeros(len(units), np.int64), units)
    wide = np.repeat(cols, units)
    base = np.repeat((np.cumsum(units) - units) * h * v, units)
    inner = [(i, j) for i in range(v) for j in range(h)]
    return np.stack([base + (v * (at // wide) + i) * (h * wide) + h * (at % wide) + j for i, j in inner], 1)


# ---- writing scans of many pictures at once


def _runs(ends: np.ndarray, filled: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks where a run of block ends begins, and its length. ends: the block ends early; filled: it has symbols; firsts: blocks that begin a picture."""
    start = ends & (filled | ~np.concatenate([[False], ends[:-1]]))
    start[firsts] |= ends[firsts]
    at = np.flatnonzero(start)
    if not len(at):
        return at, at
    stop = np.concatenate([at[1:], [len(ends)]])
    broken = np.concatenate([np.flatnonzero(~ends), [len(ends)]])
    stop = np.minimum(stop, broken[np.searchsorted(broken, at)])
    size, most = stop - at, 0x7FFF
    n = -(-size // most)
    k = _ranges(np.zeros(len(n), np.int64), n)
    return np.repeat(at, n) + k * most, np.minimum(np.repeat(size, n) - k * most, most)


def _first_ac(v: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, lengths, block) of the symbols of a first AC scan over v: blocks x band, already shifted."""
    code, length = _coder("ac")
    width = v.shape[1]
    at = np.flatnonzero(v)
    block, k = at // width, at % width
    before = np.full(len(at), -1)
    before[1:] = np.where(block[1:] == block[:-1], k[:-1], -1)
    run = k - before - 1
    value = v.ravel()[at]
    size = _category(value)
    symbol = (run & 15) << 4 | size
    bits, n = code[symbol] << size | _extra(value, size), length[symbol] + size
    key = block * (width + 1) + k
    long = run >> 4
    if long.any():
        again = long + 1
        last = np.cumsum(again) - 1
        full_bits, full_n = np.full(again.sum(), code[0xF0]), np.full(again.sum(), length[0xF0])
        full_bits[last], full_n[last] = bits, n
        bits, n, key = full_bits, full_n, np.repeat(key, again)
    filled = np.zeros(len(v), bool)
    filled[block] = True
    start, size = _runs(v[:, -1] == 0, filled, firsts)
    if len(start):
        more = _category(size) - 1
        key = np.concatenate([key, start * (width + 1) + width])
        order = np.argsort(key, kind="stable")
        bits = np.concatenate([bits, code[more << 4] << more | size - (1 << more)])[order]
        n, key = np.concatenate([n, length[more << 4] + more])[order], key[order]
    return bits, n, key // (width + 1)


def _more_ac(v: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, lengths, block) of the symbols of the AC scan that adds the lowest bit of v: blocks x band."""
    code, length = _coder("ac")
    width, flat = v.shape[1], v.ravel()
    size = np.abs(flat)
    old, new = np.flatnonzero(size > 1), np.flatnonzero(size == 1)
    zeros = np.concatenate([[0], np.cumsum(size <= 1)])  # places without history before each place
    block = new // width
    before = block * width
    before[1:] = np.where(block[1:] == block[:-1], new[:-1] + 1, before[1:])
    run = zeros[new] - zeros[before]
    event, bits, n, owner_block = [new], [code[(run & 15) << 4 | 1] << 1 | (flat[new] > 0)], [length[(run & 15) << 4 | 1] + 1], [block]
    if (run >> 4).any():  # each 16 places without history before a new coefficient end in a symbol of their own
        again = run >> 4
        k = _ranges(np.zeros(len(again), np.int64), again)
        event.append(np.flatnonzero(size <= 1)[np.repeat(zeros[before], again) + 16 * k + 15])
        bits.append(np.full(len(k), code[0xF0]))
        n.append(np.full(len(k), length[0xF0]))
        owner_block.append(np.repeat(block, again))
    filled = np.zeros(len(v), bool)
    filled[block] = True
    last = np.full(len(v), -1)
    last[block] = new % width
    start, blocks = _runs(last < width - 1, filled, firsts)
    more = _category(blocks) - 1
    event.append((start + blocks) * width - 0.5)
    bits.append(code[more << 4] << more | blocks - (1 << more))
    n.append(length[more << 4] + more)
    owner_block.append(start)
    event, bits, n, owner_block = (np.concatenate(x) for x in (event, bits, n, owner_block))
    if len(event) > len(start):
        order = np.argsort(event, kind="stable")
        event, bits, n, owner_block = event[order], bits[order], n[order], owner_block[order]
    # each coefficient with history gives a bit after the symbol in whose stretch it lies
    owner = np.searchsorted(event, old)
    place = np.concatenate([np.arange(len(event)) + np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(event)))])[:-1], np.arange(len(old)) + owner + 1])
    out = np.empty((3, len(place)), np.int64)
    out[:, place] = np.stack([np.concatenate([bits, size[old] & 1]), np.concatenate([n, np.ones(len(old), np.int64)]), np.concatenate([owner_block, old // width])])
    return out[0], out[1], out[2]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


_SHAPE = ((2, 2), (1, 1), (1, 1))


def write_jpegs(planes: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, notes: list[bytes]) -> list[bytes]:
    """Progressive 4:2:0 JPEGs of rows x cols units of 16 x 16 pixels each, with a comment.

    planes: coefficients in zigzag order of Y, Cb and Cr, those of all pictures one after another.
    """
    count, units = len(rows), rows * cols
    ends = np.cumsum(units)
    tables = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + b"".join(_segment(0xC4, bytes([kind, *counts, *symbols])) for kind, (counts, symbols) in ((0x00, _DC), (0x10, _AC)))
    parts = b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(_SHAPE))
    out = [
        [b"\xff\xd8", _segment(0xFE, note), _segment(0xC2, bytes([8]) + (16 * r).to_bytes(2, "big") + (16 * c).to_bytes(2, "big") + bytes([3]) + parts), tables]
        for note, r, c in zip(notes, rows.tolist(), cols.tolist(), strict=True)
    ]

    def scan(which: list[int], first: int, last: int, high: int, low: int, values: np.ndarray, lengths: np.ndarray, picture: np.ndarray) -> None:
        head = _segment(0xDA, bytes([len(which), *(x for c in which for x in (c + 1, 0)), first, last, high << 4 | low]))
        for own, bits in zip(out, _pack(values, lengths, picture, count), strict=True):
            own += (head, bits)

    def ac(c: int, first: int, last: int, high: int, low: int, v: np.ndarray) -> None:
        each = _SHAPE[c][0] * _SHAPE[c][1]
        values, lengths, block = (_more_ac if high else _first_ac)(v, (ends - units) * each)
        scan([c], first, last, high, low, values, lengths, np.searchsorted(ends * each, block, "right"))

    dc = [p[:, 0][_units(rows, cols, h, v)] for p, (h, v) in zip(planes, _SHAPE, strict=True)]
    code, length = _coder("dc")
    steps = []
    for d in dc:
        flat = (d >> 1).ravel()
        step = np.diff(flat, prepend=0)
        begin = (ends - units) * d.shape[1]
        step[begin] = flat[begin]
        steps.append(step.reshape(d.shape))
    diff = np.concatenate(steps, 1).ravel()
    size, picture = _category(diff), np.repeat(np.arange(count), 6 * units)
    scan([0, 1, 2], 0, 0, 0, 1, code[size] << size | _extra(diff, size), length[size] + size, picture)
    y = planes[0]
    half = np.sign(y) * (np.abs(y) >> 1)
    ac(0, 1, 5, 0, 1, half[:, 1:6])
    ac(1, 1, 63, 0, 0, planes[1][:, 1:])
    ac(2, 1, 63, 0, 0, planes[2][:, 1:])
    ac(0, 6, 63, 0, 1, half[:, 6:])
    ac(0, 1, 63, 1, 0, y[:, 1:])
    low = np.concatenate([d & 1 for d in dc], 1).ravel()
    scan([0, 1, 2], 0, 0, 1, 0, low, np.ones(len(low), np.int64), picture)
    return [b"".join([*own, b"\xff\xd9"]) for own in out]


# ---- reading scans of many pictures at once


@dataclass
class Picture:
    """planes: coefficients in zigzag order for each component, blocks row by row over whole units."""

    width: int = 0
    height: int = 0
    ids: list[int] = field(default_factory=list)
    factors: list[tuple[int, int]] = field(default_factory=list)
    tables: list[int] = field(default_factory=list)
    planes: list[np.ndarray] = field(default_factory=list)
    quant: dict[int, tuple[int, ...]] = field(default_factory=dict)
    note: bytes = b""
    rows: int = 0
    cols: int = 0
    scans: list[tuple] = field(default_factory=list)  # (head, Huffman tables at that point, data)

    def blocks(self, c: int) -> np.ndarray | None:
        """The blocks that a scan of component c alone goes through, those that cover the picture; None for all of them."""
        (h, v), hm, vm = self.factors[c], max(f[0] for f in self.factors), max(f[1] for f in self.factors)
        high, wide = -(-self.height * v // (8 * vm)), -(-self.width * h // (8 * hm))
        if high == self.rows * v and wide == self.cols * h:
            return None
        return np.arange(self.rows * v * self.cols * h).reshape(self.rows * v, -1)[:high, :wide].ravel()


def _outline(octets: bytes) -> Picture:
    """A picture's headers, and its scans unread. ValueError for what isn't a progressive JPEG without restarts."""
    if octets[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    pic, huff, k = Picture(), {}, 2
    while k + 1 < len(octets):
        marker = octets[k + 1]
        if marker == 0xD9:
            return pic
        size = int.from_bytes(octets[k + 2 : k + 4], "big")
        body, k = octets[k + 4 : k + 2 + size], k + 2 + size
        if marker == 0xFE:
            pic.note = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                pic.quant[body[0] & 15] = tuple(np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).tolist())
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            huff = dict(huff)
            while body:
                n = sum(body[1:17])
                huff[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            pic.height, pic.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for c in range(body[5]):
                i, hv, q = body[6 + 3 * c : 9 + 3 * c]
                pic.ids.append(i)
                pic.factors.append((hv >> 4, hv & 15))
                pic.tables.append(q)
            hm, vm = max(f[0] for f in pic.factors), max(f[1] for f in pic.factors)
            pic.rows, pic.cols = -(-pic.height // (8 * vm)), -(-pic.width // (8 * hm))
        elif marker in (0xDD, 0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError(f"marker {marker:x} isn't one of a progressive JPEG without restarts")
        elif marker == 0xDA:
            end = octets.index(b"\xff", k)
            while octets[end + 1] == 0:
                end = octets.index(b"\xff", end + 2)
            pic.scans.append((body, tuple(sorted(huff.items())), octets[k:end].replace(b"\xff\x00", b"\xff")))
            k = end
    raise ValueError("the JPEG has no end")


def read_jpegs(many: list[bytes]) -> list[Picture]:
    """All scans of progressive JPEGs. Pictures with the same scans and tables are read together."""
    pics = [_outline(x) for x in many]
    alike: dict[tuple, list[Picture]] = {}
    for pic in pics:
        alike.setdefault((tuple((head, huff) for head, huff, _ in pic.scans), tuple(pic.factors), tuple(pic.ids)), []).append(pic)
    for (scans, factors, ids), some in alike.items():
        planes = [np.zeros((sum(p.rows * p.cols for p in some) * h * v, 64), np.int64) for h, v in factors]
        for k, (head, huff) in enumerate(scans):
            _read_scan(some, planes, ids, head, dict(huff), [p.scans[k][2] for p in some])
        at = 0
        for p in some:
            units = p.rows * p.cols
            p.planes = [plane[at * h * v : (at + units) * h * v] for plane, (h, v) in zip(planes, factors, strict=True)]
            p.scans, at = [], at + units
    return pics


def _walk(bits: _Bits, reader: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of the symbols of all scans, each up to where there is no code. Four symbols are gone at a time."""
    _, _, table, unit = reader
    w = bits.every(unit)
    size, none = len(w), np.zeros(128, np.uint8)
    step = np.concatenate([table[w], none])
    place = np.arange(size)
    two = np.concatenate([step[:size] + step[place + step[:size]], none])
    hop, at = np.concatenate([two[:size] + two[place + two[:size]], none]).tobytes(), []
    add = at.append
    for p in bits.starts:
        p //= unit
        while n := hop[p]:
            add(p)
            p += n
    out = np.empty((len(at), 4), np.int64)
    out[:, 0] = at
    for k in (1, 2, 3):
        out[:, k] = out[:, k - 1] + step[out[:, k - 1]]
    out = out.ravel()
    out = out[step[out] > 0]  # a walk stands still where there is no code
    return out * unit, w[out]


def _read_first_ac(data: list[bytes], table: tuple, count: int, width: int) -> np.ndarray:
    """count: blocks of all pictures. A scan ends with its picture's last block, so places go on from one picture to the next."""
    reader, bits = _reader(*table, False), _Bits(data)
    at, w = _walk(bits, reader)
    out = np.zeros(count * width, np.int64)
    if not len(at):
        return out.reshape(count, width)
    s = reader[0][w]
    run, size = s >> 4, s & 15
    ends = (size == 0) & (run < 15)
    raw = bits.at(at + reader[1][w]) >> (16 - np.where(ends, run, size))
    # places gone: an end of block goes on to the next block, and over the blocks of its run
    gone = np.cumsum(np.where(ends, 0, run + 1))
    stop = np.flatnonzero(ends)
    if len(stop):
        part = gone[stop]
        part[1:] -= gone[stop[:-1]]
        shift = np.zeros(len(at), np.int64)
        shift[stop] = (part // width + 1) * width - part + ((1 << run[stop]) + raw[stop] - 1) * width
        gone += np.cumsum(shift) - shift
    real = size > 0
    out[gone[real] - 1] = _extended(raw[real], size[real])
    return out.reshape(count, width)


def _read_more_ac(data: list[bytes], table: tuple, now: np.ndarray, blocks: list[int], low: int) -> np.ndarray:
    """now (blocks x band of all pictures; blocks: how many of each) with bit `low` of its coefficients, and those that begin with it."""
    (symbol, length, *_), bits = _reader(*table, False), _Bits(data)
    three = bits.three
    width, flat = now.shape[1], now.reshape(-1).copy()
    history = flat != 0
    free = np.flatnonzero(~history)
    olds = np.concatenate([[0], np.cumsum(history)])
    place, total, news, spans = 0, 0, [], []

    def window(p: int) -> int:
        return int(three[p >> 3]) >> (8 - (p & 7)) & 0xFFFF

    for p, own in zip(bits.starts, blocks, strict=True):
        total += own * width
        while place < total:
            at = window(p)
            s, p = int(symbol[at]), p + int(length[at])
            run, sign = s >> 4, 0
            if not s & 15 and run < 15:
                to = min(total, (place // width + (1 << run) + (window(p) >> (16 - run))) * width)
                p += run
            else:
                if s & 15:
                    sign = 1 if window(p) >> 15 else -1
                    p += 1
                to = int(free[place - int(olds[place]) + run])
            n = int(olds[to] - olds[place])
            spans.append((p, n))
            p, place = p + n, to
            if s & 15 or run == 15:
                place += 1
                if sign:
                    news.append((to, sign << low))
    if spans:
        begin, n = np.array(spans).T
        old = np.flatnonzero(history)
        flat[old] += np.sign(flat[old]) * ((bits.at(_ranges(begin, n)) >> 15) << low)
    for k, v in news:
        flat[k] = v
    return flat.reshape(now.shape)


def _read_scan(pics: list[Picture], planes: list[np.ndarray], ids: tuple, head: bytes, huff: dict[int, tuple], data: list[bytes]) -> None:
    n = head[0]
    parts = [(ids.index(head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    factors = pics[0].factors

    def alone(c: int) -> tuple[np.ndarray | slice, list[int]]:
        each = [p.rows * p.cols * factors[c][0] * factors[c][1] for p in pics]
        some = [p.blocks(c) for p in pics]
        if all(b is None for b in some):
            return slice(None), each
        begin = np.cumsum([0, *each[:-1]]).tolist()
        some = [i + (np.arange(m) if b is None else b) for b, m, i in zip(some, each, begin, strict=True)]
        return np.concatenate(some), [len(b) for b in some]

    if first:
        c, table = parts[0][0], huff[0x10 | parts[0][1] & 15]
        at, each = alone(c)
        band = slice(first, last + 1)
        if high:
            planes[c][at, band] = _read_more_ac(data, table, planes[c][at, band], each, low)
        else:
            planes[c][at, band] = _read_first_ac(data, table, sum(each), last - first + 1) << low
        return
    rows, cols = (np.array([getattr(p, x) for p in pics]) for x in ("rows", "cols"))
    if n == 1:
        at, units = alone(parts[0][0])
        orders = [np.arange(len(planes[parts[0][0]]))[at][:, None]]
    else:
        units = (rows * cols).tolist()
        orders = [_units(rows, cols, *factors[c]) for c, _ in parts]
    wide = [o.shape[1] for o in orders]
    size = np.array(units) * sum(wide)
    if high:
        octets = [np.unpackbits(np.frombuffer(d, np.uint8))[:k] for d, k in zip(data, size.tolist(), strict=True)]
        values = np.split(np.concatenate(octets).reshape(-1, sum(wide)).astype(np.int64), np.cumsum(wide)[:-1], 1)
        for (c, _), o, v in zip(parts, orders, values, strict=True):
            planes[c][o, 0] |= v << low
        return
    bits, readers = _Bits(data), [_reader(*huff[t >> 4], True) for _, t in parts]
    turn = np.tile(np.repeat(np.arange(n), wide), sum(units))
    if all(huff[t >> 4] == huff[parts[0][1] >> 4] for _, t in parts):
        at, w = _walk(bits, readers[0])
        number, skip = readers[0][0][w], readers[0][1][w]
    else:
        at, k = [], 0
        for p, m in zip(bits.starts, size.tolist(), strict=True):
            for t in turn[k : k + m].tolist():
                at.append(p)
                p += int(readers[t][2][int(bits.three[p >> 3]) >> (8 - (p & 7)) & 0xFFFF]) * readers[t][3]
            k += m
        at = np.array(at, np.int64)
        number, skip = (np.choose(turn, [r[x][bits.at(at)] for r in readers]) for x in (0, 1))
    diff = _extended(bits.at(at + skip) >> (16 - number), number).reshape(-1, sum(wide))
    for (c, _), o, v in zip(parts, orders, np.split(diff, np.cumsum(wide)[:-1], 1), strict=True):
        total = np.cumsum(v.ravel())
        begin = (np.cumsum(units) - units) * v.shape[1]
        total -= np.repeat(np.where(begin > 0, total[begin - 1], 0), np.array(units) * v.shape[1])
        planes[c][o, 0] = total.reshape(v.shape) << low


def to_rgb(pics: list[Picture]) -> list[np.ndarray]:
    """Each picture as height x width x 3 bytes: inverse transform, chroma widened to full size, YCbCr to RGB."""
    out = []
    for pic in pics:
        hm, vm = max(f[0] for f in pic.factors), max(f[1] for f in pic.factors)
        full = []
        for (h, v), q, plane in zip(pic.factors, pic.tables, pic.planes, strict=True):
            block = np.empty(plane.shape, np.float32)
            block[:, ZIGZAG] = plane * np.array(pic.quant[q])
            # the two-dimensional transform of a block of 64 is one product with a fixed matrix
            samples = block @ _INVERSE
            samples += 128.0
            np.clip(np.rint(samples, out=samples), 0, 255, out=samples)
            samples = samples.reshape(pic.rows * v, pic.cols * h, 8, 8).transpose(0, 2, 1, 3).reshape(8 * pic.rows * v, -1)
            full.append(samples if (h, v) == (hm, vm) else samples.repeat(vm // v, 0).repeat(hm // h, 1))
        if len(full) == 1:
            rgb = np.repeat(full[0][:, :, None], 3, 2)
        else:
            y, cb, cr = full[0], full[1] - 128, full[2] - 128
            rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        out.append(np.clip(np.rint(rgb), 0, 255).astype(np.uint8)[: pic.height, : pic.width])
    return out


# ---- texts as pictures


def padded(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of UNIT bytes."""
    return text + b" " * ((-len(text)) % UNIT if text else UNIT)


#: Payload bytes that are coded together.
TOGETHER = 1 << 17


def _parcels(sizes: list[int]) -> Iterator[slice]:
    """Stretches of at most TOGETHER bytes, or of one longer payload."""
    i = 0
    while i < len(sizes):
        j, total = i + 1, sizes[i]
        while j < len(sizes) and total + sizes[j] <= TOGETHER:
            total += sizes[j]
            j += 1
        yield slice(i, j)
        i = j


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as a progressive JPEG."""
    out = []
    for some in _parcels([len(p) for p in payloads]):
        own = payloads[some]
        blocks = np.fromiter((len(p) // 64 for p in own), np.int64, len(own))
        units = -(-blocks // 6)
        cols = np.ceil(np.sqrt(units)).astype(np.int64)
        rows = -(-units // cols)
        units = rows * cols
        begin = 6 * (np.cumsum(units) - units)
        held = np.zeros((6 * units.sum(), 64), np.int64)
        held[_ranges(begin, blocks)] = np.frombuffer(b"".join(own), np.uint8).reshape(-1, 64).astype(np.int64) - 128
        planes = [held[_ranges(begin + a * units, n * units)] for a, n in ((0, 4), (4, 1), (5, 1))]
        out += write_jpegs(planes, rows, cols, [len(p).to_bytes(8, "big") for p in own])
    return out


def restore(pic: Picture) -> bytes:
    """The payload that store() put into a picture."""
    size = int.from_bytes(pic.note, "big")
    return (np.concatenate(pic.planes)[: size // 64] + 128).astype(np.uint8).tobytes()


def describe(rgb: np.ndarray) -> str:
    """height x width, mean and deviation of each channel, and a checksum of the tensor."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    n, one, two = len(flat), flat.sum(0), (flat * flat).sum(0)
    parts = [f"{rgb.shape[0]}x{rgb.shape[1]}"]
    parts += [f"{x / n:.3f}/{max(0.0, y / n - (x / n) ** 2) ** 0.5:.3f}" for x, y in zip(one.tolist(), two.tolist(), strict=True)]
    return " ".join([*parts, f"{zlib.crc32(rgb.tobytes()):08x}"])


def encode_texts(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """docs with two more columns: n_bytes (of the text in UTF-8) and the picture that holds it. A null text counts as empty."""
    at = docs.columns.index(text_col)
    size, media = free_name(docs.columns, "n_bytes"), free_name(docs.columns, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(size, T.LongType()), T.StructField(media, T.BinaryType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(map(len, texts), pa.int64()), pa.array(store([padded(t) for t in texts]), pa.binary())], names=schema.names
        )

    return per_batch(docs, schema, work)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def decode_media(rows: DataFrame, media_col: str = "media", tensor: bool = False, payload: bool = False) -> DataFrame:
    """rows with what the stored pictures hold, read back: READ; with tensor: height, width and RGB bytes; with payload: its bytes.

    A null picture gives nulls. All columns of rows stay; of the new names those that clash get underscores in front.
    """
    at = rows.columns.index(media_col)
    more = T.StructType(list(T.StructType.fromDDL(READ)))
    if tensor:
        more = T.StructType([*more, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])
    if payload:
        more = T.StructType([*more, T.StructField("payload", T.BinaryType())])
    names = list(rows.columns)
    for f in more:
        names.append(free_name(names, f.name))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names[len(rows.columns) :], more, strict=True))])

    def read(media: list[bytes | None]) -> list[list]:
        out = []
        for some in _parcels([len(m or b"") for m in media]):
            there = [m for m in media[some] if m is not None]
            pics = read_jpegs(there)
            pairs = iter(zip(pics, to_rgb(pics), strict=True))
            for m in media[some]:
                if m is None:
                    out.append([None] * len(more))
                    continue
                pic, rgb = next(pairs)
                held = restore(pic)
                row = [len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-16:]), describe(rgb)]
                out.append(row + ([rgb.shape[0], rgb.shape[1], rgb.tobytes()] if tensor else []) + ([held] if payload else []))
        return out

    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()] for f in more]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*read(batch.column(at).to_pylist()), strict=True))
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return per_batch(rows, schema, work)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A digest of each text's picture: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""
    held = encode_texts(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text").drop("_text")
    held = held.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return decode_media(held).select(
        F.col("_id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
