"""Media columns: payloads as progressive JPEG, and their full-resolution RGB tensors.

The reader takes any progressive JPEG (SOF2, 8 bits, any Huffman tables, sampling factors and restart intervals): it
adds up spectral-selection and successive-approximation scans in coefficient arrays, transforms them inversely by one
matrix product in numpy, upsamples chroma to full resolution and converts to RGB, strip by strip, so memory besides
the coefficients and the tensor follows STRIP blocks. The entropy-coded segments of first scans are independent of one
another (a scan's restart intervals, its bands, other files), so all of a slice of files are decoded in step: each step of
a few array operations decodes one Huffman symbol of every segment. Refinements follow in the order of the file, end-of-band
runs as arrays, others symbol by symbol.

The writer stores bytes losslessly in the format's own unit, the quantised coefficient: 48 of them (zigzag 1 to 48) in a
block, six blocks (4:2:0) in a unit of 16 x 16 pixels; so 576 bytes are two units. A blank is coefficient 0, and other bytes
have magnitudes of 2 and more that grow with their distance from the middle of the small letters. The DC coefficient is
a check sum of its block. Scans: DC and its refinement, then for each component two spectral bands without their lowest
bit, and that bit. First scans are cut by restart markers. A comment segment has the payload's length.

Defined results: null and empty texts are 576 bytes of 255; any length is stored (a side may have 65,520 pixels);
repeated rows repeat their result, and equal texts have equal values; a null file has null columns, a damaged one is an error.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import map_slices, materialize

#: Bytes of a payload's unit; bytes of a block and of an MCU; the low bits that later scans bring.
UNIT, IN_BLOCK, IN_MCU, LOW = 576, 48, 288, 1
#: Last coefficients of the two spectral bands.
BANDS = ((1, 15), (16, 48))
#: Blocks transformed at once.
STRIP = 8192
#: The last MCU along a side.
MOST = 4095
#: Zeros that an end of block stands for: more than any run that leaves its band.
END = 100


@cache
def zigzag() -> np.ndarray:
    """Row-major places of the coefficients in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@cache
def basis() -> np.ndarray:
    """The inverse transform as a matrix: zigzag coefficients times it are row-major samples."""
    u = np.arange(8)
    one = np.sqrt(np.where(u == 0, 1, 2) / 8)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()]


# --- reading


@dataclass
class Component:
    h: int
    v: int
    table: int
    wide: int = 0
    high: int = 0
    own_wide: int = 0
    own_high: int = 0
    values: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: dict[int, Component]
    quantisers: dict[int, np.ndarray]
    comment: bytes = b""


class Huffman:
    """A table: entries by (length, code), by the next 16 bits (length and symbol), and by symbol (code and length).

    bands and means have by the next 16 bits what the symbol and the number behind it say together, if both are in these
    bits: the number << 16 | zeros before it << 8 | bits of both. An end of block has END zeros. Others have no bits.
    """

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        self.next = np.zeros(1 << 16, np.int32)
        self.code, self.size = np.zeros(256, np.int32), np.zeros(256, np.int32)
        code, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[k]
                self.next[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
                self.code[symbols[k]], self.size[symbols[k]] = code, length
                code, k = code + 1, k + 1
            code <<= 1

    @cached_property
    def bands(self) -> np.ndarray:
        run, size = self.next >> 4 & 15, self.next & 15
        return self._together(np.where(self.next & 255, run, END), size, (size > 0) | (run == 0) | (run == 15))

    @cached_property
    def means(self) -> np.ndarray:
        size = self.next & 255
        return self._together(np.zeros_like(size), np.minimum(size, 16), size <= 16)

    def _together(self, zeros: np.ndarray, size: np.ndarray, known: np.ndarray) -> np.ndarray:
        length = self.next >> 8
        rest = np.arange(1 << 16, dtype=np.int32) << length & 0xFFFF
        number = (rest >> (16 - size)) - np.where((rest >> 15 == 1) | (size == 0), 0, (1 << size) - 1)
        return np.where(known & (length > 0) & (length + size <= 16), number << 16 | zeros << 8 | length + size, 0).astype(np.int32)


@lru_cache(256)
def huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


class Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def array(self, n: int) -> np.ndarray:
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, table: Huffman) -> int:
        code, codes = 0, table.codes
        for length in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            found = codes.get((length, code))
            if found is not None:
                return found
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


#: The end of entropy-coded data: a marker that is no stuffing and no restart.
_END, _RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7]"), re.compile(rb"\xff[\xd0-\xd7]")


def read(data: bytes) -> Image:
    """The coefficients of a progressive JPEG, all scans added up."""
    return read_all([data])[0]


def read_all(files: list[bytes]) -> list[Image]:
    """The coefficients of files. First scans of all files are decoded together, then each file's refinements."""
    images, first, later = [], [], []
    for data in files:
        image, scans = _parse(data)
        images.append(image)
        for head, body, tables, restart in scans:
            (later if head[-1] >> 4 else first).append(_Scan(image, head, body, tables, restart))
    decode_first(first)
    for scan in later:
        scan.refine()
    return images


def _parse(data: bytes) -> tuple[Image, list]:
    """A file's frame, and its scans: header, entropy-coded data, the tables and the restart interval that hold there."""
    at, tables, quantisers, image, restart, comment, scans = 2, {}, {}, None, 0, b"", []
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif marker == 0xC2:
            image = _frame(body, quantisers)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables = tables | {(body[0] >> 4, body[0] & 15): huffman(body[1:17], body[17 : 17 + n])}
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            m = _END.search(data, at)
            end = m.start() if m else len(data)
            scans.append((body, data[at:end], tables, restart))
            at = end
    image.comment = comment
    return image, scans


def _frame(body: bytes, quantisers: dict[int, np.ndarray]) -> Image:
    _, height, width, n = struct.unpack(">BHHB", body[:6])
    parts = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
    h, v = max(c.h for c in parts.values()), max(c.v for c in parts.values())
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    for c in parts.values():
        c.wide, c.high = across * c.h, down * c.v
        c.own_wide, c.own_high = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
        c.values = np.zeros((c.wide * c.high, 64), np.int32)
    return Image(width, height, parts, quantisers)


class _Scan:
    """One scan: its components, the order of their blocks, and its entropy-coded segments."""

    def __init__(self, image: Image, head: bytes, data: bytes, tables: dict, restart: int):
        n = head[0]
        self.chosen = [(image.components[head[1 + 2 * i]], head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(n)]
        self.first, self.last, approximation = head[1 + 2 * n : 4 + 2 * n]
        self.high, self.low, self.tables = approximation >> 4, approximation & 15, tables
        c0 = self.chosen[0][0]
        if n > 1:
            self.order = [_interleaved(c.high, c.wide, c.v, c.h) for c, _, _ in self.chosen]
        else:
            self.order = [_alone(c0.own_high, c0.own_wide, c0.wide)]
        units = len(self.order[0])
        parts = _RESTART.split(data) if restart else [data]
        step = restart or units
        self.segments = [(p.replace(b"\xff\x00", b"\xff"), k * step, min(units, (k + 1) * step)) for k, p in enumerate(parts) if k * step < units]

    def refine(self) -> None:
        for data, a, b in self.segments:
            bits = Bits(data)
            if self.first == 0:
                got_all = bits.array((b - a) * sum(o.shape[1] for o in self.order)).reshape(b - a, -1).astype(np.int32) << self.low
                at = 0
                for (c, _, _), o in zip(self.chosen, self.order, strict=True):
                    c.values[o[a:b], 0] |= got_all[:, at : at + o.shape[1]]
                    at += o.shape[1]
            else:
                c, _, t = self.chosen[0]
                _ac_refined(bits, c.values, self.order[0][a:b, 0], self.tables[1, t], self.first, self.last, self.low)


def decode_first(scans: list[_Scan]) -> None:
    """Fills in the coefficients of first scans, all their segments in step."""
    bands, means = [], []
    for scan in scans:
        for data, a, b in scan.segments:
            (bands if scan.first else means).append((scan, data, a, b))
    _in_step(bands, _Bands)
    _in_step(means, _Means)


def _in_step(segments: list, kind: type) -> None:
    if not segments:
        return
    sizes = np.array([len(data) for _, data, _, _ in segments])
    starts = np.cumsum(sizes + 8) - sizes - 8
    raw = np.full(int(starts[-1] + sizes[-1]) + 8, 255, np.uint8)
    for (_, data, _, _), at in zip(segments, starts.tolist(), strict=True):
        raw[at : at + len(data)] = np.frombuffer(data, np.uint8)
    three = raw[:-2].astype(np.int32) << 16 | raw[1:-1].astype(np.int32) << 8 | raw[2:]  # each place's next three bytes
    job = kind(segments)
    at, ends = starts * 8, (starts + sizes) * 8
    while len(at):
        # a place behind the data stays there: each step ends a coefficient, and the end is compared after the last one
        window = three.take(at >> 3, mode="clip") >> (8 - (at & 7)) & 0xFFFF
        if job.table is not None:
            window += job.table
        found = job.fast.take(window)
        used = found & 31
        few = None if used.all() else np.flatnonzero(used == 0)
        more = None
        if few is not None:
            length, symbol = np.divmod(job.next[window[few]], 256)
            if not length.all():
                raise ValueError("no such Huffman code")
            place = at[few] + length
            five = raw.take((place >> 3)[:, None] + np.arange(5), mode="clip").astype(np.int64) @ (1 << np.arange(32, -1, -8))
            bits, more = job.other(symbol, five << (24 + (place & 7)))  # the next 32 bits and more, at the top
            used[few] = length + bits
        at += used
        done = job.take(found, few, more)
        if len(done):
            if (at[done] > ends[done]).any():
                raise ValueError("entropy-coded data ends early")
            stay = np.ones(len(at), bool)
            stay[done] = False
            at, ends = at[stay], ends[stay]
            job.keep(stay)
    job.settle()


class _Job:
    """What the segments of a kind share: where each is, its table, and the numbers that symbols announce.

    Attributes named in STATE have one entry for each segment that is not yet at its end.
    """

    STATE: tuple[str, ...] = ()

    def __init__(self, segments: list, units: list[int]):
        self.segments = segments
        #: Where each segment's part of out begins; the segments of a scan follow one another.
        self.starts = np.concatenate([[0], np.cumsum(units)])

    def tables_of(self, tables: list[Huffman], fast: str) -> np.ndarray:
        """Takes these tables; returns where each one's entries begin."""
        names: dict[int, tuple[int, Huffman]] = {}
        which = [names.setdefault(id(t), (len(names), t))[0] for t in tables]
        self.fast = np.concatenate([getattr(t, fast) for _, t in names.values()])
        self.next = np.concatenate([t.next for _, t in names.values()])
        return np.array(which, np.int32) << 16

    def keep(self, stay: np.ndarray) -> None:
        for name in self.STATE:
            value = getattr(self, name)
            if value is not None:
                setattr(self, name, value[stay])

    def whole(self) -> Iterator[tuple[_Scan, int, int]]:
        """Each scan, and where in out its segments begin and how much they fill."""
        i = 0
        while i < len(self.segments):
            scan = self.segments[i][0]
            n = len(scan.segments)
            yield scan, int(self.starts[i]), int(self.starts[i + n] - self.starts[i])
            i += n

    @staticmethod
    def bits(window: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first size bits of windows."""
        return (window >> 32 & 0xFFFFFFFF) >> (32 - size)

    @classmethod
    def number(cls, window: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The signed number of size bits that a window begins with."""
        value = cls.bits(window, size)
        # window's top bit is the number's first one: numbers that begin with 0 are negative, and none has no value
        return value - np.where((window < 0) | (size == 0), 0, (1 << size) - 1)


class _Bands(_Job):
    """First scans of spectral bands: runs of zeros and sizes, end-of-band runs."""

    STATE = ("k", "block", "stop", "first", "last", "low", "table")

    def __init__(self, segments: list):
        super().__init__(segments, [b - a for _, _, a, b in segments])
        scans = [s for s, _, _, _ in segments]
        self.first, self.last, self.low = (np.array([getattr(s, x) for s in scans], np.int32) for x in ("first", "last", "low"))
        self.table = self.tables_of([s.tables[1, s.chosen[0][2]] for s in scans], "bands")
        if not self.table.any():
            self.table = None
        self.k, self.block, self.stop = self.first.copy(), self.starts[:-1] * 64, self.starts[1:] * 64
        self.out = np.zeros((int(self.starts[-1]) + 1, 64), np.int16)
        self.flat = self.out.reshape(-1)

    def other(self, symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, tuple]:
        """For symbols whose numbers the tables lack: bits behind the symbol; zeros, the number, and blocks that an end-of-band run skips."""
        run, size = symbol >> 4, symbol & 15
        ends = (size == 0) & (run < 15)
        bits = np.where(ends, run, size)
        skipped = np.where(ends, (1 << bits) - 1 + self.bits(window, bits), 0)
        return bits, (np.where(ends, END, run), np.where(ends, 0, self.number(window, size)), skipped)

    def take(self, found: np.ndarray, few: np.ndarray | None, more: tuple | None) -> np.ndarray:
        zeros, value = found >> 8 & 127, found >> 16
        if few is not None:
            zeros[few], value[few], skipped = more
        self.k += zeros
        # where no number is announced, a 0 is written to a place whose turn is still to come
        self.flat[self.block + np.minimum(self.k, 63)] = value << self.low
        over = np.flatnonzero(self.k >= self.last)
        self.k += 1
        if few is not None:
            self.block[few] += 64 * skipped
        k = self.k[over]
        if ((k > self.last[over] + 1) & (k <= END)).any():
            raise ValueError("a run leaves its band")
        self.k[over] = self.first[over]
        block = self.block[over] + 64
        self.block[over] = block
        return over[block >= self.stop[over]]

    def settle(self) -> None:
        for scan, at, n in self.whole():
            part, values = self.out[at : at + n, scan.first : scan.last + 1], scan.chosen[0][0].values
            if n == len(values):
                values[:, scan.first : scan.last + 1] = part
            else:
                values[scan.order[0][:n, 0], scan.first : scan.last + 1] = part


class _Means(_Job):
    """First scans of DC coefficients: differences from the block before, by component."""

    STATE = ("unit", "stop", "place", "each", "row", "table")

    def __init__(self, segments: list):
        scans = [s for s, _, _, _ in segments]
        self.each = np.array([sum(o.shape[1] for o in s.order) for s in scans])
        super().__init__(segments, [(b - a) * n for (_, _, a, b), n in zip(segments, self.each.tolist(), strict=True)])
        self.out = np.zeros(int(self.starts[-1]), np.int32)
        # the table may change from component to component: by place within a unit
        by_place = [[s.tables[0, t] for (_, t, _), o in zip(s.chosen, s.order, strict=True) for _ in range(o.shape[1])] for s in scans]
        widest = max(map(len, by_place))
        self.by_place = self.tables_of([t for row in by_place for t in row + row[:1] * (widest - len(row))], "means").reshape(-1, widest)
        self.row = np.arange(len(segments)) if self.by_place.any() else None
        self.table = None if self.row is None else self.by_place[:, 0]
        self.unit, self.stop, self.place = self.starts[:-1].copy(), self.starts[1:], np.zeros(len(segments), np.int64)

    def other(self, symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if symbol.max() > 16:
            raise ValueError("no such size")
        return symbol, self.number(window, symbol)

    def take(self, found: np.ndarray, few: np.ndarray | None, more: np.ndarray | None) -> np.ndarray:
        value = found >> 16
        if few is not None:
            value[few] = more
        self.out[self.unit] = value
        self.unit += 1
        if self.row is not None:
            self.place = (self.place + 1) % self.each
            self.table = self.by_place[self.row, self.place]
        return np.flatnonzero(self.unit >= self.stop)

    def settle(self) -> None:
        for scan, at, n in self.whole():
            got, k = self.out[at : at + n].reshape(-1, sum(o.shape[1] for o in scan.order)), 0
            cut = [b for _, _, b in scan.segments[:-1]]
            for (c, _, _), o in zip(scan.chosen, scan.order, strict=True):
                part = got[:, k : k + o.shape[1]]
                total = np.cumsum(part.ravel()).reshape(part.shape)
                for a in cut:  # differences start anew at a restart
                    total[a:] -= total[a - 1, -1]
                c.values[o[: len(got)], 0] = total << scan.low
                k += o.shape[1]


#: Blocks of an image whose order is remembered.
SMALL = 4096


def _alone(high: int, wide: int, stride: int) -> np.ndarray:
    """Block numbers of a component in a scan of its own."""
    return (_alone_small if high * wide <= SMALL else _alone_small.__wrapped__)(high, wide, stride)


@lru_cache(1024)
def _alone_small(high: int, wide: int, stride: int) -> np.ndarray:
    return (np.arange(high)[:, None] * stride + np.arange(wide)[None, :]).reshape(-1, 1)


def _interleaved(high: int, wide: int, v: int, h: int) -> np.ndarray:
    """Block numbers of a component by MCU."""
    return (_interleaved_small if high * wide <= SMALL else _interleaved_small.__wrapped__)(high, wide, v, h)


@lru_cache(1024)
def _interleaved_small(high: int, wide: int, v: int, h: int) -> np.ndarray:
    grid = np.arange(high * wide).reshape(high // v, v, wide // h, h)
    return grid.transpose(0, 2, 1, 3).reshape(-1, v * h)


def _ac_refined(bits: Bits, values: np.ndarray, blocks: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    step, at, n = 1 << low, 0, len(blocks)
    while at < n:
        row, k = values[blocks[at]], first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if not size and run < 15:
                many = (1 << run) + bits.take(run)
                if k > first:
                    _correct(bits, row, k, last, step)
                _correct_all(bits, values, blocks[at + (k > first) : at + many], first, last, step)
                at += many - 1
                break
            new = (step if bits.take(1) else -step) if size else 0
            while k <= last:
                if row[k]:
                    if bits.take(1):
                        row[k] += step if row[k] > 0 else -step
                elif run:
                    run -= 1
                else:
                    row[k] = new
                    k += 1
                    break
                k += 1
        at += 1


def _correct(bits: Bits, row: np.ndarray, first: int, last: int, step: int) -> None:
    part = row[first : last + 1]
    where = np.flatnonzero(part)
    part[where] += np.sign(part[where]) * bits.array(len(where)) * step


def _correct_all(bits: Bits, values: np.ndarray, blocks: np.ndarray, first: int, last: int, step: int) -> None:
    if not len(blocks):
        return
    straight = blocks[-1] - blocks[0] == len(blocks) - 1
    part = values[blocks[0] : blocks[-1] + 1, first : last + 1] if straight else values[blocks, first : last + 1]
    sign = np.sign(part)
    if sign.all():
        part += sign * bits.array(part.size).reshape(part.shape) * step
    else:
        some = sign != 0
        part[some] += sign[some] * bits.array(int(some.sum())) * step
    if not straight:
        values[blocks, first : last + 1] = part


def strips(image: Image) -> Iterator[np.ndarray]:
    """The picture as RGB rows, uint8 (rows, width, 3), from the top."""
    parts = list(image.components.values())
    h, v = max(c.h for c in parts), max(c.v for c in parts)
    matrices = [image.quantisers[c.table][:, None] * basis() for c in parts]
    units = parts[0].high // parts[0].v
    some = max(1, STRIP // max(1, parts[0].wide))
    for a in range(0, units, some):
        b = min(units, a + some)
        planes = []
        for c, matrix in zip(parts, matrices, strict=True):
            rows = (b - a) * c.v
            samples = c.values[a * c.v * c.wide : b * c.v * c.wide] @ matrix
            plane = samples.reshape(rows, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, c.wide * 8)
            if c.v < v:
                plane = plane.repeat(v // c.v, axis=0)
            if c.h < h:
                plane = plane.repeat(h // c.h, axis=1)
            planes.append(plane[: image.height - a * v * 8, : image.width])
        yield _rgb(planes)


def _rgb(planes: list[np.ndarray]) -> np.ndarray:
    y = planes[0] + 128
    if len(planes) < 3:
        return np.clip(np.rint(y), 0, 255).astype(np.uint8)[:, :, None].repeat(3, axis=2)
    cb, cr = planes[1], planes[2]
    out = np.empty((*y.shape, 3))
    np.add(y, 1.402 * cr, out=out[:, :, 0])
    np.subtract(y, 0.344136 * cb + 0.714136 * cr, out=out[:, :, 1])
    np.add(y, 1.772 * cb, out=out[:, :, 2])
    np.rint(out, out=out)
    np.clip(out, 0, 255, out=out)
    return out.astype(np.uint8)


def tensor(data: bytes) -> np.ndarray:
    """The full-resolution RGB tensor of a progressive JPEG."""
    return np.concatenate(list(strips(read(data))))


# --- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _entropy(bits: np.ndarray) -> bytes:
    """Bits, filled up with ones, as entropy-coded bytes."""
    spare = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(spare, np.uint8)]) if spare else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _header(n: int, first: int, last: int, high: int, low: int, component: int = 0, tables: int = 0) -> bytes:
    who = bytes([1, 0, 2, 0, 3, 0]) if n == 3 else bytes([component, tables])
    return _segment(0xDA, bytes([n]) + who + bytes([first, last, high << 4 | low]))


def _lengths(weights: dict[int, int]) -> tuple[bytes, bytes]:
    """A Huffman table for symbols by weight: how many codes of each length, and the symbols; no code is all ones."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate({**weights, -1: 0}.items())]  # -1 takes the longest code, which stays unused
    heapify(heap)
    depth = dict.fromkeys([*weights, -1], 0)
    while len(heap) > 1:
        (a, _, x), (b, n, y) = heappop(heap), heappop(heap)
        for s in (*x, *y):
            depth[s] += 1
        heappush(heap, (a + b, n + len(depth), (*x, *y)))
    order = sorted(weights, key=lambda s: (depth[s], s))
    if max(depth.values()) > 16:
        raise ValueError("a code is too long")
    return bytes(sum(depth[s] == n for s in order) for n in range(1, 17)), bytes(order)


#: Weights of DC sizes, of runs of blanks, and of sizes of other bytes, as they occur in texts.
_DC_WEIGHTS = {n: w for n, w in enumerate((4, 4, 6, 10, 16, 24, 30, 24, 4, 1))}
_RUNS, _SIZES = (64, 20, 2, *[1] * 13), (24, 30, 40, 8, 8, 14, 2)
_AC_WEIGHTS = {0x00: 200, 0xF0: 2} | {run << 4 | size: r * s for run, r in enumerate(_RUNS) for size, s in enumerate(_SIZES, 1)}
#: AC table 1 has the end-of-band runs of refinements, 2 ** n blocks each.
_END_RUNS = (bytes([0, 0, 0, 15, *[0] * 12]), bytes(n << 4 for n in range(15)))


@cache
def _tables() -> tuple[Huffman, Huffman, bytes]:
    """The writer's DC and AC tables, and the segment that holds all its tables."""
    dc, ac = _lengths(_DC_WEIGHTS), _lengths(_AC_WEIGHTS)
    body = b"".join(bytes([kind]) + counts + symbols for kind, (counts, symbols) in ((0x00, dc), (0x10, ac), (0x11, _END_RUNS)))
    return huffman(*dc), huffman(*ac), _segment(0xC4, body)


#: A byte's coefficient: blanks are 0, others two more than their distance from "m", with its sign.
_FAR = (np.arange(256) - 0x6D + 128) % 256 - 128
COEFFICIENT = np.where(np.arange(256) == 32, 0, np.where(_FAR >= 0, _FAR + 2, _FAR - 2)).astype(np.int32)
_LEAST = int(COEFFICIENT.min())
#: The byte of a coefficient less the least one; -1 where there is none.
BYTE = np.full(int(COEFFICIENT.max()) - _LEAST + 1, -1, np.int32)
BYTE[COEFFICIENT - _LEAST] = np.arange(256)
#: Restart intervals of first scans: units of DC scans, blocks of others.
RESTART_DC, RESTART = 16, 4


def check_sums(blocks: np.ndarray) -> np.ndarray:
    """The DC coefficient of blocks of bytes: their weighted sum, folded to -128 to 127."""
    return (blocks.astype(np.int64) @ np.arange(1, IN_BLOCK + 1)) % 251 - 125


def _numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of signed numbers, and their bits."""
    size = _BIT_LENGTH[np.abs(values)]
    return size, np.where(values < 0, values + (1 << size) - 1, values).astype(np.int32)


_BIT_LENGTH = np.array([i.bit_length() for i in range(2048)], np.int32)


def _packed(codes: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Codes of so many bits, one behind the other, as entropy-coded segments that begin at the given items."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.append(starts[1:], len(sizes))
    length = total[ends] - total[starts]
    spare = -length % 8  # filled with ones
    sizes, codes = np.insert(sizes.astype(np.uint8), ends, spare), np.insert(codes, ends, (1 << spare) - 1)
    aligned = (codes.astype(np.uint32) << (32 - np.maximum(sizes, 1)).astype(np.uint32)).astype(">u4").view(np.uint8).reshape(-1, 4)
    some = 1 << 15
    bits = [np.unpackbits(aligned[at : at + some], axis=1)[_COLUMNS < sizes[at : at + some, None]] for at in range(0, len(sizes), some)]
    raw, cut = np.packbits(np.concatenate(bits)).tobytes(), np.concatenate([[0], np.cumsum(length + spare) // 8]).tolist()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(cut, cut[1:], strict=False)]


_COLUMNS = np.arange(32, dtype=np.uint8)
_MARKS = [bytes((0xFF, 0xD0 + k)) for k in range(8)]


def _marked(segments: list[bytes]) -> bytes:
    """Segments of a scan, parted by restart markers."""
    out = [segments[0]]
    for k, x in enumerate(segments[1:]):
        out += (_MARKS[k % 8], x)
    return b"".join(out)


def _grouped(segments: list[bytes], counts: list[int]) -> list[bytes]:
    """The scans of files that have so many segments each."""
    out, at = [], 0
    for n in counts:
        out.append(_marked(segments[at : at + n]))
        at += n
    return out


def _steps(sizes: list[int], step: int) -> tuple[np.ndarray, list[int]]:
    """Where segments of step begin, for files of so many units one behind the other; and how many each file has."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate([np.arange(a, b, step) for a, b in zip(at, at[1:], strict=False)]), [-(-n // step) for n in sizes]


def _dc_scans(parts: list[np.ndarray], order: list[np.ndarray], units: list[int]) -> list[bytes]:
    """DC differences of interleaved units, cut at restart intervals. parts have the components' DC values by block."""
    table, (starts, counts), columns = _tables()[0], _steps(units, RESTART_DC), []
    for values, o in zip(parts, order, strict=True):
        rows = values[o]  # by unit
        before = np.concatenate([[0], rows.ravel()[:-1]]).reshape(rows.shape)
        before[starts, 0] = 0
        columns.append(rows - before)
    size, bits = _numbers(np.concatenate(columns, axis=1).ravel())
    each = sum(o.shape[1] for o in order)
    return _grouped(_packed(table.code[size] << size | bits, table.size[size] + size, starts * each), counts)


def _band_scans(values: np.ndarray, blocks: list[int]) -> list[bytes]:
    """First scans of a band: blocks by coefficients, without their lowest bits, of files of so many blocks."""
    table, (n, wide) = _tables()[1], values.shape
    block, k = np.nonzero(values)
    before = np.concatenate([[-1], k[:-1]])[: len(k)]
    before[np.flatnonzero(np.diff(block, prepend=-1))] = -1
    run = k - before - 1
    size, bits = _numbers(values[block, k])
    symbol = (run % 16) << 4 | size
    last = np.full(n, -1)
    last[block] = k  # the last one of each block stays
    short = np.flatnonzero(last < wide - 1)
    code, sizes, owner = table.code[symbol] << size | bits, table.size[symbol] + size, block
    many = run // 16
    if many.any() or len(short):
        # besides the coefficients, the long runs before them and the ends of blocks, put in order
        long = np.repeat(np.arange(len(k)), many)
        key = np.concatenate([block * 128 + 2 * k + 1, block[long] * 128 + 2 * k[long], short * 128 + 127])
        at = np.argsort(key, kind="stable")
        code = np.concatenate([code, np.full(len(long), table.code[0xF0]), np.full(len(short), table.code[0])])[at]
        sizes = np.concatenate([sizes, np.full(len(long), table.size[0xF0]), np.full(len(short), table.size[0])])[at]
        owner = key[at] >> 7
    starts, counts = _steps(blocks, RESTART)
    return _grouped(_packed(code, sizes, np.searchsorted(owner, starts)), counts)


def _refinements(corrections: np.ndarray, known: np.ndarray, blocks: list[int]) -> list[bytes]:
    """Refinement scans without new coefficients: end-of-band runs, each with its blocks' corrections of known ones."""
    bits = corrections[known].astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(known.sum(1))])
    out, first, most = [], 0, (1 << 15) - 1
    for n in blocks:
        parts = []
        for at in range(first, first + n, most):
            run = min(most, first + n - at)
            parts += [_run_head(run), bits[ends[at] : ends[at + run]]]
        out.append(_entropy(np.concatenate(parts)))
        first += n
    return out


@lru_cache(4096)
def _run_head(run: int) -> np.ndarray:
    size = run.bit_length() - 1
    return np.array(list(map(int, f"{size:04b}" + (f"{run - (1 << size):0{size}b}" if size else ""))), np.uint8)


def _interval(n: int) -> bytes:
    return _segment(0xDD, struct.pack(">H", n))


def write(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients hold the payload, a multiple of UNIT bytes."""
    return write_all([payload])[0]


def write_all(payloads: list[bytes]) -> list[bytes]:
    """The files of payloads; the same work is done for all of them at once."""
    sides, parts = [], ([], [], [])
    for payload in payloads:
        if not payload or len(payload) % UNIT:
            raise ValueError(f"a payload has a positive multiple of {UNIT} bytes")
        units = len(payload) // IN_MCU
        across = math.isqrt(units - 1) + 1
        down = -(-units // across)
        if across > MOST:
            raise ValueError("the payload is too long for one image")
        data = np.full(across * down * IN_MCU, 255, np.uint8)
        data[: len(payload)] = np.frombuffer(payload, np.uint8)
        # by component, the blocks in raster order
        mcus = data.reshape(down, across, 6, IN_BLOCK)
        parts[0].append(mcus[:, :, :4].reshape(down, across, 2, 2, IN_BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, IN_BLOCK))
        parts[1].append(mcus[:, :, 4].reshape(-1, IN_BLOCK))
        parts[2].append(mcus[:, :, 5].reshape(-1, IN_BLOCK))
        sides.append((down, across))
    parts = [np.concatenate(p) for p in parts]
    units = [down * across for down, across in sides]
    at = np.concatenate([[0], np.cumsum(units)])
    chroma = np.arange(at[-1]).reshape(-1, 1)
    order = [np.concatenate([_interleaved(2 * d, 2 * a, 2, 2) + 4 * b for (d, a), b in zip(sides, at.tolist(), strict=False)]), chroma, chroma]
    sums = [check_sums(p) for p in parts]
    low_bits = np.concatenate([(s & 1)[o] for s, o in zip(sums, order, strict=True)], axis=1).astype(np.uint8)
    scans = [[_header(3, 0, 0, 0, 1), x, _interval(0), _header(3, 0, 0, 1, 0)] for x in _dc_scans([s >> 1 for s in sums], order, units)]
    for scan, a, b in zip(scans, at.tolist(), at.tolist()[1:], strict=False):
        scan += (_entropy(low_bits[a:b].ravel()), _interval(RESTART))
    blocks = [[4 * n for n in units], units, units]
    values = [COEFFICIENT[p] for p in parts]
    for k, (v, n) in enumerate(zip(values, blocks, strict=True), 1):
        upper = np.sign(v) * (np.abs(v) >> LOW)
        for first, last in BANDS:
            head = _header(1, first, last, 0, LOW, k, 0)
            for scan, x in zip(scans, _band_scans(upper[:, first - 1 : last], n), strict=True):
                scan += (head, x)
    for scan in scans:
        scan.append(_interval(0))
    for k, (v, n) in enumerate(zip(values, blocks, strict=True), 1):
        for low in range(LOW - 1, -1, -1):
            head = _header(1, 1, IN_BLOCK, low + 1, low, k, 1)
            for scan, x in zip(scans, _refinements(np.abs(v) >> low & 1, v != 0, n), strict=True):
                scan += (head, x)
    start = b"\xff\xd8" + _segment(0xDB, bytes([0, *[1] * 64])) + _tables()[2]
    out = []
    for payload, (down, across), scan in zip(payloads, sides, scans, strict=True):
        frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        out.append(b"".join([start, _segment(0xFE, str(len(payload)).encode()), _segment(0xC2, frame), _interval(RESTART_DC), *scan, b"\xff\xd9"]))
    return out


def payload_of(image: Image) -> bytes:
    """The bytes that write() stored; an error if a block's check sum differs."""
    luma, blue, red = [c.values for c in image.components.values()]
    c = image.components[1]
    down, across = c.high // 2, c.wide // 2
    data = np.empty((down, across, 6, 64), np.int32)
    data[:, :, :4] = luma.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    data[:, :, 4], data[:, :, 5] = blue.reshape(down, across, 64), red.reshape(down, across, 64)
    blocks = data.reshape(-1, 64)
    found = BYTE[np.clip(blocks[:, 1 : IN_BLOCK + 1] - _LEAST, 0, len(BYTE) - 1)]
    if (found < 0).any() or (check_sums(found) != blocks[:, 0]).any():
        raise ValueError("a block's check sum differs")
    return found.astype(np.uint8).tobytes()[: int(image.comment)]


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


# --- columns


#: Characters of texts that are written together, and bytes of files that are read together.
WRITTEN, READ = 1 << 17, 1 << 20


def to_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, n_bytes, media: the text's UTF-8 payload as a progressive JPEG."""

    def many(texts: list) -> list[tuple]:
        raw = [(x or "").encode() for x in texts]
        return list(zip(map(len, raw), write_all([padded(x) for x in raw]), strict=True))

    return map_slices(docs, text, list(keep), lambda: many, "n_bytes long, media binary", WRITTEN)


def to_tensors(media: DataFrame, column: str = "media", keep: tuple[str, ...] | None = None) -> DataFrame:
    """keep's columns (all, if none are named) and of each progressive JPEG height, width, rgb (row-major uint8, height x width x 3) and feature; null stays null."""

    def many(files: list) -> list[tuple]:
        images = iter(read_all([bytes(x) for x in files if x is not None]))
        return [(None,) * 4 if x is None else _tensor_row(next(images)) for x in files]

    return map_slices(media, column, list(media.columns if keep is None else keep), lambda: many, "height int, width int, rgb binary, feature string", READ)


def _tensor_row(image: Image) -> tuple:
    rgb = np.concatenate(list(strips(image)))
    return rgb.shape[0], rgb.shape[1], rgb.tobytes(), feature_of(rgb)


def feature_of(rgb: np.ndarray) -> str:
    """Size, channel means and standard deviations of an RGB tensor, from the counts of its values."""
    flat = rgb.reshape(-1, 3)
    counts, values = np.stack([np.bincount(flat[:, k], minlength=256) for k in range(3)]), np.arange(256)
    mean = counts @ values / len(flat)
    spread = np.sqrt(np.maximum(counts @ (values * values) / len(flat) - mean**2, 0))
    return f"{rgb.shape[1]}x{rgb.shape[0]} mean {' '.join(f'{x:.3f}' for x in mean)} std {' '.join(f'{x:.3f}' for x in spread)}"


def from_media(media: DataFrame, column: str = "media", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Like to_tensors, with payload: the bytes that to_media stored."""

    def many(files: list) -> list[tuple]:
        images = iter(read_all([bytes(x) for x in files if x is not None]))
        return [(None,) * 5 if x is None else (payload_of(image := next(images)), *_tensor_row(image)) for x in files]

    return map_slices(media, column, list(media.columns if keep is None else keep), lambda: many, "payload binary, height int, width int, rgb binary, feature string", READ)


def media_digest(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stores each text as a media column, reads it back, and returns hashes of payload, file and tensor, and the tensor's feature."""
    stored = materialize(to_media(docs, text, keep))
    stored = stored.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    back = from_media(stored, "media", (*keep, "n_bytes", "media_bytes", "media_sha256"))
    return back.select(
        *keep, "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature", "height", "width", F.length("rgb").cast("long").alias("rgb_bytes"), F.sha2("rgb", 256).alias("rgb_sha256"),
    )
