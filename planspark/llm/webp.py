"""Lossless WebP as a store of 8-bit samples: a complete VP8L reader, and a writer that picks the shortest of four forms.

The reader decodes prefix codes (simple, normal and meta codes), back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. The writer stores an image as literals under one fixed
prefix code; where runs of pixels come again it also tries back-references with a colour cache under the image's own
codes, with and without the predictor transform (the pixel above), and for few colours the palette transform; the
shortest file is kept. Literal images share a prefix code and are decoded together, all of them stepping along pixel by
pixel with one table; all other images go through the general reader one by one.
A payload is laid out as RGBA pixels, sixteen to a row, in images of at most ``ROWS`` rows whose files follow each other,
so memory stays bounded for any length.

Edge cases: a null text is stored as an empty one, which still has one block of zero bytes. Equal texts give equal media.
Very long texts become many images. Broken or truncated files raise ``ValueError``. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from functools import cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

BLOCK, WIDTH, ROWS = 64, 16, 512
#: Longest code of the writer's fixed code; four of them fit one 64-bit read.
MAX_CODE = 12
#: Bits of the writer's colour cache, pixels from which a repetition is referred to, and the share of pixels that must
#: stand in repetitions before references are tried.
CACHE_BITS, LEAST_COPY, REPEATED = 6, 3, 0.15
# Orders and tables of the lossless WebP format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_COLOR_MULTIPLIER = 0x1E35A7BD


class Bits:
    """Reads little-endian bits."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the file ends early")
        first = self.at >> 3
        value = int.from_bytes(self.data[first : (self.at + n + 7) >> 3], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


class Code:
    """A canonical prefix code: codes by symbol, and a walk by length for reading."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.single = used[0][1] if len(used) == 1 else None
        if not used:
            raise ValueError("a prefix code without symbols")
        used.sort()
        self.codes: dict[int, tuple[int, int]] = {}  # symbol: (code, first bit highest; length)
        self.symbols: dict[tuple[int, int], int] = {}
        code, before = 0, used[0][0]
        for n, s in used:
            code <<= n - before
            before = n
            self.codes[s], self.symbols[n, code] = (code, n), s
            code += 1
        if self.single is None and code != 1 << before:
            raise ValueError("a prefix code that is not complete")

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        code = n = 0
        while True:
            code, n = code << 1 | bits.take(1), n + 1
            s = self.symbols.get((n, code))
            if s is not None:
                return s
            if n > 15:
                raise ValueError("no such code")

    def table(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for every next ``width`` bits."""
        symbols, sizes = np.zeros(1 << width, np.int64), np.zeros(1 << width, np.int64)
        if self.single is not None:
            symbols[:] = self.single
            return symbols, sizes
        for s, (code, n) in self.codes.items():
            turned = int(f"{code:0{n}b}"[::-1], 2)
            symbols[turned :: 1 << n] = s
            sizes[turned :: 1 << n] = n
        return symbols, sizes


def read_code(bits: Bits, size: int) -> Code:
    if bits.take(1):
        both, wide = bits.take(1), bits.take(1)
        symbols = [bits.take(8 if wide else 1)] + ([bits.take(8)] if both else [])
        lengths = [0] * max(size, max(symbols) + 1)
        for s in symbols:
            lengths[s] = 1
        return Code(lengths)
    first = [0] * 19
    for k in range(bits.take(4) + 4):
        first[CODE_LENGTH_ORDER[k]] = bits.take(3)
    meta = Code(first)
    left = size
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
    lengths, last = [], 8
    while len(lengths) < size and left:
        left -= 1
        s = meta.read(bits)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + bits.take(2))
        else:
            lengths += [0] * (3 + bits.take(3) if s == 17 else 11 + bits.take(7))
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    return Code(lengths + [0] * (size - len(lengths)))


def _extended(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Entropy-coded ARGB pixels (uint32) of an image or of a transform's data."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache of a wrong size")
    groups, tiles, tile_bits, across = 1, None, 0, 0
    if top and bits.take(1):
        tile_bits = bits.take(3) + 2
        across = (width + (1 << tile_bits) - 1) >> tile_bits
        down = (height + (1 << tile_bits) - 1) >> tile_bits
        tiles = (read_pixels(bits, across, down, False) >> 8) & 0xFFFF
        groups = int(tiles.max()) + 1
    cached = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, n) for n in (256 + 24 + cached, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    out = [0] * total
    kept = [0] * cached
    shift = 32 - cache_bits
    at = fresh = 0
    while at < total:
        group = codes[int(tiles[(at // width >> tile_bits) * across + (at % width >> tile_bits)])] if tiles is not None else codes[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _extended(bits, s - 256)
            code = _extended(bits, group[4].read(bits))
            if code > 120:
                back = code - 120
            else:
                dx, dy = DISTANCES[code - 1]
                back = max(1, dx + dy * width)
            if back > at or at + length > total:
                raise ValueError("a reference outside the image")
            for _ in range(length):
                out[at] = out[at - back]
                at += 1
        else:
            while fresh < at:
                kept[(out[fresh] * _COLOR_MULTIPLIER & 0xFFFFFFFF) >> shift] = out[fresh]
                fresh += 1
            out[at] = kept[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _split(p: np.ndarray) -> np.ndarray:
    return np.stack([(p >> s) & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 0xFF
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _average(a: tuple, b: tuple) -> tuple:
    return tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))


def _select(left: tuple, top: tuple, corner: tuple) -> tuple:
    to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
    to_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
    return left if to_left < to_top else top


def _clamp(x: int) -> int:
    return min(255, max(0, x))


def _predict(mode: int, left: tuple, top: tuple, right: tuple, corner: tuple) -> tuple:
    """Prediction from the left, top, top-right and top-left pixels."""
    if mode == 0 or mode > 13:
        return (255, 0, 0, 0)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode < 8:
        return _average(left, corner if mode == 6 else top)
    if mode < 10:
        return _average(top, corner if mode == 8 else right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return tuple(_clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True))
    mean = _average(left, top)
    return tuple(_clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True))


def invert_predictor(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    across = (width + (1 << bits) - 1) >> bits
    residual = _split(pixels).tolist()
    out: list[tuple] = []
    for i, r in enumerate(residual):
        y, x = divmod(i, width)
        if i == 0:
            guess = (255, 0, 0, 0)
        elif y == 0:
            guess = out[i - 1]
        elif x == 0:
            guess = out[i - width]
        else:
            mode = int(modes[(y >> bits) * across + (x >> bits)] >> 8) & 15
            guess = _predict(mode, out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
        out.append(tuple((a + b) & 0xFF for a, b in zip(r, guess, strict=True)))
    return _join(np.array(out, np.int64).reshape(-1, 4))


def invert_cross_color(pixels: np.ndarray, width: int, height: int, bits: int, data: np.ndarray) -> np.ndarray:
    across = (width + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(width * height), width)
    tile = _split(data[(y >> bits) * across + (x >> bits)]).astype(np.uint8).view(np.int8).astype(np.int64)
    red_to_blue, green_to_blue, green_to_red = tile[:, 1], tile[:, 2], tile[:, 3]
    c = _split(pixels)
    signed = lambda v: (v & 0xFF).astype(np.uint8).view(np.int8).astype(np.int64)
    green = signed(c[:, 2])
    c[:, 1] = (c[:, 1] + (green_to_red * green >> 5)) & 0xFF
    c[:, 3] = (c[:, 3] + (green_to_blue * green >> 5) + (red_to_blue * signed(c[:, 1]) >> 5)) & 0xFF
    return _join(c)


def invert_palette(pixels: np.ndarray, width: int, height: int, packed: int, palette: np.ndarray) -> np.ndarray:
    index = (pixels >> 8) & 0xFF
    if packed:
        per, size = 1 << packed, 8 >> packed
        row = (width + per - 1) // per
        x = np.arange(width)
        index = (index.reshape(height, row)[:, x // per] >> ((x % per) * size).astype(np.uint32)) & ((1 << size) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index.reshape(-1)]


def _chunk(data: bytes, at: int) -> tuple[bytes, int]:
    """The VP8L bitstream of the file at an offset, and where the file ends."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
        raise ValueError("not a WebP file")
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if end > len(data):
        raise ValueError("the file ends early")
    k = at + 12
    while k + 8 <= end:
        size = int.from_bytes(data[k + 4 : k + 8], "little")
        if data[k : k + 4] == b"VP8L":
            return data[k + 8 : k + 8 + size], end
        k += 8 + size + size % 2
    raise ValueError("no lossless image")


def _header(bits: Bits) -> tuple[int, int]:
    if bits.take(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    return width, height


def decode_argb(stream: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB pixels of any lossless bitstream."""
    bits = Bits(stream)
    width, height = _header(bits)
    steps, inner = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind < 2:
            size = bits.take(3) + 2
            side = [(n + (1 << size) - 1) >> size for n in (inner, height)]
            steps.append((kind, inner, size, read_pixels(bits, *side, False)))
        elif kind == 2:
            steps.append((kind, inner, 0, None))
        else:
            n = bits.take(8) + 1
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            palette = _join(np.cumsum(_split(read_pixels(bits, n, 1, False)), 0))
            steps.append((kind, inner, packed, palette))
            inner = (inner + (1 << packed) - 1) >> packed
    pixels = read_pixels(bits, inner, height, True)
    for kind, w, size, data in reversed(steps):
        if kind == 0:
            pixels = invert_predictor(pixels, w, height, size, data)
        elif kind == 1:
            pixels = invert_cross_color(pixels, w, height, size, data)
        elif kind == 2:
            c = _split(pixels)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            pixels = _join(c)
        else:
            pixels = invert_palette(pixels, w, height, size, data)
    return width, height, pixels


def samples(argb: np.ndarray) -> bytes:
    """RGBA bytes."""
    return (argb << np.uint32(8) | argb >> np.uint32(24)).astype(">u4").tobytes()


def huffman_lengths(weights: list[float], longest: int) -> list[int]:
    """Lengths of a complete prefix code for all symbols with a weight; weights are levelled until it is short enough."""
    while True:
        heap = [(w, i, (i,)) for i, w in enumerate(weights) if w > 0]
        heapq.heapify(heap)
        lengths, made = [0] * len(weights), len(weights)
        while len(heap) > 1:
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            for s in left + right:
                lengths[s] += 1
            heapq.heappush(heap, (a + b, made := made + 1, left + right))
        if max(lengths) <= longest:
            return lengths
        weights = [w and w**0.8 for w in weights]


class BitWriter:
    def __init__(self):
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def put_code(self, code: Code, symbol: int) -> None:
        if code.single is None:
            bits, n = code.codes[symbol]
            self.put(int(f"{bits:0{n}b}"[::-1], 2), n)

    def put_lengths(self, lengths: list[int]) -> None:
        """A normal prefix code; zero runs are shortened."""
        items, k = [], 0
        while k < len(lengths):
            run = 1
            while k + run < len(lengths) and not lengths[k] and not lengths[k + run] and run < 138:
                run += 1
            if run >= 11:
                items.append((18, run - 11, 7))
            elif run >= 3:
                items.append((17, run - 3, 3))
            else:
                items += [(lengths[k], 0, 0)] * run
            k += run
        counts = [0] * 19
        for s, _, _ in items:
            counts[s] += 1
        if sum(c > 0 for c in counts) == 1:
            counts[1 if not counts[1] else 0] += 1
        own = huffman_lengths(counts, 7)
        meta = Code(own)
        self.put(0, 1)
        self.put(15, 4)
        for s in CODE_LENGTH_ORDER:
            self.put(own[s], 3)
        self.put(0, 1)
        for s, extra, n in items:
            self.put_code(meta, s)
            self.put(extra, n)

    def put_any(self, lengths: list[int]) -> None:
        """The shortest way to write a code: a lone symbol (or none) is a simple code."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) > 1 or (used and used[0] > 255):
            self.put_lengths(lengths)
        else:
            self.put_single(used[0] if used else 0)

    def put_single(self, symbol: int) -> None:
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)


@cache
def text_code() -> tuple[Code, np.ndarray, np.ndarray]:
    """The writer's code for bytes of text: symbol codes (first bit lowest) and lengths; all 256 bytes have one."""
    weight = [0.2] * 32 + [3.0] * 96 + [2.0] * 128
    for letters, w in ((b" ", 180), (b"e", 100), (b"nirtaosh", 60), (b"dlucmpbgqv", 25), (b"fjkwxyz", 8), (b".,\n", 10), (b"\xc3", 40)):
        for b in letters:
            weight[b] = w
    code = Code(huffman_lengths(weight, MAX_CODE))
    turned = np.array([int(f"{c:0{n}b}"[::-1], 2) for c, n in (code.codes[s] for s in range(256))], np.uint64)
    return code, turned, np.array(code.lengths, np.int64)


@cache
def _prefix(height: int) -> tuple[int, int]:
    """The bits of an image before its pixels."""
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(WIDTH - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)  # alpha is used
    w.put(0, 3)
    w.put(0, 1)  # no transform
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # no meta codes
    lengths = text_code()[0].lengths
    w.put_lengths(lengths + [0] * 24)
    for _ in range(3):
        w.put_lengths(lengths)
    w.put_single(0)
    return w.value, w.size


def _packed(head: int, size: int, word: np.ndarray, n: np.ndarray) -> bytes:
    """Bits of a head, then words of up to 64 bits one after another."""
    start = size + np.cumsum(n) - n
    total = int(start[-1] + n[-1])
    cell, shift = start >> 6, (start & 63).astype(np.uint64)
    out = np.zeros((total >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    out[cell[first]] |= np.bitwise_or.reduceat(word << shift, first)
    high = np.where(shift > 0, word >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    out[cell[first] + 1] |= np.bitwise_or.reduceat(high, first)
    return (out | np.frombuffer(head.to_bytes(8 * len(out), "little"), np.uint64)).tobytes()[: (total + 7) >> 3]


def _literals(rgba: np.ndarray) -> bytes:
    """Bitstream of one image under the fixed code: the pixels' codes are put together as 64-bit words."""
    _, codes, lengths = text_code()
    order = rgba.reshape(-1, 4)[:, [1, 0, 2, 3]]  # green, red, blue, alpha
    word, n = np.zeros(len(order), np.uint64), np.zeros(len(order), np.int64)
    for k in range(4):
        word |= codes[order[:, k]] << n.astype(np.uint64)
        n += lengths[order[:, k]]
    return _packed(*_prefix(len(rgba) // (4 * WIDTH)), word, n)


def _open(height: int) -> BitWriter:
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(WIDTH - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)  # alpha is used
    w.put(0, 3)
    return w


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    extra = top - 1
    return 2 * top + ((value - 1) >> extra & 1), (value - 1) & ((1 << extra) - 1), extra


def _runs_ahead(p: np.ndarray) -> np.ndarray:
    """For each pixel the last earlier place from which ``LEAST_COPY`` equal pixels go on, or -1."""
    before = np.full(len(p), -1, np.int64)
    if len(p) > LEAST_COPY:
        wide = p.astype(np.uint64)
        key = wide[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ wide[2:] * np.uint64(0x165667B19E3779F9)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
    return before


def _tokens(p: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, value, distance): literals (0, pixel), copies (1, length, distance) and cached colours (2, slot)."""
    pixels, slots = p.tolist(), ((p.astype(np.uint64) * _COLOR_MULTIPLIER & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).tolist()
    kept: list[int] = [0] * (1 << CACHE_BITS)
    out, at, fresh, end = [], 0, 0, len(pixels)
    while at < end:
        source = int(before[at])
        length = 0
        if source >= 0:
            stop = min(end - at, 4096)
            differ = np.flatnonzero(p[at : at + stop] != p[source : source + stop])
            length = int(differ[0]) if len(differ) else stop
        while fresh < at:
            kept[slots[fresh]] = pixels[fresh]
            fresh += 1
        if length >= LEAST_COPY:
            out.append((1, length, at - source))
            at += length
        else:
            out.append((2, slots[at], 0) if kept[slots[at]] == pixels[at] else (0, pixels[at], 0))
            at += 1
    return out


def _put_pixels(w: BitWriter, p: np.ndarray, before: np.ndarray) -> bytes:
    """The stream of a top image: references and cache, under codes made for it."""
    tokens = _tokens(p, before)
    sizes = (256 + 24 + (1 << CACHE_BITS), 256, 256, 256, 40)
    counts = [np.zeros(n, np.int64) for n in sizes]
    items: list[list[tuple[int, int, int, int]]] = []  # by token: (code, symbol, extra bits, their number)
    for kind, value, distance in tokens:
        if kind == 0:
            own = [(0, value >> 8 & 255, 0, 0), (1, value >> 16 & 255, 0, 0), (2, value & 255, 0, 0), (3, value >> 24, 0, 0)]
        elif kind == 1:
            symbol, extra, n = _prefix_of(value)
            far, more, m = _prefix_of(distance + 120)
            own = [(0, 256 + symbol, extra, n), (4, far, more, m)]
        else:
            own = [(0, 280 + value, 0, 0)]
        for code, symbol, _, _ in own:
            counts[code][symbol] += 1
        items.append(own)
    w.put(1, 1)  # a colour cache
    w.put(CACHE_BITS, 4)
    w.put(0, 1)  # no meta codes
    codes = []
    for n in counts:
        lengths = huffman_lengths(n.tolist(), 15) if (n > 0).sum() > 1 else (n > 0).astype(int).tolist()
        w.put_any(lengths)
        codes.append(Code(lengths) if any(lengths) else None)
    words, n = [], []
    for own in items:
        value = size = 0
        for code, symbol, extra, m in own:
            if codes[code].single is None:
                bits, length = codes[code].codes[symbol]
                value |= int(f"{bits:0{length}b}"[::-1], 2) << size
                size += length
            value |= extra << size
            size += m
        words.append(value)
        n.append(size)
    return _packed(w.value, w.size, np.array(words, np.uint64), np.array(n, np.int64))


def _references(p: np.ndarray, height: int) -> list[bytes]:
    """Streams with references, of the pixels and of their differences from the pixel above, if enough comes again."""
    found = []
    before = _runs_ahead(p)
    if (before >= 0).mean() > REPEATED:
        w = _open(height)
        w.put(0, 1)  # no transform
        found.append(_put_pixels(w, p, before))
        c = _split(p)
        guess = np.concatenate([[[255, 0, 0, 0]], c[: WIDTH - 1], c[:-WIDTH]])[: len(c)]
        rest = _join(c - guess)
        w = _open(height)
        w.put(1, 1)
        w.put(0, 2)  # predictor
        w.put(7, 3)  # tiles of 512 pixels: one a file
        w.put(0, 1)
        for s in (2, 0, 0, 255):  # mode 2: the pixel above
            w.put_single(s)
        w.put_single(0)
        w.put(0, 1)  # no further transform
        found.append(_put_pixels(w, rest, _runs_ahead(rest)))
    return found


def _palette(p: np.ndarray, height: int) -> list[bytes]:
    """A stream of palette indices, several to a pixel, if there are few colours."""
    colours, index = np.unique(p, return_inverse=True)
    if len(colours) > 16:
        return []
    w = _open(height)
    w.put(1, 1)
    w.put(3, 2)  # palette
    w.put(len(colours) - 1, 8)
    w.put(0, 1)
    steps = _split(colours)
    steps[1:] = (steps[1:] - steps[:-1]) & 255
    codes = []
    for channel in (2, 1, 3, 0):
        n = np.bincount(steps[:, channel], minlength=280 if channel == 2 else 256)
        lengths = huffman_lengths(n.tolist(), 15) if (n > 0).sum() > 1 else (n > 0).astype(int).tolist()
        w.put_any(lengths)
        codes.append((channel, Code(lengths)))
    w.put_single(0)
    for row in steps.tolist():
        for channel, code in codes:
            w.put_code(code, row[channel])
    w.put(0, 1)  # no further transform
    packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
    per, size = 1 << packed, 8 >> packed
    shared_ = (index.reshape(height, WIDTH // per, per) << (np.arange(per) * size)).sum(2).reshape(-1)
    small = (shared_.astype(np.uint32)) << np.uint32(8)
    return [_put_pixels(w, small, _runs_ahead(small))]


def _write_stream(rgba: np.ndarray) -> bytes:
    """The shortest bitstream of one image of sixteen pixels a row."""
    height = len(rgba) // (4 * WIDTH)
    c = rgba.reshape(-1, 4).astype(np.uint32)
    p = c[:, 3] << 24 | c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]
    return min([_literals(rgba), *_references(p, height), *_palette(p, height)], key=len)


def write(payload: bytes) -> bytes:
    """Files of all images of a payload, one after another."""
    data = np.frombuffer(payload, np.uint8)
    parts = []
    for at in range(0, len(data), 4 * WIDTH * ROWS):
        stream = _write_stream(data[at : at + 4 * WIDTH * ROWS])
        pad = len(stream) % 2
        parts.append(b"RIFF" + (12 + len(stream) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * pad)
    return b"".join(parts)


_codes_seen: dict[tuple, tuple | None] = {}


def _plain_codes(stream: bytes) -> tuple | None:
    """(bits before the pixels, tables) of an image without transforms, cache, meta codes or references, else None.

    What stands before the pixels is parsed once for each distinct run of bits.
    """
    value, size = _prefix(1)
    head = int.from_bytes(stream[: (size + 7) >> 3], "little") & ((1 << size) - 1)
    key = head >> 36
    if key not in _codes_seen:
        if len(_codes_seen) > 64:
            _codes_seen.clear()
        found = None
        try:
            bits = Bits(stream)
            _header(bits)
            if bits.take(3) == 0:
                codes = [read_code(bits, n) for n in (280, 256, 256, 256, 40)]
                if bits.at == size and not any(codes[0].lengths[256:]) and max(max(c.lengths) for c in codes[:4]) <= MAX_CODE and all(c.single is None for c in codes[:4]):
                    found = size, [c.table(MAX_CODE) for c in codes[:4]]
        except ValueError:
            found = None
        _codes_seen[key] = found
    return _codes_seen[key]


def _together(streams: list[bytes], sizes: list[int], start: int, tables: list) -> list[np.ndarray]:
    """ARGB pixels of images that share their codes; the largest come first, so finished ones drop out at the end."""
    order = sorted(range(len(streams)), key=lambda i: -sizes[i])
    counts = np.array([sizes[i] for i in order])
    blob = b"".join([streams[i] + b"\0" * 8 for i in order])
    raw = np.frombuffer(blob, np.uint8)
    ends = np.cumsum([len(streams[i]) + 8 for i in order])
    at = (np.concatenate([[0], ends[:-1]]) * 8 + start).astype(np.int64)
    words = np.ndarray((len(raw) - 7,), "<u8", blob, strides=(1,))
    out = np.zeros((int(counts[0]), len(order)), np.uint32)
    mask = np.uint64((1 << MAX_CODE) - 1)
    packed = [(symbols << s).astype(np.uint32) for (symbols, _), s in zip(tables, (8, 16, 0, 24), strict=True)]
    lengths = [n.astype(np.uint64) for _, n in tables]
    live = len(order)
    for k in range(int(counts[0])):
        while counts[live - 1] <= k:
            live -= 1
        here = at[:live]
        w = words[here >> 3] >> (here & 7).astype(np.uint64)
        used = np.zeros(live, np.uint64)
        pixel = out[k, :live]
        for p, n in zip(packed, lengths, strict=True):
            peek = w & mask
            pixel |= p[peek]
            step = n[peek]
            w >>= step
            used += step
        here += used.astype(np.int64)
    if np.any(at > (ends - 8) * 8):
        raise ValueError("the file ends early")
    found: list = [None] * len(order)
    for j, i in enumerate(order):
        found[i] = out[: sizes[i], j].copy()
    return found


def read_many(media: list[bytes]) -> list[tuple[bytes, int, int]]:
    """(payload, images, rows) of each medium."""
    pieces: list[list] = []
    waiting: dict[int, tuple[tuple, list]] = {}
    for m, data in enumerate(media):
        own, at = [], 0
        while at < len(data):
            stream, at = _chunk(data, at)
            plain = _plain_codes(stream)
            if plain is None:
                w, h, pixels = decode_argb(stream)
                own.append([pixels, h])
            else:
                w, h = _header(Bits(stream))
                own.append([None, h])
                waiting.setdefault(id(plain), (plain, []))[1].append((m, len(own) - 1, stream, w * h))
        pieces.append(own)
    for (start, tables), todo in waiting.values():
        for (m, k, _, _), pixels in zip(todo, _together([t[2] for t in todo], [t[3] for t in todo], start, tables), strict=True):
            pieces[m][k][0] = pixels
    return [(b"".join([samples(p) for p, _ in own]), len(own), sum(h for _, h in own)) for own in pieces]


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def describe(payload: bytes, images: int, rows: int) -> str:
    """Features of decoded samples: images, rows, mean, distinct values and the most frequent value."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    mean = float(counts @ np.arange(256)) / max(1, len(payload))
    return f"images={images};rows={rows};mean={mean:.3f};distinct={int((counts > 0).sum())};mode={int(counts.argmax())}"


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media binary) of every text."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {id_col: cols[id_col], "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in cols[text]], "media": [write(payload_of(t)) for t in cols[text]]}

    return map_rows(docs, [id_col, text], run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, media binary")


def load(stored: DataFrame, id_col: str = "doc_id", media: str = "media") -> DataFrame:
    """(id, payload binary, feature) of stored media; a null medium has an empty payload."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = read_many([m or b"" for m in cols[media]])
        return {id_col: cols[id_col], "payload": [p for p, _, _ in found], "feature": [describe(*f) for f in found]}

    return map_rows(stored, [id_col, media], run, f"`{id_col}` {dict(stored.dtypes)[id_col]}, payload binary, feature string")


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored, read back and digested, one row for each document, without keeping the media."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        media = [write(payload_of(t)) for t in cols[text]]
        found = read_many(media)
        return {
            id_col: cols[id_col], "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in cols[text]], "payload_bytes": [len(p) for p, _, _ in found],
            "payload_sha256": [sha256(p).hexdigest() for p, _, _ in found], "tail_crc32": [zlib.crc32(p[-BLOCK:]) for p, _, _ in found],
            "media_bytes": [len(m) for m in media], "media_sha256": [sha256(m).hexdigest() for m in media], "feature": [describe(*f) for f in found],
        }

    return map_rows(docs, [id_col, text], run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
