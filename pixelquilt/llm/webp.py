"""Lossless WebP (VP8L) media columns: bytes to images and back to pixel arrays.

Storing: a byte sequence, padded with zeros to rows of WIDTH samples, becomes grey images of at most ROWS rows, one
WebP file after the other. An image is written with the subtract-green transform (grey then needs one channel), or
with a palette whose indices share bytes if it has at most 16 different samples, as prefix-coded literals and
back-references (repeated lines, runs).

Reading: a complete decoder of the format: simple and normal prefix codes, meta prefix images, back-references with
the two-dimensional distance codes, colour cache, and the inverse predictor, cross-colour, subtract-green and palette
transforms. Images with one prefix group, no cache and one varying channel, as stored here, are decoded together: each
step takes one symbol of every image that is still open; all others go symbol by symbol.

Defined results: NULL texts are empty; empty texts are one row of zeros; equal texts give equal bytes. A file that is
cut off or no WebP raises ValueError.
"""
from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import as_bytes, documents, slices

WIDTH = 64
ROWS = 256              # most rows of one image
LIMIT = 11              # longest code that is written (the format allows 15)
LEAST_LINE = 16         # shortest repeated line that becomes a back-reference
LONGEST = 4096          # longest back-reference
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
LENGTH_CODES, CACHE_FACTOR = 24, 0x1E35A7BD
# fixed order in which the lengths of the code-length code are stored
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
# distance codes 1..120: pixels above and left, nearest first
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# ---- prefix codes

def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Lengths of a prefix code for the counted symbols, none above `limit`."""
    while True:
        heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))]
        heapq.heapify(heap)
        lengths, tick = dict.fromkeys(counts, 0), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (both := a[2] + b[2]):
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], tick, both))
            tick += 1
        if max(lengths.values(), default=0) <= limit:
            return lengths
        counts = {s: (n + 1) // 2 for s, n in counts.items()}       # flatter counts give shorter codes


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits in the order they are sent, length): codes by length, then symbol."""
    out, code, last = {}, 0, 0
    for s, n in sorted(((s, n) for s, n in lengths.items() if n), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s], last = (int(format(code, f"0{n}b")[::-1], 2), n), n
        code += 1
    return out


_REVERSED: dict[int, np.ndarray] = {}


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table of symbol << 4 | length by the next bits, bits of the index) of a canonical code."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        return np.array([int(used[0]) << 4 if len(used) else 0], np.int32), 0
    order = used[np.argsort(lengths[used], kind="stable")]
    n, top = lengths[order], int(lengths[used].max())
    table = np.repeat((order << 4 | n).astype(np.int32), 1 << (top - n))
    if len(table) != 1 << top:
        raise ValueError("incomplete prefix code")
    if top not in _REVERSED:
        _REVERSED[top] = np.array([int(format(i, f"0{top}b")[::-1], 2) for i in range(1 << top)])
    return table[_REVERSED[top]], top


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, number of extra bits) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    return 2 * high + (v >> (high - 1) & 1), v & ((1 << (high - 1)) - 1), high - 1


# ---- writing

class Bits:
    """Bits to be written: (value, length) pairs, lowest bit first."""

    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def code(self, lengths: dict[int, int], alphabet: int) -> dict[int, tuple[int, int]]:
        """Write a prefix code; the bits of its symbols."""
        used = sorted(s for s, n in lengths.items() if n or len(lengths) == 1)
        if len(used) <= 2 and all(s < 256 for s in used):
            used = used or [0]
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            wide = used[0] > 1
            self.put(int(wide), 1)
            self.put(used[0], 8 if wide else 1)
            if len(used) == 2:
                self.put(used[1], 8)
            return {s: (i, len(used) - 1) for i, s in enumerate(used)}
        if len(used) == 1:          # a single symbol beyond a byte needs a partner to be a complete code
            lengths = {used[0]: 1, 0 if used[0] else 1: 1}
        runs = _runs([lengths.get(s, 0) for s in range(alphabet)])
        counts: dict[int, int] = {}
        for s, _, _ in runs:
            counts[s] = counts.get(s, 0) + 1
        if len(counts) == 1:
            counts[0 if 0 not in counts else 1] = 1
        inner = code_lengths(counts, 7)
        sent = max(i for i, s in enumerate(LENGTH_ORDER) if inner.get(s)) + 1
        self.put(0, 1)
        self.put(max(sent, 4) - 4, 4)
        for s in LENGTH_ORDER[:max(sent, 4)]:
            self.put(inner.get(s, 0), 3)
        self.put(0, 1)
        bits = canonical(inner)
        for s, extra, size in runs:
            self.put(*bits[s])
            if size:
                self.put(extra, size)
        return canonical(lengths)


def _runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra, extra bits): 17 and 18 repeat zero."""
    out, i = [], 0
    while i < len(lengths):
        n = 1
        while lengths[i] == 0 and i + n < len(lengths) and lengths[i + n] == 0 and n < 138:
            n += 1
        if lengths[i] or n < 3:
            out.append((lengths[i], 0, 0))
            i += 1
        else:
            out.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            i += n
    return out


def _matches(samples: bytes) -> list[tuple[int, int, int]]:
    """(place, length, distance) of repeated lines and of the zeros at the end."""
    out, seen, at = [], {}, 0
    tail = len(samples) - len(samples.rstrip(b"\0"))
    end = len(samples) - tail
    for line in samples[:end].split(b"\n"):
        n = min(len(line) + 1, end - at)
        if n >= LEAST_LINE and (old := seen.get(line)) is not None and old + n <= end:
            for i in range(0, n, LONGEST):
                if n - i >= 4:
                    out.append((at + i, min(LONGEST, n - i), at - old))
        seen[line] = at
        at += len(line) + 1
    if tail > 4:
        for i in range(end + 1, len(samples), LONGEST):
            if len(samples) - i >= 4:
                out.append((i, min(LONGEST, len(samples) - i), 1))
    return out


def _entropy_coded(bits: Bits, samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and symbols of a one-channel image (red and blue 0, opaque), without cache; more to be packed after `bits`."""
    matches = _matches(samples)
    data = np.frombuffer(samples, np.uint8)
    literal = np.ones(len(data), bool)
    for at, n, _ in matches:
        literal[at:at + n] = False
    histogram = np.bincount(data[literal], minlength=256)
    counts = {int(s): int(histogram[s]) for s in np.flatnonzero(histogram)}
    steps, distances = [], {}
    for at, n, back in matches:
        one, two = prefix_of(n), prefix_of(back + len(NEAR))
        steps.append((at, one, two))
        counts[256 + one[0]] = counts.get(256 + one[0], 0) + 1
        distances[two[0]] = distances.get(two[0], 0) + 1
    green = bits.code(code_lengths(counts), 256 + LENGTH_CODES)
    for constant in (0, 0, 255):
        bits.code({constant: 0}, 256)
    far = bits.code(code_lengths(distances), 40)
    table = np.zeros((256, 2), np.int64)
    for s, pair in green.items():
        if s < 256:
            table[s] = pair
    at = np.flatnonzero(literal)
    values, sizes = table[data[at], 0], table[data[at], 1]
    if steps:
        place = np.concatenate([at] + [[p] * 4 for p, _, _ in steps])
        more = [x for _, one, two in steps for x in (green[256 + one[0]], one[1:], far[two[0]], two[1:])]
        order = np.argsort(place, kind="stable")
        values = np.concatenate([values, [v for v, _ in more]])[order]
        sizes = np.concatenate([sizes, [n for _, n in more]])[order]
    return values, sizes


def _image_bits(samples: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of all bits of a VP8L stream for grey samples."""
    bits = Bits()
    height = len(samples) // width
    bits.put(0x2F, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(0, 4)
    kinds = sorted(set(samples))
    if len(kinds) <= 16:
        bits.put(1 | PALETTE << 1, 3)
        bits.put(len(kinds) - 1, 8)
        bits.put(0, 1)                                              # the palette: an image of differences
        steps = np.diff(np.array(kinds), prepend=0) & 255
        codes = [bits.code(code_lengths({int(s): 1 for s in steps}), 256 + LENGTH_CODES)]
        codes += [bits.code(code_lengths({int(s): 1 for s in steps}), 256) for _ in range(2)]
        alpha = bits.code(code_lengths({s: 1 for s in {255, 0} if s == 255 or len(kinds) > 1}), 256)
        bits.code({0: 0}, 40)
        for i, s in enumerate(steps):
            for pair in (*(c[int(s)] for c in codes), alpha[0 if i else 255]):
                bits.put(*pair)
        share = 3 if len(kinds) <= 2 else 2 if len(kinds) <= 4 else 1
        place = np.zeros(256, np.uint8)
        place[kinds] = np.arange(len(kinds))
        rows = place[np.frombuffer(samples, np.uint8)].reshape(height, -1)
        rows = np.pad(rows, ((0, 0), (0, -width % (1 << share)))).reshape(height, -1, 1 << share)
        samples = (rows << (np.arange(1 << share) * (8 >> share)).astype(np.uint8)).sum(axis=2).astype(np.uint8).tobytes()
    else:
        bits.put(1 | SUBTRACT_GREEN << 1, 3)
    bits.put(0, 3)                                                  # no more transforms, no cache, no meta prefix image
    values, sizes = _entropy_coded(bits, samples)
    return np.concatenate([bits.values, values]).astype(np.uint64), np.concatenate([bits.sizes, sizes]).astype(np.int64)


def pack(streams: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """The bytes of bit streams, all in one pass."""
    if not streams:
        return []
    sizes = np.concatenate([s for _, s in streams])
    lengths = np.array([int(s.sum()) for _, s in streams])
    words = (lengths + 31) // 32
    first = np.cumsum(words) - words
    start = np.cumsum(sizes) - sizes + np.repeat(first * 32 - (np.cumsum(lengths) - lengths), [len(s) for _, s in streams])
    value = np.concatenate([v for v, _ in streams]) << (start & 31).astype(np.uint64)
    low, high = value & np.uint64(0xFFFFFFFF), value >> np.uint64(32)
    total = int(words.sum())
    out = np.bincount(start >> 5, low.astype(float), total + 1)[:total + 1] + np.bincount((start >> 5) + 1, high.astype(float), total + 2)[:total + 1]
    raw = out.astype("<u4").tobytes()           # the summed bit fields do not overlap, so the sums are exact
    return [raw[4 * f:4 * f + (n + 7) // 8] for f, n in zip(first.tolist(), lengths.tolist())]


def container(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def store(payloads: list[bytes]) -> list[bytes]:
    """Padded payloads as WebP files, one after the other for more than ROWS rows."""
    cuts = [[p[i:i + WIDTH * ROWS] for i in range(0, len(p), WIDTH * ROWS)] for p in payloads]
    packed = iter(pack([_image_bits(c, WIDTH) for part in cuts for c in part]))
    return [b"".join(container(next(packed)) for _ in part) for part in cuts]


# ---- reading

class Reader:
    """Bits of a stream, lowest first."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw + bytes(16), at
        self.end = 8 * len(raw)

    def peek(self) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.raw[byte:byte + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return value

    def symbol(self, code: tuple[np.ndarray, int]) -> int:
        entry = int(code[0][self.peek() & ((1 << code[1]) - 1)])
        self.at += entry & 15
        return entry >> 4

    def value(self, prefix: int) -> int:
        """The length or distance of a prefix symbol and its extra bits."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1

    def code(self, alphabet: int) -> tuple[np.ndarray, int]:
        lengths = np.zeros(alphabet, np.int64)
        if self.read(1):
            two, wide = self.read(1), self.read(1)
            used = [self.read(8 if wide else 1)] + ([self.read(8)] if two else [])
            lengths[used] = len(used) if len(used) == 1 else 1
            return lookup(lengths)
        inner = np.zeros(19, np.int64)
        for s in LENGTH_ORDER[:4 + self.read(4)]:
            inner[s] = self.read(3)
        table, top = lookup(inner)
        entries, mask = table.tolist(), (1 << top) - 1
        left = alphabet if not self.read(1) else 2 + self.read(2 + 2 * self.read(3))
        out: list[int] = []
        last = 8
        while len(out) < alphabet and left:
            left -= 1
            entry = entries[self.peek() & mask]
            self.at += entry & 15
            s = entry >> 4
            if s < 16:
                out.append(s)
                last = s or last
            else:
                out.extend([last if s == 16 else 0] * (self.read((2, 3, 7)[s - 16]) + (3, 3, 11)[s - 16]))
        if len(out) > alphabet or self.at > self.end:
            raise ValueError("too many code lengths")
        lengths[:len(out)] = out
        return lookup(lengths)

    def group(self, cache_bits: int) -> list[tuple[np.ndarray, int]]:
        return [self.code(256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)), *(self.code(256) for _ in range(3)), self.code(40)]


def entropy_image(r: Reader, width: int, height: int) -> np.ndarray:
    """A sub-image: cache, one prefix group, pixels."""
    cache_bits = r.read(4) if r.read(1) else 0
    return pixels(r, width, height, cache_bits, [r.group(cache_bits)])


def pixels(r: Reader, width: int, height: int, cache_bits: int, groups: list, meta: np.ndarray | None = None, meta_bits: int = 0) -> np.ndarray:
    """Pixels as ARGB numbers, symbol by symbol."""
    out = np.zeros(width * height, np.uint32)
    cache = np.zeros(1 << cache_bits, np.uint32)
    at, group, noted = 0, groups[0], 0

    def note(upto: int) -> None:
        if cache_bits:
            for argb in out[noted:upto].tolist():
                cache[(CACHE_FACTOR * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb

    while at < len(out):
        if meta is not None:
            group = groups[int(meta[at // width >> meta_bits, at % width >> meta_bits])]
        s = r.symbol(group[0])
        if s < 256:
            red, blue, alpha = (r.symbol(group[i]) for i in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + LENGTH_CODES:
            at = copied(out, at, r.value(s - 256), distance(r.value(r.symbol(group[4])), width))
        else:
            note(at)
            noted = at
            out[at] = cache[s - 256 - LENGTH_CODES]
            at += 1
        if r.at > r.end:
            raise ValueError("the stream ends too early")
    return out


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def copied(out: np.ndarray, at: int, n: int, back: int, base: int = 0, end: int | None = None) -> int:
    """Copy n pixels from `back` before; the new place."""
    end = len(out) if end is None else end
    if back > at - base or at + n > end:
        raise ValueError("a back-reference leaves the image")
    if back >= n:
        out[at:at + n] = out[at - back:at - back + n]
    else:
        out[at:at + n] = np.resize(out[at - back:at], n)
    return at + n


class Head:
    """What stands before the pixels of an image: size, transforms, cache, prefix groups."""

    def __init__(self, raw: bytes):
        if raw[:1] != b"\x2f":
            raise ValueError("no VP8L stream")
        r = self.reader = Reader(raw, 8)
        self.width, self.height = r.read(14) + 1, r.read(14) + 1
        if r.read(4) >> 1:
            raise ValueError("unknown version")
        self.transforms, self.coded_width = [], self.width
        while r.read(1):
            kind, w = r.read(2), self.coded_width
            if kind in (PREDICTOR, CROSS_COLOUR):
                bits = r.read(3) + 2
                size = (w + (1 << bits) - 1) >> bits, (self.height + (1 << bits) - 1) >> bits
                self.transforms.append((kind, w, bits, entropy_image(r, *size).reshape(size[1], size[0])))
            elif kind == PALETTE:
                n = r.read(8) + 1
                table = entropy_image(r, n, 1).view(np.uint8).reshape(n, 4)
                colours = np.ascontiguousarray(np.cumsum(table, axis=0, dtype=np.uint8)).view(np.uint32).ravel()
                share = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, w, share, colours))
                self.coded_width = (w + (1 << share) - 1) >> share
            else:
                self.transforms.append((kind, w, 0, None))
        self.cache_bits = r.read(4) if r.read(1) else 0
        self.meta, self.meta_bits, n = None, 0, 1
        if r.read(1):
            b = self.meta_bits = r.read(3) + 2
            size = (self.coded_width + (1 << b) - 1) >> b, (self.height + (1 << b) - 1) >> b
            self.meta = (entropy_image(r, *size) >> 8 & 0xFFFF).reshape(size[1], size[0])
            n = int(self.meta.max()) + 1
        self.groups = [r.group(self.cache_bits) for _ in range(n)]

    def one_channel(self) -> bool:
        """Whether the images can be decoded together: only green varies, nothing but literals and back-references."""
        return self.meta is None and not self.cache_bits and all(c[1] == 0 for c in self.groups[0][1:4])


def together(heads: list[Head]) -> list[np.ndarray]:
    """Pixels of images with one varying channel, a symbol of each open image per step."""
    counts = np.array([h.coded_width * h.height for h in heads])
    base = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint8)
    raw = b"".join(h.reader.raw for h in heads)
    window = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    first_byte = np.cumsum([0] + [len(h.reader.raw) for h in heads])[:-1]
    pos = np.array([h.reader.at for h in heads]) + 8 * first_byte
    limit = np.array([h.reader.end for h in heads]) + 8 * first_byte
    table = np.concatenate([h.groups[0][0][0] for h in heads]).astype(np.int64)
    sizes = np.array([len(h.groups[0][0][0]) for h in heads])
    start, mask = np.cumsum(sizes) - sizes, (sizes - 1).astype(np.uint64)
    at, end, who = base.copy(), base + counts, np.arange(len(heads))
    while len(who):
        for _ in range(int((end - at).min())):
            entry = table[start + ((window[pos >> 3] >> (pos & 7).astype(np.uint64)) & mask).astype(np.int64)]
            pos += entry & 15
            symbol = entry >> 4
            out[at] = symbol & 255
            at += 1
            if symbol.max() > 255:
                for i in np.flatnonzero(symbol > 255).tolist():
                    h = heads[who[i]]
                    h.reader.at = int(pos[i] - 8 * first_byte[who[i]])
                    n = h.reader.value(int(symbol[i]) - 256)
                    back = distance(h.reader.value(h.reader.symbol(h.groups[0][4])), h.coded_width)
                    pos[i] = h.reader.at + 8 * first_byte[who[i]]
                    at[i] = copied(out, int(at[i]) - 1, n, back, int(base[who[i]]), int(end[i]))
                break
        if (pos > limit).any():
            raise ValueError("the stream ends too early")
        open_ = at < end
        if not open_.all():
            pos, limit, start, mask, at, end, who = (x[open_] for x in (pos, limit, start, mask, at, end, who))
    result = []
    for h, b, n in zip(heads, base.tolist(), counts.tolist()):
        red, blue, alpha = (int(c[0][0]) >> 4 for c in h.groups[0][1:4])
        result.append(out[b:b + n].astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue))
    return result


# ---- inverse transforms

def _channels(argb: np.ndarray) -> np.ndarray:
    """[n, 4] blue, green, red, alpha."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(-1, 4).astype(np.int64)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view("<u4").ravel()


def predicted(mode: int, left, top, corner, right) -> list[int]:
    """The prediction of a pixel from its neighbours (lists of four channels): left, above, above left, above right."""
    def mean(a, b):
        return [(x + y) >> 1 for x, y in zip(a, b)]

    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner))
        to_top = sum(abs(x - c) for x, c in zip(left, corner))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner)]
    if mode == 13:
        return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean(left, top), corner)]
    simple = {1: left, 2: top, 3: right, 4: corner}
    if mode in simple:
        return simple[mode]
    pairs = {5: (mean(left, right), top), 6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right),
             10: (mean(left, corner), mean(top, right))}
    return mean(*pairs[mode]) if mode in pairs else [0, 0, 0, 255]


def add_predictions(argb: np.ndarray, width: int, bits: int, modes: np.ndarray) -> np.ndarray:
    rest, out = _channels(argb).tolist(), []
    for i, residual in enumerate(rest):
        y, x = divmod(i, width)
        if y == 0:
            guess = out[i - 1] if x else [0, 0, 0, 255]
        elif x == 0:
            guess = out[i - width]
        else:
            mode = int(modes[y >> bits, x >> bits]) >> 8 & 15
            guess = predicted(mode, out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1])
        out.append([(a + b) & 255 for a, b in zip(residual, guess)])
    return _joined(np.array(out))


def add_cross_colour(argb: np.ndarray, width: int, bits: int, factors: np.ndarray) -> np.ndarray:
    c = _channels(argb)
    y, x = np.divmod(np.arange(len(c)), width)
    f = _channels(factors.ravel()).reshape(*factors.shape, 4)[y >> bits, x >> bits]
    signed = lambda v: ((v & 255) ^ 128) - 128      # noqa: E731
    green_red, green_blue, red_blue = signed(f[:, 0]), signed(f[:, 1]), signed(f[:, 2])
    green = signed(c[:, 1])
    c[:, 2] = (c[:, 2] + (green_red * green >> 5)) & 255
    c[:, 0] = (c[:, 0] + (green_blue * green >> 5) + (red_blue * signed(c[:, 2]) >> 5)) & 255
    return _joined(c)


def add_green(argb: np.ndarray) -> np.ndarray:
    green = argb >> np.uint32(8) & np.uint32(255)
    both = np.uint32(0x00FF00FF)
    return argb & ~both | ((argb & both) + (green << np.uint32(16) | green)) & both


def from_palette(argb: np.ndarray, width: int, share: int, colours: np.ndarray) -> np.ndarray:
    size = 8 >> share
    packed = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    index = (packed[:, None] >> (np.arange(1 << share) * size)) & ((1 << size) - 1)
    index = index.reshape(-1, ((width + (1 << share) - 1) >> share) << share)[:, :width].ravel()
    return np.append(colours, np.zeros(256, np.uint32))[index]


def finished(head: Head, argb: np.ndarray) -> np.ndarray:
    """[height, width] ARGB pixels after the inverse transforms."""
    for kind, width, bits, data in reversed(head.transforms):
        if kind == PREDICTOR:
            argb = add_predictions(argb, width, bits, data)
        elif kind == CROSS_COLOUR:
            argb = add_cross_colour(argb, width, bits, data)
        elif kind == SUBTRACT_GREEN:
            argb = add_green(argb)
        else:
            argb = from_palette(argb, width, bits, data)
    return argb.reshape(head.height, head.width)


def streams(media: bytes) -> list[bytes]:
    """The VP8L streams of one or more WebP files."""
    out, at = [], 0
    while at < len(media):
        if media[at:at + 4] != b"RIFF" or media[at + 8:at + 16] != b"WEBPVP8L" or len(media) < at + 20:
            raise ValueError("no lossless WebP file")
        size, n = struct.unpack_from("<I", media, at + 4)[0], struct.unpack_from("<I", media, at + 16)[0]
        if at + 8 + size > len(media) or n > size - 12:
            raise ValueError("the file ends too early")
        out.append(media[at + 20:at + 20 + n])
        at += 8 + size
    return out


def load(media: list[bytes]) -> list[list[np.ndarray]]:
    """The pixel arrays of every media value."""
    parts = [[Head(s) for s in streams(m)] for m in media]
    easy = [h for p in parts for h in p if h.one_channel()]
    quick = dict(zip(map(id, easy), together(easy))) if easy else {}

    def one(h: Head) -> np.ndarray:
        argb = quick.get(id(h))
        if argb is None:
            argb = pixels(h.reader, h.coded_width, h.height, h.cache_bits, h.groups, h.meta, h.meta_bits)
        return finished(h, argb)

    return [[one(h) for h in p] for p in parts]


# ---- columns

def padded(raw: bytes | None) -> bytes:
    raw = raw or b""
    return raw + bytes(WIDTH if not raw else -len(raw) % WIDTH)


def feature(images: list[np.ndarray]) -> str:
    """Size, mean, spread and roughness of the samples, and the shares of eight grey classes."""
    g = np.concatenate([(i >> np.uint32(8) & np.uint32(255)).astype(np.uint8) for i in images])
    classes = np.bincount(g.ravel() >> 5, minlength=8) / g.size
    rough = np.abs(np.diff(g.astype(np.int16), axis=1)).mean()
    return f"{g.shape[1]}x{g.shape[0]} {g.mean():.4f} {g.std():.4f} {rough:.4f} " + ",".join(f"{c:.4f}" for c in classes)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as stored WebP bytes."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=512, mb=4):
            texts = as_bytes(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()),
                                              pa.array(store([padded(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def pixel_arrays(stored: DataFrame) -> DataFrame:
    """doc_id, part, width, height, argb: the pixel arrays of stored(doc_id, media), one row per image."""
    kind = dict(stored.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", rows=256, mb=2):
            rows = [(d, i, image.shape[1], image.shape[0], image.ravel().astype(np.int64))
                    for d, images in zip(batch.column(0).to_pylist(), load(batch.column("media").to_pylist())) for i, image in enumerate(images)]
            columns = list(zip(*rows))
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "part", "width", "height", "argb"])

    return documents(stored, "doc_id", "media").mapInArrow(run, f"doc_id {kind}, part int, width int, height int, argb array<long>")


def media_digest(docs: DataFrame) -> DataFrame:
    """Digest of every text's stored form and of what is read back from it."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=2048, mb=4):
            texts = as_bytes(batch)
            stored = store([padded(t) for t in texts])
            rows = []
            for text, m, images in zip(texts, stored, load(stored)):
                back = b"".join((i >> np.uint32(8)).astype(np.uint8).tobytes() for i in images)
                rows.append((len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(m),
                             hashlib.sha256(m).hexdigest(), feature(images)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return documents(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
             "media_sha256 string, feature string")
