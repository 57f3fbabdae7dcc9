"""Lossless WebP media columns: a full decoder to pixel arrays, and a writer.

The decoder reads prefix codes (simple and normal, by tables over the next bits), meta prefix groups,
back-references with plane distances and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. The writer makes Huffman codes, references (greedy, three pixels or
more), a colour cache where it saves bits, and of the transforms the one that leaves the least entropy.
Every stored payload is read back by that decoder; there is no other path.

Payloads are laid out 192 RGB pixels a row. An image holds at most ROWS rows; longer payloads are a
sequence of WebP files behind each other (each RIFF header says how long it is), so memory is bounded, and
many images are coded and decoded together, a pixel of each in every step.

Cases: a null text is empty and is stored as one row of bytes 255; equal texts give equal bytes; bad
files raise ValueError; a null media value decodes to nulls.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map

ROW, WIDTH, ROWS = 576, 192, 16
#: Pixels that are coded together (some 200 bytes of memory each), and that are decoded together (some 50).
TOGETHER, READ_TOGETHER = 1_200_000, 3_000_000
_ORDER = (17, 18, *range(6), 16, *range(6, 16))
_ORDER_OF = np.array(_ORDER)


def _plane_offsets() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: by squared distance, then nearer rows' order of the format."""
    points = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy > 0 or dx > 0]
    points.sort(key=lambda p: (p[0] * p[0] + p[1] * p[1], abs(p[0]), -p[0]))
    return points[:120]


_PLANE = _plane_offsets()


_REVERSED_BYTE = np.array([int(f"{x:08b}"[::-1], 2) for x in range(256)], np.uint32)
_DOWN = np.arange(9, 1, -1, dtype=np.uint32)


class Bits:
    """Reads bit fields, least significant first; window holds, for each bit position, the next 15 bits as prefix codes have them."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)
        byte = np.zeros(len(data) + 24, np.uint32)  # with room for fields that run over the end
        byte[: len(data)] = _REVERSED_BYTE[np.frombuffer(data, np.uint8)]
        three = byte[:-2] << np.uint32(16) | byte[1:-1] << np.uint32(8) | byte[2:]
        self.all = ((three[:, None] >> _DOWN & np.uint32(0x7FFF)).astype(np.uint16)).ravel()
        self.window = memoryview(self.all)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("image data ends early")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


class Code:
    """A canonical prefix code as a table: the next bits (15 - shift of them) to symbol << 4 | length; one symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.entries, self.shift = np.array([(used[0] if len(used) else 0) << 4], np.uint16), 15
            self.table = memoryview(self.entries)
            return
        n = lengths[used]
        order = np.argsort(n, kind="stable")
        used, n = used[order], n[order]
        most = int(n[-1])
        table = np.repeat((used << 4 | n).astype(np.uint16), 1 << (most - n))
        if len(table) != 1 << most:
            raise ValueError("prefix code is not complete")
        self.entries, self.table, self.shift = table, memoryview(table), 15 - most


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    found = _read_lengths(bits, size)
    lengths[: len(found)] = found
    return Code(lengths)


@lru_cache(4096)
def _small_table(lengths: tuple[tuple[int, int], ...]) -> tuple[list[int], int]:
    """The table (see `Code`) of code lengths' own code: (length, symbol) in ascending order."""
    if len(lengths) < 2:
        return [lengths[0][1] << 4 if lengths else 0], 15
    most, out = lengths[-1][0], []
    for n, symbol in lengths:
        out += [symbol << 4 | n] * (1 << (most - n))
    if len(out) != 1 << most:
        raise ValueError("prefix code is not complete")
    return out, 15 - most


def _read_lengths(bits: Bits, size: int) -> list[int]:
    """The code lengths of the first symbols; all others are 0."""
    kind = bits.read(3)
    if kind & 1:
        symbol = bits.read(8 if kind & 4 else 1)
        other = bits.read(8) if kind & 2 else symbol
        if max(symbol, other) >= size:
            raise ValueError("no such symbol")
        out = [0] * (max(symbol, other) + 1)
        out[symbol] = out[other] = 1
        return out
    bits.at -= 2
    n = 4 + bits.read(4)
    packed = bits.read(3 * n)
    table, shift = _small_table(tuple(sorted((x, _ORDER[i]) for i in range(n) if (x := packed >> 3 * i & 7))))
    most = size
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
        if most > size:
            raise ValueError("too many code lengths")
    window, at = bits.window, bits.at
    out, last = [], 8
    while len(out) < size and most > 0:
        most -= 1
        if at > bits.end:
            raise ValueError("image data ends early")
        e = table[window[at] >> shift]
        at += e & 15
        s = e >> 4
        if s < 16:
            out.append(s)
            last = s or last
        else:
            bits.at = at
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            at = bits.at
            out += [last if s == 16 else 0] * n
    bits.at = at
    if len(out) > size or at > bits.end:
        raise ValueError("code lengths run over")
    return out


def _tables(codes: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tables of many codes (see `Code`) behind each other: entries, where each begins, and its shift."""
    n = np.array([len(c) for c in codes])
    length, code = np.fromiter(chain.from_iterable(codes), np.int64, int(n.sum())), np.repeat(np.arange(len(codes)), n)
    symbol = np.arange(len(length)) - np.repeat(np.cumsum(n) - n, n)
    there = np.flatnonzero(length)
    length, code, symbol = length[there], code[there], symbol[there]
    count = np.bincount(code, minlength=len(codes))
    single = count[code] == 1
    length[single] = 0  # one symbol alone takes no bits
    most = np.zeros(len(codes), np.int64)
    np.maximum.at(most, code, length)
    order = np.lexsort((symbol, length, code))
    length, code, symbol = length[order], code[order], symbol[order]
    times = 1 << (most[code] - length)
    size = np.bincount(code, times, len(codes)).astype(np.int64)
    if (size != 1 << most).any():
        empty = np.flatnonzero(count == 0)
        if (np.delete(size, empty) != np.delete(1 << most, empty)).any():
            raise ValueError("prefix code is not complete")
        size[empty] = 1
        return np.insert(np.repeat(symbol << 4 | length, times), (np.cumsum(size) - size)[empty] - np.arange(len(empty)), 0), np.cumsum(size) - size, 15 - most
    return np.repeat(symbol << 4 | length, times), np.cumsum(size) - size, 15 - most


def _length_or_distance(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as ARGB integers, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, shift, which, across = 1, 0, None, 1
    if top and bits.read(1):
        shift = 2 + bits.read(3)
        which = ((_pixels(bits, -(-width >> shift), -(-height >> shift), False) >> 8) & 0xFFFF).tolist()
        groups, across = max(which) + 1, -(-width >> shift)
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = []
    for _ in range(groups):
        codes.append([_read_code(bits, n) for n in sizes])
    try:
        out = _decoded(bits, width, width * height, [[x for c in some for x in (c.table, c.shift)] for some in codes], which, shift, across, cache_bits)
    except IndexError:
        raise ValueError("image data ends early") from None
    if bits.at > bits.end:
        raise ValueError("image data ends early")
    return np.array(out, np.uint32)


def _decoded(bits: Bits, width: int, n: int, codes: list[list], which: list[int] | None, shift: int, across: int, cache_bits: int) -> list[int]:
    out: list[int] = []
    cache, down, window, p, i = [0] * (1 << cache_bits), 32 - cache_bits, bits.window, bits.at, 0
    green, green_shift, red, red_shift, blue, blue_shift, alpha, alpha_shift, far, far_shift = codes[0]
    while i < n:
        if which is not None:
            green, green_shift, red, red_shift, blue, blue_shift, alpha, alpha_shift, far, far_shift = codes[which[(i // width >> shift) * across + (i % width >> shift)]]
        e = green[window[p] >> green_shift]
        p += e & 15
        s = e >> 4
        if s < 256:
            r = red[window[p] >> red_shift]
            p += r & 15
            b = blue[window[p] >> blue_shift]
            p += b & 15
            a = alpha[window[p] >> alpha_shift]
            p += a & 15
            c = (a >> 4) << 24 | (r >> 4) << 16 | s << 8 | b >> 4
            out.append(c)
            if cache_bits:
                cache[(0x1E35A7BD * c & 0xFFFFFFFF) >> down] = c
            i += 1
        elif s >= 280:  # what comes from the cache is there already
            out.append(cache[s - 280])
            i += 1
        else:
            bits.at = p
            length = _length_or_distance(s - 256, bits)
            e = far[window[bits.at] >> far_shift]
            bits.at += e & 15
            d = _length_or_distance(e >> 4, bits)
            p = bits.at
            if d <= 120:
                dx, dy = _PLANE[d - 1]
                d = max(1, dx + dy * width) if dy else dx
            else:
                d -= 120
            if d > i or i + length > n:
                raise ValueError("reference out of the image")
            copied = _copied(out, d, length)
            out += copied
            if cache_bits:
                for c in copied[-d:]:  # of a repetition, its last round
                    cache[(0x1E35A7BD * c & 0xFFFFFFFF) >> down] = c
            i += length
    bits.at = p
    return out


_LENGTH_EXTRA = np.array([0] * 4 + [(s - 2) >> 1 for s in range(4, 40)], np.int64)
_LENGTH_BASE = np.array([s + 1 for s in range(4)] + [((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(4, 40)], np.int64)
_PLANE_X, _PLANE_Y = (np.array([0, *x]) for x in zip(*_PLANE))


def _decoded_together(images: list[tuple[Bits, int, int, list[list[int]], int]]) -> list[np.ndarray]:
    """Pixels of many images (bits, width, pixels, codes, cache bits) of one prefix group each: in every step each image
    gets its next pixel, from its prefix codes, its cache, or a reference that it is copying."""
    order = sorted(range(len(images)), key=lambda k: -images[k][2])
    some = [images[k] for k in order]
    entries, base, shift = _tables([c for *_, codes, _ in some for c in codes])
    base, shift = np.ascontiguousarray(base.reshape(-1, 5).T), np.ascontiguousarray(shift.reshape(-1, 5).T)
    sizes = np.array([len(b.data) + 8 for b, *_ in some])
    byte = np.zeros(int(sizes.sum()) + 64, np.uint32)
    begin = np.cumsum(sizes) - sizes
    for a, (b, *_) in zip(begin.tolist(), some):
        byte[a : a + len(b.data)] = np.frombuffer(b.data, np.uint8)
    turned = _REVERSED_BYTE[byte]
    three = turned[:-2] << np.uint32(16) | turned[1:-1] << np.uint32(8) | turned[2:]
    windows = (three[:, None] >> _DOWN & np.uint32(0x7FFF)).astype(np.uint16).ravel()
    four = byte[:-3] | byte[1:-2] << np.uint32(8) | byte[2:-1] << np.uint32(16) | byte[3:] << np.uint32(24)
    stop = 8 * begin + np.array([b.end for b, *_ in some])
    p = 8 * begin + np.array([b.at for b, *_ in some])
    width, pixels = np.array([w for _, w, *_ in some]), np.array([n for _, _, n, *_ in some])
    bits = np.array([c or 1 for *_, c in some])  # one that nothing reads, where there is no cache
    down = (32 - bits).astype(np.uint32)
    cache_at = np.cumsum(1 << bits) - (1 << bits)
    cache = np.zeros(int((1 << bits).sum()) + 1, np.uint32)
    start = np.cumsum(pixels) - pixels
    out = np.zeros(int(pixels.sum()) + 1, np.uint32)
    left, back = np.zeros(len(some), np.int64), np.ones(len(some), np.int64)
    active, copying = len(some), False

    def entry(c: int, at: np.ndarray) -> np.ndarray:
        return entries.take(base[c, :active] + (windows.take(at) >> shift[c, :active]))

    def field(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (four[at >> 3] >> (at & 7).astype(np.uint32)).astype(np.int64) & ((1 << n) - 1)

    plain = bool((shift[3] == 15).all())  # alpha takes no bits anywhere
    constant = (entries[base[3]] >> 4 << 24).astype(np.uint32)
    counts = pixels.tolist()
    for i in range(counts[0]):
        while counts[active - 1] <= i:
            active -= 1
            if (p[active:] > stop[active:]).any():
                raise ValueError("image data ends early")
        now = p[:active]
        e = entry(0, now)
        after = now + (e & 15)
        s = e >> 4
        r = entry(1, after)
        next_ = after + (r & 15)
        b = entry(2, next_)
        next_ += b & 15
        if plain:
            colour = constant[:active] | (r >> 4 << 16 | (s & 255) << 8 | b >> 4).astype(np.uint32)
        else:
            a = entry(3, next_)
            next_ += a & 15
            colour = ((a >> 4) << 24 | r >> 4 << 16 | (s & 255) << 8 | b >> 4).astype(np.uint32)
        other = s > 255
        if copying:
            other |= left[:active] > 0
        lanes = np.flatnonzero(other)
        if len(lanes):
            kind, busy = s[lanes], left[lanes] > 0
            hit = lanes[~busy & (kind >= 280)]
            colour[hit], next_[hit] = cache[cache_at[hit] + s[hit] - 280], after[hit]
            fresh = lanes[~busy & (kind < 280)]
            if len(fresh):
                q, length = after[fresh], s[fresh] - 256
                n = _LENGTH_EXTRA[length]
                left[fresh] = _LENGTH_BASE[length] + field(q, n)
                q = q + n
                far = entries[base[4, fresh] + (windows[q] >> shift[4, fresh])]
                q = q + (far & 15)
                n = _LENGTH_EXTRA[far >> 4]
                d = _LENGTH_BASE[far >> 4] + field(q, n)
                near = np.where(d <= 120, d, 0)
                short = np.where(_PLANE_Y[near] > 0, np.maximum(1, _PLANE_X[near] + _PLANE_Y[near] * width[fresh]), _PLANE_X[near])
                back[fresh] = np.where(d <= 120, short, d - 120)
                next_[fresh] = q + n
                if (back[fresh] > i).any() or (i + left[fresh] > pixels[fresh]).any():
                    raise ValueError("reference out of the image")
            next_[lanes[busy]] = now[lanes[busy]]
            copies = lanes[left[lanes] > 0]
            if len(copies):
                colour[copies] = out[start[copies] + i - back[copies]]
                left[copies] -= 1
            copying = len(copies) > 0
        else:
            copying = False
        out[start[:active] + i] = colour
        cache[cache_at[:active] + (colour * np.uint32(0x1E35A7BD) >> down[:active])] = colour
        p[:active] = np.minimum(next_, stop[:active] + 1)
    if (p > stop).any():
        raise ValueError("image data ends early")
    found: list[np.ndarray] = [out] * len(images)
    for k, a, n in zip(order, start.tolist(), pixels.tolist()):
        found[k] = out[a : a + n]
    return found


def _copied(out: list[int], d: int, length: int) -> list[int]:
    some = out[len(out) - d : len(out) - d + length]
    while len(some) < length:  # what overlaps itself repeats
        some += some[: length - len(some)]
    return some


def _split(argb: np.ndarray) -> np.ndarray:
    """(..., 4) bytes: alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _join(parts: np.ndarray) -> np.ndarray:
    p = parts.astype(np.uint32) & np.uint32(255)
    return p[..., 0] << np.uint32(24) | p[..., 1] << np.uint32(16) | p[..., 2] << np.uint32(8) | p[..., 3]


def _predict(mode: int, left, up, up_left, up_right):
    """The predicted (4,) bytes of a pixel."""
    average = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode <= 4:
        return (left, up, up_right, up_left)[mode - 1]
    if mode == 5:
        return average(average(left, up_right), up)
    if mode <= 10:
        return (average(left, up_left), average(left, up), average(up_left, up), average(up, up_right), average(average(left, up_left), average(up, up_right)))[mode - 6]
    if mode == 11:
        return left if abs(up - up_left).sum() < abs(left - up_left).sum() else up
    if mode == 12:
        return np.clip(left + up - up_left, 0, 255)
    mean = average(left, up)
    half = mean - up_left
    return np.clip(mean + np.where(half < 0, -((-half) // 2), half // 2), 0, 255)


def _predictor(pixels: np.ndarray, modes: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """(h, w, 4) residuals to pixels (undo) or back."""
    h, w, _ = pixels.shape
    if (modes == modes.flat[0]).all() and modes.flat[0] in (1, 2):
        return _straight(pixels, int(modes.flat[0]), undo)
    out, source = pixels.copy(), None if undo else pixels
    for y in range(h):
        for x in range(w):
            known = out if undo else source
            if not (x or y):
                guess = np.array([255, 0, 0, 0])
            elif not y:
                guess = known[0, x - 1]
            elif not x:
                guess = known[y - 1, 0]
            else:  # the pixel to the upper right of a row's last is the row's own first
                right = known[y - 1, x + 1] if x + 1 < w else known[y, 0]
                guess = _predict(int(modes[y >> bits, x >> bits]), known[y, x - 1], known[y - 1, x], known[y - 1, x - 1], right)
            out[y, x] = (pixels[y, x] + guess if undo else pixels[y, x] - guess) & 255
    return out


def _straight(pixels: np.ndarray, mode: int, undo: bool) -> np.ndarray:
    """The predictors "left" (1) and "above" (2) of a whole image: running sums, or differences."""
    black = np.array([255, 0, 0, 0])
    if undo:
        out = pixels.copy()
        out[0, 0] += black
        if mode == 1:
            out[:, 0] = np.cumsum(out[:, 0], axis=0)
            return np.cumsum(out, axis=1) & 255
        out[0] = np.cumsum(out[0], axis=0)
        return np.cumsum(out, axis=0) & 255
    out = np.empty_like(pixels)
    if mode == 1:
        out[:, 1:] = pixels[:, 1:] - pixels[:, :-1]
        out[1:, 0] = pixels[1:, 0] - pixels[:-1, 0]
    else:
        out[1:] = pixels[1:] - pixels[:-1]
        out[0, 1:] = pixels[0, 1:] - pixels[0, :-1]
    out[0, 0] = pixels[0, 0] - black
    return out & 255


def _signed(x: np.ndarray) -> np.ndarray:
    return np.where(x > 127, x - 256, x)


def _cross_colour(p: np.ndarray, blocks: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    h, w, _ = p.shape
    e = _signed(blocks[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits])  # alpha, red_to_blue, green_to_blue, green_to_red
    green, out, sign = _signed(p[..., 2]), p.copy(), 1 if undo else -1
    red = (p[..., 1] + sign * ((e[..., 3] * green) >> 5)) & 255
    out[..., 1] = red
    out[..., 3] = (p[..., 3] + sign * (((e[..., 2] * green) >> 5) + ((e[..., 1] * _signed(red if undo else p[..., 1])) >> 5))) & 255
    return out


def _opened(data: bytes) -> tuple[Bits, int, int, int]:
    """The bits of a file's image, its width, height, and whether it has alpha."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    bits = Bits(bytes(data[21 : 20 + size]))
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return bits, width, height, has_alpha


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of items whose sizes add up to at most `most`, or that are one item."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if len(sizes) > begin:
        yield begin, len(sizes)


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """The files as `decode` gives them; those of one prefix group without transforms are decoded together."""
    found: list[np.ndarray | None] = [None] * len(files)
    together, places = [], []
    for k, data in enumerate(files):
        bits, width, height, has_alpha = _opened(data)
        begin = bits.at
        if not bits.read(1):
            cache_bits = bits.read(4) if bits.read(1) else 0
            if cache_bits <= 11 and not bits.read(1):
                sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
                together.append((bits, width, width * height, [_read_lengths(bits, n) for n in sizes], cache_bits))
                places.append((k, width, height, has_alpha))
                continue
        bits.at = begin
        found[k] = _finished(bits, width, height, has_alpha)
    try:
        for a, b in slices([n for _, _, n, *_ in together], READ_TOGETHER):
            for (k, width, height, has_alpha), argb in zip(places[a:b], _decoded_together(together[a:b])):
                found[k] = _plain(argb, width, height, has_alpha)
    except IndexError:
        raise ValueError("image data ends early") from None
    return found


def decode(data: bytes) -> np.ndarray:
    """One WebP file to an (h, w, 4) array of red, green, blue, alpha."""
    return _finished(*_opened(data))


def _plain(argb: np.ndarray, width: int, height: int, has_alpha: int) -> np.ndarray:
    out, four = np.empty((height * width, 4), np.uint8), np.ascontiguousarray(argb).view(np.uint8).reshape(-1, 4)
    out[:, :3], out[:, 3] = four[:, 2::-1], four[:, 3] if has_alpha else 255
    return out.reshape(height, width, 4)


def _finished(bits: Bits, width: int, height: int, has_alpha: int) -> np.ndarray:
    full, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in undo]:
            raise ValueError("a transform repeats")
        if kind < 2:
            shift = 2 + bits.read(3)
            shape = -(-height >> shift), -(-width >> shift)
            undo.append((kind, shift, _split(_pixels(bits, shape[1], shape[0], False)).reshape(*shape, 4), width))
        elif kind == 2:
            undo.append((kind, 0, None, width))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_split(_pixels(bits, n, 1, False)), axis=0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, pack, table, width))
            width = -(-width >> pack)
    argb = _pixels(bits, width, height, True)
    if not undo:
        return _plain(argb, width, height, has_alpha)
    p = _split(argb).reshape(height, width, 4)
    for kind, shift, extra, w in reversed(undo):
        if kind == 0:
            p = _predictor(p, extra[..., 2] & 15, shift, True)
        elif kind == 1:
            p = _cross_colour(p, extra, shift, True)
        elif kind == 2:
            p[..., 1] = (p[..., 1] + p[..., 2]) & 255
            p[..., 3] = (p[..., 3] + p[..., 2]) & 255
        else:
            index, per = p[..., 2], 8 >> shift
            if shift:
                index = ((index[..., None] >> (np.arange(1 << shift) * per)) & ((1 << per) - 1)).reshape(height, -1)[:, :w]
            p = np.where((index < len(extra))[..., None], extra[np.minimum(index, len(extra) - 1)], 0)
    out = p[..., [1, 2, 3, 0]].astype(np.uint8)
    if not has_alpha:
        out[..., 3] = 255
    return out.reshape(height, full, 4)


def split_files(data: bytes) -> list[bytes]:
    """The WebP files that lie behind each other in data."""
    out, at = [], 0
    while at < len(data):
        n = 8 + struct.unpack_from("<I", data, at + 4)[0]
        out.append(data[at : at + n])
        at += n
    return out


class _Writer:
    """Fields of bits, least significant first; packed together at the end."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.widths: list[int] = []

    def write(self, value: int, n: int) -> None:
        self.values.append(value)
        self.widths.append(n)

    def many(self, values: np.ndarray, widths: np.ndarray) -> None:
        self._close()
        self.parts.append((values, widths))

    def _close(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values), np.array(self.widths)))
            self.values, self.widths = [], []

    def bytes(self) -> bytes:
        self._close()
        values, widths = (np.concatenate(x) for x in zip(*self.parts))
        there = np.flatnonzero(widths)
        values, widths = values[there], widths[there]
        last = np.cumsum(widths)
        at = np.arange(last[-1], dtype=np.int32) - np.repeat((last - widths).astype(np.int32), widths)
        return np.packbits((np.repeat(values, widths) >> at & 1).astype(np.uint8), bitorder="little").tobytes()


def _riff(body: bytes) -> bytes:
    body = b"\x2f" + body
    pad = len(body) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad


def _tree(a: list[int]) -> list[int]:
    """Huffman code lengths of two or more ascending counts, worked out in place."""
    n, root, leaf = len(a), 0, 2
    a[0] += a[1]
    for k in range(1, n - 1):
        if leaf >= n or a[root] < a[leaf]:
            a[k], a[root] = a[root], k
            root += 1
        else:
            a[k] = a[leaf]
            leaf += 1
        if leaf >= n or (root < k and a[root] < a[leaf]):
            a[k], a[root] = a[k] + a[root], k
            root += 1
        else:
            a[k] += a[leaf]
            leaf += 1
    a[n - 2] = 0
    for k in range(n - 3, -1, -1):
        a[k] = a[a[k]] + 1
    free, depth, root, k = 1, 0, n - 2, n - 1
    while free > 0:
        inner = 0
        while root >= 0 and a[root] == depth:
            inner += 1
            root -= 1
        while free > inner:
            a[k] = depth
            k -= 1
            free -= 1
        free, depth = 2 * inner, depth + 1
    return a


def _rounded(counts: np.ndarray) -> list[int]:
    """Complete code lengths near the counts' own information, the most frequent symbols shortened while there is room."""
    n = np.ceil(np.log2(counts.sum() / counts) - 1e-9).astype(np.int64)
    most = int(n.max())
    order, lengths = np.argsort(n, kind="stable").tolist(), n.tolist()
    room = (1 << most) - int((1 << (most - n)).sum())
    while room:
        for k in order:
            w = 1 << (most - lengths[k])
            if w <= room and lengths[k] > 1:
                lengths[k] -= 1
                room -= w
                if not room:
                    break
    return lengths


def _code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Code lengths of at most `most` bits, Huffman's where many symbols pay for working them out; a symbol alone has length 1."""
    lengths, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if most == 15 and counts.sum() < 1 << 14:
        lengths[used] = _rounded(counts[used])
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    n, floor = counts[used], 1
    while True:
        found = _tree(n.tolist())
        if found[0] <= most:
            lengths[used] = found
            return lengths
        floor *= 2
        n = np.maximum(n, floor)


_REVERSED = np.array([int(f"{x:015b}"[::-1], 2) for x in range(1 << 15)])


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's code, its highest bit lowest, and its width; one symbol alone takes no bits."""
    codes, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if len(used) < 2:
        return codes, codes.copy()
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used]
    size = 1 << (15 - n)
    codes[used] = _REVERSED[np.cumsum(size) - size]
    return codes, lengths


def _zeros(symbols: list[int], extra: dict[int, int], n: int) -> None:
    """Adds a run of n zeros: symbols, and by place what those of runs say beside."""
    while n:
        if n < 3:
            symbols += [0] * n
            return
        run = min(n, 138)
        extra[len(symbols)] = run - 3 if run < 11 else run - 11
        symbols.append(17 if run < 11 else 18)
        n -= run


def _write_code(out: _Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used = np.flatnonzero(counts)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        a, *b = used.tolist() or [0]
        out.write(1 | len(b) << 1 | 4 | a << 3, 11)
        if b:
            out.write(b[0], 8)
        return _canonical((counts > 0).astype(np.int64))
    lengths = _code_lengths(counts)
    symbols, extra, at = [], {}, 0
    edges = np.flatnonzero(np.diff(used) > 1) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(used)]):  # runs of zeros, then lengths
        k, m = int(used[a]), int(used[b - 1]) + 1
        _zeros(symbols, extra, k - at)
        symbols += lengths[k:m].tolist()
        at = m
    _zeros(symbols, extra, len(counts) - at)
    tokens = np.array(symbols)
    first = _code_lengths(np.bincount(tokens, minlength=19), 7)
    order = first[_ORDER_OF].tolist()
    n = max(4, 1 + max(i for i, x in enumerate(order) if x))
    out.write((n - 4) << 1 | sum(x << 5 + 3 * i for i, x in enumerate(order[:n])), 5 + 3 * n)
    out.write(0, 1)
    code, width = _canonical(first)
    value, bits = np.zeros((len(tokens), 2), np.int64), np.zeros((len(tokens), 2), np.int64)
    value[:, 0], bits[:, 0] = code[tokens], width[tokens]
    runs = list(extra)
    value[runs, 1], bits[runs, 1] = list(extra.values()), np.where(tokens[runs] == 17, 3, 7)
    out.many(value.ravel(), bits.ravel())
    return _canonical(lengths)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, extra values and widths of lengths or distances."""
    value = value - 1
    top = np.frexp(np.maximum(value, 1).astype(np.float64))[1] - 1
    extra = np.where(value < 4, 0, top - 1)
    return np.where(value < 4, value, 2 * top + ((value >> extra) & 1)), np.where(value < 4, 0, value & ((1 << extra) - 1)), extra


@lru_cache(64)
def _short_distances(width: int) -> dict[int, int]:
    """Distance to the least of its 120 short codes."""
    out: dict[int, int] = {}
    for k, (dx, dy) in enumerate(_PLANE, 1):
        out.setdefault(max(1, dx + dy * width) if dy else dx, k)
    return out


def _repeats(argb: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy references of three pixels or more: starts, lengths, distance codes."""
    n, none = len(argb), np.empty(0, np.int64)
    if n < 4:
        return none, none, none
    c = argb.astype(np.uint64)
    key = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    key = np.sort(key & ~np.uint64(0xFFFFF) | np.arange(n - 2, dtype=np.uint64))  # an image has fewer than 2^20 pixels
    same = np.flatnonzero(key[1:] >> np.uint64(20) == key[:-1] >> np.uint64(20))
    if not len(same):
        return none, none, none
    before, start = ((key[k] & np.uint64(0xFFFFF)).astype(np.int64) for k in (same, same + 1))  # the last place of the same three
    by = np.argsort(start)
    short, at, found = _short_distances(width), 0, []
    for i, j in zip(start[by].tolist(), before[by].tolist()):
        if i < at:
            continue
        most, length = min(n - i, 4096), 0
        for step in (32, most):
            step = min(step, most)
            differ = (argb[i : i + step] != argb[j : j + step]).argmax() if step else 0
            length = int(differ) if argb[i + differ] != argb[j + differ] else step
            if length < step:
                break
        if length >= 3:
            found.append((i, length, short.get(i - j, i - j + 120)))
            at = i + length
    return tuple(np.array(x) for x in zip(*found)) if found else (none, none, none)


_TIMES_LOG = np.arange(1 << 16) * np.log2(np.maximum(np.arange(1 << 16), 1))


def _times_log(counts: np.ndarray) -> float:
    """Sum of c log2 c."""
    if counts.max(initial=0) < 1 << 16:
        return float(_TIMES_LOG[counts].sum())
    return float((counts * np.log2(np.maximum(counts, 1))).sum())


def _bits_for(*counts: np.ndarray) -> float:
    """Bits that codes of the best lengths take for symbols with these counts."""
    return sum(_times_log(c.sum(keepdims=True)) - _times_log(c) for c in counts)


def _write_pixels(out: _Writer, argb: np.ndarray, width: int, top: bool, cache_bits: int | None = None, references: bool = True) -> None:
    """cache_bits: None takes a colour cache where it saves a good part of the bits."""
    n = len(argb)
    start, length, code = _repeats(argb, width) if references else (np.empty(0, np.int64),) * 3
    covered = np.zeros(n + 1, np.int8)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + length, -1)
    own = np.flatnonzero(np.cumsum(covered[:-1], dtype=np.int8) == 0)
    parts = [(argb[own] >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0, 24)]
    size, extra, widths = _prefix(length)
    far = _prefix(code)
    refs = np.bincount(size, minlength=24)
    plain = [np.bincount(p, minlength=256) for p in parts]
    hit, green = np.zeros(len(own), bool), parts[0]
    counts = [np.concatenate([plain[0], refs]), *plain[1:]]
    if cache_bits != 0:
        k = cache_bits or max(2, min(10, n.bit_length() - 3))
        slot = (argb * np.uint32(0x1E35A7BD) >> np.uint32(32 - k)).astype(np.uint16)
        order = np.argsort(slot, kind="stable")
        there = np.zeros(n, bool)  # the last pixel with the same place in the cache was the same
        there[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
        hits = there[own]
        left = [np.bincount(p[~hits], minlength=256) for p in parts]
        with_cache = [np.concatenate([left[0], refs, np.bincount(slot[own][hits], minlength=1 << k)]), *left[1:]]
        if cache_bits or _bits_for(*with_cache) + 4 * np.count_nonzero(with_cache[0][280:]) < 0.94 * _bits_for(*counts):  # some four bits name a code's length
            cache_bits, hit, counts, green = k, hits, with_cache, np.where(hits, 280 + slot[own].astype(np.int64), green)
    out.write(int(bool(cache_bits)) | (cache_bits or 0) << 1, 5 if cache_bits else 1)
    if top:
        out.write(0, 1)
    codes = [_write_code(out, c) for c in (*counts, np.bincount(far[0], minlength=40))]
    tokens, refs = len(own), len(start)
    value, bits = np.zeros((tokens + refs, 4), np.int64), np.zeros((tokens + refs, 4), np.int64)
    value[:tokens, 0], bits[:tokens, 0] = codes[0][0][green], codes[0][1][green]
    for k in (1, 2, 3):
        value[:tokens, k], bits[:tokens, k] = codes[k][0][parts[k]], np.where(hit, 0, codes[k][1][parts[k]])
    if refs:
        value[tokens:] = np.stack([codes[0][0][256 + size], extra, codes[4][0][far[0]], far[1]], 1)
        bits[tokens:] = np.stack([codes[0][1][256 + size], widths, codes[4][1][far[0]], far[2]], 1)
        order = np.argsort(np.concatenate([own, start]), kind="stable")
        value, bits = value[order], bits[order]
    out.many(value.ravel(), bits.ravel())


def _factors(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> tuple[int, int, int]:
    """green_to_red, green_to_blue and red_to_blue (in 32nds) of the least squares over signed bytes."""
    r, g, b = (x.astype(np.float64) for x in (red, green, blue))
    fit = lambda x, y: int(np.clip(round(32 * float(x @ y) / max(1.0, float(x @ x))), -127, 127))
    to_blue = fit(g, b)
    return fit(g, r), to_blue, fit(r, b - to_blue / 32 * g)


def encode(pixels: np.ndarray, transforms: tuple[str, ...] = (), cache_bits: int | None = None, references: bool = True, mode: int = 11) -> bytes:
    """An (h, w, 4) array of red, green, blue, alpha; transforms of palette, predictor, cross, green, in that order of use."""
    h, w, _ = pixels.shape
    out, p = _Writer(), pixels[..., [3, 0, 1, 2]].astype(np.int64)
    out.write(w - 1, 14)
    out.write(h - 1, 14)
    out.write(int((pixels[..., 3] != 255).any()), 1)
    out.write(0, 3)
    shift = 9 if mode in (1, 2) else 4  # of one mode for the whole image there is no use in small blocks
    for name in transforms:
        out.write(1, 1)
        shape = -(-h >> shift), -(-p.shape[1] >> shift)
        if name == "predictor":
            out.write(0, 2)
            out.write(shift - 2, 3)
            _write_pixels(out, np.full(shape[0] * shape[1], 255 << 24 | mode << 8, np.uint32), shape[1], False)
            p = _predictor(p, np.full(shape, mode), shift, False)
        elif name == "cross":
            out.write(1, 2)
            out.write(shift - 2, 3)
            to_red, to_blue, red_to_blue = _factors(*(_signed(p[..., k]).ravel() for k in (1, 2, 3)))
            block = np.array([255, red_to_blue, to_blue, to_red]) & 255
            _write_pixels(out, _join(np.tile(block, (shape[0] * shape[1], 1))), shape[1], False)
            p = _cross_colour(p, np.tile(block, (*shape, 1)), shift, False)
        elif name == "green":
            out.write(2, 2)
            p[..., 1] = (p[..., 1] - p[..., 2]) & 255
            p[..., 3] = (p[..., 3] - p[..., 2]) & 255
        else:
            table, index = np.unique(_join(p).ravel(), return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            out.write(3, 2)
            out.write(len(table) - 1, 8)
            parts = _split(table)
            _write_pixels(out, _join(np.diff(parts, axis=0, prepend=0) & 255), len(table), False)
            pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            index = np.pad(index.reshape(h, w), ((0, 0), (0, -w % (1 << pack)))).reshape(h, -1, 1 << pack)
            packed = (index << (np.arange(1 << pack) * (8 >> pack))).sum(-1)
            p = np.zeros((*packed.shape, 4), np.int64)
            p[..., 0], p[..., 2] = 255, packed
    out.write(0, 1)
    _write_pixels(out, _join(p).ravel(), p.shape[1], True, cache_bits, references)
    return _riff(out.bytes())


def _in_groups(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the stretches of values that begin at first (none is empty)."""
    return np.add.reduceat(values, first)


class Images:
    """Many RGB images of 192 pixels a row and ROWS rows at most, as one array of pixels."""

    def __init__(self, payloads: list[np.ndarray]):
        self.data = np.concatenate(payloads)
        self.rows = np.array([len(p) // ROW for p in payloads])
        self.pixels = WIDTH * self.rows
        self.first = np.cumsum(self.pixels) - self.pixels
        self.image = np.repeat(np.arange(len(payloads)), self.pixels)
        self.red, self.green, self.blue = (np.ascontiguousarray(self.data[k::3]) for k in range(3))
        self.colour = self.red.astype(np.uint32) << np.uint32(16) | self.green.astype(np.uint32) << np.uint32(8) | self.blue

    def __len__(self) -> int:
        return len(self.rows)

    def entropy(self, *channels: np.ndarray) -> np.ndarray:
        """For each image: bits that the channels' bytes take by codes of their own."""
        return sum(_entropies(np.bincount(self.image << 8 | c, minlength=len(self) << 8).reshape(-1, 256)) for c in channels)

    def factors(self) -> np.ndarray:
        """green_to_red, green_to_blue and red_to_blue (in 32nds) of each image's least squares over signed bytes."""
        r, g, b = (x.view(np.int8).astype(np.int64) for x in (self.red, self.green, self.blue))
        gg, gr, gb, rr, rb = (_in_groups(x, self.first).astype(float) for x in (g * g, g * r, g * b, r * r, r * b))
        fit = lambda xy, xx: np.clip(np.rint(32 * xy / np.maximum(xx, 1)), -127, 127).astype(np.int64)
        to_blue = fit(gb, gg)
        return np.stack([fit(gr, gg), to_blue, fit(rb - to_blue / 32 * gr, rr)])

    def choose(self) -> list[tuple[tuple[str, ...], int]]:
        """For each image the transforms, and the predictor, that leave the least entropy."""
        ways: list[tuple[tuple[str, ...], int]] = [((), 0), (("green",), 0), (("predictor",), 1), (("predictor",), 2), (("cross",), 0), (("palette",), 0)]
        red, green, blue = self.red, self.green, self.blue
        costs = [self.entropy(red, green, blue), 100 + self.entropy(red - green, green, blue - green)]
        for step in (3, ROW):
            rest = self.data.copy()
            rest[step:] -= self.data[:-step]
            for k in range(step):  # what lies before an image isn't its own
                rest[3 * self.first + k] = self.data[3 * self.first + k]
            costs.append(150 + self.entropy(*(rest[k::3] for k in range(3))))
        to_red, to_blue, red_to_blue = self.factors()[:, self.image]
        g, r = green.view(np.int8).astype(np.int64), red.view(np.int8).astype(np.int64)
        costs.append(150 + self.entropy(red - (to_red * g >> 5).astype(np.uint8), green, blue - ((to_blue * g >> 5) + (red_to_blue * r >> 5)).astype(np.uint8)))
        colours = np.sort(self.image.astype(np.uint64) << np.uint64(24) | self.colour)
        new = np.concatenate([[True], colours[1:] != colours[:-1]])
        n = np.bincount((colours[new] >> np.uint64(24)).astype(np.int64), minlength=len(self))
        costs.append(np.where(n <= 256, n * 20 + self.pixels * np.log2(np.maximum(2, n)) / np.where(n > 16, 1, 2), np.inf))
        return [ways[k] for k in np.argmin(costs, axis=0).tolist()]


def _entropies(counts: np.ndarray) -> np.ndarray:
    """For each row of counts: bits of codes of the best lengths."""
    total = counts.sum(axis=1)
    return _TIMES_LOG[np.minimum(total, len(_TIMES_LOG) - 1)] - _TIMES_LOG[np.minimum(counts, len(_TIMES_LOG) - 1)].sum(axis=1)


def _rounded_rows(counts: np.ndarray, most: int) -> np.ndarray:
    """For each row a complete code of at most `most` bits near the counts' own information; one symbol alone has length 1."""
    used = counts > 0
    n = np.where(used, np.ceil(np.log2(np.maximum(1, counts.sum(axis=1, keepdims=True)) / np.maximum(counts, 1)) - 1e-9), most + 1).astype(np.int64).clip(1)
    n = np.where(used, np.minimum(n, most), n)
    order = np.argsort(n, axis=1, kind="stable")
    lengths, rows = np.take_along_axis(n, order, 1), np.arange(len(n))
    deep = int(used.sum(axis=1).max(initial=0))
    lengths = lengths[:, :deep]
    valid = lengths <= most
    many = valid.sum(axis=1) > 1
    room = (1 << most) - np.where(valid, 1 << (most - np.minimum(lengths, most)), 0).sum(axis=1)
    while ((room < 0) & many).any():  # too many short ones: the rarest that can become longer
        for k in range(deep - 1, -1, -1):
            can = (room < 0) & many & valid[:, k] & (lengths[:, k] < most)
            room += np.where(can, 1 << (most - 1 - np.minimum(lengths[:, k], most - 1)), 0)
            lengths[:, k] += can
    while ((room > 0) & many).any():
        for k in range(deep):
            w = 1 << (most - np.minimum(lengths[:, k], most))
            can = (w <= room) & many & valid[:, k] & (lengths[:, k] > 1)
            room -= np.where(can, w, 0)
            lengths[:, k] -= can
    out = np.zeros(counts.shape, np.int64)
    out[rows[:, None], order[:, :deep]] = np.where(valid, lengths, 0)
    return out


def _canonical_rows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of lengths the codes, their highest bits lowest, and their widths; one symbol alone takes no bits."""
    size = np.where(lengths > 0, 1 << (15 - lengths), 0)
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    ordered = np.take_along_axis(size, order, 1)
    codes = np.empty_like(lengths)
    np.put_along_axis(codes, order, np.cumsum(ordered, axis=1) - ordered, 1)
    some = (lengths > 0).sum(axis=1, keepdims=True) > 1
    return np.where(some & (lengths > 0), _REVERSED[codes & 0x7FFF], 0), np.where(some, lengths, 0)


Fields = tuple[np.ndarray, np.ndarray, np.ndarray]  # rows (in ascending order), values, widths


def _code_fields(lengths: np.ndarray) -> Fields:
    """How each row's code lengths are written."""
    m, size = lengths.shape
    used = (lengths > 0).sum(axis=1)
    simple = np.flatnonzero(used < 2)
    fields = [(simple, (5 | lengths[simple].argmax(axis=1) << 3).astype(np.uint64), np.full(len(simple), 11))] if len(simple) else []
    normal = np.flatnonzero(used >= 2)
    if len(normal):
        n = lengths[normal]
        zero = np.pad(n == 0, ((0, 0), (1, 1)))
        edge = np.diff(zero.astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        run = np.nonzero(edge == -1)[1] - begin
        rest = run % 138
        plain_row, plain_at = np.nonzero(n)
        parts = [(plain_row, plain_at, n[plain_row, plain_at], 0)]  # row, place, symbol, what it says beside
        for k in range(size // 138):
            some = run >= 138 * (k + 1)
            parts.append((row[some], begin[some] + k, 18, 127))
        behind = begin + run // 138
        for some, symbol, least in ((rest >= 11, 18, 11), ((rest >= 3) & (rest < 11), 17, 3)):
            parts.append((row[some], behind[some], symbol, rest[some] - least))
        for k in (0, 1):
            some = (rest > k) & (rest < 3)
            parts.append((row[some], behind[some] + k, 0, 0))
        row = np.concatenate([x[0] for x in parts])
        order = np.argsort(row * (size + 1) + np.concatenate([x[1] for x in parts]))
        symbol, beside = (np.concatenate([np.broadcast_to(np.asarray(x[k]), x[0].shape) for x in parts])[order] for k in (2, 3))
        row = row[order]
        first = _rounded_rows(np.bincount(row * 19 + symbol, minlength=19 * len(normal)).reshape(-1, 19), 7)
        code, width = _canonical_rows(first)
        listed = first[:, _ORDER_OF]
        count = np.maximum(4, 19 - np.argmax(listed[:, ::-1] > 0, axis=1))
        head = (count - 4).astype(np.uint64) << np.uint64(1)
        for k in range(19):
            head |= listed[:, k].astype(np.uint64) << np.uint64(5 + 3 * k)
        fields.append((normal, head, 5 + 3 * count + 1))
        at = row * 19 + symbol
        wide = width.ravel()[at]
        value = code.ravel()[at].astype(np.uint64) | beside.astype(np.uint64) << wide.astype(np.uint64)
        fields.append((normal[row], value, wide + np.where(symbol == 17, 3, np.where(symbol == 18, 7, 0))))
    row, value, width = (np.concatenate(x) for x in zip(*fields))
    order = np.argsort(row, kind="stable")
    return row[order], value[order], width[order]


def _packed(m: int, sections: list[Fields]) -> list[bytes]:
    """The fields of each row, section by section, as bytes."""
    sums = [np.bincount(row, width, m).astype(np.int64) for row, _, width in sections]
    size = sum(sums)
    words = -(-size // 64) + 1
    base = 64 * (np.cumsum(words) - words)
    out = np.zeros(int(words.sum()), np.uint64)
    before = base.copy()
    for (row, value, width), total in zip(sections, sums):
        there = np.flatnonzero(width)
        row, value, width = row[there], value[there], width[there]
        if len(row):
            last = np.cumsum(width)
            begin = np.cumsum(total) - total  # bits of the section before each row's
            at = before[row] + last - width - begin[row]
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            low, high = value << shift, value >> np.uint64(1) >> (np.uint64(63) - shift)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[first]] += np.add.reduceat(low, first)
            out[word[first] + 1] += np.add.reduceat(high, first)
        before += total
    data = out.tobytes()
    return [data[a : a + n] for a, n in zip((base >> 3).tolist(), (-(-size // 8)).tolist())]


_CACHE_BITS = 6


def _runs(images: Images) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy references of three pixels or more to the last place of the same three: starts, lengths, distances."""
    c, n = images.colour, len(images.colour)
    key = c.astype(np.uint64)
    key = key[:-2] * np.uint64(0x9E3779B97F4A7C15) + key[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + key[2:] * np.uint64(0x165667B19E3779F9)
    key ^= key >> np.uint64(29)
    bits = max(1, (n - 1).bit_length())
    mask = np.uint64((1 << bits) - 1)
    key = np.sort(key & ~mask | np.arange(n - 2, dtype=np.uint64))
    same = np.flatnonzero(key[1:] >> np.uint64(bits) == key[:-1] >> np.uint64(bits))
    j, i = ((key[k] & mask).astype(np.int64) for k in (same, same + 1))
    ok = (c[i] == c[j]) & (c[i + 1] == c[j + 1]) & (c[i + 2] == c[j + 2]) & (images.image[i + 2] == images.image[j])
    order = np.argsort(i[ok])
    i, d = i[ok][order], (i - j)[ok][order]
    if not len(i):
        return i, i, i
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1]) | (images.image[i[1:]] != images.image[i[:-1]])]))
    ends = i[np.concatenate([first[1:], [len(i)]]) - 1] + 3
    at, found = 0, []
    for k, (a, b) in enumerate(zip(i[first].tolist(), ends.tolist())):
        a = max(a, at)
        if b - a >= 3:
            found.append((a, b - a, k))
            at = b
    start, length, k = (np.array(x) for x in zip(*found))
    return start, length, d[first][k]


_SHORT = np.zeros(8 * WIDTH + 16, np.int64)
for _k in range(120, 0, -1):
    _dx, _dy = _PLANE[_k - 1]
    _SHORT[max(1, _dx + _dy * WIDTH) if _dy else _dx] = _k


def _encoded(images: Images) -> list[bytes]:
    """WebP files of the images, without transforms: codes, references, and a colour cache where it saves a good part of the bits."""
    m, n, image = len(images), len(images.colour), images.image
    start, length, distance = _runs(images)
    short = np.where(distance < len(_SHORT), _SHORT[np.minimum(distance, len(_SHORT) - 1)], 0)
    size, size_extra, size_bits = _prefix(length)
    far, far_extra, far_bits = _prefix(np.where(short > 0, short, distance + 120))
    edge = np.zeros(n + 1, np.int8)
    edge[start] += 1
    edge[start + length] -= 1
    own = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8) == 0)
    whole = images.colour | np.uint32(255 << 24)
    slot = (whole * np.uint32(0x1E35A7BD) >> np.uint32(32 - _CACHE_BITS)).astype(np.int64)
    bits = n.bit_length()
    key = np.sort((image << _CACHE_BITS | slot) << bits | np.arange(n))
    at = key & ((1 << bits) - 1)
    there = np.zeros(n, bool)  # the last pixel with the same place in the cache was the same
    there[at[1:]] = (key[1:] >> bits == key[:-1] >> bits) & (images.colour[at[1:]] == images.colour[at[:-1]])
    hit = there[own]
    wide = 280 + (1 << _CACHE_BITS)

    def counts(hit: np.ndarray) -> list[np.ndarray]:
        lit, out = own[~hit], []
        green = np.concatenate([image[lit] * wide + images.green[lit], image[own[hit]] * wide + 280 + slot[own[hit]], image[start] * wide + 256 + size])
        out.append(np.bincount(green, minlength=m * wide).reshape(m, wide))
        return out + [np.bincount(image[lit] << 8 | c[lit], minlength=m << 8).reshape(m, 256) for c in (images.red, images.blue)]

    with_cache, without = counts(hit), counts(np.zeros(len(own), bool))
    cached = sum(map(_entropies, with_cache)) + 4 * (with_cache[0][:, 280:] > 0).sum(axis=1) < 0.94 * sum(map(_entropies, without))  # some four bits name a code's length
    hit &= cached[image[own]]
    used = [np.where(cached[:, None], a, b) for a, b in zip(with_cache, without)]
    used.append(np.bincount(image[start] * 40 + far, minlength=m * 40).reshape(m, 40))
    lengths = [_rounded_rows(c, 12) for c in used]
    codes = [_canonical_rows(x) for x in lengths]
    every = np.arange(m)
    head = np.uint64(WIDTH - 1) | (images.rows - 1).astype(np.uint64) << np.uint64(14) | np.where(cached, 1 | _CACHE_BITS << 1, 0).astype(np.uint64) << np.uint64(33)
    sections: list[Fields] = [(every, head, np.where(cached, 39, 35))]  # no alpha, version 0, no transform; cache, one group
    plain, rich = np.flatnonzero(~cached), np.flatnonzero(cached)
    for some, most in ((plain, 280), (rich, wide)):
        if len(some):
            row, value, width = _code_fields(lengths[0][some, :most])
            sections.append((some[row], value, width))
    sections += [_code_fields(lengths[1]), _code_fields(lengths[2])]
    sections.append((every, np.full(m, 5 | 255 << 3, np.uint64), np.full(m, 11)))  # alpha is 255
    sections.append(_code_fields(lengths[3]))
    value, width = np.zeros(n, np.uint64), np.zeros(n, np.int64)

    def put(at: np.ndarray, *pieces: tuple[np.ndarray, np.ndarray]) -> None:
        v, w = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
        for a, b in pieces:
            v |= a.astype(np.uint64) << w.astype(np.uint64)
            w = w + b
        value[at], width[at] = v, w

    code = lambda k, row, symbol: (codes[k][0][row, symbol], codes[k][1][row, symbol])
    lit, hits = own[~hit], own[hit]
    put(lit, code(0, image[lit], images.green[lit]), code(1, image[lit], images.red[lit]), code(2, image[lit], images.blue[lit]))
    put(hits, code(0, image[hits], 280 + slot[hits]))
    put(start, code(0, image[start], 256 + size), (size_extra, size_bits), code(3, image[start], far), (far_extra, far_bits))
    sections.append((image, value, width))
    return [_riff(body) for body in _packed(m, sections)]


def store_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload of whole rows as WebP files, with the transforms, references and cache that pay; none depends on the others."""
    parts, owner = [], []
    for k, payload in enumerate(payloads):
        data = np.frombuffer(payload, np.uint8)
        for a in range(0, len(data), ROW * ROWS):
            parts.append(data[a : a + ROW * ROWS])
            owner.append(k)
    files: list[bytes] = []
    for a, b in slices([len(p) // 3 for p in parts], TOGETHER):
        some = parts[a:b]
        ways = Images(some).choose()
        simple = [k for k, (transforms, _) in enumerate(ways) if not transforms]
        made = dict(zip(simple, _encoded(Images([some[k] for k in simple])))) if simple else {}
        for k, (transforms, mode) in enumerate(ways):
            if transforms:
                pixels = np.full((len(some[k]) // ROW, WIDTH, 4), 255, np.uint8)
                pixels[..., :3] = some[k].reshape(-1, WIDTH, 3)
                made[k] = encode(pixels, transforms, mode=mode or 11)
        files += [made[k] for k in range(len(some))]
    out: list[list[bytes]] = [[] for _ in payloads]
    for k, f in zip(owner, files):
        out[k].append(f)
    return [b"".join(x) for x in out]


def store(payload: bytes) -> bytes:
    return store_all([payload])[0]


def features(images: list[np.ndarray]) -> str:
    """Size, mean of each channel, and a 64-bit average hash of the pixel arrays."""
    count = sum(i.shape[0] * i.shape[1] for i in images)
    means = [sum(int(i[..., c].sum(dtype=np.int64)) for i in images) / count for c in range(3)]
    flat = np.concatenate([i[..., :3].reshape(-1, ROW // 8).sum(axis=1, dtype=np.int64) for i in images])
    cells = np.add.reduceat(flat, np.arange(64) * len(flat) // 64) if len(flat) >= 64 else np.resize(flat, 64)
    bits = np.packbits(cells / np.diff(np.append(np.arange(64) * len(flat) // 64, len(flat))).clip(1) > flat.mean()) if len(flat) >= 64 else np.packbits(cells > flat.mean())
    return f"{WIDTH}x{count // WIDTH}:" + ",".join(f"{m:.3f}" for m in means) + ":" + bits.tobytes().hex()


def decode_media(media: DataFrame, column: str = "media", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, number in the column, width, height, pixels as RGBA bytes) of a binary column of WebP files."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out += [(i, k, a.shape[1], a.shape[0], a.tobytes()) for k, a in enumerate(map(decode, split_files(data)))] if data is not None else [(i, None, None, None, None)]
        kinds = (batch.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["id", "number", "width", "height", "pixels"])

    kind = dict(media.dtypes)[id_col]
    return arrow_map(media.select(id_col, column), rows, f"id {kind}, number int, width int, height int, pixels binary").withColumnRenamed("id", id_col)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of each document's text."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(store_all([padded(d) for d in data]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, n_bytes long, media binary")


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores each text's payload, reads the stored bytes back, and describes both."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        new, known = list(dict.fromkeys(texts)), {}  # copies are stored alike
        for a, b in slices([len(t) // 3 + WIDTH for t in new], READ_TOGETHER):
            stored = store_all([padded(t) for t in new[a:b]])
            files = [split_files(media) for media in stored]
            images = iter(decode_all([f for some in files for f in some]))
            for data, media, some in zip(new[a:b], stored, files):
                own = [next(images) for _ in some]
                back = b"".join(np.ascontiguousarray(x[..., :3]).tobytes() for x in own)
                known[data] = len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(own)
        out = [(i, *known[t]) for i, t in zip(batch.column(0).to_pylist(), texts)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
