"""Progressive JPEG coefficients, read and written for many files at once.

``decode`` accumulates DC and AC scans, spectral selection and successive approximation, into
coefficient arrays.  Restart intervals are independent, so all intervals of one scan in a
batch of files are decoded in step with numpy: one table look-up serves every interval.  A
file without restart markers is one interval for each scan and is read the same way, slowly.
``rgb`` inverse-transforms in exact integer arithmetic, upsamples chroma and converts colours.
``encode`` writes coefficient blocks losslessly as a 4:2:0 file with a restart at every unit.
"""

from __future__ import annotations

import functools
import re
import struct
from typing import NamedTuple

import numpy as np

#: Zigzag order of an 8x8 block, by its rule.
ZIGZAG = np.array(
    sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
)
_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
_U = np.uint64


class Huffman(NamedTuple):
    bits: bytes  # number of codes of each length 1..16
    values: bytes

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length of each symbol."""
        code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        c = k = 0
        for length, count in enumerate(self.bits, 1):
            for _ in range(count):
                code[self.values[k]], size[self.values[k]] = c, length
                c, k = c + 1, k + 1
            c <<= 1
        return code, size

    def table(self) -> np.ndarray:
        """For each 16 bits ahead: length << 8 | symbol."""
        t = np.full(1 << 16, 16 << 8, np.int64)
        c = k = 0
        for length, count in enumerate(self.bits, 1):
            for _ in range(count):
                t[c << (16 - length) : (c + 1) << (16 - length)] = length << 8 | self.values[k]
                c, k = c + 1, k + 1
            c <<= 1
        return t


def _table_of(groups: dict[int, list[int]]) -> Huffman:
    return Huffman(bytes(len(groups.get(n, [])) for n in range(1, 17)), bytes(v for n in range(1, 17) for v in groups.get(n, [])))


def _direct(h: Huffman) -> np.ndarray:
    """For each 16 bits ahead of an AC symbol: value + 2**15 << 32 | bits used << 8 | symbol, or 0 if they do not hold all bits."""
    t = h.table()
    used, size = t >> 8, t & 15
    total = used + size
    fits = (total <= 16) & ((size > 0) | (t & 255 == 0xF0) | (t & 255 == 0))
    x = (np.arange(1 << 16) >> np.maximum(16 - total, 0)) & ((1 << size) - 1)
    value = np.where(size > 0, _extend(x, size), 0)
    return np.where(fits, (value + 32768) << 32 | total << 8 | t & 255, 0)


_DC = _table_of({4: list(range(12))})
_short = {2: [0x05], 3: [0x06, 0x04], 4: [0x03, 0x07, 0x00]}
_AC = _table_of(
    _short | {10: [x for x in [r << 4 | s for r in range(16) for s in range(1, 11)] + [r << 4 for r in range(1, 16)] if x not in (5, 6, 4, 3, 7)]}
)
_REFINE = _table_of({1: [0x00], 6: [r << 4 | 1 for r in range(16)] + [r << 4 for r in range(1, 16)]})
_tables: dict[tuple, np.ndarray] = {}


def _lookup(h: Huffman, direct: bool = False) -> np.ndarray:
    if (h, direct) not in _tables:
        if len(_tables) > 200:  # files of many origins
            _tables.clear()
        _tables[h, direct] = _direct(h) if direct else h.table()
    return _tables[h, direct]


class Scan(NamedTuple):
    parts: tuple[tuple[int, int, int], ...]  # component, DC table, AC table
    first: int
    last: int
    high: int
    low: int
    restart: int
    dc: tuple[Huffman | None, ...]
    ac: tuple[Huffman | None, ...]


class File(NamedTuple):
    width: int
    height: int
    shape: tuple[tuple[int, int, int], ...]  # of each component: h, v, quantisation table
    quant: tuple[bytes, ...]
    scans: tuple[Scan, ...]
    data: tuple[bytes, ...]
    comment: bytes

    def grid(self, c: int) -> tuple[int, int]:
        """Rows and columns of stored blocks, whole units."""
        hm, vm = max(s[0] for s in self.shape), max(s[1] for s in self.shape)
        h, v, _ = self.shape[c]
        return -(-self.height // (8 * vm)) * v, -(-self.width // (8 * hm)) * h


@functools.lru_cache(maxsize=256)
def _huffman(body: bytes) -> list[tuple[int, Huffman]]:
    out = []
    while body:
        n = sum(body[1:17])
        out.append((body[0], Huffman(body[1:17], body[17 : 17 + n])))
        body = body[17 + n :]
    return out


def parse(blob: bytes) -> File:
    """Headers and entropy-coded segments of a progressive JPEG file; raises ValueError for other files."""
    if blob[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, restart = 2, 0
    quant: list[bytes] = [bytes(64)] * 4
    dc: list[Huffman | None] = [None] * 4
    ac: list[Huffman | None] = [None] * 4
    frame = None
    scans, data, comment = [], [], b""
    while at < len(blob) - 1:
        mark = blob[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        (size,) = struct.unpack(">H", blob[at + 2 : at + 4])
        body = blob[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisation")
                quant[body[0] & 3], body = body[1:65], body[65:]
        elif mark == 0xC4:
            for k, h in _huffman(body):
                (ac if k >> 4 else dc)[k & 3] = h
        elif mark == 0xC2:
            _, h, w, n = struct.unpack(">BHHB", body[:6])
            ids = [body[6 + 3 * i] for i in range(n)]
            frame = (w, h, tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)))
        elif mark in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive file")
        elif mark == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif mark == 0xFE:
            comment = body
        elif mark == 0xDA:
            n = body[0]
            parts = tuple((ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n))
            a, b, hl = body[1 + 2 * n : 4 + 2 * n]
            scans.append(Scan(parts, a, b, hl >> 4, hl & 15, restart, tuple(dc), tuple(ac)))
            m = _END.search(blob, at)
            end = m.start() if m else len(blob)
            data.append(blob[at:end])
            at = end
    if frame is None:
        raise ValueError("no frame")
    return File(*frame, tuple(quant), tuple(scans), tuple(data), comment)


class _Bits:
    """Unstuffed data of many segments and the bit each one is read at."""

    def __init__(self, pieces: list[bytes], lanes: list[int]) -> None:
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
        after = raw[ff + 1] if len(ff) else np.zeros(0, np.uint8)
        marks = ff[(after >= 0xD0) & (after <= 0xD7)]
        drop = np.zeros(len(raw), bool)
        drop[ff[after == 0] + 1] = True
        drop[marks] = drop[marks + 1] = True
        kept = np.cumsum(~drop)
        starts = np.sort(np.concatenate([np.r_[0, ends[:-1]], marks + 2]))
        place = np.searchsorted(starts, np.r_[0, ends[:-1]])
        first = np.r_[0, kept][np.minimum(starts, len(raw))]
        if len(starts) != sum(lanes):  # markers missing or too many: lanes beyond the end read ones
            first = np.concatenate([first[p : p + n] if p + n <= len(first) else np.r_[first[p:], np.full(p + n - len(first), kept[-1])] for p, n in zip(place, lanes, strict=True)])
        self.buffer = np.concatenate([raw[~drop], np.full(16, 255, np.uint8)])
        n = len(self.buffer) - 8
        self.words = np.ndarray((n,), ">u8", self.buffer, strides=(1,))
        self.pos = first.astype(np.int64) * 8
        self.top = (n - 1) * 8

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next 57 bits of each lane, at the top of 64."""
        p = np.minimum(self.pos[lanes], self.top)
        return self.words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)


def _extend(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(x < (1 << np.maximum(n - 1, 0)), x - (1 << n) + 1, x)


def _take(w: np.ndarray, used: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits of w after the first ``used`` ones."""
    return ((w << used.astype(np.uint64)) >> (_U(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _dc_first(bits: _Bits, scan: Scan, blocks: np.ndarray, comps: np.ndarray, coef: np.ndarray) -> None:
    pred = np.zeros((len(blocks), 4), np.int64)
    lanes = np.arange(len(blocks))
    for j in range(blocks.shape[1]):
        on = lanes[blocks[:, j] >= 0]
        if not len(on):
            continue
        c = int(comps[j])
        w = bits.peek(on)
        t = _lookup(scan.dc[scan.parts[c][1]])[(w >> _U(48)).astype(np.int64)]
        used, size = t >> 8, t & 255
        pred[on, c] += np.where(size > 0, _extend(_take(w, used, size), size), 0)
        bits.pos[on] += used + size
        coef[blocks[on, j], 0] = pred[on, c] << scan.low


def _dc_refine(bits: _Bits, scan: Scan, blocks: np.ndarray, coef: np.ndarray) -> None:
    lanes = np.arange(len(blocks))
    for j in range(blocks.shape[1]):
        on = lanes[blocks[:, j] >= 0]
        coef[blocks[on, j], 0] |= (bits.peek(on) >> _U(63)).astype(np.int64) << scan.low
        bits.pos[on] += 1


def _ac_first(bits: _Bits, scan: Scan, blocks: np.ndarray, coef: np.ndarray) -> None:
    huff = scan.ac[scan.parts[0][2]]
    table, direct = _lookup(huff), _lookup(huff, True)
    flat = coef.reshape(-1)
    eob = np.zeros(len(blocks), np.int64)
    low = 1 << scan.low
    for j in range(blocks.shape[1]):
        have = blocks[:, j] >= 0
        on = np.flatnonzero(have & (eob == 0))
        eob[have & (eob > 0)] -= 1
        at = blocks[on, j] * 64 + scan.first  # place of the next coefficient
        end = blocks[on, j] * 64 + scan.last
        pos = bits.pos[on]
        while len(on):
            p = np.minimum(pos, bits.top)
            w = bits.words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
            d = direct[(w >> _U(48)).astype(np.int64)]
            run, size, used, x = (d >> 4) & 15, d & 15, (d >> 8) & 255, (d >> 32) - 32768
            odd = np.flatnonzero(d == 0)
            if len(odd):  # more than 16 bits, or a run of blocks
                t = table[(w[odd] >> _U(48)).astype(np.int64)]
                r, n = (t >> 4) & 15, t & 15
                more = np.where(n > 0, n, np.where(r < 15, r, 0))
                v = _take(w[odd], t >> 8, more)
                run[odd], size[odd], used[odd] = r, n, (t >> 8) + more
                x[odd] = np.where(n > 0, _extend(v, n), v)
            pos += used
            plain = size > 0
            if plain.all():
                at += run
                np.minimum(at, end, out=at)
                flat[at] = x * low
                at += 1
                go = at <= end
            else:
                stop = ~plain & (run < 15)
                at += np.where(stop, 0, run)
                hit = plain & (at <= end)
                flat[at[hit]] = x[hit] * low
                eob[on[stop]] = (1 << run[stop]) - 1 + x[stop]
                at += 1
                go = ~stop & (at <= end)
            if not go.all():
                bits.pos[on] = pos
                on, at, end, pos = on[go], at[go], end[go], pos[go]


def _corrections(bits: _Bits, lanes: np.ndarray, base: np.ndarray, scan: Scan, flat: np.ndarray, one: int) -> None:
    """The correction bits of whole blocks that hold no new coefficient."""
    span = np.arange(scan.first, scan.last + 1)
    at = base[:, None] + span
    old = flat[at]
    had = old != 0
    nth = np.cumsum(had, axis=1)
    two = np.stack([bits.peek(lanes), np.zeros(len(lanes), np.uint64)], axis=1)
    bits.pos[lanes] += 32
    two[:, 1] = bits.peek(lanes)
    bits.pos[lanes] += nth[:, -1] - 32
    ahead = np.ascontiguousarray((two >> _U(32)).astype(">u4")).view(np.uint8).reshape(len(lanes), 8)
    ahead = np.unpackbits(ahead, axis=1).astype(np.int64)
    bit = np.take_along_axis(ahead, np.maximum(nth - 1, 0), axis=1)
    flat[at] = old + np.sign(old) * bit * one


def _ac_refine(bits: _Bits, scan: Scan, blocks: np.ndarray, coef: np.ndarray) -> None:
    table = _lookup(scan.ac[scan.parts[0][2]])
    flat = coef.reshape(-1)
    one = 1 << scan.low
    eob = np.zeros(len(blocks), np.int64)

    def symbols(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads a symbol in each lane: the zeros to pass (-1: none, the block run began) and the new value."""
        w = bits.peek(lanes)
        t = table[(w >> _U(48)).astype(np.int64)]
        used, r, s = t >> 8, (t >> 4) & 15, t & 15
        more = np.where(s > 0, 1, np.where(r < 15, r, 0))
        x = _take(w, used, more)
        bits.pos[lanes] += used + more
        stop = (s == 0) & (r < 15)
        eob[lanes[stop]] = ((1 << r) + x)[stop]
        return np.where(stop, -1, r), np.where(s > 0, np.where(x > 0, one, -one), 0)

    for j in range(blocks.shape[1]):
        on = np.flatnonzero(blocks[:, j] >= 0)
        run = np.full(len(on), -1)
        new = np.zeros(len(on), np.int64)
        free = np.flatnonzero(eob[on] == 0)
        run[free], new[free] = symbols(on[free])
        rest = eob[on] > 0
        if rest.any():
            _corrections(bits, on[rest], blocks[on[rest], j] * 64, scan, flat, one)
            eob[on[rest]] -= 1
            on, run, new = on[~rest], run[~rest], new[~rest]
        base = blocks[on, j] * 64
        for k in range(scan.first, scan.last + 1 if len(on) else 0):
            old = flat[base + k]
            need = np.flatnonzero((run < 0) & (eob[on] == 0))
            if len(need):
                run[need], new[need] = symbols(on[need])
            had = old != 0
            at = np.flatnonzero(had)
            lanes = on[at]
            bit = (bits.peek(lanes) >> _U(63)).astype(np.int64)
            bits.pos[lanes] += 1
            flat[base[at] + k] = old[at] + np.sign(old[at]) * bit * one
            zero = ~had & (run >= 0)
            put = zero & (run == 0)
            flat[base[put] + k] = new[put]
            run[zero] -= 1
        eob[on] = np.maximum(eob[on] - 1, 0)


def decode(files: list[File]) -> list[list[np.ndarray]]:
    """Coefficients of each file and component, (rows, columns, 64) in zigzag order."""
    base: list[list[int]] = []
    total = 0
    for f in files:
        base.append([])
        for r, c in (f.grid(c) for c in range(len(f.shape))):
            base[-1].append(total)
            total += r * c
    coef = np.zeros((total, 64), np.int64)
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(files):
        groups.setdefault((f.scans, tuple(s[:2] for s in f.shape)), []).append(i)
    for (scans, _), members in groups.items():
        for s, scan in enumerate(scans):
            rows, lanes, comps = [], [], np.zeros(1, np.int64)
            for i in members:
                f = files[i]
                units, comps = _units(f.width, f.height, f.shape, scan.parts)
                units = units + base[i][0]
                step = scan.restart or len(units)
                n = -(-len(units) // step)
                if n * step > len(units):
                    units = np.concatenate([units, np.full((n * step - len(units), units.shape[1]), -1)])
                rows.append(units.reshape(n, -1))
                lanes.append(n)
            width = max(r.shape[1] for r in rows)
            blocks = np.concatenate([r if r.shape[1] == width else np.pad(r, ((0, 0), (0, width - r.shape[1])), constant_values=-1) for r in rows])
            comps = np.tile(comps, width // len(comps))
            bits = _Bits([files[i].data[s] for i in members], lanes)
            if scan.first == 0:
                if scan.high:
                    _dc_refine(bits, scan, blocks, coef)
                else:
                    _dc_first(bits, scan, blocks, comps, coef)
            elif scan.high:
                _ac_refine(bits, scan, blocks, coef)
            else:
                _ac_first(bits, scan, blocks, coef)
    out = []
    for f, b in zip(files, base, strict=True):
        out.append([coef[b[c] : b[c] + f.grid(c)[0] * f.grid(c)[1]].reshape(*f.grid(c), 64) for c in range(len(f.shape))])
    return out


@functools.lru_cache(maxsize=8192)
def _units(width: int, height: int, shape: tuple, parts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers, from the file's first block, of each coded unit of a scan, and the scan's component of each."""
    hm, vm = max(s[0] for s in shape), max(s[1] for s in shape)
    grids = [(-(-height // (8 * vm)) * v, -(-width // (8 * hm)) * h) for h, v, _ in shape]
    base = [sum(r * c for r, c in grids[:i]) for i in range(len(shape))]
    if len(parts) == 1:
        c = parts[0][0]
        h, v, _ = shape[c]
        rows, cols = -(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)
        return (base[c] + np.arange(rows)[:, None] * grids[c][1] + np.arange(cols)[None, :]).reshape(-1, 1), np.zeros(1, np.int64)
    cols, owner = [], []
    for p, (c, _, _) in enumerate(parts):
        h, v, _ = shape[c]
        rows, wide = grids[c]
        grid = base[c] + np.arange(rows * wide).reshape(rows // v, v, wide // h, h)
        cols.append(grid.transpose(0, 2, 1, 3).reshape(-1, h * v))
        owner += [p] * (h * v)
    return np.concatenate(cols, axis=1), np.array(owner)


_BASIS = np.array([[round((2**12) * (0.5**0.5 if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16)) for x in range(8)] for u in range(8)], float)


def plane(coef: np.ndarray, quant: bytes) -> np.ndarray:
    """8-bit samples of a component: integers below 2**53 in float64, so the sums are exact in any order."""
    rows, cols, _ = coef.shape
    nat = np.zeros((rows * cols, 64))
    nat[:, ZIGZAG] = coef.reshape(-1, 64) * np.frombuffer(quant, np.uint8)
    x = nat.reshape(-1, 8) @ _BASIS
    x = x.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _BASIS
    x = np.floor(x / 2**24 + 128.5).clip(0, 255).astype(np.uint8)
    return x.reshape(rows, cols, 8, 8).transpose(0, 3, 1, 2).reshape(rows * 8, cols * 8)


def rgb(f: File, coef: list[np.ndarray]) -> np.ndarray:
    """Full-resolution (height, width, 3) tensor of 8-bit samples."""
    hm, vm = max(s[0] for s in f.shape), max(s[1] for s in f.shape)
    full = [plane(c, f.quant[q]) for (_, _, q), c in zip(f.shape, coef, strict=True)]

    def up(p: np.ndarray, c: int) -> np.ndarray:
        h, v, _ = f.shape[c]
        p = p if vm == v else p.repeat(vm // v, axis=0)
        return (p if hm == h else p.repeat(hm // h, axis=1))[: f.height, : f.width]

    y = up(full[0], 0)
    if len(full) == 1:
        return np.repeat(y[:, :, None], 3, axis=2)
    out = np.empty((f.height, f.width, 3), np.uint8)
    y = y.astype(np.int16)
    if f.shape[1] == f.shape[2]:  # what chroma adds is computed before it is upsampled
        green = up(_GREEN_B[full[1]] + _GREEN_R[full[2]] >> 16, 1)
    else:
        green = _GREEN_B[up(full[1], 1)] + _GREEN_R[up(full[2], 2)] >> 16
    for i, add in enumerate((up(_RED[full[2]], 2), green, up(_BLUE[full[1]], 1))):
        np.clip(y + add.astype(np.int16), 0, 255, out=out[:, :, i], casting="unsafe")
    return out


_level = np.arange(256) - 128
_RED = ((91881 * _level + 32768) >> 16).astype(np.int16)
_BLUE = ((116130 * _level + 32768) >> 16).astype(np.int16)
_GREEN_B, _GREEN_R = -22554 * _level + 32768, -46802 * _level

# ---- writing ----

WIDTH = 4000  # units in a row at most: 64,000 samples


def _pack(val: np.ndarray, nb: np.ndarray, lane: np.ndarray, n: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes with stuffing and a restart marker after each, and where each lane ends."""
    ends = np.cumsum(nb)
    bits = np.bincount(lane, weights=nb, minlength=n).astype(np.int64)
    before = np.cumsum(bits) - bits
    size = (bits + 7) // 8
    start = np.cumsum(size) - size
    off = ends - nb - before[lane] + start[lane] * 8
    raw = np.zeros(int(size.sum()) + 8, np.uint8)
    v = val << (64 - nb - (off & 7)).astype(np.uint64)
    reach = (off & 7) + nb
    for j in range(int(-(-reach.max() // 8)) if len(reach) else 0):
        some = slice(None) if j == 0 else np.flatnonzero(reach > 8 * j)
        np.add.at(raw, (off[some] >> 3) + j, ((v[some] >> _U(56 - 8 * j)) & _U(255)).astype(np.uint8))
    raw = raw[:-8]
    raw[start + size - 1] |= ((1 << (size * 8 - bits)) - 1).astype(np.uint8)
    ff = raw == 255
    of = np.repeat(np.arange(n), size)
    shift = np.cumsum(ff)
    pos = np.arange(len(raw)) + shift - ff + 2 * of
    end = start + size - 1
    stop = pos[end] + 1 + ff[end]
    out = np.zeros(len(raw) + int(shift[-1]) + 2 * n, np.uint8)
    out[pos] = raw
    out[stop] = 255
    out[stop + 1] = 0xD0 + index % 8
    return out, stop


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category and additional bits of signed values."""
    size = np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
    return size, np.where(v >= 0, v, v + (1 << size) - 1).astype(np.uint64)


def _write_dc(dc: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of an interleaved DC scan; dc is (units, 6)."""
    lane = np.repeat(np.arange(len(dc)), 6)
    if high:
        return ((dc >> low) & 1).astype(np.uint64).reshape(-1), np.ones(dc.size, np.int64), lane
    v = dc >> low
    d = np.stack([v[:, 0], v[:, 1] - v[:, 0], v[:, 2] - v[:, 1], v[:, 3] - v[:, 2], v[:, 4], v[:, 5]], axis=1).reshape(-1)
    size, more = _magnitude(d)
    code, length = _DC.codes()
    return code[size] << size.astype(np.uint64) | more, length[size] + size, lane


def _joined(val: np.ndarray, nb: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of three neighbours as one: at most 51 bits."""
    n, w = val.shape
    if w % 3:
        val = np.pad(val, ((0, 0), (0, -w % 3)))
        nb = np.pad(nb, ((0, 0), (0, -w % 3)))
    v, b = val.reshape(-1, 3), nb.reshape(-1, 3)
    out = (v[:, 0] << b[:, 1].astype(np.uint64) | v[:, 1]) << b[:, 2].astype(np.uint64) | v[:, 2]
    return out, b.sum(axis=1), np.repeat(rows, len(out) // max(n, 1))


def _merged(fast: tuple, slow: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of two sets of blocks in the order of blocks; the slow ones are numbered by ``rows``."""
    lane = np.concatenate([fast[2], rows[slow[2]]])
    order = np.argsort(lane, kind="stable")
    return np.concatenate([fast[0], slow[0]])[order], np.concatenate([fast[1], slow[1]])[order], lane[order]


def _write_ac(q: np.ndarray, first: int, last: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    band = q[:, first : last + 1]
    v = np.sign(band) * (np.abs(band) >> low)
    full = (v != 0).all(axis=1)
    if full.any():
        rows = np.flatnonzero(full)
        fast = _joined(*(t[v[rows] + 1024] for t in _FULL), rows)
        return fast if full.all() else _merged(fast, _write_ac(q[~full], first, last, low), np.flatnonzero(~full))
    b, k = np.nonzero(v)
    x = v[b, k]
    head = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
    run = k - np.where(head, -1, np.r_[-1, k[:-1]] if len(k) else k) - 1
    size, more = _magnitude(x)
    code, length = _AC.codes()
    sym = (run & 15) << 4 | size
    val = code[sym] << size.astype(np.uint64) | more
    nb = length[sym] + size
    for z in range(1, 4):  # a run of 16 zeros goes ahead of the symbol, up to three times
        far = run >= 16 * z
        val = np.where(far, code[0xF0] << nb.astype(np.uint64) | val, val)
        nb = nb + far * length[0xF0]
    top = np.full(len(q), -1)
    top[b] = k
    short = np.flatnonzero(top < last - first)
    where = np.searchsorted(b, short, side="right")
    return (
        np.insert(val, where, code[0]), np.insert(nb, where, length[0]), np.insert(b, where, short),
    )


def _full_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of each value -1024..1024 after no zeros."""
    v = np.arange(-1024, 1025)
    size, more = _magnitude(v)
    code, length = _AC.codes()
    return code[size] << size.astype(np.uint64) | more, length[size] + size


_FULL = _full_tables()


def _write_refine(q: np.ndarray, first: int, last: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of an AC refinement scan: correction bits, each group of them after its symbol."""
    band = q[:, first : last + 1]
    n, width = band.shape
    mag = np.abs(band) >> low
    full = (mag > 1).all(axis=1)
    if width == 63 and full.any():  # the end of the block, then 63 corrections: 64 bits
        rows = np.flatnonzero(full)
        eight = np.zeros((len(rows), 64), np.uint8)
        eight[:, 1:] = mag[rows] & 1
        val = np.packbits(eight, axis=1).reshape(-1).view(">u4").astype(np.uint64)
        fast = (val, np.full(len(val), 32), np.repeat(rows, 2))
        return fast if full.all() else _merged(fast, _write_refine(q[~full], first, last, low), np.flatnonzero(~full))
    new, had, zero = mag == 1, mag > 1, mag == 0
    later = np.cumsum(new[:, ::-1], axis=1)[:, ::-1] - new > 0  # a new coefficient follows
    closed = later | new  # inside a group that a new coefficient ends
    # zeros before, within the group that begins after the last new coefficient
    z = np.cumsum(zero, axis=1)
    mark = np.where(new, z, 0)
    from_ = np.zeros_like(z)
    from_[:, 1:] = np.maximum.accumulate(mark, axis=1)[:, :-1]
    inside = z - zero - from_
    sub = np.where(closed, inside // 16, 0)
    group = np.cumsum(new, axis=1) - new
    gid = group * 8 + sub
    begin = np.ones((n, width), bool)
    begin[:, 1:] = gid[:, 1:] != gid[:, :-1]
    code, length = _REFINE.codes()
    # the symbol a group begins with: its own end if that is a new coefficient, 16 zeros, or the end of the block
    b, k = np.nonzero(begin)
    stop = np.r_[k[1:], 0]
    stop = np.where(np.r_[b[1:] == b[:-1], False], stop, width) - 1
    ends_new = new[b, stop]
    run = np.where(ends_new, inside[b, stop] % 16, 0)
    sym = np.where(ends_new, run << 4 | 1, np.where(closed[b, stop], 0xF0, 0))
    sign = (band[b, stop] > 0) & ends_new
    val = np.zeros((n, width), np.uint64)
    nb = np.zeros((n, width), np.int64)
    val[b, k] = code[sym] << ends_new.astype(np.uint64) | sign.astype(np.uint64)
    nb[b, k] = length[sym] + ends_new
    val = np.where(had, val << _U(1) | (mag & 1).astype(np.uint64), val)
    nb = nb + had
    lane = np.repeat(np.arange(n), width)
    some = nb.reshape(-1) > 0
    return val.reshape(-1)[some], nb.reshape(-1)[some], lane[some]


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([255, mark]) + struct.pack(">H", len(body) + 2) + body


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1]) * 64)
_TABLES = _segment(0xC4, b"".join(bytes([k]) + t.bits + t.values for k, t in ((0, _DC), (16, _AC), (17, _REFINE)))) + _segment(0xDD, b"\x00\x01")
#: component (None: all three together), first, last, high, low
_SCRIPT = (
    (None, 0, 0, 0, 1), (0, 1, 5, 0, 1), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1), (0, 6, 63, 0, 1),
    (0, 1, 63, 1, 0), (1, 1, 63, 1, 0), (2, 1, 63, 1, 0), (None, 0, 0, 1, 0),
)


def encode(images: list[np.ndarray], comments: list[bytes]) -> list[bytes]:
    """Files that hold coefficient blocks (n, 64), zigzag order, in units of four Y, one Cb, one Cr block."""
    units, shapes = [], []
    for x in images:
        m = max(1, -(-len(x) // 6))
        cols = min(m, WIDTH)
        rows = -(-m // cols)
        u = np.zeros((rows * cols * 6, 64), np.int64)
        u[: len(x)] = x
        units.append(u.reshape(-1, 6, 64))
        shapes.append((rows, cols))
    q = np.concatenate(units)
    luma = np.concatenate([u[:, :4].reshape(r, c, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64) for u, (r, c) in zip(units, shapes, strict=True)])
    planes = [luma, q[:, 4], q[:, 5]]
    size = np.array([len(u) for u in units])
    out = [
        [_HEAD, _segment(0xC2, struct.pack(">BHHB", 8, r * 16, c * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES, _segment(0xFE, note)]
        for (r, c), note in zip(shapes, comments, strict=True)
    ]
    for comp, first, last, high, low in _SCRIPT:
        if comp is None:
            entries, n = _write_dc(q[:, :, 0], low, high), size
            parts = bytes([3, 1, 0, 2, 0, 3, 0])
        else:
            write = _write_refine if high else _write_ac
            entries, n = write(planes[comp], first, last, low), size * (4 if comp == 0 else 1)
            parts = bytes([1, comp + 1, int(high > 0)])
        begin = np.cumsum(n) - n
        index = np.arange(n.sum()) - np.repeat(begin, n)
        data, stop = _pack(*entries, int(n.sum()), index)
        head = _segment(0xDA, parts + bytes([first, last, high << 4 | low]))
        at = 0
        for i, e in enumerate(stop[begin + n - 1].tolist()):
            out[i] += [head, data[at:e].tobytes()]
            at = e + 2
    return [b"".join([*o, b"\xff\xd9"]) for o in out]
