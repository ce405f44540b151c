"""Progressive JPEG: scans accumulate into coefficient arrays, to RGB tensors.

``decode`` reads progressive Huffman JPEGs (8 bits, 1 or 3 components, any
sampling, restart intervals, interleaved DC scans).  Spectral-selection and
successive-approximation scans add up in one coefficient array a component; numpy
inverse-transforms it, chroma is repeated to full resolution, and a tensor of
height x width x 3 bytes comes out.  Entropy decoding runs in step over all restart
intervals of all images of a batch: a lane is an interval, a step a numpy call, so
files with an interval a block (as ``encode`` writes them) decode at array speed.

``encode`` stores a payload losslessly as quantised coefficients, the format's
unit: byte - 128 is a coefficient in zigzag order, 64 to a block, quantiser 1, four
luma blocks to one of each chroma (2 x 2 sampling), in five scans a component: DC
without its last bit, that bit, AC 1-5 and 6-63 without their last bit, that bit.

Defined cases: null and empty texts store one block of zero bytes; equal texts give
equal bytes and features (transforms are exact in integers); long texts make
images of several rows; repeated rows give repeated results; an empty table gives
no rows; damaged or unsupported files raise ValueError; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import common, words

#: Blocks coded at once; macroblocks a row at most.
CHUNK, ROW = 1 << 11, 512
#: Bytes of texts or files in a group that is coded together.
GROUP_BYTES = 2 << 20

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))

# 13-bit fixed-point basis: products are exact integers in doubles.
_BASIS = np.round(np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * (1 << 13))

_SIZE = np.array([int(i).bit_length() for i in range(1 << 11)], np.uint8)


def _table(short: list[int], every: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT body, codes and lengths by symbol: ``short`` get 4 bits, the rest 9."""
    rest = [s for s in every if s not in short]
    body = bytes([0, 0, 0, len(short), 0, 0, 0, 0, len(rest), 0, 0, 0, 0, 0, 0, 0, *short, *rest])
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for i, s in enumerate(short):
        code[s], length[s] = i, 4
    for i, s in enumerate(rest):
        code[s], length[s] = (len(short) << 5) + i, 9
    return body, code, length


_AC_BODY, _AC, _AC_LEN = _table([0x05, 0x06, 0x04, 0x03, 0x02, 0x01, 0x00, 0x07], [r << 4 | s for r in range(16) for s in range(8)])
_DC_BODY, _DC, _DC_LEN = _table(list(range(9)), list(range(9)))


def _pack(value: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each row of slots, filled up to bytes with ones; bytes of each row."""
    bits = length.sum(1)
    fill = (-bits.astype(np.int64)) % 8
    value = np.concatenate([value, ((1 << fill) - 1).astype(np.uint64)[:, None]], 1).ravel()
    length = np.concatenate([length, fill.astype(np.uint64)[:, None]], 1).ravel()
    some = length > 0
    value, length = value[some], length[some]
    end = np.cumsum(length)
    at = end - length
    total = int(end[-1]) if len(end) else 0
    word, stop = at >> np.uint64(6), (at & np.uint64(63)) + length
    over = stop > 64
    high = np.where(over, value >> np.where(over, stop - np.uint64(64), 0).astype(np.uint64), value << np.where(over, 0, np.uint64(64) - stop).astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(high, dtype=np.uint64)])
    edge = np.searchsorted(word, np.arange(total // 64 + 2, dtype=np.uint64))
    out = sums[edge[1:]] - sums[edge[:-1]]
    out = np.concatenate([out, np.zeros(1, np.uint64)])
    out[word[over] + np.uint64(1)] += value[over] << (np.uint64(128) - stop[over])
    return out.byteswap().view(np.uint8)[: total // 8], (bits.astype(np.int64) + fill) // 8


def _stuff(data: np.ndarray, size: np.ndarray, rst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bytes with zeros after 255s and its restart marker behind it; ends."""
    twice = data == 255
    first = np.cumsum(size) - size
    extra = np.concatenate([[0], np.cumsum(twice)])
    length = size + extra[first + size] - extra[first] + 2
    end = np.cumsum(length)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    at = np.arange(len(data)) + extra[:-1] + 2 * np.repeat(np.arange(len(size)), size)
    out[at] = data
    out[end - 2], out[end - 1] = 255, 0xD0 + rst % 8
    return out, end


def _first(coef: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of an AC scan lo..hi without the last bit."""
    v = coef[:, lo : hi + 1]
    a = np.abs(v) >> 1
    on = a > 0
    k = np.arange(v.shape[1])
    last = np.maximum.accumulate(np.where(on, k, -1), 1)
    before = np.concatenate([np.full((len(v), 1), -1), last[:, :-1]], 1)
    run = np.where(on, k - before - 1, 0)
    size = _SIZE[a].astype(np.uint64)
    symbol = (run & 15) << 4 | size.astype(np.int64)
    mag = np.where(v > 0, a, (1 << size.astype(np.int64)) - 1 - a).astype(np.uint64)
    value, length = _AC[symbol] << size | mag, _AC_LEN[symbol] + size
    for z in (1, 2, 3):
        more = run >= 16 * z
        if more.any():
            value = np.where(more, value | _AC[0xF0] << length, value)
            length = np.where(more, length + _AC_LEN[0xF0], length)
    value, length = np.where(on, value, 0), np.where(on, length, 0)
    tail = last[:, -1:] < hi - lo
    return np.concatenate([value, np.where(tail, _AC[0], 0)], 1).astype(np.uint64), np.concatenate([length, np.where(tail, _AC_LEN[0], 0)], 1).astype(np.uint64)


def _refine(coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the last bit of AC 1..63: slot 2k is k's correction bit, 2k + 1 the
    symbol that begins behind k."""
    n = len(coef)
    a = np.abs(coef)
    known, new = a > 1, a == 1
    known[:, 0] = new[:, 0] = False
    zero = a == 0
    zero[:, 0] = False
    k = np.arange(64)
    value, length = np.zeros((n, 128), np.uint64), np.zeros((n, 128), np.uint64)
    value[:, 0::2], length[:, 0::2] = np.where(known, a & 1, 0), known
    if new.any():
        zeros = np.cumsum(zero, 1)
        base = np.maximum.accumulate(np.where(new, zeros, 0), 1)
        before = np.concatenate([np.zeros((n, 1), base.dtype), base[:, :-1]], 1)
        since = zeros - before  # zeros since the last new one, this one included
        latest = np.where(new, k, 0).max(1)
        jump = zero & (since > 0) & (since % 16 == 0) & (k < latest[:, None])
        ends = new | jump
        at = np.maximum.accumulate(np.where(ends, k, 0), 1)
        start = np.concatenate([np.zeros((n, 1), at.dtype), at[:, :-1]], 1)
        r, c = np.nonzero(ends)
        symbol = np.where(new[r, c], (since[r, c] % 16) << 4 | 1, 0xF0)
        sign = new[r, c].astype(np.uint64)
        slot = 2 * start[r, c] + 1
        value[r, slot] = _AC[symbol] << sign | (coef[r, c] > 0).astype(np.uint64) * sign
        length[r, slot] = _AC_LEN[symbol] + sign
        stop = at[:, -1]
    else:
        stop = np.zeros(n, np.int64)
    r = np.flatnonzero(stop < 63)
    value[r, 2 * stop[r] + 1], length[r, 2 * stop[r] + 1] = _AC[0], _AC_LEN[0]
    return value, length


def _dc(coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = coef[:, :1] >> 1  # an interval a block: the prediction is 0
    a = np.abs(v)
    size = _SIZE[a].astype(np.uint64)
    mag = np.where(v > 0, a, (1 << size.astype(np.int64)) - 1 - a).astype(np.uint64)
    return _DC[size] << size | mag, _DC_LEN[size] + size


#: Scans: slots, then Ss, Se, Ah, Al.
_SCANS = [
    (_dc, 0, 0, 0, 1),
    (lambda c: ((c[:, :1] & 1).astype(np.uint64), np.ones((len(c), 1), np.uint64)), 0, 0, 1, 0),
    (lambda c: _first(c, 1, 5), 1, 5, 0, 1),
    (lambda c: _first(c, 6, 63), 6, 63, 0, 1),
    (_refine, 1, 63, 1, 0),
]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload (of a positive multiple of 64 bytes)."""
    shape, coefs = [], []
    for p in payloads:
        if not p or len(p) % 64:
            raise ValueError("a payload has a positive multiple of 64 bytes")
        units = -(-len(p) // 384)
        rows = -(-units // ROW)
        wide = -(-units // rows)
        blocks = np.zeros((6 * rows * wide, 64), np.int16)
        blocks.reshape(-1)[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
        shape.append((rows, wide))
        coefs.append(blocks)
    coef = np.concatenate(coefs).astype(np.int64) if coefs else np.zeros((0, 64), np.int64)
    part, rst = [], []  # first block of each component; number of a block in its scan
    at = 0
    for rows, wide in shape:
        n = rows * wide
        part.append((at, at + 4 * n, at + 5 * n, at + 6 * n))
        rst += [np.arange(4 * n), np.arange(n), np.arange(n)]
        at += 6 * n
    rst = np.concatenate(rst) if rst else np.zeros(0, np.int64)
    scans = []
    for slots, *_ in _SCANS:
        data, ends, base = [], [np.zeros(1, np.int64)], 0
        for lo in range(0, len(coef), CHUNK):
            bytes_, size = _pack(*slots(coef[lo : lo + CHUNK]))
            out, end = _stuff(bytes_, size, rst[lo : lo + CHUNK])
            data.append(out.tobytes())
            ends.append(end + base)
            base += int(end[-1])
        scans.append((b"".join(data), np.concatenate(ends)))
    tables = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\0" + _DC_BODY) + _segment(0xC4, b"\x10" + _AC_BODY) + _segment(0xDD, b"\0\1")
    out = []
    for p, (rows, wide), cut in zip(payloads, shape, part):
        frame = b"\x08" + (16 * rows).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        file = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(p)), tables, _segment(0xC2, frame)]
        for (_, lo, hi, ah, al), (data, ends) in zip(_SCANS, scans):
            for c in range(3):
                file += [_segment(0xDA, bytes([1, c + 1, 0, lo, hi, ah << 4 | al])), data[ends[cut[c]] : ends[cut[c + 1]] - 2]]
        out.append(b"".join([*file, b"\xff\xd9"]))
    return out


class _Lookup:
    """Symbol and code length by the next 16 bits."""

    def __init__(self, body: bytes):
        counts, symbols = body[:16], body[16:]
        self.symbol, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = at = 0
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                lo = code << (16 - bits)
                hi = lo + (1 << (16 - bits))
                self.symbol[lo:hi], self.length[lo:hi] = symbols[at], bits
                at, code = at + 1, code + 1
            code <<= 1


_lookups: dict[bytes, _Lookup] = {}


def _lookup(body: bytes) -> _Lookup:
    if body not in _lookups:
        _lookups[body] = _Lookup(body)
    return _lookups[body]


class _Image:
    def __init__(self):
        self.comps: list[dict] = []
        self.quant: dict[int, np.ndarray] = {}
        self.scans: list[tuple] = []
        self.comment = b""


_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


def _parse(data: bytes) -> _Image:
    """Frame, tables and the scans' bytes of a file; no entropy decoding."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, interval, at = _Image(), {}, 0, 2
    while True:
        if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9" or data[at] != 255:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 64 << (body[0] >> 4)
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if wide > 64 else "u1").astype(np.int64)
                body = body[1 + wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = bytes(body[1:n])
                body = body[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            image.comment = bytes(body)
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or body[5] not in (1, 3) or not image.height or not image.width:
                raise ValueError("8 bits and 1 or 3 components are read")
            for i in range(body[5]):
                c = body[6 + 3 * i : 9 + 3 * i]
                image.comps.append({"id": c[0], "h": c[1] >> 4, "v": c[1] & 15, "q": c[2]})
            hm, vm = max(c["h"] for c in image.comps), max(c["v"] for c in image.comps)
            image.mcus = -(-image.width // (8 * hm)), -(-image.height // (8 * vm))
            for c in image.comps:
                c["wide"], c["high"] = image.mcus[0] * c["h"], image.mcus[1] * c["v"]
                c["w"], c["hgt"] = -(-(-(-image.width * c["h"] // hm)) // 8), -(-(-(-image.height * c["v"] // vm)) // 8)
        elif marker == 0xDA:
            n = body[0]
            picks = [(next(i for i, c in enumerate(image.comps) if c["id"] == body[1 + 2 * j]), body[2 + 2 * j]) for j in range(n)]
            lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
            if lo and n > 1:
                raise ValueError("AC scans have one component")
            end = _MARK.search(data, at)
            if not end:
                raise ValueError("the file ends in a scan")
            used = tuple(tables.get(t & 15 | 16) if lo else tables.get(t >> 4) for _, t in picks)
            image.scans.append((picks, lo, hi, bits >> 4, bits & 15, used, interval, at, end.start()))
            at = end.start()
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman files are read")


class _Lanes:
    """Bit readers over many byte strings at once."""

    def __init__(self, data: np.ndarray):
        """data: scans one after another, each restart interval ended by a marker."""
        ff = np.flatnonzero(data[:-1] == 255)
        follow = data[ff + 1]
        ends = ff[(follow >= 0xD0) & (follow <= 0xD7)]
        keep = np.ones(len(data), bool)
        keep[ff[follow == 0] + 1] = False
        keep[ends] = keep[ends + 1] = False
        place = np.cumsum(keep)
        self.at = np.concatenate([[0], place[ends[:-1]]]).astype(np.int64) << 3
        b = np.concatenate([data[keep], np.full(8, 255, np.uint8)]).astype(np.uint64)
        n = len(b) - 5
        self.words = b[:n] << np.uint64(32) | b[1 : n + 1] << np.uint64(24) | b[2 : n + 2] << np.uint64(16) | b[3 : n + 3] << np.uint64(8) | b[4 : n + 4]
        self.limit = n - 1

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next 32 bits."""
        at = self.at[lanes]
        return (self.words[np.minimum(at >> 3, self.limit)] >> (8 - (at & 7)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)

    def symbol(self, lanes: np.ndarray, table: _Lookup, bits_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next symbols, and the bits that follow each (as many as bits_of says)."""
        w = self.peek(lanes)
        top = (w >> np.uint64(16)).astype(np.int64)
        s, used = table.symbol[top], table.length[top]
        if (used == 0).any():
            raise ValueError("a code is in no table")
        more = bits_of(s)
        extra = (w >> (32 - used.astype(np.int64) - more).astype(np.uint64)).astype(np.int64) & ((1 << more) - 1)
        self.at[lanes] += used.astype(np.int64) + more
        return s, extra, more

    def bit(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        got = (self.words[np.minimum(at >> 3, self.limit)] >> (39 - (at & 7)).astype(np.uint64)).astype(np.int64) & 1
        self.at[lanes] = at + 1
        return got


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(extra >> np.maximum(size - 1, 0) & 1, extra, extra - (1 << size) + 1) * (size > 0)


def _run_scan(coef: np.ndarray, lanes: _Lanes, order: np.ndarray, first: np.ndarray, count: np.ndarray, comp: np.ndarray, scan: tuple) -> None:
    """Add a scan to the coefficients. order: block rows in the order of coding;
    first, count: each lane's stretch of it; comp: component number of each entry."""
    lo, hi, ah, al, tables = scan
    n = len(first)
    if lo == 0:
        last = np.zeros((n, 4), np.int64)
    skip = np.zeros(n, np.int64)
    for j in range(int(count.max()) if n else 0):
        live = np.flatnonzero(count > j)
        e = first[live] + j
        block = order[e]
        if lo == 0:
            if ah:
                coef[block, 0] |= (lanes.bit(live) << al).astype(np.int16)
                continue
            for c in np.unique(comp[e]):
                on = comp[e] == c
                s, extra, size = lanes.symbol(live[on], tables[c], lambda s: s.astype(np.int64))
                last[live[on], c] += _signed(extra, size)
                coef[block[on], 0] = last[live[on], c] << al
            continue
        idle = skip[live] > 0
        skip[live[idle]] -= 1
        if not ah:
            live, block = live[~idle], block[~idle]
            k = np.full(len(live), lo)
            while len(live):
                s, extra, size = lanes.symbol(live, tables[0], lambda s: np.where((s & 15) | (s >= 0xF0), s & 15, s >> 4).astype(np.int64))
                run, value = (s >> 4).astype(np.int64), (s & 15).astype(np.int64)
                put = value > 0
                k += np.where(put, run, 0)
                if (k[put] > hi).any():
                    raise ValueError("a run leaves its block")
                coef[block[put], k[put]] = _signed(extra[put], value[put]) << al
                end = ~put & (run < 15)
                skip[live[end]] = (1 << run[end]) + extra[end] - 1
                k += np.where(put, 1, np.where(end, 64, 16))
                on = k <= hi
                live, block, k = live[on], block[on], k[on]
            continue
        ended, need = idle.copy(), ~idle
        run, value = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        one = np.int16(1 << al)
        for k in range(lo, hi + 1):
            ask = np.flatnonzero(need & ~ended)
            if len(ask):
                s, extra, size = lanes.symbol(live[ask], tables[0], lambda s: np.where(s & 15, 1, np.where(s >= 0xF0, 0, s >> 4)).astype(np.int64))
                r = (s >> 4).astype(np.int64)
                fresh = (s & 15) > 0
                end = ~fresh & (r < 15)
                ended[ask[end]] = True
                skip[live[ask[end]]] = (1 << r[end]) + extra[end] - 1
                run[ask], value[ask] = r, np.where(fresh, np.where(extra > 0, one, -one), 0)
                need[ask] = False
            now = coef[block, k]
            known = now != 0
            fix = np.flatnonzero(known)
            if len(fix):
                bit = lanes.bit(live[fix])
                v = now[fix]
                coef[block[fix], k] = v + np.where((bit > 0) & (v & one == 0) | (bit > 0) & (v < 0) & (-v & one == 0), np.sign(v) * one, 0).astype(np.int16)
            free = ~known & ~ended
            stop = free & (run == 0)
            coef[block[stop], k] = value[stop]
            need[stop] = True
            run[free & ~stop] -= 1


def coefficients(files: list[bytes]) -> tuple[list[_Image], list[list[np.ndarray]]]:
    """Headers, and each image's coefficients by component: (blocks, 64) int16 in
    zigzag order. Images with the same scans are decoded together."""
    images = [_parse(f) for f in files]
    out: list[list[np.ndarray]] = [[] for _ in files]
    alike: dict[tuple, list[int]] = {}
    for i, m in enumerate(images):
        if not m.scans:
            raise ValueError("the file has no scan")
        alike.setdefault(tuple((tuple(c for c, _ in s[0]), *s[1:6]) for s in m.scans), []).append(i)
    for group in alike.values():
        sizes = np.array([[c["wide"] * c["high"] for c in images[i].comps] for i in group])
        base = np.cumsum(sizes.ravel()) - sizes.ravel()
        base = base.reshape(sizes.shape)
        coef = np.zeros((int(sizes.sum()), 64), np.int16)
        for number, (picks, lo, hi, ah, al, tables, _, _, _) in enumerate(images[group[0]].scans):
            data, order, comp, count = [], [], [], []
            for g, i in enumerate(group):
                m, scan = images[i], images[i].scans[number]
                if len(picks) == 1:
                    c = m.comps[picks[0][0]]
                    seq = (np.arange(c["hgt"])[:, None] * c["wide"] + np.arange(c["w"])).ravel() + base[g, picks[0][0]]
                    own, unit = np.zeros(len(seq), np.int64), 1
                else:
                    cells = []
                    for p, (x, _) in enumerate(picks):
                        c = m.comps[x]
                        grid = np.arange(c["wide"] * c["high"]).reshape(m.mcus[1], c["v"], m.mcus[0], c["h"]).transpose(0, 2, 1, 3).reshape(m.mcus[0] * m.mcus[1], -1) + base[g, x]
                        cells.append((grid, np.full(grid.shape, p)))
                    seq, own = np.concatenate([a for a, _ in cells], 1).ravel(), np.concatenate([b for _, b in cells], 1).ravel()
                    unit = len(seq) // (m.mcus[0] * m.mcus[1])
                step = scan[6] * unit or len(seq)
                order.append(seq)
                comp.append(own)
                count.append(np.minimum(step, len(seq) - np.arange(0, len(seq), step)))
                data += [files[i][scan[7] : scan[8]], b"\xff\xd0"]
            lanes = _Lanes(np.frombuffer(b"".join(data), np.uint8))
            count = np.concatenate(count)
            if len(count) != len(lanes.at):
                raise ValueError("a scan lacks restart markers")
            _run_scan(coef, lanes, np.concatenate(order), np.cumsum(count) - count, count, np.concatenate(comp), (lo, hi, ah, al, [t and _lookup(t) for t in tables]))
        for g, i in enumerate(group):
            out[i] = [coef[a : a + n] for a, n in zip(base[g], sizes[g])]
    return images, out


def samples(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) bytes of coefficients: inverse transform, + 128, clamped."""
    natural = np.zeros(coef.shape)
    natural[:, ZIGZAG] = coef.astype(np.int64) * quant
    x = (natural.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    x = (np.ascontiguousarray(x).reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.floor((x + (1 << 25)) / (1 << 26)) + 128, 0, 255).astype(np.uint8)


def tensor(image: _Image, planes: list[np.ndarray]) -> np.ndarray:
    """(height, width, 3) RGB of an image's component samples, chroma repeated."""
    hm, vm = max(c["h"] for c in image.comps), max(c["v"] for c in image.comps)
    full = []
    for c, p in zip(image.comps, planes):
        plane = p.reshape(c["high"], c["wide"], 8, 8).transpose(0, 2, 1, 3).reshape(c["high"] * 8, -1)
        full.append(plane.repeat(vm // c["v"], 0).repeat(hm // c["h"], 1)[: image.height, : image.width].astype(np.int32))
    if len(full) == 1:
        return np.stack([full[0]] * 3, -1).astype(np.uint8)
    y, cb, cr = full[0] << 16, full[1] - 128, full[2] - 128
    half = 1 << 15
    rgb = np.stack([(y + 91881 * cr + half) >> 16, (y - 22554 * cb - 46802 * cr + half) >> 16, (y + 116130 * cb + half) >> 16], -1)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def decode(files: list[bytes]) -> list[np.ndarray]:
    """RGB tensors of progressive JPEGs."""
    return [t for t, _ in _decode(files)]


def _decode(files: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
    """Tensor and stored payload (empty where the file holds none) of each file."""
    images, coefs = coefficients(files)
    flat = [(c, m.quant[k["q"]]) for m, cs in zip(images, coefs) for k, c in zip(m.comps, cs)]
    same = all(np.array_equal(q, flat[0][1]) for _, q in flat)
    if same and flat:
        every = samples(np.concatenate([c for c, _ in flat]), flat[0][1])
        cuts = np.cumsum([len(c) for c, _ in flat])
        done = np.split(every, cuts[:-1])
    else:
        done = [samples(c, q) for c, q in flat]
    out, at = [], 0
    for m, cs in zip(images, coefs):
        planes = done[at : at + len(cs)]
        at += len(cs)
        n = int(m.comment[8:]) if m.comment.startswith(b"payload=") else 0
        payload = (np.concatenate(cs).ravel()[:n] + 128).astype(np.uint8).tobytes() if n else b""
        out.append((tensor(m, planes), payload))
    return out


def media(df: DataFrame, name: str = "media", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``name``, the JPEG that stores the padded text."""

    def work(batch: pa.RecordBatch) -> dict:
        raw, payloads = _payloads(batch.column(1))
        return {"doc_id": batch.column(0), "n_bytes": pa.array(raw, pa.int64()), name: pa.array(encode(payloads), pa.binary())}

    return common.arrow_map(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), f"doc_id long, n_bytes long, {name} binary", "text", work, GROUP_BYTES)


def _payloads(column: pa.Array) -> tuple[list[int], list[bytes]]:
    data, offsets = words.buffer(column)
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets, offsets[1:])]
    return [len(t) for t in texts], [t + bytes(-len(t) % 64 or (0 if t else 64)) for t in texts]


def tensors(df: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """doc_id, height, width and rgb, the tensor's bytes in row order."""

    def work(batch: pa.RecordBatch) -> dict:
        got = decode(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "height": pa.array([t.shape[0] for t in got], pa.int32()), "width": pa.array([t.shape[1] for t in got], pa.int32()), "rgb": pa.array([t.tobytes() for t in got], pa.binary())}

    return common.arrow_map(df.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(column)), "doc_id long, height int, width int, rgb binary", column, work, GROUP_BYTES)


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and the tensor's CRC."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    means = [int(s) * 1000 // (rgb.shape[0] * rgb.shape[1]) for s in sums]
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{means[0]},{means[1]},{means[2]}:{zlib.crc32(rgb.tobytes()):08x}"


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as by ``media``, read back as by ``tensors``: the stored
    form's and the read payload's sizes and digests, and the tensor's feature."""

    def work(batch: pa.RecordBatch) -> dict:
        raw, payloads = _payloads(batch.column(1))
        files = encode(payloads)
        got = _decode(files)
        read = [p for _, p in got]
        return {
            "doc_id": batch.column(0),
            "n_bytes": pa.array(raw, pa.int64()),
            "payload_bytes": pa.array([len(p) for p in read], pa.int64()),
            "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in read]),
            "tail_crc32": pa.array([zlib.crc32(p[-64:]) for p in read], pa.int64()),
            "media_bytes": pa.array([len(f) for f in files], pa.int64()),
            "media_sha256": pa.array([hashlib.sha256(f).hexdigest() for f in files]),
            "feature": pa.array([feature(t) for t, _ in got]),
        }

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.arrow_map(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), schema, "text", work, GROUP_BYTES)
