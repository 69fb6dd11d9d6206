"""Progressive JPEG in numpy: a decoder for progressive files, and a lossless carrier of bytes in coefficients.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient
arrays, inverse-transforms them by one matrix product, upsamples chroma and returns a
full-resolution RGB tensor. Parts of scans that have a constant stride (one-symbol tables,
refinement bits, end-of-band runs) are decoded as arrays, the rest symbol by symbol.

The carrier keeps one byte in each quantised coefficient (quantisation steps are 1): byte v is
the value v in DC and v + 256 in AC, 4:2:0 with 384 bytes a unit of 16 x 16 pixels.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Fixed values of the format: the zigzag order of an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else -(i // 8))))
DC_CODE = {"lengths": 4, "symbols": list(range(8))}
FIRST_CODE = {"lengths": 1, "symbols": [0x08]}
REFINE_CODE = {"lengths": 4, "symbols": [r << 4 for r in range(15)]}
#: (component, first, last coefficient) of the AC scans.
AC_BANDS = [(0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63)]
UNIT = 6 * 64
TALLEST = 4095


@lru_cache(maxsize=1)
def _idct() -> np.ndarray:
    """(64 zigzag coefficients, 64 samples)."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("xu,yv->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, code: dict) -> bytes:
    counts = bytes(len(code["symbols"]) if n == code["lengths"] else 0 for n in range(1, 17))
    return bytes([kind << 4 | number]) + counts + bytes(code["symbols"])


def _scan(components: list[tuple[int, int]], first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    if pad:
        bits = np.concatenate([bits, np.ones(pad, np.uint8)])
    head = bytes([len(components)]) + b"".join(bytes([c + 1, t]) for c, t in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _variable(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The low ``sizes`` bits of each value, one after the other."""
    stop = np.cumsum(sizes)
    left = np.repeat(stop, sizes) - np.arange(stop[-1]) - 1
    return (np.repeat(values, sizes) >> left & 1).astype(np.uint8)


def _eob_runs(bits: np.ndarray) -> np.ndarray:
    """(blocks, width) correction bits behind end-of-band runs of at most 32767 blocks."""
    out = []
    for at in range(0, len(bits), 32767):
        part = bits[at : at + 32767]
        r = len(part).bit_length() - 1
        head = r << r | len(part) - (1 << r)  # 4 bits of code, r bits of length
        out += [np.array([head >> i & 1 for i in range(3 + r, -1, -1)], np.uint8), part.ravel()]
    return np.concatenate(out)


@lru_cache(maxsize=1)
def _tables() -> bytes:
    return _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC4, _table(0, 0, DC_CODE) + _table(1, 0, FIRST_CODE) + _table(1, 1, REFINE_CODE))


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG file that keeps ``payload`` (a positive multiple of 64 bytes) without loss."""
    units = -(-len(payload) // UNIT)
    wide = -(-units // TALLEST)
    tall = -(-units // wide)
    v = np.zeros(wide * tall * UNIT, np.uint8)
    v[: len(payload)] = np.frombuffer(payload, np.uint8)
    v = v.reshape(tall, wide, 6, 64)
    dc = v[..., 0].reshape(-1, 6).astype(np.int64)
    planes = [v[:, :, :4].reshape(tall, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64), v[:, :, 4].reshape(-1, 64), v[:, :, 5].reshape(-1, 64)]
    half = dc >> 1
    diff = np.empty_like(half)
    for lo, hi in ((0, 4), (4, 5), (5, 6)):
        part = half[:, lo:hi].ravel()
        diff[:, lo:hi] = np.diff(part, prepend=0).reshape(-1, hi - lo)
    diff = diff.ravel()
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    every = [(0, 0), (1, 0), (2, 0)]
    quant, huffman = _tables()
    frame = struct.pack(">BHHB", 8, 16 * tall, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), quant, _segment(0xC2, frame), huffman]
    out.append(_scan(every, 0, 0, 0, 1, _variable(size << size | extra, 4 + size)))
    for c, first, last in AC_BANDS:
        band = planes[c][:, first : last + 1]
        bits = np.zeros((band.size, 9), np.uint8)
        bits[:, 1:] = np.unpackbits((band >> 1 | 128).ravel()).reshape(-1, 8)
        out.append(_scan([(c, 0)], first, last, 0, 1, bits.ravel()))
    out.append(_scan(every, 0, 0, 1, 0, (dc & 1).ravel().astype(np.uint8)))
    for c, first, last in AC_BANDS:
        out.append(_scan([(c, 1)], first, last, 1, 0, _eob_runs(planes[c][:, first : last + 1] & 1)))
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    """Reads Huffman symbols and bits of one scan."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self._all = raw + b"\xff\xff\xff\xff", 0, None

    def peek16(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.raw[i : i + 3].ljust(3, b"\xff"), "big") >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        got = 0
        while n > 0:
            k = min(n, 16)
            got = got << k | self.peek16() >> (16 - k)
            self.at += k
            n -= k
        return got

    def symbol(self, table: dict) -> int:
        code = self.peek16()
        for n, (low, high, values) in table.items():
            c = code >> (16 - n)
            if low <= c < high:
                self.at += n
                return values[c - low]
        raise ValueError("no such code in a scan")

    def array(self, n: int) -> np.ndarray:
        if self._all is None:
            self._all = np.unpackbits(np.frombuffer(self.raw, np.uint8))
        got = self._all[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("a scan is too short")
        self.at += n
        return got


def _signed(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def _huffman(body: bytes, tables: dict) -> None:
    at = 0
    while at < len(body):
        key, counts = body[at], body[at + 1 : at + 17]
        at, code, table = at + 17, 0, {}
        for n, many in enumerate(counts, 1):
            if many:
                table[n] = (code, code + many, body[at : at + many])
                at, code = at + many, code + many
            code <<= 1
        tables[key >> 4, key & 15] = table


@lru_cache(maxsize=64)
def _lookup(table: tuple) -> list[int]:
    """Code length << 8 | symbol for every 16 bits that may follow; 0 where no code fits."""
    out = [0] * (1 << 16)
    for n, low, high, values in table:
        for c in range(low, high):
            out[c << (16 - n) : (c + 1) << (16 - n)] = [n << 8 | values[c - low]] * (1 << (16 - n))
    return out


def _dc_first(raw: bytes, order: list[int], parts: int, tables: list[dict], low: int) -> list[np.ndarray]:
    """DC values of each component in scan order. ``order``: the component of each block."""
    find = [_lookup(tuple((n, lo, hi, v) for n, (lo, hi, v) in t.items())) for t in tables]
    raw, at, last = raw + bytes([255] * 8), 0, [0] * parts
    values: list[list[int]] = [[] for _ in range(parts)]
    for c in order:
        i = at >> 3
        window = raw[i] << 40 | raw[i + 1] << 32 | raw[i + 2] << 24 | raw[i + 3] << 16 | raw[i + 4] << 8 | raw[i + 5]
        left = 48 - (at & 7)
        entry = find[c][window >> (left - 16) & 0xFFFF]
        if not entry:
            raise ValueError("no such code in a scan")
        n, size = entry >> 8, entry & 255
        at += n + size
        if size:
            v = window >> (left - n - size) & ((1 << size) - 1)
            last[c] += v if v >> (size - 1) else v - (1 << size) + 1
        values[c].append(last[c])
    return [np.array(v, np.int32) << low for v in values]


def _ac_first(bits: _Bits, coef: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int, table: dict) -> None:
    width = last - first + 1
    if len(table) == 1 and (only := next(iter(table.items())))[1][1] - only[1][0] == 1 and only[1][2][0] >> 4 == 0 and only[1][2][0]:
        n, size = only[0], only[1][2][0]
        got = bits.array(len(blocks) * width * (n + size)).reshape(-1, n + size)[:, n:]
        if size == 8:
            v = np.packbits(got).astype(np.int32)
        else:
            v = got.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        v = np.where(v >> (size - 1), v, v - (1 << size) + 1) << low
        coef[blocks, first : last + 1] = v.reshape(-1, width)
        return
    run = 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = bits.symbol(table)
            r, size = s >> 4, s & 15
            if size:
                k += r
                coef[b, k] = _signed(bits.take(size), size) << low
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1 + bits.take(r)
                break


def _ac_refine(bits: _Bits, coef: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int, table: dict) -> None:
    at, one = 0, 1 << low

    def correct(which: np.ndarray, begin: int) -> None:
        band = coef[which, begin : last + 1]
        there = band != 0
        got = bits.array(int(there.sum())).astype(np.int32)
        band[there] += got * np.sign(band[there]) * one
        coef[which, begin : last + 1] = band

    while at < len(blocks):
        b, k = blocks[at], first
        while k <= last:
            s = bits.symbol(table)
            r, size = s >> 4, s & 15
            if not size and r < 15:
                run = (1 << r) + bits.take(r)
                if k > first:
                    correct(blocks[at : at + 1], k)
                    at, run = at + 1, run - 1
                correct(blocks[at : at + run], first)
                at += run - 1
                break
            new = (one if bits.take(1) else -one) if size else 0
            while k <= last:
                if coef[b, k]:
                    if bits.take(1):
                        coef[b, k] += one if coef[b, k] > 0 else -one
                elif r == 0:
                    if new:
                        coef[b, k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        at += 1


#: Largest image, and most pixels that a file's byte may stand for: what claims more isn't read.
MOST_PIXELS, PIXELS_A_BYTE = 1 << 28, 1 << 12


def read_coefficients(media: bytes) -> dict:
    """Coefficients of a progressive JPEG: width, height, comment, and for each component its sampling,
    quantisation, padded block rows and columns, and (blocks, 64) zigzag values."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, tables, quant, out = 2, {}, {}, {"comment": b"", "components": []}
    restart = 0
    while at < len(media):
        marker, (size,) = media[at + 1], struct.unpack(">H", media[at + 2 : at + 4]) if media[at + 1] != 0xD9 else (0,)
        if marker == 0xD9:
            break
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            _huffman(body, tables)
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _, out["height"], out["width"], n = struct.unpack(">BHHB", body[:6])
            if not 0 < out["width"] * out["height"] <= MOST_PIXELS or out["width"] * out["height"] > len(media) * PIXELS_A_BYTE or out["components"]:
                raise ValueError("no plausible size")
            out["components"] = [{"id": i, "h": hv >> 4, "v": hv & 15, "quant": q} for i, hv, q in zip(*[iter(body[6 : 6 + 3 * n])] * 3, strict=True)]
            if len(out["components"]) != n or n not in (1, 3) or not all(0 < c["h"] <= 4 and 0 < c["v"] <= 4 for c in out["components"]):
                raise ValueError("grey or three components are read")
            out["h"], out["v"] = max(c["h"] for c in out["components"]), max(c["v"] for c in out["components"])
            out["wide"], out["tall"] = -(-out["width"] // (8 * out["h"])), -(-out["height"] // (8 * out["v"]))
            for c in out["components"]:
                c["cols"], c["rows"] = out["wide"] * c["h"], out["tall"] * c["v"]
                c["coef"] = np.zeros((c["rows"] * c["cols"], 64), np.int32)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman-coded files are read")
        elif marker == 0xDA:
            if not out["components"]:
                raise ValueError("a scan before the frame")
            stop = at
            while (stop := media.index(b"\xff", stop)) >= 0 and (media[stop + 1] == 0 or 0xD0 <= media[stop + 1] <= 0xD7):
                stop += 2
            _read_scan(out, tables, body, media[at:stop], restart)
            at = stop
    if not out["components"]:
        raise ValueError("no frame")
    for c in out["components"]:
        c["quant"] = quant.get(c["quant"], np.ones(64, np.float32))
    return out


def _read_scan(image: dict, tables: dict, head: bytes, raw: bytes, restart: int) -> None:
    if restart:
        raise ValueError("restart intervals are not read")
    n, comps = head[0], image["components"]
    named = {c["id"]: i for i, c in enumerate(comps)}
    used = [(named[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(n)]
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    bits = _Bits(raw.replace(b"\xff\x00", b"\xff"))
    if first:
        c, t = comps[used[0][0]], tables[1, used[0][1] & 15]
        (_ac_refine if high else _ac_first)(bits, c["coef"], _own_blocks(image, c), first, last, low, t)
        return
    order = []
    for i, _ in used:
        c = comps[i]
        if n == 1:
            blocks = _own_blocks(image, c)[:, None]
        else:
            blocks = np.arange(c["rows"] * c["cols"]).reshape(image["tall"], c["v"], image["wide"], c["h"]).transpose(0, 2, 1, 3).reshape(-1, c["v"] * c["h"])
        order.append((i, blocks))
    if high:
        widths = [b.shape[1] for _, b in order]
        got = bits.array(len(order[0][1]) * sum(widths)).reshape(-1, sum(widths)).astype(np.int32)
        lo = 0
        for (i, blocks), wide in zip(order, widths, strict=True):
            comps[i]["coef"][blocks, 0] |= got[:, lo : lo + wide] << low
            lo += wide
        return
    which = np.concatenate([np.full(b.shape, k) for k, (_, b) in enumerate(order)], axis=1).ravel().tolist()
    found = _dc_first(bits.raw, which, len(order), [tables[0, t >> 4] for _, t in used], low)
    for (i, blocks), values in zip(order, found, strict=True):
        comps[i]["coef"][blocks.ravel(), 0] = values


def _own_blocks(image: dict, c: dict) -> np.ndarray:
    """Blocks of a scan of one component: those that hold samples, row by row."""
    cols = -(-(-(-image["width"] * c["h"] // image["h"])) // 8)
    rows = -(-(-(-image["height"] * c["v"] // image["v"])) // 8)
    return (np.arange(rows)[:, None] * c["cols"] + np.arange(cols)).ravel()


def to_rgb(image: dict) -> np.ndarray:
    """(height, width, 3) uint8; grey files repeat their only component."""
    planes = []
    for c in image["components"]:
        samples = (c["coef"].astype(np.float32) * c["quant"]) @ _idct() + np.float32(128)
        plane = samples.reshape(c["rows"], c["cols"], 8, 8).transpose(0, 2, 1, 3).reshape(c["rows"] * 8, c["cols"] * 8)
        plane = plane.repeat(image["v"] // c["v"], axis=0).repeat(image["h"] // c["h"], axis=1)
        planes.append(plane[: image["height"], : image["width"]])
    if len(planes) < 3:
        planes = planes[:1] * 3
        rgb = np.stack(planes, axis=-1)
    else:
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def read_payload(image: dict) -> bytes:
    """The bytes that ``encode_payload`` has kept."""
    tall, wide = image["tall"], image["wide"]
    v = np.empty((tall, wide, 6, 64), np.uint8)
    y, cb, cr = (c["coef"].astype(np.uint8) for c in image["components"])  # v + 256 and v have equal low bytes
    v[:, :, :4] = y.reshape(tall, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(tall, wide, 4, 64)
    v[:, :, 4], v[:, :, 5] = cb.reshape(tall, wide, 64), cr.reshape(tall, wide, 64)
    return v.tobytes()[: int(image["comment"].split()[1])]
