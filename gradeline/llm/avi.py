"""Motion-JPEG in AVI: a writer that keeps bytes exactly, a reader, and shots from the decoded frames.

Frames are baseline JPEG. The writer's unit is the quantised DCT coefficient: byte b of a payload is coefficient b - 128
in zigzag order, 576 of them in a grey frame of 24 by 24, with all quantisation steps 1. So entropy decoding gives the
payload back bit by bit, and the inverse transform gives the picture. The reader takes any baseline frame without
restart intervals, of one or several components, and shows its first component.

Many frames are coded at a time: a numpy step emits or reads one symbol in every frame.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SIDE, FRAME, RATE = 24, 576, 25
#: Frames that are coded at a time.
LANES = 2048

_x = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
#: Row-major place of each coefficient in zigzag order.
ZIGZAG = np.array([8 * r + c for r, c in _x])
_k = np.arange(8)
_cos = np.sqrt(np.where(_k == 0, 1, 2) / 8)[:, None] * np.cos((2 * _k + 1)[None, :] * _k[:, None] * np.pi / 16)
#: 64 zigzag coefficients times this are 64 pixels, row by row, before the level shift.
INVERSE = np.einsum("ux,vy->uvxy", _cos, _cos).reshape(64, 64)[ZIGZAG]


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.where(v == 0, 0, np.frexp(np.abs(v).astype(np.float64))[1])


def _canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, int]]:
    """The counts of each length from 1 to 16, the symbols in order and their codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, codes, last = 0, {}, lengths[order[0]]
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = code
        code += 1
    return [sum(n == k for n in lengths.values()) for k in range(1, 17)], order, codes


# Code lengths that suit text: most bytes are lower-case letters (magnitudes of 4 or 5 bits) and blanks (7 bits).
_dc = {s: 4 for s in range(12)}
_ac = {16 * r + s: 13 for r in range(1, 16) for s in range(1, 9)} | {5: 1, 7: 2, 4: 3, 6: 5, 3: 6, 2: 7, 1: 8, 8: 8, 0: 8, 0xF0: 13}


def _arrays(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    codes = _canonical(lengths)[2]
    return np.array([codes.get(s, 0) for s in range(256)], np.uint64), np.array([lengths.get(s, 0) for s in range(256)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    counts, order, _ = _canonical(lengths)
    return _segment(0xC4, bytes([kind, *counts, *order]))


#: All that comes before a frame's entropy-coded data.
HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _table(0x00, _dc) + _table(0x10, _ac) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
_DC, _AC = _arrays(_dc), _arrays(_ac)


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """A JPEG for each row of 576 bytes."""
    return [f for i in range(0, len(payload), LANES) for f in _encode(payload[i : i + LANES])]


def _encode(payload: np.ndarray) -> list[bytes]:
    n = len(payload)
    c = payload.astype(np.int32).reshape(n, 9, 64) - 128
    c[:, 1:, 0] = np.diff(c[:, :, 0], axis=1)
    size = _size(c)
    bits = (np.where(c < 0, c + (1 << size) - 1, c)).astype(np.uint64)
    code, length = np.zeros((n, 9, 65), np.uint64), np.zeros((n, 9, 65), np.int64)
    code[:, :, 0] = _DC[0][size[:, :, 0]] << size[:, :, 0].astype(np.uint64) | bits[:, :, 0]
    length[:, :, 0] = _DC[1][size[:, :, 0]] + size[:, :, 0]
    at = np.arange(64)
    some = c != 0
    some[:, :, 0] = True
    last = np.maximum.accumulate(np.where(some, at, 0), axis=2)  # the last place before or at each that isn't zero
    run = at[1:] - last[:, :, :-1] - 1
    symbol = np.where(some[:, :, 1:], (run % 16) * 16 + size[:, :, 1:], 0xF0)
    emitted = some[:, :, 1:] | ((run % 16 == 15) & (at[1:] < last[:, :, -1:]))  # a sixteenth zero, and more to come
    own = np.where(some[:, :, 1:], size[:, :, 1:], 0)
    code[:, :, 1:64] = np.where(emitted, _AC[0][symbol] << own.astype(np.uint64) | np.where(some[:, :, 1:], bits[:, :, 1:], 0), 0)
    length[:, :, 1:64] = np.where(emitted, _AC[1][symbol] + own, 0)
    short = last[:, :, -1] < 63
    code[:, :, 64], length[:, :, 64] = np.where(short, _AC[0][0], 0), np.where(short, _AC[1][0], 0)
    length = length.reshape(n, -1)
    total = length.sum(1)
    pad = -total % 8
    length, code = np.column_stack([length, pad]), np.column_stack([code.reshape(n, -1), (1 << pad) - 1]).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum((total + pad + 31) // 32 * 32)])
    offset = np.cumsum(length, 1) - length + start[:-1, None]
    on = length > 0
    offset, code, length = offset[on], code[on], length[on]
    wide = code << (64 - (offset & 31) - length).astype(np.uint64)
    word = offset >> 5
    words = np.bincount(word, wide >> np.uint64(32), start[-1] // 32 + 1) + np.bincount(word + 1, wide & np.uint64(0xFFFFFFFF), start[-1] // 32 + 1)
    data = words.astype(">u4").tobytes()
    ends = (start[:-1] + total + pad) // 8
    return [HEAD + data[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip((start[:-1] // 8).tolist(), ends.tolist())]


@dataclass
class Layout:
    """What the headers of a frame say."""

    width: int
    height: int
    components: list[tuple[int, int]]  # horizontal and vertical sampling of each
    steps: np.ndarray  # quantisation of the first component, zigzag
    tables: np.ndarray  # for each 16-bit look-ahead: length | size << 5 | run << 9, table after table
    dc: np.ndarray  # for each block of a frame the offset of its tables
    ac: np.ndarray
    component: np.ndarray
    first: np.ndarray  # places of the first component's blocks
    place: np.ndarray  # and where these lie in rows and columns of blocks
    head: bytes

    @property
    def blocks(self) -> int:
        return len(self.component)


def _lookahead(counts: bytes, symbols: bytes) -> np.ndarray:
    out, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            out[code << (16 - n) : (code + 1) << (16 - n)] = n | (s & 15) << 5 | (s >> 4) << 9
            code += 1
        at, code = at + count, code << 1
    return out


def parse_head(jpeg: bytes) -> Layout:
    """The headers of a baseline frame, to the start of its entropy-coded data."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, steps, tables, frame = 2, {}, {}, None
    while True:
        mark, marker, size = struct.unpack_from(">BBH", jpeg, at)
        if mark != 0xFF:
            raise ValueError("a JPEG marker is missing")
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _lookahead(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD and body != b"\0\0":
            raise ValueError("restart intervals aren't read")
        elif marker == 0xDA:
            break
    scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if frame is None or len(scan) != len(frame):
        raise ValueError("not one scan of all components")
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    h, v = max(f[1] for f in frame), max(f[2] for f in frame)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    keys = sorted(tables)
    unit = [(i, scan[c]) for i, (c, x, y, _) in enumerate(frame) for _ in range(x * y)]
    dc = [keys.index(t >> 4) << 16 for _, t in unit]
    ac = [keys.index(16 | t & 15) << 16 for _, t in unit]
    component = np.tile([i for i, _ in unit], across * down)
    x, y = frame[0][1], frame[0][2]
    mcu = np.arange(across * down)
    rows = (mcu // across)[:, None] * y + np.repeat(np.arange(y), x)[None]
    cols = (mcu % across)[:, None] * x + np.tile(np.arange(x), y)[None]
    place = rows.ravel() * across * x + cols.ravel()
    if x != h or y != v:
        raise ValueError("the first component must be the finest")
    return Layout(width, height, [f[1:3] for f in frame], steps[frame[0][3]], np.concatenate([tables[k] for k in keys]), np.tile(dc, across * down), np.tile(ac, across * down), component, np.flatnonzero(component == 0), place, jpeg[:at])


def decode_frames(layout: Layout, frames: list[bytes]) -> np.ndarray:
    """The quantised coefficients of frames with the same headers: frame, block, place in zigzag order."""
    parts = [_decode(layout, frames[i : i + LANES]) for i in range(0, len(frames), LANES)]
    return np.concatenate(parts) if parts else np.zeros((0, layout.blocks, 64), np.int32)


def _decode(layout: Layout, frames: list[bytes]) -> np.ndarray:
    head, lanes, end = len(layout.head), len(frames), 64 * layout.blocks
    datas = [f[head:].removesuffix(b"\0").removesuffix(b"\xff\xd9").replace(b"\xff\x00", b"\xff") + bytes(8) for f in frames]
    flat = np.frombuffer(b"".join(datas) + bytes(8), np.uint8).astype(np.uint64)
    window = flat[:-7] << np.uint64(56)
    for i in range(1, 8):
        window |= flat[i : len(flat) - 7 + i] << np.uint64(56 - 8 * i)
    sizes = np.fromiter(map(len, datas), np.int64, lanes)
    base = np.cumsum(sizes) - sizes
    out = np.zeros((lanes, end + 64), np.int32)
    lane, pos, k, limit = np.arange(lanes), base * 8, np.zeros(lanes, np.int64), (base + sizes - 8) * 8
    dc, ac = np.append(layout.dc, 0), np.append(layout.ac, 0)
    while len(lane):
        for _ in range(16):
            block, direct = k >> 6, (k & 63) == 0
            w = window[pos >> 3] << (pos & 7).astype(np.uint64)
            entry = layout.tables[np.where(direct, dc[block], ac[block]) + (w >> np.uint64(48)).astype(np.int64)]
            length, size, run = entry & 31, entry >> 5 & 15, entry >> 9
            raw = ((w << length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) >> (32 - size)
            value = np.where(raw < (1 << size >> 1), raw - (1 << size) + 1, raw)
            live = k < end
            k1 = k + run
            out[lane, np.where(live & (size > 0), np.minimum(k1, end), end)] = value
            ended = ~direct & (size == 0) & (run < 15)
            k = np.where(live, np.where(ended, (k | 63) + 1, k1 + 1), end)
            pos = np.where(live, pos + length + size, pos)
            if (length[live] == 0).any() or (pos > limit).any():
                raise ValueError("the entropy-coded data is damaged")
        on = k < end
        lane, pos, k, limit = lane[on], pos[on], k[on], limit[on]
    coefficients = out[:, :end].reshape(lanes, layout.blocks, 64)
    for i in range(len(layout.components)):
        own = layout.component == i
        coefficients[:, own, 0] = np.cumsum(coefficients[:, own, 0], 1)
    return coefficients


def pictures(layout: Layout, coefficients: np.ndarray) -> np.ndarray:
    """The first component's samples: frame, row, column."""
    n = len(coefficients)
    h, v = layout.components[0]
    across = -(-layout.width // (8 * h)) * h
    blocks = np.empty((n, len(layout.place), 64), np.uint8)
    # the small share added makes halves round alike whatever else is decoded beside
    pixels = (coefficients[:, layout.first] * layout.steps).reshape(-1, 64) @ INVERSE
    blocks[:, layout.place] = np.clip(np.floor(pixels + (128.5 + 1e-7)), 0, 255).reshape(n, -1, 64)
    rows = blocks.reshape(n, -1, across, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, -1, across * 8)
    return rows[:, : layout.height, : layout.width]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, rate: int = RATE) -> bytes:
    """An AVI file with an index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(chunk := _chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames per second and the frames of the first video stream, by the index; without one, by the chunks in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index, at = 0.0, None, None, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"hdrl":
            if (s := data.find(b"strh", at, at + 8 + size)) >= 0 and data[s + 8 : s + 12] == b"vids":
                scale, per = struct.unpack_from("<II", data, s + 8 + 20)
                rate = per / max(scale, 1)
        elif name == b"LIST" and kind == b"movi":
            movi = (at + 8, at + 8 + size)
        elif name == b"idx1":
            index = np.frombuffer(data, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("the AVI file has no frames list")
    if index is not None and len(index):
        own = index[np.isin(index["id"], [b"00dc", b"00db"])]
        first = movi[0] if len(own) and own["at"][0] < movi[0] else 0  # offsets count from the list or from the file
        return rate, [data[p + 8 : p + 8 + n] for p, n in zip((own["at"] + first).tolist(), own["size"].tolist())]
    frames, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] in (b"00dc", b"00db"):
            frames.append(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return rate, frames


#: Bins of the histograms, differences before a frame that set its threshold, their least number, and the parts of the
#: threshold: the least share of pixels that change bins, and standard deviations above the mean.
BINS, BEFORE, LEAST, SHARE, SPREAD = 32, 8, 2, 0.25, 3.0


def histograms(images: np.ndarray) -> np.ndarray:
    n = len(images)
    key = (images.reshape(n, -1) >> 3).astype(np.int64) + BINS * np.arange(n)[:, None]
    return np.bincount(key.ravel(), minlength=BINS * n).reshape(n, BINS)


def cuts(hist: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each frame, whether a shot begins there. first: the index of the first frame of its video.

    A frame begins a shot if its histogram differs from the one before by more than a share of the pixels and by more
    than the mean plus some standard deviations of the differences shortly before. All sums are of whole numbers.
    """
    n = len(hist)
    at = np.arange(n)
    d = np.zeros(n, np.int64)
    d[1:] = np.abs(np.diff(hist, axis=0)).sum(1)
    d[at == first] = 0
    one, two = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    low = np.maximum(first + 1, at - BEFORE)
    many = np.maximum(at - low, 1)
    mean = (one[at] - one[np.minimum(low, at)]) / many
    spread = np.sqrt(np.maximum((two[at] - two[np.minimum(low, at)]) / many - mean**2, 0))
    enough = at - low >= LEAST
    limit = np.where(enough, mean + SPREAD * spread, 0)
    return (at == first) | (d > np.maximum(limit, 2 * SHARE * hist.sum(1)))
