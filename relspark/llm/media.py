"""Media columns: AVI files of motion JPEG, their frames, and the shots in them as timed clip rows.

Reading parses the RIFF chunks of all RIFF lists, takes the frames of the first video stream from the index (``indx`` and ``ix``, else ``idx1``, else the
``movi`` lists are walked, as they are where further lists have no index), and decodes each by itself: Huffman codes to
coefficients, and coefficients to samples by the inverse cosine transform. Sequential JPEG of 8 bits and any components and sampling is read,
with the standard tables where a frame leaves them out; an empty frame repeats the one before. Progressive, arithmetic or lossless frames, frames
of two fields and broken files raise ValueError.

Shots are found by the differences of the histograms of neighbouring frames: of the samples and of the quantised coefficients, half each, all
components by themselves. What is usual is taken from
the file: the up to ``NEAR`` differences on both sides, and the difference of two halves of each of both frames, which is what chance makes
in one picture. A shot begins where a difference is over their median by ``ABOVE`` deviations (of the median, as for a normal distribution), over
``TIMES`` that median and ``TIMES`` both halves' difference, and the largest among its neighbours. No threshold is fixed.

``pack`` stores bytes without loss as what a JPEG block holds: 64 quantised coefficients. A byte b becomes the coefficient whose 8
additional bits (category 8) are b, behind a Huffman code of one bit, and every block is followed by a restart marker, so the values stay in the
range of the format and a block is 72 bytes. Any JPEG reader gets the coefficients back from such a frame exactly.

Defined cases: null is the empty text, stored as 64 zero bytes; long texts take as many frames as they need; equal texts give equal files and values; a null
doc_id is kept; an empty table gives an empty result; columns other than doc_id and text are not read."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, table

BLOCK, FRAME_BLOCKS, RATE = 64, 64, 25
BINS, NEAR, ABOVE, TIMES = 16, 4, 3.0, 1.25
LEVEL, LEVELS = 8, 256
_basis = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)
#: Place in the 8 x 8 block of each coefficient, along its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
#: A marker that ends a scan: neither a stuffed byte nor a restart.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame(blocks: np.ndarray) -> bytes:
    """A JPEG frame, 8 samples wide, of the rows of 64 bytes."""
    n = len(blocks)
    bits = np.zeros((n, BLOCK, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks.reshape(-1, 1), axis=1).reshape(n, BLOCK, 8)
    rows = np.full((n, 74), 0xFF, np.uint8)
    rows[:, :72] = np.packbits(bits.reshape(n, -1), axis=1)
    rows[:, 73] = 0xD0 + np.arange(n) % 8
    stuffed = rows == 0xFF
    stuffed[:, 72:] = False
    flat, more = rows.ravel()[:-2], stuffed.ravel()[:-2]
    scan = np.zeros(len(flat) + int(more.sum()), np.uint8)
    scan[np.arange(len(flat)) + np.cumsum(more) - more] = flat
    header = struct.pack(">BHHBBBB", 8, 8 * n, 8, 1, 1, 0x11, 0)
    one_code = b"\1" + b"\0" * 15 + b"\x08"
    parts = [(0xDB, b"\0" + b"\1" * 64), (0xC0, header), (0xC4, b"\x00" + one_code), (0xC4, b"\x10" + one_code), (0xDD, b"\0\1"), (0xDA, b"\1\1\0\0\x3f\0")]
    return b"".join([b"\xff\xd8", *[segment(*p) for p in parts], scan.tobytes(), b"\xff\xd9"])


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def pack(payload: bytes) -> bytes:
    """The AVI file that holds the payload, whose length is a positive multiple of 64."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    frames = [frame(blocks[k : k + FRAME_BLOCKS]) for k in range(0, len(blocks), FRAME_BLOCKS)]
    most, high = max(map(len, frames)), 8 * min(len(blocks), FRAME_BLOCKS)
    head = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, 8, high, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4h", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, 8, high)
    kind = struct.pack("<IiiHH4sIiiII", 40, 8, high, 1, 8, b"MJPG", 8 * high, 0, 0, 0, 0)
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    lists = chunk(b"LIST", b"hdrl" + chunk(b"avih", head) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", kind)))
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    return chunk(b"RIFF", b"AVI " + lists + movi + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of each RIFF chunk."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def frames_of(media: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames of the first video stream."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movis, idx1, indexes, streams, lists = float(RATE), [], b"", {}, [], 0
    for riff, start, stop in chunks(media, 0, len(media)):
        if riff != b"RIFF":
            continue
        lists += 1
        for name, a, b in chunks(media, start + 4, min(stop, len(media))):
            kind = media[a : a + 4] if name == b"LIST" else b""
            if kind == b"movi":
                movis.append((a, min(b, len(media))))
            elif name == b"idx1":
                idx1 = idx1 or media[a:b]
            elif kind == b"hdrl":
                for inner, c, d in chunks(media, a + 4, b):
                    if inner == b"avih":
                        rate = 1e6 / max(1, struct.unpack_from("<I", media, c)[0])
                    elif inner == b"LIST" and media[c : c + 4] == b"strl":
                        for part, e, f in chunks(media, c + 4, d):
                            if part == b"strh":
                                streams.append(media[e : e + 4])
                            elif part == b"indx":
                                indexes[len(streams) - 1] = media[e:f]
    stream = streams.index(b"vids") if b"vids" in streams else None
    if stream is None:
        raise ValueError("no video stream")
    own = (b"%02ddc" % stream, b"%02ddb" % stream)
    if stream in indexes:
        places = indexed(media, indexes[stream])
    elif idx1 and lists == 1 and movis:
        places = []
        for name, _, at, size in struct.iter_unpack("<4sIII", idx1[: len(idx1) // 16 * 16]):
            if name in own:
                start = movis[0][0] + at  # offsets count from "movi" or from the file's start
                start = start if media[start : start + 4] == name else at
                if media[start : start + 4] != name:
                    raise ValueError("the index names no frame")
                places.append((start + 8, size))
    else:
        places = [x for a, b in movis for x in walked(media, a + 4, b, own)]
    found: list[bytes] = []
    for at, size in places:
        if at + size > len(media) or not (size or found):
            raise ValueError("a frame is missing")
        found.append(media[at : at + size] if size else found[-1])
    return rate, found


def indexed(media: bytes, index: bytes) -> list[tuple[int, int]]:
    """(start, size) of the frames of an OpenDML index, or of the indexes that it names."""
    longs, _, kind, entries = struct.unpack_from("<HBBI", index)
    if kind == 0 and longs == 4:
        found = []
        for k in range(entries):
            at, size, _ = struct.unpack_from("<QII", index, 24 + 16 * k)
            if media[at : at + 2] != b"ix" or at + size > len(media):
                raise ValueError("an index is missing")
            found += indexed(media, media[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]])
        return found
    if kind != 1 or longs not in (2, 3):
        raise ValueError("unknown kind of index")
    base = struct.unpack_from("<Q", index, 12)[0]
    of = [struct.unpack_from("<II", index, 24 + 4 * longs * k) for k in range(entries)]
    return [(base + at, size & 0x7FFFFFFF) for at, size in of]


def walked(media: bytes, at: int, end: int, own: tuple[bytes, ...]) -> Iterator[tuple[int, int]]:
    """(start, size) of the frames of a movi list as they come."""
    for name, a, b in chunks(media, at, end):
        if name == b"LIST" and media[a : a + 4] == b"rec ":
            yield from walked(media, a + 4, min(b, end), own)
        elif name in own:
            yield a, b - a


def marked(jpeg: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(marker, body, entropy-coded scan behind it) of each segment up to the end of the image."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while True:
        while jpeg[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("a JPEG frame is broken")
        marker = jpeg[at + 1]
        if marker == 0xD9:
            if jpeg.startswith(b"\xff\xd8\xff", at + 2):
                raise ValueError("a frame of two fields")
            return
        if at + 4 > len(jpeg):
            raise ValueError("a JPEG frame is broken")
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        scan = b""
        if marker == 0xDA:
            stop = MARKER.search(jpeg, at)
            if not stop:
                raise ValueError("a JPEG frame has no end")
            scan, at = jpeg[at : stop.start()], stop.start()
        yield marker, body, scan


def segments(jpeg: bytes) -> tuple[dict[int, list[bytes]], bytes]:
    """The bodies by marker, and the entropy-coded scan."""
    found: dict[int, list[bytes]] = {}
    scans = []
    for marker, body, scan in marked(jpeg):
        found.setdefault(marker, []).append(body)
        scans.append(scan)
    return found, b"".join(scans)


def codes_of(body: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a Huffman table."""
    found, code, at = {}, 0, 17
    for length in range(1, 17):
        for _ in range(body[length]):
            found[length, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return found


def standard(bits: str, values: str) -> dict[tuple[int, int], int]:
    return codes_of(b"\0" + bytes.fromhex(bits) + bytes.fromhex(values))


def rest(least: tuple[int, ...]) -> str:
    """The symbols of long codes: for runs from 3 on the sizes from the least one given up to 10."""
    return "".join(f"{run:x}{size:x}" for run, low in enumerate(least, 3) for size in range(low, 11))


#: The tables of the JPEG standard (annex K), which frames of motion JPEG leave out. Fixed values.
LUMINANCE = "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a"
CHROMINANCE = "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a"
STANDARD = {
    0x00: standard("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: standard("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: standard("0002010303020403050504040000017d", LUMINANCE + rest((4, 3, 3, 3, 3, 3, 2, 2, 2, 2, 2, 1, 1))),
    0x11: standard("00020102040403040705040400010277", CHROMINANCE + rest((5, 3, 3, 3, 3, 2, 2, 2, 2, 2, 2, 2, 2))),
}


def huffman_tables(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    """(class and number, codes) of all tables of a segment."""
    at = 0
    while at < len(body):
        until = at + 17 + sum(body[at + 1 : at + 17])
        yield body[at], codes_of(body[at:until])
        at = until


def quantisations(body: bytes) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while at < len(body):
        wide = body[at] >> 4
        yield body[at] & 15, np.frombuffer(body, ">u2" if wide else np.uint8, BLOCK, at + 1).astype(np.int32)
        at += 1 + BLOCK * (2 if wide else 1)


def components(jpeg: bytes) -> list[tuple[np.ndarray, np.ndarray, int, int, int]]:
    """Of each component: quantised coefficients (a row of 64 for each block, in zigzag order), quantisation, blocks in a row, samples wide and high."""
    tables, steps, restart = dict(STANDARD), {}, 0
    shape: list[tuple[int, int, int, int]] = []
    out: dict[int, tuple] = {}
    for marker, body, scan in marked(jpeg):
        if marker == 0xC4:
            tables |= dict(huffman_tables(body))
        elif marker == 0xDB:
            steps |= dict(quantisations(body))
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            shape = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if bits != 8 or not high or not wide or not n or any(not 1 <= x <= 4 for _, h, v, _ in shape for x in (h, v)):
                raise ValueError("unsupported size or depth of a JPEG frame")
            most_h, most_v = max(h for _, h, _, _ in shape), max(v for _, _, v, _ in shape)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 or marker == 0xDC:
            raise ValueError(f"unsupported kind of JPEG: {marker:x}")
        elif marker == 0xDA:
            of = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15) for k in range(body[0])]
            if not shape or any(c not in [x[0] for x in shape] or d not in tables or a not in tables for c, d, a in of):
                raise ValueError("a JPEG scan without its header or tables")
            parts = [next((k, *x) for k, x in enumerate(shape) if x[0] == c) for c, _, _ in of]
            if any(q not in steps for *_, q in parts):
                raise ValueError("a JPEG scan without its quantisation")
            size = [(-(-wide * h // most_h), -(-high * v // most_v)) for _, _, h, v, _ in parts]
            if len(parts) == 1:  # a scan of one component has its blocks row by row
                across, down = -(-size[0][0] // 8), -(-size[0][1] // 8)
                dc, ac = tables[of[0][1]], tables[of[0][2]]
                one = fixed_rate(scan, across * down) if dc == ac == {(1, 0): 8} and restart == 1 else huffman(scan, across * down, dc, ac, restart)
                out[parts[0][0]] = (one, steps[parts[0][4]], across, *size[0])
                continue
            across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
            read_ = entropy(scan, [(tables[d], tables[a], p[2] * p[3]) for (_, d, a), p in zip(of, parts, strict=True)], across * down, restart)
            for flat, (k, _, h, v, q), (w, t) in zip(read_, parts, size, strict=True):
                out[k] = (flat.reshape(down, across, v, h, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK), steps[q], across * h, w, t)
    if not shape or len(out) != len(shape):
        raise ValueError("a JPEG frame without all its components")
    return [out[k] for k in sorted(out)]


def coefficients(jpeg: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (a row of 64 for each block, in zigzag order) and the quantisation of a frame of one component."""
    found = components(jpeg)
    if len(found) > 1:
        raise ValueError("a frame of many components")
    return found[0][:2]


def fixed_rate(scan: bytes, n: int) -> np.ndarray:
    """The coefficients where all have one-bit codes and 8 additional bits, with a restart marker after each block."""
    raw = np.frombuffer(scan, np.uint8)
    escape = np.flatnonzero(raw[:-1] == 0xFF)
    drop = np.zeros(len(raw), bool)
    drop[escape + 1] = True
    drop[escape[raw[escape + 1] != 0]] = True
    bits = np.unpackbits(raw[~drop].reshape(n, 72), axis=1).reshape(n, BLOCK, 9)
    b = np.packbits(bits[:, :, 1:], axis=2).reshape(n, BLOCK).astype(np.int32)
    return np.where(b >= 128, b, b - 255)


def huffman(scan: bytes, n: int, dc: dict, ac: dict, restart: int) -> np.ndarray:
    """The coefficients of any sequential scan of one component, bit by bit."""
    return entropy(scan, [(dc, ac, 1)], n, restart)[0]


def entropy(scan: bytes, parts: list[tuple[dict, dict, int]], units: int, restart: int) -> list[np.ndarray]:
    """The coefficients of the components of a scan, each (DC codes, AC codes, blocks in a unit), in the order of the scan."""
    out = [np.zeros((units * blocks, BLOCK), np.int32) for _, _, blocks in parts]
    at, held, have, before = 0, 0, 0, [0] * len(parts)

    def take(count: int) -> int:
        nonlocal at, held, have
        while have < count:
            if at >= len(scan):
                raise ValueError("a JPEG scan ends early")
            byte = scan[at]
            at += 2 if byte == 0xFF else 1
            held, have = (held << 8 | byte) & 0xFFFFFFFF, have + 8
        have -= count
        return held >> have & (1 << count) - 1

    def symbol(table_: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table_:
                return table_[length, code]
        raise ValueError("no such code")

    def value(size: int) -> int:
        bits = take(size)
        return bits if not size or bits >> size - 1 else bits - (1 << size) + 1

    for k in range(units):
        if restart and k and k % restart == 0:
            before, have, at = [0] * len(parts), 0, at + 2
        for c, (dc, ac, blocks) in enumerate(parts):
            for row in out[c][k * blocks : (k + 1) * blocks]:
                before[c] = row[0] = before[c] + value(symbol(dc))
                place = 1
                while place < BLOCK:
                    run, size = divmod(symbol(ac), 16)
                    if not size and run < 15:
                        break
                    place += run
                    if place >= BLOCK:
                        raise ValueError("a block is too long")
                    row[place] = value(size)
                    place += 1
    return out


def samples(quantised: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The blocks' samples, 0 to 255."""
    flat = np.zeros((len(quantised), BLOCK), np.float32)
    flat[:, ZIGZAG] = quantised * steps
    basis = _basis.astype(np.float32)
    plane = basis @ flat.reshape(-1, 8, 8) @ basis.T
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)


def unpacked(quantised: np.ndarray) -> bytes:
    """The bytes that ``pack`` stored in these coefficients."""
    return np.where(quantised > 0, quantised, quantised + 255).astype(np.uint8).tobytes()


def shots(histograms: list[np.ndarray], rate: float, chance: list[float] | None = None) -> list[tuple[int, int, float, float]]:
    """(first frame, frame after the last, seconds of both) of each shot. ``chance``: for each frame, the difference of its halves."""
    chance = chance or [0.0] * len(histograms)
    gaps = [float(np.abs(b - a).sum() / 2) for a, b in zip(histograms, histograms[1:], strict=False)]
    starts = [0]
    for k, gap in enumerate(gaps):
        before, behind = gaps[max(0, k - NEAR) : k], gaps[k + 1 : k + 1 + NEAR]
        halves = chance[k : k + 2]
        usual = np.array([*before, *behind, *halves])
        middle = float(np.median(usual))
        deviation = 1.4826 * float(np.median(np.abs(usual - middle)))
        least = max(middle + ABOVE * deviation, TIMES * max(middle, *halves))
        if gap > least + 1e-9 and gap > max(before, default=0) and gap >= max(behind, default=0):
            starts.append(k + 1)
    return [(a, b, a / rate, b / rate) for a, b in zip(starts, [*starts[1:], len(histograms)], strict=True)]


def halves(parts: list[tuple[np.ndarray, np.ndarray, int, int, int]]) -> np.ndarray:
    """Shares of the samples inside the picture, for each component, in the black and the white blocks of a chessboard (two rows); all
    add up to 1."""
    found = []
    for quantised, steps, across, wide, high in parts:
        plane = samples(quantised, steps)
        down, right = np.divmod(np.arange(len(plane)), across)
        bins = (plane >> 4).reshape(-1, BLOCK) + ((down + right) % 2 * BINS).astype(np.uint8)[:, None]
        if wide % 8 or high % 8 or len(plane) * BLOCK != wide * high:
            y, x = down[:, None] * 8 + np.arange(BLOCK) // 8, right[:, None] * 8 + np.arange(BLOCK) % 8
            bins = bins[(y < high) & (x < wide)]
        found.append(np.bincount(bins.ravel(), minlength=2 * BINS).reshape(2, BINS) / (bins.size * len(parts)))
    return np.concatenate(found, axis=1)


def histogram(parts: list[tuple[np.ndarray, np.ndarray, int, int, int]]) -> np.ndarray:
    """Shares of the samples inside the picture, for each component; all add up to 1."""
    return halves(parts).sum(axis=0)


def levels(parts: list[tuple[np.ndarray, np.ndarray, int, int, int]]) -> np.ndarray:
    """The same for the quantised coefficients, in steps of ``LEVEL``."""
    found = []
    for quantised, _, across, _, _ in parts:
        down, right = np.divmod(np.arange(len(quantised)), across)
        bins = (np.clip(quantised, -1024, 1023) + 1024) // LEVEL + ((down + right) % 2 * LEVELS)[:, None]
        found.append(np.bincount(bins.ravel(), minlength=2 * LEVELS).reshape(2, LEVELS) / (bins.size * len(parts)))
    return np.concatenate(found, axis=1)


def unlike(both: np.ndarray) -> float:
    """What chance makes of the difference of two such pictures: that of the picture's halves, which have half as many samples, by the
    root of 2; 1 if it has one block only."""
    black, white = both.sum(axis=1)
    return float(np.abs(both[0] / black - both[1] / white).sum() / 2 / np.sqrt(2)) if black and white else 1.0


def read(media: bytes) -> tuple[bytes | None, list[tuple[int, int, float, float]]]:
    """The payload of a file (null if ``pack`` didn't write it) and its shots, in one pass over the decoded frames."""
    rate, frames = frames_of(media)
    payload, histograms, chance = [], [], []
    for f in frames:
        parts = components(f)
        first, steps = parts[0][:2]
        packed = len(parts) == 1 and bool((steps == 1).all()) and bool(first.all()) and int(np.abs(first).max()) <= 255
        payload.append(unpacked(first) if packed else None)
        both = np.concatenate([halves(parts), levels(parts)], axis=1) / 2
        histograms.append(both.sum(axis=0))
        chance.append(unlike(both))
    if any(len(h) != len(histograms[0]) for h in histograms):
        most = max(map(len, histograms))
        histograms = [np.pad(h, (0, most - len(h))) for h in histograms]
    return None if None in payload else b"".join(payload), shots(histograms, rate, chance) if frames else []


def clips(media: DataFrame) -> DataFrame:
    """A row for each shot of the files in column media: the other columns, clip, first_frame, end_frame, start_s, end_s."""

    names = ("clip", "first_frame", "end_frame", "start_s", "end_s")

    def found(series: pd.Series) -> pd.Series:
        return series.map(lambda m: [dict(zip(names, (k, *s), strict=True)) for k, s in enumerate(read(m)[1])] if m else [])

    shot = F.pandas_udf(found, "array<struct<clip: int, first_frame: int, end_frame: int, start_s: double, end_s: double>>")
    return media.withColumn("shot_", F.explode(shot("media"))).drop("media").select("*", "shot_.*").drop("shot_")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % BLOCK if raw else BLOCK)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, media: every text as a file."""
    made = F.pandas_udf(lambda texts: texts.map(lambda t: pack(payload_of(t)[1])), "binary")
    return in_small_batches(docs).select("doc_id", made("text").alias("media"))


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string"
)


def op10_media(spark, sf_dir: str) -> DataFrame:
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                n, payload = payload_of(text)
                media = pack(payload)
                back, found = read(media)
                feature = f"{found[-1][1]} frames: " + ", ".join(f"{a:.2f}-{b:.2f}" for _, _, a, b in found)
                read_back = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]))
                rows.append((doc_id, n, *read_back, len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return in_small_batches(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")).mapInPandas(digests, DIGESTS)
