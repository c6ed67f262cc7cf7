"""Media columns: payloads stored as baseline JPEG, and DC-only luminance thumbnails read from it.

One payload byte is one 8 x 8 block whose only coefficient is its DC value, with a DC quantiser
of 8, so the block decodes to that byte exactly and the DC-only luminance thumbnail is the payload.
Every image is grey, 8 bits, Huffman-coded with a restart marker after each row of blocks; rows are
decoded side by side in numpy. A payload over `IMAGE_BLOCKS` goes into several images, one after
the other. Read-back parses markers and decodes the scan; nothing is kept beside the file.

thumbnails() does the same for other baseline JPEGs, with AC coefficients and several components.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffers, slices

UNIT = 576
WIDTH = 64  # blocks a row; UNIT is a multiple
SLICE = 500_000  # bytes coded side by side
IMAGE_BLOCKS = WIDTH * 8172  # a whole number of units; height stays under 65,536 samples

# Fixed values of the JPEG standard: code lengths and symbols of the luminance DC table (K.3).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: One AC symbol, end of block, in one bit.
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def _codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, bits)."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


@functools.lru_cache(maxsize=8)
def _decoder(dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For every next 16 bits, if a block that holds a DC value alone begins there: its DC difference
    and its bits. Bits are 0 where that isn't so."""
    value, length = np.zeros(65536, np.int16), np.zeros(65536, np.uint8)
    eob, eob_bits = _codes(*ac)[0]
    for size, (code, bits) in _codes(*dc).items():
        total = bits + size + eob_bits
        if total <= 16:
            for extra in range(1 << size):
                lo = ((code << size | extra) << eob_bits | eob) << (16 - total)
                value[lo : lo + (1 << (16 - total))] = extra if size == 0 or extra >> (size - 1) else extra - (1 << size) + 1
                length[lo : lo + (1 << (16 - total))] = total
    return value, length


@functools.lru_cache(maxsize=1)
def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference + 255: its code, its extra bits and the end of block as one number; its bits."""
    dc, (eob, eob_bits) = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)[0]
    word, bits = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        word[d + 255] = ((code << size | extra) << eob_bits) | eob
        bits[d + 255] = n + size + eob_bits
    return word, bits


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _headers(width: int, height: int, blocks: int) -> bytes:
    """blocks: samples that hold payload, as a comment; the last row of blocks may be filled up."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xFE, b"blocks %d" % blocks),
        _segment(0xDB, b"\0\x08" + b"\x01" * 63),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, height * 8, width * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", width)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def encode_rows(grid: np.ndarray, last: np.ndarray, mark: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded rows of blocks, one after the other, and where each ends.

    grid: a byte a block; last: rows that end an image; mark: number of the restart marker after a row."""
    rows = len(grid)
    diff = grid.astype(np.int16) - 128
    diff[:, 1:] = np.diff(grid.astype(np.int16), axis=1)
    word, bits = _encoder()
    diff = (diff + 255).ravel()
    w, b = word[diff], bits[diff]
    ends = np.cumsum(b.reshape(rows, WIDTH), axis=1, dtype=np.int32)
    row_bytes = (ends[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(row_bytes, dtype=np.int64)])
    end = (ends + (base[:-1, None] << 3)).ravel() - 1  # a code's last bit
    at = end >> 3
    w = w << (7 - (end & 7)).astype(np.uint32)  # codes have 16 bits at most, so each touches three bytes at most
    total = int(base[-1])
    scan = np.zeros(total + 3, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to = at[first] + 2
    for k in range(3):
        scan[to - k] |= np.bitwise_or.reduceat(((w >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8), first)
    scan = scan[2 : total + 2]
    scan[base[1:] - 1] |= ((1 << (row_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)  # 1-bits fill a row's last byte
    # a zero byte after each 255; a restart marker after each row of an image but the last
    full = np.flatnonzero(scan == 255)
    more = np.flatnonzero(~last)
    extra = np.zeros(total + 1, np.uint8)
    extra[full + 1] = 1
    extra[base[1:][more]] += 2
    place = np.arange(total) + np.cumsum(extra[:-1], dtype=np.int64)
    tail = int(extra[-1])
    body = np.zeros((int(place[-1]) + 1 if total else 0) + tail, np.uint8)
    body[place] = scan
    close = place[base[1:] - 1] + 1 + (scan[base[1:] - 1] == 255)
    body[close[more]] = 0xFF
    body[close[more] + 1] = 0xD0 + (mark[more] & 7)
    return body.tobytes(), close


def encode_many(payloads: list[np.ndarray]) -> list[bytes]:
    """Each payload (a multiple of WIDTH bytes) as one or more baseline JPEGs."""
    heights = [np.diff([*range(0, len(p), IMAGE_BLOCKS), len(p)]) // WIDTH for p in payloads]
    image = np.concatenate(heights)
    last = np.zeros(int(image.sum()), bool)
    last[np.cumsum(image) - 1] = True
    mark = np.arange(len(last)) - np.repeat(np.cumsum(image) - image, image)
    body, close = encode_rows(np.concatenate(payloads).reshape(-1, WIDTH), last, mark)
    ends = close[last]
    starts = np.concatenate([[0], ends[:-1]])
    out, at = [], 0
    for h in heights:
        out.append(b"".join(_headers(WIDTH, int(n), int(n) * WIDTH) + body[starts[at + i] : ends[at + i]] + b"\xff\xd9" for i, n in enumerate(h)))
        at += len(h)
    return out


def _parse(raw: memoryview, at: int):
    """Markers from the start of an image at `at` to its scan: (tables, interval), quantiser, size, blocks, place of the scan."""
    if bytes(raw[at : at + 2]) != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    huff, quant, blocks, interval, size = {}, {}, None, 0, None
    while True:
        marker = raw[at + 1]
        (length,) = struct.unpack(">H", raw[at + 2 : at + 4])
        body = bytes(raw[at + 4 : at + 2 + length])
        at += 2 + length
        if marker == 0xFE and body.startswith(b"blocks "):
            blocks = int(body[7:])
        elif marker == 0xDB:
            quant[body[0] & 15] = body[1]
        elif marker == 0xC0:
            bits, high, wide, parts = struct.unpack(">BHHB", body[:6])
            if bits != 8 or parts != 1:
                raise ValueError("only 8-bit grey images are read")
            size, table = (-(-wide // 8), -(-high // 8)), body[8]
        elif marker == 0xC4:
            huff[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + sum(body[1:17])]))
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            return (huff[0x00], huff[0x10]), interval, quant[table], size, blocks, at


def decode_many(media: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """DC-only luminance thumbnails and sizes in blocks; restart intervals are decoded side by side."""
    joined = b"".join(media)
    raw, data = memoryview(joined), np.frombuffer(joined, np.uint8)
    ff = np.flatnonzero(data[:-1] == 255)
    kind = data[ff + 1]
    markers = ff[(kind != 0) & ((kind < 0xD0) | (kind > 0xD7))]
    images, at = [], 0  # (file, tables, interval, quantiser, size, blocks, scan, its end)
    for i, m in enumerate(media):
        stop = at + len(m)
        while at < stop:
            *found, scan = _parse(raw, at)
            end = int(markers[np.searchsorted(markers, scan)])
            images.append((i, *found, scan, end))
            at = end + 2
    edge = np.zeros(len(data) + 1, np.int8)
    for x in images:
        edge[x[6]] += 1
        edge[x[7]] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    inside = keep[ff]
    restart = ff[inside & (kind != 0)]
    keep[ff[inside & (kind == 0)] + 1] = False
    keep[restart] = keep[restart + 1] = False
    before = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    scan = np.concatenate([data[keep], np.zeros(64, np.uint8)]).astype(np.uint32)
    window = (scan[:-2] << 16) | (scan[1:-1] << 8) | scan[2:]
    opened = np.sort(np.concatenate([restart + 2, np.array([x[6] for x in images], np.int64)]))
    lane = before[opened] << 3
    first = np.searchsorted(opened, [x[6] for x in images])
    counts = np.diff(np.concatenate([first, [len(lane)]]))
    out: list = [([], []) for _ in media]
    for key in dict.fromkeys((x[1], x[2] or x[4][0] * x[4][1]) for x in images):
        (dc, ac), interval = key
        value, length = _decoder(dc, ac)
        own = [k for k, x in enumerate(images) if (x[1], x[2] or x[4][0] * x[4][1]) == key]
        spans = np.concatenate([np.arange(first[k], first[k] + counts[k]) for k in own])
        place = lane[spans]
        held = np.empty((interval, len(spans)), np.int16)
        level = np.zeros(len(spans), np.int16)
        limit = np.int64(len(window) - 1)
        bad = False
        for step in range(interval):  # lanes of a shorter last interval read on; what they read is cut off below
            look = (window[np.minimum(place >> 3, limit)] >> (8 - (place & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
            used = length[look]
            level = level + value[look]
            held[step] = level
            place = place + used
            bad |= not used.all() and all(images[k][4][0] * images[k][4][1] % interval == 0 for k in own)
        if bad:
            raise ValueError("a block holds more than its DC value")
        held, lo = held.T, 0
        for k in own:
            i, _, _, q, size, blocks, _, _ = images[k]
            grey = held[lo : lo + counts[k]].reshape(-1)[: size[0] * size[1]]
            lo += counts[k]
            grey = np.clip((grey.astype(np.int32) * q >> 3) + 128, 0, 255).astype(np.uint8)
            out[i][0].append(grey if blocks is None else grey[:blocks])
            out[i][1].append(size)
    return [(g[0] if len(g) == 1 else np.concatenate(g) if g else np.zeros(0, np.uint8), s) for g, s in out]


def _lookup(counts, symbols) -> tuple[list[int], list[int]]:
    """For every next 16 bits the symbol whose code begins there, and the code's bits (0: none)."""
    symbol, length = [0] * 65536, [0] * 65536
    for value, (code, bits) in _codes(counts, symbols).items():
        lo, n = code << (16 - bits), 1 << (16 - bits)
        symbol[lo : lo + n] = [value] * n
        length[lo : lo + n] = [bits] * n
    return symbol, length


class _Bits:
    """Entropy-coded bytes of one restart interval, without stuffing."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 4
        self.at, self.end = 0, 8 * len(self.data) - 32

    def peek(self) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        look = self.peek()
        if not table[1][look] or self.at >= self.end:
            raise ValueError("broken entropy-coded data")
        self.at += table[1][look]
        return table[0][look]

    def value(self, size: int) -> int:
        """A signed value of so many bits."""
        if not size:
            return 0
        x = self.peek() >> (16 - size)
        self.at += size
        return x if x >> (size - 1) else x - (1 << size) + 1


def luminance(data: bytes) -> tuple[np.ndarray, int, int]:
    """DC-only luminance thumbnail (a sample a block of 8 x 8), width and height of any baseline JPEG.

    Grey or several components, sampled alike or not, in one scan or several, with restart intervals or
    without; AC coefficients are read past. ValueError for what isn't baseline or is broken."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    quant: dict[int, int] = {}
    huff: dict[int, tuple] = {}
    parts: dict[int, tuple[int, int, int]] = {}  # component -> sampling across and down, quantiser
    at, interval, wide, high, first, grid = 2, 0, 0, 0, None, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD7:  # fill bytes, and markers without a body
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        (length,) = struct.unpack(">H", data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            k = 0
            while k < len(body):
                step = 2 if body[k] >> 4 else 1
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 1 + step], "big")
                k += 1 + 64 * step
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huff[body[k]] = _lookup(tuple(body[k + 1 : k + 17]), tuple(body[k + 17 : k + 17 + n]))
                k += 17 + n
        elif marker in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not high or not wide:
                raise ValueError("not 8 bits, or no size")
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            first = body[6]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            found = _scan(data[at:end], scan, parts, huff, interval, wide, high, first)
            grid = found if found is not None else grid
            at = end
    if grid is None:
        raise ValueError("no scan of the first component")
    across, down, q = parts[first]
    most_across, most_down = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    own = grid[: -(-high * down // (8 * most_down)), : -(-wide * across // (8 * most_across))]
    return np.clip((own * quant[q] >> 3) + 128, 0, 255).astype(np.uint8), wide, high


def _scan(data: bytes, scan: list, parts: dict, huff: dict, interval: int, wide: int, high: int, first: int) -> np.ndarray | None:
    """DC levels of the first component's blocks, if the scan holds it."""
    most_across, most_down = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    alone = len(scan) == 1
    if alone:  # a scan of one component has no block beyond its own size
        across, down, _ = parts[scan[0][0]]
        columns, rows, own = -(-wide * across // (8 * most_across)), -(-high * down // (8 * most_down)), [(1, 1)]
    else:
        columns, rows, own = -(-wide // (8 * most_across)), -(-high // (8 * most_down)), [parts[c][:2] for c, _, _ in scan]
    where = next((i for i, (c, _, _) in enumerate(scan) if c == first), None)
    if where is None:
        return None
    grid = np.zeros((rows * own[where][1], columns * own[where][0]), np.int64)
    intervals = re.split(rb"\xff[\xd0-\xd7]", data)
    bits, level = _Bits(intervals[0]), [0] * len(scan)
    for unit in range(columns * rows):
        if interval and unit and unit % interval == 0:
            if unit // interval >= len(intervals):
                raise ValueError("too few restart intervals")
            bits, level = _Bits(intervals[unit // interval]), [0] * len(scan)
        row, column = divmod(unit, columns)
        for i, (_, dc, ac) in enumerate(scan):
            for y in range(own[i][1]):
                for x in range(own[i][0]):
                    level[i] += bits.value(bits.symbol(huff[dc]))
                    if i == where:
                        grid[row * own[i][1] + y, column * own[i][0] + x] = level[i]
                    k = 1
                    while k < 64:
                        s = bits.symbol(huff[0x10 | ac])
                        if s & 15:
                            bits.value(s & 15)
                        elif s != 0xF0:
                            break
                        k += (s >> 4) + 1
    return grid


def thumbnails(images: DataFrame) -> DataFrame:
    """(doc_id, width, height, thumbnail, thumbnail_hash, problem) of images (doc_id, media) in any baseline JPEG.

    One row a row of `images`. The thumbnail holds a byte a block, row by row. A null or an image that can't
    be read has nulls and says why in `problem`; ids may be null or repeat; other columns are left out."""

    def run(batches):
        for batch in batches:
            rows = []
            for media in batch.column(1).to_pylist():
                try:
                    grey, wide, high = luminance(media or b"")
                    rows.append((wide, high, grey.tobytes(), thumbnail_hash(grey.reshape(-1)), None))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            types = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types))], names=["doc_id", "width", "height", "thumbnail", "thumbnail_hash", "problem"])

    return images.select("doc_id", "media").mapInArrow(run, "doc_id long, width int, height int, thumbnail binary, thumbnail_hash string, problem string")


def thumbnail_hash(grey: np.ndarray) -> str:
    """64 bits: which of 64 equal runs of the thumbnail's pixels are lighter than the mean of all."""
    edges = np.linspace(0, len(grey), 65).astype(np.int64)
    sums = np.diff(np.concatenate([[0], np.cumsum(grey, dtype=np.int64)])[edges])
    lighter = sums * len(grey) > int(grey.sum(dtype=np.int64)) * np.diff(edges)
    return np.packbits(lighter).tobytes().hex()


def pad(text: bytes | np.ndarray) -> np.ndarray:
    n = len(text)
    out = np.full(max(UNIT, -(-n // UNIT) * UNIT), 255, np.uint8)
    out[:n] = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    return out


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text (null: empty) as UTF-8, padded, in baseline JPEG.

    One row a row of `docs` (ids may be null or repeat); other columns are left out.
    """

    def run(batches):
        for batch in batches:
            raw, off = buffers(batch.column(1))
            for lo, hi in slices(off, SLICE):
                held = encode_many([pad(raw[off[i] : off[i + 1]]) for i in range(lo, hi)])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off[lo : hi + 1])), pa.array(held, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """Read stored media back: payload digests, dimensions in samples and thumbnail hashes."""

    def run(batches):
        for batch in batches:
            rows = []
            files = [x.as_buffer() for x in batch.column(2)]
            off = np.concatenate([[0], np.cumsum([x.size for x in files])]).astype(np.int64)
            found = [x for lo, hi in slices(off, SLICE) for x in decode_many(files[lo:hi])]
            for doc, n, media, (grey, sizes) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), files, found):
                payload = grey.tobytes()
                shape = ",".join(f"{w * 8}x{h * 8}" for w, h in sizes)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media.size, hashlib.sha256(media).hexdigest(), f"{shape};{thumbnail_hash(grey)}"))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[x.split()[0] for x in FEATURES.split(", ")])

    return stored.mapInArrow(run, FEATURES)
