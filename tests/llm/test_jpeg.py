"""Thumbnails of baseline JPEGs with AC coefficients, sampled components and several scans, made by a plain encoder."""

import random
import struct

import numpy as np
import pytest

from pagelight.llm import common, media

COUNTS = (0, 0, 0, 0, 0, 0, 0, 255) + (0,) * 8  # 255 codes of 8 bits
SYMBOLS = tuple(range(255))
CODES = media._codes(COUNTS, SYMBOLS)


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def entropy(words):
    bits = "".join(words)
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def coded(value):
    n = abs(value).bit_length()
    return n, format(value if value >= 0 else value + (1 << n) - 1, f"0{n}b") if n else ""


def block(rng, diff):
    n, extra = coded(diff)
    out, k = [format(CODES[n][0], "08b"), extra], 1
    while k < 64 and rng.random() < 0.7:
        run = rng.randint(0, min(15, 63 - k))
        n, extra = coded(rng.choice([-9, -1, 1, 2, 30]))
        out += [format(CODES[run << 4 | n][0], "08b"), extra]
        k += run + 1
    return "".join(out) + (format(CODES[0][0], "08b") if k < 64 else "")


def image(rng, wide, high, samplings, interval, together):
    """Bytes of an image of random blocks, and the levels of its first component's blocks."""
    most_x, most_y = max(x for x, _ in samplings), max(y for _, y in samplings)
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, b"\0" + bytes([5] * 64))
    head += segment(0xC0, struct.pack(">BHHB", 8, high, wide, len(samplings)) + b"".join(bytes([i + 1, x << 4 | y, 0]) for i, (x, y) in enumerate(samplings)))
    head += segment(0xC4, b"\0" + bytes(COUNTS) + bytes(SYMBOLS) + b"\x10" + bytes(COUNTS) + bytes(SYMBOLS))
    head += segment(0xDD, struct.pack(">H", interval)) if interval else b""
    levels = {}

    def scan(which):
        alone = len(which) == 1
        across, down = samplings[which[0]]
        columns = -(-wide * across // (8 * most_x)) if alone else -(-wide // (8 * most_x))
        rows = -(-high * down // (8 * most_y)) if alone else -(-high // (8 * most_y))
        out, words, last = b"", [], dict.fromkeys(which, 0)
        for unit in range(columns * rows):
            if interval and unit and unit % interval == 0:
                out += entropy(words) + bytes([0xFF, 0xD0 + (unit // interval - 1) % 8])
                words, last = [], dict.fromkeys(which, 0)
            r, c = divmod(unit, columns)
            for i in which:
                x_, y_ = (1, 1) if alone else samplings[i]
                for y in range(y_):
                    for x in range(x_):
                        level = rng.randint(-200, 200)
                        words.append(block(rng, level - last[i]))
                        last[i] = level
                        if i == 0:
                            levels[r * y_ + y, c * x_ + x] = level
        body = bytes([len(which)]) + b"".join(bytes([i + 1, 0]) for i in which) + b"\0\x3f\0"
        return segment(0xDA, body) + out + entropy(words)

    order = [list(range(len(samplings)))] if together else [[i] for i in range(len(samplings))]
    return head + b"".join(map(scan, order)) + b"\xff\xd9", levels


@pytest.mark.parametrize("samplings", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 3])
@pytest.mark.parametrize("together", [True, False])
def test_luminance(samplings, interval, together):
    rng = random.Random(len(samplings) * 7 + interval + together)
    for wide, high in ((8, 8), (37, 21), (64, 50)):
        data, levels = image(rng, wide, high, samplings, interval, together)
        grey, w, h = media.luminance(data)
        assert (w, h) == (wide, high) and grey.shape == (-(-high // 8), -(-wide // 8))
        for (r, c), level in levels.items():
            if r < grey.shape[0] and c < grey.shape[1]:
                assert grey[r, c] == min(255, max(0, (level * 5 >> 3) + 128))


def test_both_readers_agree():
    payload = media.pad(np.random.default_rng(1).integers(0, 256, 1500, dtype=np.uint8))
    (own,) = media.encode_many([payload])
    assert (media.luminance(own)[0].reshape(-1) == payload).all()


def test_rows(spark):
    common.ship(spark)
    data, _ = image(random.Random(2), 37, 21, [(2, 2), (1, 1), (1, 1)], 0, True)
    rows = [(1, data), (1, data), (2, None), (3, b""), (4, data[: len(data) // 2]), (None, b"\xff\xd8\xff\xc2\0\x04ab"), (5, b"GIF89a")]
    out = media.thumbnails(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, media binary, width int")).collect()
    assert len(out) == len(rows)
    assert [(r.width, r.height, len(r.thumbnail)) for r in out if r.doc_id == 1] == [(37, 21, 15)] * 2
    assert all(r.width is None and r.problem for r in out if r.doc_id != 1)
    assert media.thumbnails(spark.createDataFrame([], "doc_id long, media binary")).collect() == []
