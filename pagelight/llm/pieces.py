"""SentencePiece encoding and decoding of whole batches by suffix-array matching.

The distinct units of a batch (a run of word marks and what follows up to the next; no piece reaches
across), less those that the worker has just encoded, are concatenated and indexed by a suffix array, sorted to the length of the longest piece.
Every piece of the vocabulary is binary-searched for its range of occurrences. The resulting edges
(place, piece) are sorted by where they end, and relaxed in that order: an edge extends the encoding
of the prefix before it exactly if its piece may follow that encoding's last piece, that is, if the
two, joined, encode to themselves. Byte-pair encodings are those paths, and each place has one. (A
largest sum of scores, as for a unigram model, isn't what this model's pieces mean.) Where a place
would have another number of paths than one, the unit is merged pair by pair instead.
"""

from __future__ import annotations

import array
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffers, claim, slices

MARK = "▁"
UNKNOWN = 1 << 17  # number of an unknown character: its code point beyond this
BATCH_BYTES = 1_000_000
CACHE = 800_000  # units whose ids a worker keeps, about 200 MB; then it starts anew
PAIR_BITS = 21  # slots for answers about pairs, as a power of 2; a pair takes the slot of another


class Model:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.number = {p: i for i, p in enumerate(self.text) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.number.items()}
        self.longest = max(map(len, self.number))
        by = sorted(self.number.items())
        self.ids = np.array([i for _, i in by], np.int64)
        self.length = np.array([len(p) for p, _ in by], np.int64)
        self.codes = np.full((len(by), self.longest), -1, np.int32)
        for k, (p, _) in enumerate(by):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in self.number if len(p) == 1]] = True
        self.pairs, self.answers = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.seen: dict[str, bytes] = {}
        self.shown = [" " if p == MARK else p.replace(MARK, " ") for p in self.text]
        self.raw = [bytes((self.byte_of[i],)) if i in self.byte_of else x.encode() for i, x in enumerate(self.shown)]

    def merge(self, unit: str) -> list[str]:
        """Pair by pair: always the adjacent two whose joint piece scores best, the leftmost of equals."""
        now = list(unit)
        while True:
            best, at = None, -1
            for i in range(len(now) - 1):
                s = self.score.get(now[i] + now[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return now
            now[at : at + 2] = [now[at] + now[at + 1]]

    def string(self, number: int) -> str:
        return chr(number - UNKNOWN) if number >= UNKNOWN else self.text[number]

    def may_follow(self, keys: np.ndarray) -> np.ndarray:
        """For first * 2**32 + second: whether the two pieces, joined, encode to themselves."""
        slot = self._slot(keys)
        out = self.answers[slot]
        unknown = np.flatnonzero(self.pairs[slot] != keys)
        if len(unknown):
            new, back = np.unique(keys[unknown], return_inverse=True)
            fits = np.empty(len(new), bool)
            for k, key in enumerate(new.tolist()):
                a, b = self.string(key >> 32), self.string(key & 0xFFFFFFFF)
                fits[k] = self.merge(a + b) == [a, b]
            slot = self._slot(new)
            self.pairs[slot], self.answers[slot] = new, fits  # of several that share one, one is kept
            out[unknown] = fits[back]
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def final(self, numbers: list[int]) -> bytes:
        """Ids with unknown characters as their bytes."""
        return array.array("I", [i for n in numbers for i in ([n] if n < UNKNOWN else [self.byte[b] for b in chr(n - UNKNOWN).encode()])]).tobytes()


@functools.lru_cache(maxsize=2)
def _model(path: str) -> Model:
    return Model(path)


def model(path: str) -> Model:
    claim("pieces", _model.cache_clear)
    return _model(path)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` codes at least: codes are packed into one symbol of
    64 bits as far as the batch's alphabet allows, then prefixes are doubled."""
    n = len(codes)
    letters, rank = np.unique(codes, return_inverse=True)
    bits = max(1, int(len(letters)).bit_length())
    width = max(1, 62 // bits)
    padded = np.concatenate([rank.astype(np.int64) + 1, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + second
        width *= 2


def occurrences(m: Model, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of suffixes that begin with each piece."""
    padded = np.concatenate([codes, np.full(m.longest, -2, np.int32)])
    lo, hi = np.zeros(len(m.ids), np.int64), np.full(len(m.ids), len(order), np.int64)
    for d in range(m.longest):
        own = np.flatnonzero((m.length > d) & (lo < hi))
        want = m.codes[own, d]
        for upper in (False, True):
            a, b = lo[own].copy(), hi[own].copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) >> 1
                c = padded[order[mid] + d]
                right = c <= want[open_] if upper else c < want[open_]
                a[open_[right]] = mid[right] + 1
                b[open_[~right]] = mid[~right]
            if upper:
                hi[own] = a
            else:
                first = a
        lo[own] = first
    return lo, hi


def encode_units(m: Model, units: list[str]) -> list[bytes]:
    """Ids of each unit (all distinct, none empty), packed."""
    if not units:
        return []
    sizes = np.array([len(u) for u in units], np.int64)
    joined = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int32)
    n = len(joined)
    starts = np.cumsum(sizes) - sizes
    # a separator after each unit
    places = np.arange(n) + np.repeat(np.arange(len(units)), sizes)
    codes = np.full(n + len(units), -1, np.int32)
    codes[places] = joined
    starts = starts + np.arange(len(units))
    order = suffix_array(codes, m.longest)
    lo, hi = occurrences(m, codes, order)
    count = np.maximum(hi - lo, 0)
    piece = np.repeat(np.arange(len(m.ids)), count)
    at = order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    number, length = m.ids[piece], m.length[piece]
    strange = places[~m.known[joined]]
    at = np.concatenate([at, strange])
    number = np.concatenate([number, codes[strange].astype(np.int64) + UNKNOWN])
    length = np.concatenate([length, np.ones(len(strange), np.int64)])
    unit = np.zeros(len(codes), np.int64)
    unit[places] = np.repeat(np.arange(len(units)), sizes)
    end = at + length  # the place behind the edge
    step = end - starts[unit[at]]
    by = np.argsort(step, kind="stable")
    at, number, end, step = at[by], number[by], end[by], step[by]
    edges = np.searchsorted(step, np.arange(1, int(step[-1]) + 2)) if len(step) else []
    begins = np.zeros(len(codes) + 1, bool)
    begins[starts] = True
    last, back = np.full(len(codes) + 1, -1, np.int64), np.full(len(codes) + 1, -1, np.int64)
    paths = np.zeros(len(codes) + 1, np.int32)
    for a, b in zip(edges[:-1], edges[1:]):
        if a == b:
            continue
        s, p, e = at[a:b], number[a:b], end[a:b]
        ok = begins[s]
        rest = np.flatnonzero(~ok & (last[s] >= 0))
        if len(rest):
            ok[rest] = m.may_follow(last[s[rest]] << 32 | p[rest])
        s, p, e = s[ok], p[ok], e[ok]
        last[e], back[e] = p, s
        np.add.at(paths, e, 1)
    wrong = np.unique(unit[places[paths[places + 1] != 1]])
    # all units are walked back at once, from their ends
    now, own, taken = starts + sizes, np.arange(len(units)), []
    while len(own):
        taken.append((own, last[now]))
        now = back[now]
        on = now > starts[own]
        now, own = now[on], own[on]
    steps = np.repeat(np.arange(len(taken)), [len(o) for o, _ in taken])
    own, number = np.concatenate([o for o, _ in taken]), np.concatenate([p for _, p in taken])
    by = np.lexsort((-steps, own))
    number = number[by]
    ends = np.cumsum(np.bincount(own, minlength=len(units)))
    flat = number.astype("<u4").tobytes()
    out = [flat[a:b] for a, b in zip((4 * np.concatenate([[0], ends[:-1]])).tolist(), (4 * ends).tolist())]
    for k in np.unique(own[by][number >= UNKNOWN]).tolist():
        out[k] = m.final(number[ends[k - 1] if k else 0 : ends[k]].tolist())
    for k in wrong.tolist():
        out[k] = m.final([m.number.get(x, UNKNOWN + ord(x[0])) for x in m.merge(units[k])])
    return out


_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def units_of(text: str) -> list[str]:
    """Units of a text with its leading mark; none for an empty text."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return _UNIT.findall(MARK + text.replace(" ", MARK))
    return [MARK + x for x in text.split(" ")]


def encode_batch(m: Model, texts: list[str | None]) -> list[bytes]:
    """Ids of each text (null: none) as little-endian unsigned 32-bit integers."""
    if len(m.seen) > CACHE:
        m.seen.clear()
    cut = [units_of(t or "") for t in texts]
    new = list(set().union(*cut).difference(m.seen)) if cut else []
    m.seen.update(zip(new, encode_units(m, new)))
    return [b"".join(map(m.seen.__getitem__, c)) for c in cut]


def decode(m: Model, ids: bytes) -> str:
    """Text of ids; the leading mark goes, other marks are spaces, byte pieces are joined to characters."""
    numbers = array.array("I", ids).tolist()
    if m.byte_of.keys().isdisjoint(numbers):
        text = "".join(map(m.shown.__getitem__, numbers))
    else:
        text = b"".join(map(m.raw.__getitem__, numbers)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _encoded(batch: pa.RecordBatch, m: Model):
    """(doc_id, text, ids) of slices of a batch."""
    _, off = buffers(batch.column(1))
    for lo, hi in slices(off, BATCH_BYTES):
        texts = batch.column(1).slice(lo, hi - lo).to_pylist()
        yield batch.column(0).slice(lo, hi - lo), texts, encode_batch(m, texts)


_DIGEST = (("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_chars", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_()))


def _digested(docs: pa.Array, texts: list, ids: list, m: Model) -> pa.RecordBatch:
    rows = []
    for text, x in zip(texts, ids):
        back = decode(m, x)
        rows.append((len(x) // 4, zlib.crc32(x), len(back), zlib.crc32(back.encode()), back == (text or "").replace(MARK, " ")))
    return pa.record_batch([docs, *(pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [()] * 5, _DIGEST[1:]))], names=[n for n, _ in _DIGEST])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, ids): ids of every text as packed 32-bit integers; a null or empty text has none.

    One row a row of `docs`; other columns are left out."""

    def run(batches):
        m = model(path)
        for batch in batches:
            for doc, texts, ids in _encoded(batch, m):
                yield pa.record_batch([doc, pa.array(texts, pa.string()), pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, ids binary")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches):
        m = model(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([decode(m, x.as_py() or b"") for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_chars, decoded_crc32, round_trip): every text encoded and decoded.

    round_trip: the decoded text is the text (null: empty), with word marks in it as spaces. One worker
    does both, so ids don't travel. Other columns are left out; ids may be null or repeat."""

    def run(batches):
        m = model(path)
        for batch in batches:
            for doc, texts, ids in _encoded(batch, m):
                yield _digested(doc, texts, ids, m)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, decoded_crc32 long, round_trip boolean")
