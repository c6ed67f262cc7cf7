"""Suffix-array dedup: remove bytes covered by long strings that an earlier document holds too.

A byte of a text (UTF-8) goes if some string of LENGTH bytes that covers it also starts in a document
with a smaller doc_id. Windows of LENGTH bytes are compared in three rounds, each linear in the input:

1. Texts are written once, in compressed chunks. A window's key is the least hash of its GRAM-byte
   grams, so equal windows have equal keys, and neighbours mostly share one: a run of windows with
   one key is a segment. Chunks send their distinct keys, packed; keys of one document only are
   dropped for good.
2. Chunks send each distinct segment of the other keys, with the least doc_id that holds it in the
   chunk, so a passage that a third of all documents share is sent once a chunk. Segments of a range
   of keys form one suffix array, sorted deep-shallow: multikey quicksort on 8-byte symbols to a
   shallow depth, then blind tries, which skip what all suffixes of a group share and branch where
   they first differ, to the window's length. Windows of one class get the least doc_id of all.
3. Chunks learn where a smaller doc_id than their own holds a window, and cut their documents.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, claim, drop, materialise, slices
from .words import mix, prefix_hashes, range_hashes

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 2_000_000
RANGE_BYTES = 3_000_000
KEY_RANGE_BYTES = 12_000_000  # of text, whose keys are 5 to 8 bytes for about 14
SHALLOW = 16  # bytes that the multikey quicksort sorts
KEY_BYTES = 5  # of a key that chunks send, at least; 8 at most
KEY_SPARE = 9  # bits of a key beyond those that number all keys: few that are held once then look common


def key_bytes(size: int) -> int:
    """Bytes of a key to send for `size` bytes of text, which have about a key for 14 of them."""
    return min(8, max(KEY_BYTES, -(-((size // 14 + 1).bit_length() + KEY_SPARE) // 8)))


def flag(width: int) -> np.uint64:
    """The lowest bit of a sent key: it says that several documents hold it."""
    return np.uint64(1 << (64 - 8 * width))


def bare(keys: np.ndarray, width: int) -> np.ndarray:
    """Keys as they are sent, without that bit."""
    return keys & ~np.uint64((1 << (65 - 8 * width)) - 1)


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, blob): slices of about CHUNK_BYTES of text with all columns, as compressed Arrow streams."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, off = buffers(batch.column(at))
            for lo, hi in slices(off, CHUNK_BYTES):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(pa.record_batch([c.slice(lo, hi - lo) for c in batch.columns], schema=batch.schema))
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([sink.getvalue()], pa.binary())], names=["chunk", "blob"])
                number += 1

    return docs.mapInArrow(run, "chunk long, blob binary")


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def spread(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def opened(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(blob)).read_all()


class Runs:
    """Segments of one chunk: runs of windows with one key, in order of place."""

    def __init__(self, table: pa.Table):
        claim("suffixes")
        self.raw, self.off = buffers(table.column("text"))
        ids = table.column("doc_id").combine_chunks() if table.column("doc_id").num_chunks != 1 else table.column("doc_id").chunk(0)
        self.known = np.asarray(ids.is_valid())
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        starts, keys, sizes, docs = [], [], [], []
        for lo, hi in slices(self.off, 400_000):
            found = self._runs(lo, hi)
            if found:
                for to, x in zip((starts, sizes, keys, docs), found):
                    to.append(x)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.size, self.key, self.doc = cat(starts, np.int64), cat(sizes, np.int64), cat(keys, np.uint64), cat(docs, np.int64)

    def _runs(self, lo: int, hi: int):
        base = self.off[lo]
        raw, off = self.raw[base : self.off[hi]], self.off[lo : hi + 1] - base
        n = len(raw) - LENGTH + 1
        if n <= 0:
            return None
        v = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,)).astype(np.uint64)
        with np.errstate(over="ignore"):
            m = len(raw) - GRAM + 1
            h = v[:m] * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h = (h + v[8 : 8 + m]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h = mix(h + v[16 : 16 + m])
        want, width = LENGTH - GRAM + 1, 1
        while width < want:
            step = min(width, want - width)
            h = np.minimum(h[:-step], h[step:])
            width += step
        size = np.diff(off)
        last = np.zeros(n + 1, np.int32)  # windows that start in a document and end in it
        own = (size >= LENGTH) & self.known[lo:hi]
        np.add.at(last, off[:-1][own], 1)
        np.add.at(last, off[1:][own] - LENGTH + 1, -1)
        ok = np.cumsum(last[:-1]) > 0
        new = ok.copy()
        new[1:] &= (h[1:] != h[:-1]) | ~ok[:-1]
        begins = off[:-1][own]
        new[begins] = True
        start = np.flatnonzero(new)
        if not len(start):
            return None
        end = np.concatenate([start[1:], [n]])
        doc = np.searchsorted(off, start, side="right") - 1
        end = np.minimum(end, off[doc + 1] - LENGTH + 1)
        return start + base, end - start, h[start], doc + lo

    def segments(self, dups: np.ndarray):
        """Runs of the keys `dups` (sorted): which, the number of each's segment, and of every distinct
        segment a run that holds it and the least doc_id. Numbers follow from the chunk alone."""
        if not len(dups) or not len(self.key):
            z = np.zeros(0, np.int64)
            return z, z, z, z
        at = np.minimum(np.searchsorted(dups, self.key), len(dups) - 1)
        who = np.flatnonzero(dups[at] == self.key)
        total = prefix_hashes(mix(self.raw.astype(np.uint64) + np.uint64(977)))
        s = self.start[who]
        with np.errstate(over="ignore"):
            h = mix(range_hashes(total, s, s + self.size[who] + LENGTH - 1) + self.size[who].astype(np.uint64))
        order = np.lexsort((self.ids[self.doc[who]], h, self.key[who]))
        k, x = self.key[who][order], h[order]
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])]) if len(order) else np.zeros(0, bool)
        number = np.empty(len(who), np.int64)
        number[order] = np.cumsum(first) - 1
        one = who[order[first]]
        return who, number, one, self.ids[self.doc[one]]


def _dealt(number: np.ndarray, ranges: int) -> list[tuple[int, np.ndarray]]:
    """Indices by range of a key, in order."""
    where = (number % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    own, first = np.unique(where[order], return_index=True)
    return [(int(r), order[a:b]) for r, a, b in zip(own, first, [*first[1:], len(order)])]


def narrow(keys: np.ndarray, width: int) -> np.ndarray:
    """The upper bytes of each key: keys that agree there count as one, which only keeps more of them."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width])


def widened(data: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view(">u8")[:, 0].astype(np.uint64)


def send_keys(held: DataFrame, ranges: int, width: int) -> DataFrame:
    """(range, chunk, data): distinct keys of each chunk, upper bytes only; the lowest bit that is sent
    says that several documents hold it."""

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                r = Runs(opened(blob.as_buffer()))
                order = np.argsort(r.key, kind="stable")
                key, doc = bare(r.key[order], width), r.doc[order]
                if not len(key):
                    continue
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                keys = key[first] | np.where(several, flag(width), np.uint64(0))
                parts = _dealt(key[first] >> np.uint64(32), ranges)
                yield pa.record_batch([pa.array([p for p, _ in parts]), pa.array([chunk] * len(parts), pa.int64()), pa.array([narrow(keys[i], width).tobytes() for _, i in parts], pa.binary())], names=["range", "chunk", "data"])

    return held.mapInArrow(run, "range long, chunk long, data binary")


def common_keys(table: pa.Table, width: int) -> pa.Table:
    """Keys of several documents, for each chunk that holds them."""
    parts = [widened(x, width) for x in table.column("data").to_pylist()]
    keys = np.concatenate(parts)
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(p) for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, chunk = keys[order], chunk[order]
    plain = bare(keys, width)
    first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    several = (size > 1) | (np.maximum.reduceat(keys & flag(width), first) > 0)
    keep = np.repeat(several, size)
    keys, chunk = plain[keep], chunk[keep]
    order = np.argsort(chunk, kind="stable")
    keys, chunk = keys[order], chunk[order]
    own, at = np.unique(chunk, return_index=True)
    return pa.table([pa.array(own, pa.int64()), pa.array([narrow(keys[a:b], width).tobytes() for a, b in zip(at, [*at[1:], len(keys)])], pa.binary())], names=["chunk", "data"])


def _joined(table: pa.Table) -> pa.Table:
    """One row a chunk: what all ranges said of it."""
    return pa.table([table.column("chunk").slice(0, 1), pa.array([b"".join(table.column("data").to_pylist())], pa.binary())], names=["chunk", "data"])


def _dups(r: Runs, data: bytes | None, width: int) -> np.ndarray:
    """The chunk's full keys that are common."""
    return np.unique(r.key[np.isin(bare(r.key, width), widened(data or b"", width))])


def send_segments(held: DataFrame, ranges: int, width: int) -> DataFrame:
    """(range, chunk, data, text): data packs (number, bytes, least doc_id) of each distinct segment."""

    def run(batches):
        for batch in batches:
            for chunk, blob, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                r = Runs(opened(blob.as_buffer()))
                _, _, one, least = r.segments(_dups(r, data, width))
                if not len(one):
                    continue
                parts = _dealt(r.key[one] >> np.uint64(32), ranges)
                rows = []
                for p, i in parts:
                    start, size = r.start[one[i]], r.size[one[i]] + LENGTH - 1
                    pick = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    rows.append((p, chunk, squeezed(np.stack([i, size, least[i]]).astype(np.int64).tobytes()), squeezed(r.raw[pick].tobytes())))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "chunk", "data", "text"])

    return held.mapInArrow(run, "range long, chunk long, data binary, text binary")


def window_classes(raw: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sort of the suffixes at `at` to `length` bytes: their order, and the class of each in it."""
    symbols = np.ndarray((len(raw) - 7,), ">u8", np.ascontiguousarray(raw), strides=(1,))
    word = lambda i, d: symbols[at[i] + d].astype(np.uint64)
    # shallow: multikey quicksort, a symbol at a time, inside the groups that are still equal
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    for d in range(0, SHALLOW, 8):
        w = word(order, d)
        by = np.lexsort((w, group))
        order, group, w = order[by], group[by], w[by]
        group = np.cumsum(np.concatenate([[0], ((group[1:] != group[:-1]) | (w[1:] != w[:-1])).astype(np.int64)]))
    # deep: a blind trie for each group; at each node skip to the first symbol that isn't common to all
    depths = [*range(SHALLOW, length - 7, 8)]
    depths += [length - 8] if length - 8 not in depths else []
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    live = np.flatnonzero(size[group] > 1)
    for d in depths:
        if not len(live):
            break
        g = group[live]
        w = word(order[live], d)
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        members = np.diff(np.concatenate([head, [len(g)]]))
        branches = np.logical_or.reduceat(w != np.repeat(w[head], members), head)
        if branches.any():  # a branching node: its members fall into its children's order
            inside = np.flatnonzero(np.repeat(branches, members))
            by = np.lexsort((w[inside], g[inside]))
            order[live[inside]] = order[live[inside]][by]
            w[inside] = w[inside][by]
            cut = np.zeros(len(group), np.int64)
            cut[live[1:]] = (g[1:] == g[:-1]) & (w[1:] != w[:-1])
            group = group + np.cumsum(cut)
            size = np.bincount(group)
            live = live[size[group[live]] > 1]
    return order, group


def least_holders(table: pa.Table) -> pa.Table:
    """For each chunk, where windows of its segments are held by a smaller doc_id: (number, offset, windows, doc_id)."""
    heads = [np.frombuffer(spread(x), np.int64).reshape(3, -1).T for x in table.column("data").to_pylist()]
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(h) for h in heads])
    head = np.concatenate(heads)
    raw = np.frombuffer(b"".join(map(spread, table.column("text").to_pylist())) + b"\0" * 8, np.uint8)
    begin = np.cumsum(head[:, 1]) - head[:, 1]
    windows = head[:, 1] - LENGTH + 1
    seg = np.repeat(np.arange(len(head)), windows)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, group = window_classes(raw, begin[seg] + offset)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.empty(len(seg), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(head[seg[order], 2], first), np.diff(np.concatenate([first, [len(order)]])))
    who = np.flatnonzero(least < head[seg, 2])
    s, o, m = seg[who], offset[who], least[who]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1) | (m[1:] != m[:-1])]) if len(who) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate([start, [len(who)]]))
    rows = np.stack([head[s[start], 0], o[start], size, m[start]], 1).astype(np.int64) if len(who) else np.zeros((0, 4), np.int64)
    of = chunk[s[start]] if len(who) else np.zeros(0, np.int64)
    by = np.argsort(of, kind="stable")
    own, at = np.unique(of[by], return_index=True)
    rows = rows[by]
    return pa.table([pa.array(own, pa.int64()), pa.array([rows[a:b].tobytes() for a, b in zip(at, [*at[1:], len(rows)])], pa.binary())], names=["chunk", "data"])


def removed(r: Runs, dups: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk go. told: rows of least_holders()."""
    who, number, _, least = r.segments(dups)
    edge = np.zeros(len(r.raw) + 1, np.int32)
    own = r.ids[r.doc[who]]
    hit = least[number] < own if len(who) else np.zeros(0, bool)
    np.add.at(edge, r.start[who[hit]], 1)
    np.add.at(edge, r.start[who[hit]] + r.size[who[hit]] + LENGTH - 1, -1)
    if len(told) and len(who):
        told = told[np.argsort(told[:, 0], kind="stable")]
        lo, hi = np.searchsorted(told[:, 0], number), np.searchsorted(told[:, 0], number, side="right")
        n = hi - lo
        run = np.repeat(np.arange(len(who)), n)
        row = told[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        less = row[:, 3] < own[run]
        start = r.start[who[run[less]]] + row[less, 1]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + row[less, 2] + LENGTH - 1, -1)
    return np.cumsum(edge[:-1]) > 0


OUT = ("long", "array<struct<start:long,length:long>>", "binary")


NAMES = ("n_bytes", "spans", "kept")


def dedup(docs: DataFrame, names: tuple[str, str, str] = NAMES, then=None) -> DataFrame:
    """docs' columns, then n_bytes, spans (maximal removed runs, in bytes) and kept (the other bytes, joined).

    One row a row of `docs` (doc_id, text, and any others; columns that are called as `names` are
    replaced). A null text is empty. A row with a null doc_id loses nothing and takes nothing
    from others; rows that repeat a doc_id take nothing from each other. Texts under LENGTH bytes stay.
    `then` may change the batches before they leave the worker: a function, and the schema it makes.
    """
    docs = docs.drop(*names)
    held = materialise(chunks(docs), "text-chunks")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(8, -(-size // KEY_RANGE_BYTES))
    width = key_bytes(size)
    dups = materialise(send_keys(held, ranges, width).groupBy("range").applyInArrow(lambda table: common_keys(table, width), "chunk long, data binary").groupBy("chunk").applyInArrow(_joined, "chunk long, data binary"), "common-keys")
    ranges = max(8, -(-size // RANGE_BYTES))
    with_keys = held.join(dups, "chunk").select("chunk", "blob", "data")
    told = send_segments(with_keys, ranges, width).groupBy("range").applyInArrow(least_holders, "chunk long, data binary").groupBy("chunk").applyInArrow(_joined, "chunk long, data binary")
    told = materialise(told, "least-holders")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, {', '.join(f'`{n}` {t}' for n, t in zip(names, OUT))}"
    names = [*docs.columns, *names]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for batch in batches:
            for blob, data, said in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                table = opened(blob.as_buffer())
                r = Runs(table)
                gone = removed(r, _dups(r, data, width), np.frombuffer(said or b"", np.int64).reshape(-1, 4)) if data else np.zeros(len(r.raw), bool)
                gone = np.concatenate([gone, [False]])
                turn = gone[:-1].copy()
                turn[1:] &= ~gone[:-2]
                starts = r.off[:-1][r.off[:-1] < len(r.raw)]
                turn[starts] = gone[starts]
                begin = np.flatnonzero(turn)
                total = np.concatenate([[0], np.cumsum(gone[:-1])])
                doc = np.searchsorted(r.off, begin, side="right") - 1
                # a span ends at the next byte that stays, or with its document
                stay = np.flatnonzero(~gone)
                end = np.minimum(stay[np.searchsorted(stay, begin)], r.off[doc + 1])
                first = np.searchsorted(doc, np.arange(len(r.off)))
                kept = r.raw[~gone[:-1]].tobytes()
                at = r.off - total[r.off]
                spans = [[{"start": int(b - r.off[k]), "length": int(e - b)} for b, e in zip(begin[x:y], end[x:y])] for k, (x, y) in enumerate(zip(first, first[1:]))]
                extra = [pa.array(np.diff(r.off)), pa.array(spans, spans_type), pa.array([kept[a:b] for a, b in zip(at, at[1:])], pa.binary())]
                out = pa.record_batch([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns] + extra, names=names)
                yield then[0](out) if then else out

    whole = held.join(dups, "chunk", "left").join(told.withColumnRenamed("data", "said"), "chunk", "left").select("blob", "data", "said")
    return whole.mapInArrow(run, then[1] if then else schema)


def cut_texts(docs: DataFrame) -> DataFrame:
    """docs with their texts cut as dedup() says: the kept bytes, without characters that were cut through.

    n_chars, where there is one, becomes the new length. Texts that lost all they had go; null and
    empty texts stay as they are."""
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")

    def shorten(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [x.decode("utf-8", "ignore") for x in batch.column("_kept").to_pylist()]
        old = batch.column(at).to_pylist()
        new = [o if not o else k for o, k in zip(old, kept)]
        stay = pa.array([not o or bool(k.strip()) or o == k for o, k in zip(old, kept)], pa.bool_())
        out = list(batch.columns[: len(columns)])
        out[at] = pa.array(new, pa.string())
        if "n_chars" in columns:
            n = columns.index("n_chars")
            out[n] = pa.array([was if not o else len(k) for o, k, was in zip(old, kept, out[n].to_pylist())], out[n].type)
        return pa.record_batch([c.filter(stay) for c in out], names=columns)

    return dedup(docs, ("_n_bytes", "_spans", "_kept"), (shorten, schema))


def digest(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return deduped.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same by plain joins on the windows themselves (bytes in hexadecimal digits); for small tables.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM p),
m AS (SELECT s, min(doc_id) AS held FROM w GROUP BY s),
c AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE held < doc_id),
b AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS new FROM c),
k AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM k GROUP BY ALL),
g AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after FROM r),
x AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last, string_agg(substr(h, 2 * after + 1, 2 * (lo - after)), '' ORDER BY lo) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""
