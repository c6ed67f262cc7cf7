"""Binary token files: one wavelet matrix per file, succinct bit-planes with rank and select.

A file holds the ids of consecutive documents in ascending order of doc_id. Layout, all little-endian:
b"WMX2"; header length; header (JSON: tokens, bits, zeros of each plane, documents, block size, codec);
document ids and token counts (deflate, delta-coded); a directory of block places and ranks; the planes'
blocks, each compressed by itself. A block begins with the ones before each of its stretches of STRETCH
bits, so that a rank counts the ones of one stretch at most. Token access, counting and occurrence
lookup read the blocks that they need from the one compressed file.

Files are rows (shard, file, first_id, tokens, content) of a table that Spark writes, so any store that
Spark knows will do; export() puts them one by one into a folder that the executors share.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import encoder

BLOCK = 1 << 16  # bits a block
STRETCH = 512  # bits
FILE_TOKENS = 2_000_000  # a shard with more tokens gives several files
SHARD_BYTES = 20_000_000
MAX_SHARDS = 20_000  # cuts that the driver holds; shards grow beyond
BROADCAST_FILES = 100_000


def build(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Planes (bit arrays, the highest bit first) and zeros of each: every plane is sorted stably by the one above."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    narrow = np.uint16 if bits <= 16 else np.uint32
    planes, zeros, now = [], [], ids.astype(narrow)
    for level in range(bits - 1, -1, -1):
        bit = (now & narrow(1 << level)).astype(bool)
        planes.append(bit)
        low = np.flatnonzero(~bit)  # indices, as masks of random bits are slow to apply
        zeros.append(len(low))
        if level:
            now = np.concatenate([now.take(low), now.take(np.flatnonzero(bit))])
    return planes, zeros


def _blocks(plane: np.ndarray, block: int):
    """Each block's bytes (counts of ones before its stretches, then its bits) and its ones."""
    size, per = STRETCH // 8, block // STRETCH
    packed = np.packbits(plane)
    bits = np.zeros((max(1, -(-len(packed) // size)), size), np.uint8)
    bits.ravel()[: len(packed)] = packed
    ones = np.bitwise_count(bits.view(np.uint64)).sum(1, dtype=np.int64)
    for lo in range(0, len(bits), per):
        own = ones[lo : lo + per]
        before = np.cumsum(own) - own
        yield before.astype("<u2").tobytes() + bits[lo : lo + per].tobytes(), int(before[-1] + own[-1])


def write_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    planes, zeros = build(ids)
    known = np.array([-1 if d is None else d for d in doc_ids], np.int64)
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = zlib.compress(np.diff(known, prepend=0).astype("<i8").tobytes() + null.tobytes() + counts.astype("<i8").tobytes(), 1)
    body, places, ranks, at = [], [], [], 0
    for plane in planes:
        ones = 0
        for raw, more in _blocks(plane, BLOCK):
            block = len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)
            places.append(at)
            ranks.append(ones)
            ones += more
            at += len(block)
            body.append(block)
    places.append(at)
    header = json.dumps({"tokens": len(ids), "bits": len(planes), "zeros": zeros, "documents": len(doc_ids), "docs_bytes": len(docs), "block": BLOCK, "stretch": STRETCH, "codec": "zstd"}).encode()
    directory = np.array(places + ranks, "<u8").tobytes()
    return b"".join([b"WMX2", struct.pack("<I", len(header)), header, docs, directory, *body])


class TokenFile:
    """Reads one file; blocks are inflated when they are asked for."""

    def __init__(self, content: bytes):
        view = memoryview(content)
        if bytes(view[:4]) != b"WMX2":
            raise ValueError("not a token file")
        (n,) = struct.unpack("<I", view[4:8])
        self.head = h = json.loads(bytes(view[8 : 8 + n]))
        at = 8 + n
        docs = zlib.decompress(view[at : at + h["docs_bytes"]])
        m = h["documents"]
        ids = np.cumsum(np.frombuffer(docs, "<i8", m))
        null = np.frombuffer(docs, np.uint8, m, 8 * m)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.counts = np.frombuffer(docs, "<i8", m, 9 * m)
        at += h["docs_bytes"]
        self.per = max(1, -(-h["tokens"] // h["block"]))
        blocks = self.per * h["bits"]
        directory = np.frombuffer(view, "<u8", 2 * blocks + 1, at)
        self.places, self.ranks = directory[: blocks + 1].astype(np.int64), directory[blocks + 1 :].astype(np.int64)
        self.body = view[at + 8 * (2 * blocks + 1) :]
        self.size, self.bits, self.zeros = h["tokens"], h["bits"], h["zeros"]
        self.stretch = h["stretch"]
        self._held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each stretch of a block, and its bits, packed."""
        k = plane * self.per + block
        if k not in self._held:
            data = self.body[self.places[k] : self.places[k + 1]]
            raw = pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
            n = len(raw) // (2 + self.stretch // 8)
            self._held[k] = np.frombuffer(raw, "<u2", n), np.frombuffer(raw, np.uint8, offset=2 * n)
        return self._held[k]

    def rank1(self, plane: int, place: int) -> int:
        """Ones among the first `place` bits of a plane."""
        if place <= 0:
            return 0
        block, inside = divmod(place - 1, self.head["block"])
        counts, bits = self._block(plane, block)
        part, rest = divmod(inside + 1, self.stretch)
        if part == len(counts):
            part, rest = part - 1, self.stretch
        own = bits[part * self.stretch // 8 :][: -(-rest // 8)]
        ones = int(np.bitwise_count(own).sum()) - (int(own[-1] & ((1 << (-rest % 8)) - 1)).bit_count() if rest % 8 else 0)
        return int(self.ranks[plane * self.per + block]) + int(counts[part]) + ones

    def select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        step, ranks = self.head["block"], self.ranks[plane * self.per : (plane + 1) * self.per]
        before = ranks if bit else np.arange(self.per) * step - ranks
        block = bisect.bisect_right(before.tolist(), k) - 1
        counts, bits = self._block(plane, block)
        inside = counts.astype(np.int64) if bit else np.arange(len(counts)) * self.stretch - counts
        k -= int(before[block])
        part = bisect.bisect_right(inside.tolist(), k) - 1
        own = np.unpackbits(bits[part * self.stretch // 8 : (part + 1) * self.stretch // 8])
        return block * step + part * self.stretch + int(np.flatnonzero(own == bit)[k - int(inside[part])])

    def access(self, place: int) -> int:
        out = 0
        for plane in range(self.bits):
            block, inside = divmod(place, self.head["block"])
            bit = self._block(plane, block)[1][inside >> 3] >> (7 - (inside & 7)) & 1
            ones = self.rank1(plane, place)
            place = self.zeros[plane] + ones if bit else place - ones
            out = out << 1 | int(bit)
        return out

    def _range(self, token: int, place: int) -> tuple[int, int]:
        """Where the tokens of that value among the first `place` stand below the last plane: first, end."""
        lo, hi = 0, place
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self.rank1(plane, lo), self.rank1(plane, hi)
            lo, hi = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (self.bits - 1 - plane) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Times a token stands at places lo..hi-1."""
        hi = self.size if hi is None else hi
        a, b = self._range(token, lo), self._range(token, hi)
        return (b[1] - b[0]) - (a[1] - a[0])

    def occurrence(self, token: int, k: int) -> int | None:
        """Place of the k-th (from 0) occurrence of a token, or None."""
        lo, hi = self._range(token, self.size)
        if k < 0 or lo + k >= hi:
            return None
        place = lo + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            place = self.select(plane, bit, place - self.zeros[plane] if bit else place)
        return place

    def tokens(self) -> np.ndarray:
        """All ids: the stable sorts of the planes are undone from the last plane up."""
        narrow = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.size, narrow)
        if not self.size:
            return now
        for plane in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(np.concatenate([self._block(plane, b)[1] for b in range(self.per)]), count=self.size).view(bool)
            back = np.empty(self.size, narrow)
            z = self.zeros[plane]
            back[np.flatnonzero(~bit)] = now[:z]
            back[np.flatnonzero(bit)] = now[z:] | narrow(1 << (self.bits - 1 - plane))
            now = back
            for b in range(self.per):
                self._held.pop(plane * self.per + b, None)
        return now


FILES = "shard long, file int, first_id long, tokens long, content binary"


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Encode every text (null: empty), append the end id and write files in ascending doc_id order.

    The table of files (shard, file, first_id, tokens, content), kept at `path` if one is given. Shards
    are ranges of doc_id of about SHARD_BYTES of text, cut at approximate quantiles; a null id comes
    first, and equal ids stay together, ordered by their ids' bytes. Each is sorted, and streamed into
    files of about FILE_TOKENS tokens, so a task holds one file however large its shard. Ids are made
    before the shuffle, which so moves ids and no text. Other columns are left out.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = min(MAX_SHARDS, max(1, -(-size // SHARD_BYTES)))
    cuts = sorted(set(docs.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.25 / shards))) if shards > 1 else []
    width = "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() < 65536 else "<u4"

    def encode(batches):
        e, tail, edges = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), np.array(cuts, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [np.frombuffer(x + tail, "<u4").astype(width).tobytes() for x in e.encode_all(part.column(1).to_pylist())]
                doc = part.column(0)
                shard = np.searchsorted(edges, doc.fill_null(-(2**62)).to_numpy(), side="right")
                yield pa.record_batch([pa.array(shard, pa.int64()), doc, pa.array(found, pa.binary())], names=["shard", "doc_id", "ids"])

    def files(batches):
        shard, number, held, tokens = None, 0, [], 0

        def close():
            ids = [np.frombuffer(x, width) for _, x in held]
            content = write_file([d for d, _ in held], np.array([len(x) for x in ids]), np.concatenate(ids))
            return pa.record_batch([pa.array([x], t) for x, t in zip((shard, number, held[0][0], tokens, content), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "file", "first_id", "tokens", "content"])

        for batch in batches:
            for s, doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (s != shard or tokens >= FILE_TOKENS):
                    yield close()
                    number, held, tokens = (number + 1 if s == shard else 0), [], 0
                shard = s
                held.append((doc, ids))
                tokens += len(ids) // np.dtype(width).itemsize
        if held:
            yield close()

    coded = docs.select("doc_id", "text").mapInArrow(encode, "shard long, doc_id long, ids binary")
    written = coded.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(files, FILES)
    if path is None:
        return materialise(written, "token-files")
    written.write.parquet(path)
    return files_at(docs.sparkSession, path)


def files_at(spark, path: str) -> DataFrame:
    """A table of files that write() has kept."""
    return spark.read.schema(FILES).parquet(path)


def export(written: DataFrame, folder: str) -> DataFrame:
    """(path, bytes): every file put into `folder`, which all executors must share, named by shard and number."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for shard, number, content in zip(*(c.to_pylist() for c in batch.columns)):
                name = os.path.join(folder, f"{shard:08d}-{number:06d}.wmx")
                with open(f"{name}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f"{name}.{os.getpid()}", name)  # a task that runs twice leaves one whole file
                out.append((name, len(content)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), ()), (pa.string(), pa.int64()))], names=["path", "bytes"])

    return written.select("shard", "file", "content").mapInArrow(run, "path string, bytes long")


def read(written: DataFrame) -> DataFrame:
    """Documents of token files: (doc_id, start, n_tokens, ids_crc32); start counts ids of all documents before."""
    heads = written.select("shard", "file", "tokens", F.expr("shard div 256").alias("span"))  # one row a file
    spans = heads.groupBy("span").agg(F.sum("tokens").alias("n"))
    spans = spans.select("span", F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # MAX_SHARDS / 256 rows
    order = Window.partitionBy("span").orderBy("shard", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.join(F.broadcast(spans), "span").withColumn("before", F.col("base") + F.coalesce(F.sum("tokens").over(order), F.lit(0))).select("shard", "file", "before")
    starts = F.broadcast(starts) if written.select("shard").count() <= BROADCAST_FILES else starts

    def run(batches):
        for batch in batches:
            for before, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = TokenFile(content.as_buffer())
                ids = np.ascontiguousarray(f.tokens(), "<u4")
                ends = np.cumsum(f.counts)
                begins = ends - f.counts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.record_batch([pa.array(f.doc_ids, pa.int64()), pa.array(begins + before), pa.array(f.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return written.join(starts, ["shard", "file"]).select("before", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
