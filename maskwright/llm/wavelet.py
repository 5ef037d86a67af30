"""Token ids as wavelet matrices: one per shard, with rank and select from bit planes.

Documents are dealt by doc_id ranges to shards, so that shards and rows inside them are in ascending doc_id order. A
shard's ids become a wavelet matrix: for each bit, from the highest that an id has, a plane of that bit of all ids, which
are then partitioned stably by it (zeros first). The structure answers access(i), rank(symbol, i) (counting) and
select(symbol, k) (occurrence lookup) without decoding the rest.

A shard is one self-contained file image in a row of a Parquet table, which any store that Spark knows can hold: magic,
header, document table (ids and lengths), the planes' directories, and the planes in blocks of BLOCK_BITS bits that are
compressed one by one. A directory has where each block stands and how many set bits are before it, so that a lookup
opens one or two blocks of a plane; `WaveletMatrix.from_bytes` opens an image without reading any.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_DOCS, Block, Words, _LOWER, find_words, hash_words, map_batches, shared_dir, text_blocks

MAGIC = b"WVMX0002"
BLOCK_BITS = 1 << 15
#: Ids in a shard at most, but that a longer document makes a shard of its own.
SHARD_IDS = 2 << 20
#: Bytes of text that are encoded at once.
TEXT_BYTES = 4 << 20


def _width(bits: int) -> type:
    """The narrowest of two types for numbers of so many bits."""
    return np.uint16 if bits <= 16 else np.uint32


class WaveletMatrix:
    """A sequence of integers of `bits` bits in `bits` planes, and the documents that it is made of."""

    def __init__(self, n: int, bits: int, zeros: list[int], ones: np.ndarray, block: Callable[[int, int], np.ndarray], doc_ids: np.ndarray, lengths: np.ndarray):
        """ones: for each plane the set bits before each block; block(plane, k): the bytes of a block."""
        self.n, self.bits, self.zeros, self.ones, self.block, self.doc_ids, self.lengths = n, bits, zeros, ones, block, doc_ids, lengths

    @classmethod
    def build(cls, values: np.ndarray, doc_ids: np.ndarray | None = None, lengths: np.ndarray | None = None) -> WaveletMatrix:
        """The planes are as many as the largest value has bits."""
        values = np.asarray(values, np.uint32)
        n, bits = len(values), int(values.max()).bit_length() if len(values) else 0
        planes, zeros, width = [], [], BLOCK_BITS // 8
        values = values.astype(_width(bits))
        for b in range(bits - 1, -1, -1):
            bit = (values & values.dtype.type(1 << b)).astype(bool)
            packed = np.zeros(-(-n // BLOCK_BITS) * width, np.uint8)
            packed[: -(-n // 8)] = np.packbits(bit, bitorder="little")
            planes.append(packed.reshape(-1, width))
            zeros.append(int(n - np.count_nonzero(bit)))
            if b:
                values = np.concatenate([values.take(np.flatnonzero(x)) for x in (~bit, bit)])  # faster than by masks
        counts = np.array([np.bitwise_count(p).sum(axis=1) for p in planes], np.int64).reshape(bits, -(-n // BLOCK_BITS))
        none = np.zeros(0, np.int64)
        return cls(n, bits, zeros, np.cumsum(counts, axis=1) - counts, lambda level, k: planes[level][k], none if doc_ids is None else np.asarray(doc_ids, np.int64), none if lengths is None else np.asarray(lengths, np.int64))

    def _bit(self, level: int, i: int) -> int:
        return int(self.block(level, i // BLOCK_BITS)[i % BLOCK_BITS >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a plane before place i."""
        k, rest = divmod(i, BLOCK_BITS)
        if k == self.ones.shape[1]:
            return self.n - self.zeros[level]
        out = int(self.ones[level, k])
        if rest:
            raw = self.block(level, k)
            out += int(np.bitwise_count(raw[: rest >> 3]).sum()) + (int(raw[rest >> 3]) & (1 << (rest & 7)) - 1).bit_count()
        return out

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if symbol >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, symbol: int, i: int) -> int:
        """How often the symbol stands before place i."""
        if symbol >> self.bits:
            return 0
        a, b = self._range(symbol, min(max(i, 0), self.n))
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """The place of the symbol's k-th occurrence, from 0; -1 if there are fewer."""
        if k < 0 or k >= self.rank(symbol, self.n):
            return -1
        i = self._range(symbol, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = symbol >> (self.bits - 1 - level) & 1
            i = self._find(level, i - self.zeros[level] if one else i, one)
        return i

    def _find(self, level: int, want: int, one: int) -> int:
        """The place of the plane's bit number `want` (from 0) of that kind."""
        counts = self.ones[level] if one else np.arange(self.ones.shape[1]) * BLOCK_BITS - self.ones[level]
        k = int(np.searchsorted(counts, want, side="right")) - 1
        bits = np.unpackbits(self.block(level, k), bitorder="little")
        return k * BLOCK_BITS + int(np.flatnonzero(bits == one)[want - int(counts[k])])

    def document(self, place: int) -> np.ndarray:
        """The ids of the document in that place of the document table."""
        first = int(self.lengths[:place].sum())
        return np.array([self.access(i) for i in range(first, first + int(self.lengths[place]))], np.uint32)

    def decode(self) -> np.ndarray:
        """All values: each plane's stable partition is undone, from the lowest bit up."""
        values = np.zeros(self.n, _width(self.bits))
        for level in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self.block(level, k) for k in range(self.ones.shape[1])])
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            before, one = np.empty_like(values), values[self.zeros[level] :]
            one |= values.dtype.type(1 << self.bits - 1 - level)
            before[np.flatnonzero(~bit)], before[np.flatnonzero(bit)] = values[: self.zeros[level]], one
            values = before
        return values.astype(np.uint32, copy=False)

    def to_bytes(self) -> bytes:
        blocks = self.ones.shape[1]
        packed = [zlib.compress(self.block(level, k).tobytes(), 1) for level in range(self.bits) for k in range(blocks)]
        table = zlib.compress(np.concatenate([np.diff(self.doc_ids, prepend=np.int64(0)), self.lengths]).astype("<i8").tobytes(), 1)
        directory = zlib.compress(np.concatenate([self.zeros, self.ones.ravel(), np.cumsum([0, *map(len, packed)])]).astype("<i8").tobytes(), 1)
        head = struct.pack("<QIIQQQ", self.n, self.bits, blocks, len(self.doc_ids), len(table), len(directory))
        return b"".join([MAGIC, head, table, directory, *packed])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits, blocks, docs, table, directory = struct.unpack_from("<QIIQQQ", raw, 8)
        at = 8 + struct.calcsize("<QIIQQQ")
        own = np.frombuffer(zlib.decompress(raw[at : at + table]), "<i8")
        where = np.frombuffer(zlib.decompress(raw[at + table : at + table + directory]), "<i8")
        places = where[bits + bits * blocks :] + at + table + directory

        @lru_cache(maxsize=64)
        def block(level: int, k: int) -> np.ndarray:
            x = level * blocks + k
            return np.frombuffer(zlib.decompress(raw[places[x] : places[x + 1]]), np.uint8)

        return cls(n, bits, where[:bits].tolist(), where[bits : bits + bits * blocks].reshape(bits, blocks), block, np.cumsum(own[:docs]), own[docs:])


_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+")


def _visible_bytes() -> dict[int, str]:
    """The byte-level vocabulary's character of each byte: printable ones stand for themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
# the letters from U+00C0 to U+00FF are this byte and one from 0x80; U+00D7 and U+00F7 are signs
_LATIN = 0xC3
_KIND[[_LATIN, *range(0x80, 0xC0)]] = _LETTER
_BAD = np.ones(256, bool)
_BAD[[9, 10, 11, 12, 13, *range(0x20, 0x7F), _LATIN]] = False


def plain_pieces(block: Block, words: Words) -> tuple[Words, np.ndarray, np.ndarray]:
    """The pieces of a block's chunks as the tokenizer's file cuts them, the block's bytes with plain chunks in lower case, and
    which pieces are plain.

    A chunk of printable ASCII and letters up to U+00FF without "<|" is plain: its pieces are runs of letters, single digits, runs of other signs, and
    after an apostrophe that begins such a run the endings s, t, m, d, re, ve and ll. Any other chunk is one piece.
    """
    data, n = block.data, len(block.data)
    low = _LOWER[data]
    bad = _BAD[data]
    if n > 1:
        bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        latin = np.flatnonzero(data[:-1] == _LATIN) + 1
        second = data[latin]
        letter = (second != 0x97) & (second != 0xB7)
        bad[latin] = ~letter
        low[latin] += np.where(letter & (second < 0x9F), 32, 0).astype(np.uint8)
    bads = np.flatnonzero(bad)
    plain = np.searchsorted(bads, words.ends) == np.searchsorted(bads, words.starts)
    inside = np.zeros(n + 1, np.int8)
    inside[words.starts[plain]] += 1
    inside[words.ends[plain]] -= 1  # words have ends of their own
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    kind = np.where(inside, _KIND[data], 0)
    begins = np.zeros(n, bool)
    if n > 1:
        begins[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    begins[words.starts] = True
    ends_of = np.zeros(n + 3, bool)
    ends_of[words.ends] = True  # no piece goes on here
    quote = np.flatnonzero(begins & inside & (data == 39))
    padded = np.concatenate([low, np.zeros(3, np.uint8)])
    quote = quote[~ends_of[quote + 1]]
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, [115, 116, 109, 100])
    long_ = ~ends_of[quote + 2] & (np.isin(one, [114, 118]) & (two == 101) | (one == 108) & (two == 108))
    for at, size in ((quote[short], 2), (quote[long_], 3)):
        begins[at + 1] = False
        after = at + size
        after = after[~ends_of[after]]
        begins[after[kind[after] == _LETTER]] = True
    starts = np.flatnonzero(begins)
    chunk = np.searchsorted(words.starts, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], n), words.ends[chunk])
    return Words(starts, ends, np.searchsorted(starts, block.offsets)), np.where(inside, low, data), plain[chunk]


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, where one of each stands (not always the first), and each hash's place among them."""
    order = np.argsort(hashes)
    own = hashes[order]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    inverse = np.empty(len(hashes), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return own[new], order[new], inverse


class Encoder:
    """tokenizers' ids of whole texts, kept by pieces, which no token of the vocabulary crosses.

    The library's model encodes the distinct pieces of plain chunks. Other chunks of printable Latin-1 are lower-cased and cut
    as the tokenizer's file says; all others, and those that may hold a special token, go through the whole library.
    """

    #: Pieces that are remembered at most.
    MOST = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.visible = _visible_bytes()
        self.pieces: dict[str, list[int]] = {}
        self.places: dict[int, int] = {}
        self._clear()

    def _clear(self):
        self.places.clear()
        self.pieces.clear()
        self.lengths = np.zeros(1 << 16, np.int64)
        self.firsts = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.n_ids = 0

    def _shown(self, piece: bytes) -> str:
        return piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.visible)

    def _piece(self, p: str) -> list[int]:
        got = self.pieces.get(p)
        if got is None:
            got = self.pieces[p] = [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.visible))]
        return got

    def chunk(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return [i for p in _PIECES.findall(text.lower()) for i in self._piece(p)]
        return self.whole.encode(text, add_special_tokens=False).ids

    def _add(self, keys: list[int], lists: list[list[int]]) -> np.ndarray:
        first, n = len(self.places), len(keys)
        self.places.update(zip(keys, range(first, first + n), strict=True))
        sizes = np.fromiter(map(len, lists), np.int64, n)
        total = self.n_ids + int(sizes.sum())
        while first + n > len(self.lengths):
            self.lengths, self.firsts = (np.concatenate([a, np.zeros_like(a)]) for a in (self.lengths, self.firsts))
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.lengths[first : first + n], self.firsts[first : first + n] = sizes, self.n_ids + np.cumsum(sizes) - sizes
        self.ids[self.n_ids : total] = [i for x in lists for i in x]
        self.n_ids = total
        return np.arange(first, first + n)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The block's ids and its documents' bounds in them."""
        words = find_words(block)
        if not len(words.starts):
            return np.zeros(0, np.uint32), np.zeros(len(block) + 1, np.int64)
        if len(self.places) > self.MOST or self.n_ids > 8 * self.MOST:
            self._clear()
        units, data, plain = plain_pieces(block, words)
        key, first, inverse = _distinct(hash_words(Block(block.first, data, block.offsets), units, lower=False))
        keys = key.tolist()
        place = np.fromiter(map(self.places.get, keys, [-1] * len(keys)), np.int64, len(key))
        new = np.flatnonzero(place < 0)
        if len(new):
            at, raw, tokenize, chunk, shown = first[new], data.tobytes(), self.model.tokenize, self.chunk, self._shown
            lists = [
                [t.id for t in tokenize(shown(raw[a:b]))] if p else chunk(raw[a:b].decode())
                for a, b, p in zip(units.starts[at].tolist(), units.ends[at].tolist(), plain[at].tolist(), strict=True)
            ]
            place[new] = self._add(key[new].tolist(), lists)
        place = place[inverse]
        n = self.lengths[place]
        ends = np.cumsum(n)
        at = np.repeat(self.firsts[place] - (ends - n), n) + np.arange(ends[-1])
        return self.ids[at], np.concatenate([[0], ends])[units.bounds]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def shards(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """One row per shard: part, seq, n_docs, n_ids and image (bytes, with the document table).

    Parts are in doc_id order, and so is seq inside a part. Null texts count as empty; rows without an id are left out, as a
    document table has none for them; repeated rows are documents of their own.
    """
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL").repartitionByRange(int(n), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, seq, part = _encoder(path), [], 0, 0

        def close():
            ids, lengths, values = zip(*held, strict=True)
            values, lengths, doc_ids = np.concatenate(values), np.concatenate(lengths), [i for x in ids for i in x]
            image = WaveletMatrix.build(values, doc_ids, lengths).to_bytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([image], pa.binary())], ["part", "seq", "n_docs", "n_ids", "image"]
            )

        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            doc_ids = batch.column("doc_id").to_pylist()
            for block in text_blocks(batch.column("text"), TEXT_BYTES, BLOCK_DOCS):
                ids, bounds = encoder.encode(block)
                lengths = np.diff(bounds) + 1
                values = np.insert(ids, bounds[1:], end_id)
                if held and total + len(values) > SHARD_IDS:
                    yield close()
                    held, total, seq = [], 0, seq + 1
                held.append((doc_ids[block.first : block.first + len(block)], lengths, values))
                total += len(values)
        if held:
            yield close()

    return ordered.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, image binary")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> str:
    """Writes the shards' images and returns the folder. Without documents there is no shard."""
    folder = folder or shared_dir(docs.sparkSession)
    shards(docs, tokenizer, end_id).write.parquet(folder)
    return folder


def read_documents(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the images alone.

    A shard's start is the sum of the sizes before it: the parts' sums over a window of one row per part, and within a part a
    window over its shards.
    """
    table = spark.read.parquet(folder)
    sizes = table.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per part of the range partitioning
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    starts = sizes.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inner"))
    placed = table.select("part", "seq", "image").join(starts.join(parts, "part").select("part", "seq", (F.col("inner") + F.col("before")).alias("start")), ["part", "seq"])

    def make() -> Callable:
        def step(batch):
            for start, image in zip(batch.column("start").to_pylist(), batch.column("image"), strict=True):
                shard = WaveletMatrix.from_bytes(image.as_py())
                values = shard.decode().astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(shard.lengths)])
                crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids), pa.array(bounds[:-1] + start), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return step

    return map_batches(placed.select("start", "image"), make, "doc_id long, start long, n_tokens long, ids_crc32 long")
