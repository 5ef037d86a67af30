"""Shared helpers: Arrow text blocks as numpy arrays, word spans and hashes, shared-folder tables, sessions' sizes."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy block holds; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Documents of one block at most (12 bits of a sort key hold the document's place).
BLOCK_DOCS = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (np.uint64(_BASE), inverse))
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, (int(n) - 1).bit_length()))


@dataclass
class Block:
    """Some whole documents: their UTF-8 bytes one after the other, and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a block in order: byte spans, and the place of each document's first word."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


#: Rows that are turned into bytes at once.
SLICE_ROWS = 1024


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES, rows: int = SLICE_ROWS) -> Iterator[Block]:
    """Cuts a string column into blocks, of `rows` rows at most; null counts as empty."""
    for begin in range(0, len(column), rows):
        part = column.slice(begin, rows)
        if isinstance(part, pa.ChunkedArray):
            part = pa.concat_arrays(part.chunks)
        part = pc.fill_null(part.cast(pa.large_string()), "")
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(part):
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(part), first + BLOCK_DOCS)
            yield Block(begin + first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last


def find_words(block: Block, space: np.ndarray = _SPACE) -> Words:
    """Runs of bytes that `space` doesn't mark; no run crosses documents."""
    return word_spans(block, ~space[block.data])


def word_spans(block: Block, inside: np.ndarray) -> Words:
    """Runs of bytes that are marked as `inside`; no run crosses documents."""
    begins, stops = inside.copy(), inside.copy()
    if len(inside):
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        heads = block.offsets[:-1][block.offsets[:-1] < len(inside)]
        begins[heads] = inside[heads]
        tails = block.offsets[1:][block.offsets[1:] > 0] - 1
        stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def hash_words(block: Block, words: Words, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words; with `lower`, A-Z count as a-z."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(block.data))
    data = _LOWER[block.data] if lower else block.data
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=sums[1:])
        value = (sums[words.ends] - sums[words.starts]) * down[words.starts]
        return mix(value + (words.ends - words.starts).astype(np.uint64) * _M2)


def combine(*parts: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes; the order and the number count."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            out = mix(out * np.uint64(_BASE) + p)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def fold_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def crc_mod(ids: np.ndarray, modulus: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(str(i).encode()) % modulus for i in ids), np.int64, len(ids))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir; where that is unset, on one machine only, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/maskwright-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_files: int | None = None) -> DataFrame:
    """Cuts the lineage: writes `df` to the shared folder and reads it back."""
    return Scratch(df.sparkSession).written(df, partition_files)


#: Whether Spark removes the shuffle files of a query as it ends, rather than with the driver's garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in the shared folder, which can go before the end of the job; with `free`, the shuffle files go when a table is written."""

    def __init__(self, spark: SparkSession, free: bool = False, codec: str | None = None):
        self.spark, self.paths, self.free, self.options = spark, {}, free, {"compression": codec} if codec else {}

    def written(self, df: DataFrame, partition_files: int | None = None) -> DataFrame:
        path, before = shared_dir(self.spark), self.spark.conf.get(FREE_SHUFFLES, "false")
        if self.free:
            self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            (df.coalesce(partition_files) if partition_files else df).write.options(**self.options).parquet(path)
        finally:
            if self.free:
                self.spark.conf.set(FREE_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that written() returned and that nothing reads any more."""
        path = self.paths.pop(id(df))[0]
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm, True)


#: Bits of the table that narrowed() broadcasts: 2 MB, whatever the number of keys.
NARROW_BITS = 1 << 24


def narrowed(df: DataFrame, key: Column, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of `df` whose key (a 64-bit hash) may be in `wanted.key`, and none that is; or else the others.

    A bit for each of NARROW_BITS slots of hashes tells whether a wanted key is in it. The bits are a broadcast table of at
    most NARROW_BITS / 64 rows. With more keys than bits all rows may be wanted, and nothing is narrowed but all is right.
    """
    slot = lambda h: h.bitwiseAND(F.lit(NARROW_BITS - 1))
    words = wanted.select(F.shiftright(slot(F.col("key")), 6).alias("_word"), F.expr(f"shiftleft(1L, cast((key & {NARROW_BITS - 1}) & 63 AS INT))").alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    names = [c for c in df.columns]
    marked = df.withColumn("_slot", slot(key)).withColumn("_at", F.shiftright("_slot", 6)).join(F.broadcast(words), F.col("_at") == F.col("_word"), "inner" if inside else "left")
    hit = F.expr("(shiftrightunsigned(coalesce(_bits, 0L), cast(_slot & 63 AS INT)) & 1L) = 1")
    return marked.where(hit if inside else ~hit).select(*names)


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of `df` whose key (a 64-bit hash) isn't in `gone.key`; only rows that may be in it are shuffled."""
    maybe = narrowed(df, key, gone).withColumn("_key", key).join(gone.select(F.col("key").alias("_gone")), F.col("_key") == F.col("_gone"), "left_anti")
    return narrowed(df, key, gone, False).unionByName(maybe.drop("_key"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state that each task makes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            if b.num_rows:
                yield from step(b)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives back the memory that a task has freed, as its worker goes on to others."""
    pa.default_memory_pool().release_unused()
    if (give := _malloc_trim()) is not None:
        give(0)


@lru_cache(maxsize=1)
def _malloc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not this C library
        return None
