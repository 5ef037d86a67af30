"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

Items are cut into windows of `size` words. The shingles (here words) of a window are ordered by rarity in the
documents, rarest first. A document holds a whole window only if it holds the window's rarest word, so that a prefix of
one word is necessary and enough to find candidates; its place in the window gives the only place where the window can
begin (positional bound), which must leave `size` words in the document (length bound). Candidates are then compared
word by word over the window (exact containment).

The items are the query set: they are taken in blocks of at most BLOCK_WINDOWS windows, one pass over the documents
for each block, so that what a task holds is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, without, written

#: Windows whose words one pass over the documents holds in memory (about 100 MB at most of words and places).
BLOCK_WINDOWS = 200_000

_DELIMITERS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_TABLE = bytearray(range(256))
for _b in _DELIMITERS:
    _TABLE[_b] = 0x20
for _b in range(65, 91):
    _TABLE[_b] = _b + 32
_TABLE = bytes(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and takes the runs of letters, digits and non-ASCII characters; null has none."""
    return text.encode().translate(_TABLE).split() if text else []


def item_windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class _Index:
    """Windows of a block of items by their rarest word; words are numbered, 0 is any other word."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list[int]]], frequency: dict[bytes, int], size: int):
        self.vocabulary: dict[bytes, int] = {}
        for w, _ in windows:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.size = size
        by_prefix = defaultdict(list)
        self.grid = np.zeros((len(windows), size), np.int32)
        self.length = np.array([len(w) for w, _ in windows], np.int64)
        self.items = [i for _, i in windows]
        place = np.zeros(len(windows), np.int64)
        for k, (w, _) in enumerate(windows):
            self.grid[k, : len(w)] = [self.vocabulary[x] for x in w]
            place[k] = min(range(len(w)), key=lambda i: (frequency.get(w[i], 0), w[i], i))
            by_prefix[self.grid[k, place[k]]].append(k)
        self.place = place
        n = len(self.vocabulary) + 1
        self.counts = np.zeros(n, np.int64)
        for v, ks in by_prefix.items():
            self.counts[v] = len(ks)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.order = np.array([k for v in sorted(by_prefix) for k in by_prefix[v]], np.int64)

    def matches(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur in documents numbered by the vocabulary: start positions and windows."""
        at = np.flatnonzero(self.counts[ids])
        if not len(at):
            return at, at
        out = []
        # groups of positions, so that candidates stay bounded
        for part in np.array_split(at, 1 + int(self.counts[ids[at]].sum() // 2_000_000)):
            n = self.counts[ids[part]]
            k = self.order[np.repeat(self.first[ids[part]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            pos = np.repeat(part, n)
            start = pos - self.place[k]
            doc = np.searchsorted(bounds, pos, side="right") - 1
            ok = (start >= bounds[doc]) & (start + self.length[k] <= bounds[doc + 1])
            start, k = start[ok], k[ok]
            for j in range(self.size):
                if not len(k):
                    break
                inside = j < self.length[k]
                ok = ~inside | (ids[np.minimum(start + j, len(ids) - 1)] == self.grid[k, j])
                start, k = start[ok], k[ok]
            out.append((start, k))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spans(batch: pa.RecordBatch, size: int = 1 << 18) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Documents' words, in groups of about `size` words."""
    texts, rows, n, first = batch.column("text"), [], 0, 0
    for i in range(len(texts)):
        rows.append(words_of(texts[i].as_py()))
        n += len(rows[-1])
        if n >= size:
            yield first, rows
            rows, n, first = [], 0, i + 1
    if rows:
        yield first, rows


def word_frequency(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of the (bounded) vocabulary stands in the documents."""
    names = sorted(vocabulary)
    ids = {w: i + 1 for i, w in enumerate(names)}

    def make():
        def step(batch):
            total = np.zeros(len(names) + 1, np.int64)
            for _, rows in _spans(batch):
                for words in rows:
                    total += np.bincount(np.fromiter((ids.get(w, 0) for w in words), np.int64, len(words)), minlength=len(total)) if len(words) > 4096 else 0
                small = [w for words in rows if len(words) <= 4096 for w in words]
                total += np.bincount(np.fromiter(map(ids.get, small, [0] * len(small)), np.int64, len(small)), minlength=len(total))
            seen = np.flatnonzero(total[1:])
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[1:][seen], pa.int64())], ["w", "n"])

        return step

    counts = map_batches(docs.select("text"), make, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {names[r.w]: r.n for r in counts.collect()}


def find_items(docs: DataFrame, items: DataFrame, size: int = 8, id_col: str = "doc_id") -> DataFrame:
    """For each document: n_words, hit spans and the items with windows in it.

    docs: id_col (integer) and text; items: item_id and text; other columns are ignored. Null texts have no words, items
    without words no windows; repeated rows of documents each get a row; repeated items count once by their id. An empty
    benchmark leaves all documents without hits. Returns id_col, n_words, n_hit, item_ids (sorted array<string>).
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = _item_blocks(rows, size)
    sc = docs.sparkSession.sparkContext
    frequency = word_frequency(docs, {x for b in blocks for w, _ in b[0] for x in w}) if blocks else {}
    indexes = [(_Index(w, frequency, size), names) for w, names in blocks]
    docs = docs.withColumn("key", F.lit(0).cast("long"))
    if len(indexes) > 1:  # rows keep their numbers in all passes, as they are written once
        docs = written(docs.withColumn("key", F.monotonically_increasing_id()))
    out = None
    for k in range(max(1, len(indexes))):
        shared = sc.broadcast(indexes[k] if indexes else None)
        part = map_batches(docs, _matcher(shared, size), "key long, id long, n_words long, spans array<long>, items array<string>")
        out = part if out is None else out.unionByName(part)
    if len(indexes) > 1:  # the passes' spans of a row are joined
        raise_many = out.groupBy("key", "id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        out = raise_many
    length = F.expr(
        "aggregate(array_sort(transform(sequence(1, size(spans) div 2), i -> struct(spans[2*i-2] AS a, spans[2*i-1] AS b))), "
        "struct(0L AS n, 0L AS z), (s, x) -> struct(s.n + greatest(0L, x.b - greatest(x.a, s.z)) AS n, greatest(s.z, x.b) AS z)).n"
    )
    return out.select(
        F.col("id").alias(id_col), "n_words", F.when(F.size("spans") > 0, length).otherwise(F.lit(0).cast("long")).alias("n_hit"), F.array_sort("items").alias("item_ids")
    )


def _item_blocks(rows: DataFrame, size: int):
    """Items' windows in blocks of BLOCK_WINDOWS: [(windows with the numbers of their items, the items' names)]."""
    blocks, seen, names, held = [], {}, [], 0
    for r in rows.toLocalIterator():
        own = item_windows(words_of(r.text), size)
        if not own:
            continue
        if held and held + len(own) > BLOCK_WINDOWS:
            blocks.append(([(w, sorted(set(i))) for w, i in seen.items()], names))
            seen, names, held = {}, [], 0
        names.append(r.item_id)
        for w in own:
            seen.setdefault(w, []).append(len(names) - 1)
        held += len(own)
    if seen:
        blocks.append(([(w, sorted(set(i))) for w, i in seen.items()], names))
    return blocks


def _matcher(shared, size: int):
    def make():
        index, names = shared.value or (None, [])
        ids_of = index.vocabulary if index else {}

        def step(batch):
            ids = batch.column("id")
            n_words, spans, items = [], [], []
            for _, rows in _spans(batch):
                bounds = np.concatenate([[0], np.cumsum([len(w) for w in rows])])
                own = [([], set()) for _ in rows]
                if index and bounds[-1]:
                    flat = np.empty(bounds[-1], np.int64)
                    for a, w in zip(bounds[:-1], rows, strict=True):
                        flat[a : a + len(w)] = [ids_of.get(x, 0) for x in w]
                    start, k = index.matches(flat, bounds)
                    order = np.argsort(start, kind="stable")
                    doc = np.searchsorted(bounds, start[order], side="right") - 1
                    for d, a, w in zip(doc.tolist(), start[order].tolist(), k[order].tolist(), strict=True):
                        a -= int(bounds[d])
                        s, found = own[d]
                        b = a + int(index.length[w])
                        if s and a <= s[-1]:
                            s[-1] = max(s[-1], b)
                        else:
                            s += [a, b]
                        found.update(index.items[w])
                n_words += np.diff(bounds).tolist()
                spans += [s for s, _ in own]
                items += [sorted({names[i] for i in f}) for _, f in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), ids.cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["key", "id", "n_words", "spans", "items"]
            )

        return step

    return make


def contamination(docs: DataFrame, items: DataFrame, size: int = 8, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= least_items) for each document."""
    found = find_items(docs, items, size)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.size("item_ids") >= least_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 8, least_items: int = 2) -> DataFrame:
    """Documents without those that are contaminated; the columns stay. Each row is judged by its own text, whatever its
    doc_id; rows that share both go or stay together. Only rows that may be contaminated are shuffled."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bad = contamination(docs.select(key.alias("doc_id"), "text"), items, size, least_items).where("contaminated").select(F.col("doc_id").alias("key"))
    return without(docs, key, written(bad.distinct()))


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
