"""Byte-level BPE without a shuffle: encoding of blocks of documents by their distinct words, and decoding.

Documents are taken in blocks. The pattern's matches are numbered by the block's distinct words. Words that are tokens
are known at once; the others are arrays of their bytes' token ids, over which ranked merges are folded: each round
merges the pair of lowest rank in each word, looked up in a rank map, until no pair has a rank. The documents' ids are
put together from their words' ids; decoding concatenates the binary pieces of the ids.

`fold_merges` is that fold as Spark higher-order functions over a literal rank map, and `encode(..., native_fold=True)`
uses it. It gives the same ids, but needs more time than the limit allows (the README has the figures), so that the fold
runs over all words of a block at once in numpy unless it is asked for.

The rank map is an array: an entry holds a pair's two ids and the rank of their merge, which is also the id of the
merged token; each pair has two places, so that a lookup reads two entries.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_blocks, trim

#: Bytes of text in a block at most, but for a longer document.
BLOCK_BYTES = 2 << 20
#: Bytes of distinct words that are folded at once.
FOLD_BYTES = 1 << 18
NO_RANK = (1 << 31) - 1


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _is_prime(n: int) -> bool:
    return all(n % k for k in range(2, int(n**0.5) + 1))


def rank_map(ranks: dict[bytes, int]) -> tuple[list[int], int, int]:
    """The literal array and its two moduli: a pair (a, b) is at (a << 16 | b) % first or at first + (a << 16 | b) % second.

    Ids and ranks are packed in 16 bits each; larger vocabularies are refused."""
    if ranks and max(ranks.values()) >= 1 << 16:
        raise ValueError(f"the rank map holds ranks below {1 << 16}")
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a << 16 | b] = rank
    size = max(16, len(pairs) * 5 // 4)
    while True:
        while not _is_prime(size):
            size += 1
        second = size + 1
        while not _is_prime(second):
            second += 1
        table = [-1] * (size + second)
        if all(_place(table, key, rank, size, second) for key, rank in pairs.items()):
            return table, size, second
        size = size * 5 // 4


def _place(table: list[int], key: int, rank: int, first: int, second: int) -> bool:
    entry, side = key << 16 | rank, 0
    for _ in range(500):
        at = (entry >> 16) % first if side == 0 else first + (entry >> 16) % second
        entry, table[at] = table[at], entry
        if entry < 0:
            return True
        side = 1 if at < first else 0
    return False


@lru_cache(maxsize=2)
def _numpy_map(path: str) -> tuple[np.ndarray, int, int]:
    table, first, second = rank_map(load_ranks(path))
    out = np.array(table, np.int64), first, second
    del table
    trim()
    return out


def fold_words(flat: np.ndarray, lengths: np.ndarray, rank_map: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Folds the merges over all words at once: their byte ids one after the other -> their token ids and numbers of them.

    A round merges in each word the places of its lowest pair, from the left and without overlap, up to the first whose
    merge makes a pair of lower rank: as far as merging one place after the other would have gone on with that pair.
    """
    table, first, second = rank_map

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 16 | b
        one, two = table[key % first], table[first + key % second]
        return np.where(one >> 16 == key, one & 65535, np.where(two >> 16 == key, two & 65535, NO_RANK))

    token, owner = flat.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
    done_tokens, done_owners = [], []
    pairs = np.full(len(token), NO_RANK, np.int64)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    pairs[inside] = rank(token[inside], token[inside + 1])
    while len(token):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        lowest = np.minimum.reduceat(pairs, starts)
        size = np.diff(np.append(starts, len(token)))
        finished = np.repeat(lowest == NO_RANK, size)
        if finished.any():
            done_tokens.append(token[finished])
            done_owners.append(owner[finished])
            go = ~finished
            token, owner, pairs, lowest, size = token[go], owner[go], pairs[go], lowest[lowest < NO_RANK], size[lowest < NO_RANK]
            if not len(token):
                break
        at = np.flatnonzero(pairs == np.repeat(lowest, size))
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # places next to each other overlap: every second one counts
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[place % 2 == 0]
        made, own, n = pairs[at], owner[at], len(token)
        left, right = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
        before = np.where(np.diff(at, prepend=-9) == 2, made, token[left])
        lower = (at > 0) & (owner[left] == own) & (rank(before, made) < made) | (at + 2 < n) & (owner[right] == own) & (rank(made, token[right]) < made)
        so_far = np.cumsum(lower) - lower
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        at = at[so_far == np.repeat(so_far[heads], np.diff(np.append(heads, len(at))))]
        token[at] = pairs[at]
        keep = np.ones(len(token), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))
        token, owner, pairs = token[keep], owner[keep], pairs[keep]
        touched = np.concatenate([moved, moved[moved > 0] - 1])
        last = np.append(owner[1:] != owner[:-1], True)
        pairs[touched[last[touched]]] = NO_RANK
        touched = touched[~last[touched]]
        pairs[touched] = rank(token[touched], token[touched + 1])
    token, owner = np.concatenate([*done_tokens, np.zeros(0, np.int64)]), np.concatenate([*done_owners, np.zeros(0, np.int64)]).astype(np.int64)
    return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))


def _fold_in_parts(words: list[bytes], byte_ids: np.ndarray, rank_map: tuple) -> tuple[np.ndarray, np.ndarray]:
    """fold_words of parts of about FOLD_BYTES, which bounds its arrays."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    part = (np.cumsum(sizes) - sizes) // FOLD_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
    done = [fold_words(byte_ids[np.frombuffer(b"".join(words[a:b]), np.uint8)], sizes[a:b], rank_map) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(words: Column, table: list[int], first: int, second: int) -> Column:
    """array<array<bigint>> of byte ids -> array<array<bigint>> of token ids."""
    none = F.lit(NO_RANK).cast("bigint")
    empty = F.array().cast("array<bigint>")
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def with_table(t: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            def probe(key: Column) -> Column:
                one, two = F.get(t, (key % F.lit(first)).cast("int")), F.get(t, (key % F.lit(second) + F.lit(first)).cast("int"))
                return F.when(F.shiftright(one, 16) == key, one.bitwiseAND(F.lit(65535).cast("bigint"))).when(F.shiftright(two, 16) == key, two.bitwiseAND(F.lit(65535).cast("bigint"))).otherwise(none)

            return _let(a * F.lit(65536).cast("bigint") + b, probe)

        def merge(state: Column, _: Column) -> Column:
            ids, ranks = state["ids"], state["ranks"]

            def at(lowest: Column) -> Column:
                def made(i: Column) -> Column:
                    before = F.when(i >= 2, F.array(rank(F.get(ids, i - F.lit(2)), lowest))).otherwise(empty)
                    after = F.when(i + F.lit(1) < F.size(ids), F.array(rank(lowest, F.get(ids, i + F.lit(1))))).otherwise(empty)
                    n = F.size(ids)
                    return F.struct(
                        F.concat(F.slice(ids, F.lit(1), i - F.lit(1)), F.array(lowest), F.slice(ids, i + F.lit(2), n)).alias("ids"),
                        F.concat(F.slice(ranks, F.lit(1), F.greatest(i - F.lit(2), F.lit(0))), before, after, F.slice(ranks, i + F.lit(2), n)).alias("ranks"),
                    )

                return F.when(lowest < none, _let(F.array_position(ranks, lowest).cast("int"), made)).otherwise(state)

            return _let(F.coalesce(F.array_min(ranks), none), at)

        def encode(word: Column) -> Column:
            steps = F.when(F.size(word) >= 2, F.sequence(F.lit(2), F.size(word))).otherwise(F.array().cast("array<int>"))
            ranks = F.transform(steps, lambda k: rank(F.get(word, k - F.lit(2)), F.get(word, k - F.lit(1))))
            return F.aggregate(steps, F.struct(word.alias("ids"), ranks.alias("ranks")), merge)["ids"]

        return F.transform(words, encode)

    return _let(literal, with_table)


def _cut(path: str, pattern: str):
    def make():
        ranks, match = load_ranks(path), regex.compile(pattern).findall
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

        def step(batch):
            doc_ids = batch.column("doc_id")
            for block in text_blocks(batch.column("text"), BLOCK_BYTES):
                number = defaultdict(itertools.count().__next__)  # not its own __len__, which would keep it until a garbage collection
                parts, sizes, raw = [], [], block.data.tobytes()
                for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
                    words = match(raw[a:b].decode())
                    parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    sizes.append(len(words))
                known, fold, lengths = [], [], []
                for w in number:
                    w = w.encode()
                    r = ranks.get(w, -1)
                    known.append(r)
                    if r < 0:
                        fold.append(w)
                        lengths.append(len(w))
                flat = byte_ids[np.frombuffer(b"".join(fold), np.uint8)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
                one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
                yield pa.RecordBatch.from_arrays(
                    [
                        one(doc_ids.slice(block.first, len(block)).to_pylist(), pa.int64()), one(sizes, pa.int64()), one(np.concatenate(parts), pa.int32()), one(known, pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists),
                    ],
                    ["doc_ids", "sizes", "numbers", "known", "words"],
                )

        return step

    return make


def _assemble(path: str, finish, names: list[str]):
    def make():
        pieces = {r: t for t, r in load_ranks(path).items()}

        def step(batch):
            for row in range(batch.num_rows):
                value = lambda name: batch.column(name)[row].values  # noqa: B023, E731
                known = value("known").to_numpy(zero_copy_only=False)
                folded = value("words")
                offsets = np.frombuffer(folded.buffers()[1], np.int32)[folded.offset : folded.offset + len(folded) + 1] if len(folded) else np.zeros(1, np.int32)
                inner = folded.values.to_numpy(zero_copy_only=False) if len(folded) else np.zeros(0, np.int64)
                lengths, firsts = np.ones(len(known), np.int64), np.arange(len(known)) + len(inner)
                todo = known < 0
                lengths[todo], firsts[todo] = np.diff(offsets), offsets[:-1]
                ids = np.concatenate([inner, known])
                doc_ids, numbers = value("doc_ids"), value("numbers").to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(value("sizes").to_numpy(zero_copy_only=False))])
                out = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    w = numbers[a:b]
                    n = lengths[w]
                    ends = np.cumsum(n)
                    out.append(finish(ids[np.repeat(firsts[w] - (ends - n), n) + np.arange(ends[-1] if b > a else 0)].tolist(), pieces))
                yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, zip(*out, strict=True))], ["doc_id", *names])

        return step

    return make


def decode(ids: list[int], pieces: dict[int, bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, ids))


def _digest(ids: list[int], pieces: dict[int, bytes]):
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decode(ids, pieces)).hexdigest()


def _whole(ids: list[int], pieces: dict[int, bytes]):
    return ids, decode(ids, pieces).decode()


def _straight(path: str, pattern: str, finish, names: list[str]):
    """All in one: blocks of documents to finish(ids, pieces) of each."""

    def make():
        ranks, match = load_ranks(path), regex.compile(pattern).findall
        pieces, lookup = {r: t for t, r in ranks.items()}, _numpy_map(path)
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

        def step(batch):
            doc_ids = batch.column("doc_id")
            for block in text_blocks(batch.column("text"), BLOCK_BYTES):
                number = defaultdict(itertools.count().__next__)  # not its own __len__, which would keep it until a garbage collection
                parts, raw = [], block.data.tobytes()
                for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
                    words = match(raw[a:b].decode())
                    parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                words = [w.encode() for w in number]
                known = np.fromiter((ranks.get(w, -1) for w in words), np.int64, len(words))
                todo = np.flatnonzero(known < 0)
                fold = [words[i] for i in todo.tolist()]
                inner, counts = _fold_in_parts(fold, byte_ids, lookup)
                lengths, firsts = np.ones(len(known), np.int64), np.arange(len(known)) + len(inner)
                lengths[todo], firsts[todo] = counts, np.cumsum(counts) - counts
                ids, out = np.concatenate([inner, known]), []
                for w in parts:
                    n = lengths[w]
                    ends = np.cumsum(n)
                    out.append(finish(ids[np.repeat(firsts[w] - (ends - n), n) + np.arange(ends[-1] if len(w) else 0)].tolist(), pieces))
                del number, parts, words, fold, ids  # before the next block's
                yield pa.RecordBatch.from_arrays([doc_ids.slice(block.first, len(block)), *map(pa.array, zip(*out, strict=True))], ["doc_id", *names])

        return step

    return make


def _run(docs: DataFrame, path: str, pattern: str, finish, names: list[str], schema: str, native_fold: bool) -> DataFrame:
    if native_fold:
        return map_batches(_folded(docs, path, pattern), _assemble(path, finish, names), schema)
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _straight(path, pattern, finish, names), schema)


def _folded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    cut = map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _cut(path, pattern),
        "doc_ids array<bigint>, sizes array<bigint>, numbers array<int>, known array<bigint>, words array<array<bigint>>",
    )
    return cut.withColumn("words", fold_merges(F.col("words"), *rank_map(load_ranks(path))))


def encode(docs: DataFrame, path: str, pattern: str, native_fold: bool = False) -> DataFrame:
    """doc_id, ids and the decoded text of each row. docs: doc_id and text; null and empty texts have no ids."""
    return _run(docs, path, pattern, _whole, ["ids", "decoded"], "doc_id long, ids array<bigint>, decoded string", native_fold)


def digests(docs: DataFrame, path: str, pattern: str, native_fold: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the decoded bytes of each row; null and empty texts have no ids."""
    return _run(docs, path, pattern, _digest, ["n_tokens", "ids_sha256", "decoded_sha256"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", native_fold)
