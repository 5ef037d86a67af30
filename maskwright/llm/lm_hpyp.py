"""A hierarchical Pitman-Yor language model over word pairs, words and their spelling, with seating sampled by Gibbs.

Each word that precedes another has a restaurant, which seats the training tokens that follow it; a document's first word
follows the end of a document. Its base is the word restaurant: a table of a context's restaurant is a customer there. The
base of the word restaurant is a spelling model: the probability of a word's bytes and its end under restaurants whose
contexts are the last two symbols; these share parents with one symbol of context, these the restaurant without context,
and that the uniform measure. A table of the word restaurant is a customer of the two-symbol restaurants, a table of
these a customer of their parents, and so on. A Gibbs sweep seats all customers again given the other restaurants: seats
of a dish's customers are drawn in the order of the Chinese restaurant process, beyond the first few in blocks that
double. Scores are predictions of the seats, tables and word probabilities averaged over SAMPLES sweeps after BURN_IN.

Words that training doesn't know have the probability of their spelling. In the base score they are one event.

Counts cover all training documents and stay distributed: one row per distinct word and one per distinct pair that training
has more than once. Only the spelling restaurants are gathered; they have at most 258**2 * 257 cells, whatever the corpus.
Words and pairs are counted in blocks of BLOCK_DOCS documents, and merged in cells of their hashes: what is known of a
block's distinct words and pairs comes back to it. Of those that training has once it is told where other blocks have them
too; else its own count is all. Such words have one customer and one table, so that a block prices them by their spelling.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, combine, fold_crc, map_batches, mix, shuffle_partitions, signed, text_blocks, trim, word_spans

BLOCK_DOCS = 2048
BURN_IN, SAMPLES = 1, 3
#: Strength of all restaurants; discounts of the spelling restaurants by the length of the context.
STRENGTH, SPELLING_DISCOUNT = 1.0, (0.1, 0.3, 0.5)
#: Words whose sums over pairs a task holds before it hands them on.
SUM_WORDS = 1 << 20
#: Parts of the blocks that are scored one after the other, which bounds what is in the shuffle at once.
SLICES = 3
#: Symbols: bytes, the end of a word, its start.
END, START, SYMBOLS = 256, 257, 258


def tokens(text: bytes) -> list[bytes]:
    """Lower-case A-Z; words between ASCII white space, then the end (an empty word)."""
    return [*text.lower().split(), b""]


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(mix(keys) + np.uint64(salt)) >> np.uint64(11)).astype(float) * 2.0**-53


def seat(customers: np.ndarray, base: np.ndarray, discount: float, strength: float, tables: np.ndarray | float, keys: np.ndarray, salt: int) -> np.ndarray:
    """How many tables each dish's customers take, drawn in turn; `tables` is the number of tables in its restaurant.

    A customer opens a table with odds (strength + discount * tables) * base against (seated - discount * own tables).
    The draw depends on keys and salt only, so that a task that runs again draws the same.
    """
    open_ = (strength + discount * np.asarray(tables, float)) * base
    t = (customers > 0).astype(float)
    for k in range(1, 8):
        live = np.flatnonzero(customers > k)
        if not len(live):
            return t
        p = open_[live] / (open_[live] + np.maximum(k - discount * t[live], 1e-9))
        t[live] += _uniform(keys[live], salt * 1000 + k) < p
    n = 8.0
    while len(live := np.flatnonzero(customers > n)):
        size, own = np.clip(customers[live] - n, 0, n), keys[live]
        p = open_[live] / (open_[live] + np.maximum(n - discount * t[live], 1e-9))
        u, v = _uniform(own, salt * 1000 + 100 + int(n).bit_length()), _uniform(own, salt * 1000 + 200 + int(n).bit_length())
        normal = np.sqrt(-2 * np.log(np.maximum(u, 1e-300))) * np.cos(2 * np.pi * v)
        mean = size * p
        few = np.floor(mean) + (u < mean - np.floor(mean))  # for small means rounding at random keeps the expectation
        many = np.round(mean + np.sqrt(mean * (1 - p)) * normal)
        t[live] += np.clip(np.where(mean < 10, few, many), 0, size)
        n *= 2
    return t


@dataclass
class Spelling:
    """Seated restaurants of 0, 1 and 2 symbols of context as sorted cells (context, symbol)."""

    cells: list[np.ndarray]  # keys of cells, by length of the context
    counts: list[np.ndarray]
    tables: list[np.ndarray]
    contexts: list[np.ndarray]
    context_counts: list[np.ndarray]
    context_tables: list[np.ndarray]

    def probability(self, codes: np.ndarray, order: int = 2) -> np.ndarray:
        """Of the last symbols of trigrams (code = (a * SYMBOLS + b) * SYMBOLS + c)."""
        p = np.full(len(codes), 1 / (SYMBOLS - 1))
        for k in range(order + 1):
            cell, context = codes % SYMBOLS ** (k + 1), codes % SYMBOLS ** (k + 1) // SYMBOLS
            c, t = _look(self.cells[k], cell, self.counts[k], self.tables[k])
            n, m = _look(self.contexts[k], context, self.context_counts[k], self.context_tables[k])
            p = (c - SPELLING_DISCOUNT[k] * t + (STRENGTH + SPELLING_DISCOUNT[k] * m) * p) / (STRENGTH + n)
        return p

    def words(self, words: list[bytes]) -> np.ndarray:
        return self.of(*trigram_codes(words), len(words))

    def of(self, codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Of n words, by their trigrams and the words these belong to: `probability` with all that depends on a cell or its
        context alone looked up."""
        cells, seen = self._tables()[:2]
        at = np.minimum(np.searchsorted(cells, codes), len(cells) - 1) if len(cells) else np.zeros(len(codes), np.int64)
        miss = np.flatnonzero(cells[at] != codes) if len(cells) else np.arange(len(codes))
        logs = seen[at] if len(cells) else np.empty(len(codes))
        logs[miss] = self.unseen(codes[miss])
        return np.exp(np.bincount(owner, logs, n))

    def unseen(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of trigrams that have no cell."""
        _, _, parent, weight, below = self._tables()
        context, last = codes // SYMBOLS, codes % SYMBOLS**2
        return np.log(weight[context] * parent[last] / below[context])

    def _tables(self) -> tuple[np.ndarray, ...]:
        """Cells with two symbols of context and their log probabilities, then the probability of each cell with one, and for
        each context of two what an unseen cell's parent is multiplied with and divided by."""
        if (own := getattr(self, "_looked_up", None)) is None:
            all_ = np.arange(SYMBOLS**2)
            n, m = _look(self.contexts[2], all_, self.context_counts[2], self.context_tables[2])
            own = self._looked_up = self.cells[2], np.log(self.probability(self.cells[2])), self.probability(all_, 1), STRENGTH + SPELLING_DISCOUNT[2] * m, STRENGTH + n
        return own

    @classmethod
    def empty(cls) -> Spelling:
        none = [np.zeros(0, np.int64) for _ in range(3)]
        return cls(none, none, none, none, none, none)

    @classmethod
    def sampled(cls, codes: np.ndarray, customers: np.ndarray, last: Spelling, salt: int) -> Spelling:
        """Seats the customers of the two-symbol cells, their tables in the one-symbol cells, and so on."""
        out = cls([None] * 3, [None] * 3, [None] * 3, [None] * 3, [None] * 3, [None] * 3)
        for k in (2, 1, 0):
            cells, inverse = np.unique(codes % SYMBOLS ** (k + 1), return_inverse=True)
            counts = np.bincount(inverse, customers, len(cells)) if len(cells) else np.zeros(0)
            contexts, group = np.unique(cells // SYMBOLS, return_inverse=True)
            had = _look(last.contexts[k], contexts, last.context_tables[k])[0] if len(last.cells[k]) else np.bincount(group, minlength=len(contexts))
            parent = last.probability(cells, k - 1) if k else np.full(len(cells), 1 / (SYMBOLS - 1))
            tables = seat(counts, parent, SPELLING_DISCOUNT[k], STRENGTH, had[group] if len(cells) else 0.0, cells.astype(np.uint64), salt * 10 + k)
            out.cells[k], out.counts[k], out.tables[k], out.contexts[k] = cells, counts, tables, contexts
            out.context_counts[k], out.context_tables[k] = (np.bincount(group, x, len(contexts)) for x in (counts, tables))
            codes, customers = cells, tables
        return out


def _look(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    if not len(keys):
        return [np.zeros(len(wanted)) for _ in values]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return [np.where(found, v[at], 0.0) for v in values]


def trigram_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (two symbols before, symbol) for all bytes and the end of each word, and the words they belong to."""
    return _trigrams(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))


def _column_trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for a binary column without nulls."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    return _trigrams(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), np.diff(offsets))


def _trigrams(raw: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = length + 3
    ends = np.cumsum(length)
    s = np.empty(ends[-1] if len(ends) else 0, np.int64)
    inner = np.ones(len(s), bool)
    inner[ends - 1] = False
    inner[ends - length] = inner[ends - length + 1] = False
    s[inner], s[ends - 1] = raw, END
    s[ends - length] = s[ends - length + 1] = START
    at = np.arange(len(s))
    scored = np.ones(len(s), bool)
    scored[ends - length] = scored[ends - length + 1] = False
    at = at[scored]
    return (s[at - 2] * SYMBOLS + s[at - 1]) * SYMBOLS + s[at], np.repeat(np.arange(len(length)), length - 2)


def _keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


#: A pair's key within a block, from the hashes of its words; the same as _pair_keys.
PAIR_KEY = "context ^ (shiftleft(word, 1) | shiftrightunsigned(word, 63))"


def _pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    c, w = context.view(np.uint64), word.view(np.uint64)
    return (c ^ (w << np.uint64(1) | w >> np.uint64(63))).view(np.int64)


@dataclass
class WordModel:
    discount: float
    total: int  # training tokens
    distinct: int
    tables: list[float]  # of the word restaurant, by kept sample
    before: list[float]  # that its seating was drawn with
    spelling: list[Spelling]  # that its seating was drawn with, by kept sample
    known: list[float]  # the spelling's probability of all known words, by kept sample
    salts: list[int]

    def log10(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Averaged predictive log10 probabilities of words with their training counts; all unknown words are one event."""
        return np.log10(np.maximum(self.predict(words, counts, spelled=False), 1e-300))

    def predict(self, words: list[bytes], counts: np.ndarray, spelled: bool = True) -> np.ndarray:
        """Averaged predictive probabilities; with `spelled`, an unknown word has that of its spelling."""
        p, keys = np.zeros(len(words)), _keys(words)
        for tables, before, spelling, known, salt in zip(self.tables, self.before, self.spelling, self.known, self.salts, strict=True):
            base = spelling.words(words)
            if not spelled:
                base = np.where(counts > 0, base, max(1 - known, 1e-9))
            t = seat(counts, base, self.discount, STRENGTH, before, keys, salt)
            p += (counts - self.discount * t + (STRENGTH + self.discount * tables) * base) / (STRENGTH + self.total)
        return p / len(self.salts)


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def fit_words(table: DataFrame) -> WordModel:
    """Gibbs sweeps over the word table (word binary, c long: all training tokens; words with c = 0 are ignored)."""
    seen = table.where("c > 0")
    s = seen.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    discount = _discount(s.n1, s.n2)
    out = WordModel(discount, s.n or 0, s.v, [], [], [], [], [])
    spelling, tables = Spelling.empty(), float(s.v)
    sc = table.sparkSession.sparkContext
    for sweep in range(BURN_IN + SAMPLES):
        shared = sc.broadcast((spelling, tables))
        rows = _sweep(seen, shared, discount, sweep).toPandas().sort_values("code")
        now, known = (float(rows.loc[rows["code"] == k, "n"].sum()) for k in (-1, -2))
        cells = rows[rows["code"] >= 0]
        if sweep >= BURN_IN:
            out.tables.append(now), out.before.append(tables), out.spelling.append(spelling), out.known.append(known), out.salts.append(sweep)
        spelling, tables = Spelling.sampled(cells["code"].to_numpy(np.int64), cells["n"].to_numpy(float), spelling, sweep), now
    return out


def _sweep(seen: DataFrame, shared, discount: float, sweep: int) -> DataFrame:
    """code, n: customers that the drawn tables bring to the two-symbol cells; code -1 has the number of tables, code -2 the words' base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, tables = shared.value
        codes, sums, taken, known = np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0
        for batch in batches:
            words = batch.column("word").to_pylist()
            base = spelling.words(words)
            t = seat(batch.column("c").to_numpy().astype(float), base, discount, STRENGTH, tables, _keys(words), sweep)
            own, owner = trigram_codes(words)
            codes, inverse = np.unique(np.concatenate([codes, own]), return_inverse=True)
            sums, taken = np.bincount(inverse, np.concatenate([sums, t[owner]]), len(codes)), taken + t.sum()
            known += base.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(codes, [-1, -2])), pa.array(np.append(sums, [taken, known]))], ["code", "n"])

    return seen.select("word", "c").mapInArrow(run, "code long, n double").groupBy("code").agg(F.sum("n").alias("n"))


#: A pair's entry in a cell, in planes of bytes: the step from the hash of the context before, the word's hash without its lowest byte, the training count.
_ENTRY = 8 + 7 + 4


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all first ones before all second ones, which compresses better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T


def _whole(planes: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _zipped(x: bytes | np.ndarray) -> bytes:
    x = x if isinstance(x, bytes) else np.ascontiguousarray(x).data
    return memoryview(x).nbytes.to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)


def _unzipped(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


def _block_cells(bits: int):
    """cell, block, pairs, words, n: a block's distinct pairs and words, dealt over 2**bits cells (8 bits and more), compressed.

    A pair's cell is that of the exclusive or of its words' hashes, so that the second's lowest byte needn't be sent. Pairs
    are in the order of their contexts; words are joined by blanks, n has their training counts and in how many distinct
    training pairs of the block they are the second and the first.
    """
    mask = np.uint64((1 << bits) - 1)

    def make():
        def step(batch):
            blocks = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1))
            texts, train = batch.column("text"), batch.column("train")
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(blocks)], strict=True):
                words, codes, n, _, _ = _paired(texts.slice(a, b - a), train.slice(a, b - a), places=False)
                h = _keys(words)
                u, w = codes // len(words), codes % len(words)
                # each token is the second of one pair; then the block's distinct training pairs with the word as second and as first
                held = np.stack([np.bincount(w, n, len(words)), np.bincount(w, n > 0, len(words)), np.bincount(u, n > 0, len(words))]).astype("<i4")
                context, word = h[u], h[w]
                cell = (context ^ word) & mask
                order = np.argsort(cell << np.uint64(64 - bits) | context >> np.uint64(bits))
                pairs = np.searchsorted(cell[order], np.arange((1 << bits) + 1, dtype=np.uint64))
                context = context[order]
                step_ = context.copy()
                step_[1:] -= context[:-1]
                heads = pairs[:-1][np.diff(pairs) > 0]
                step_[heads] = context[heads]
                sent = np.concatenate([_planes(step_.astype("<u8")), _planes(word[order].astype("<u8"))[1:], _planes(n[order].astype("<i4"))])
                mine = h & mask
                listed = np.argsort(mine, kind="stable")
                single = np.searchsorted(mine[listed], np.arange((1 << bits) + 1, dtype=np.uint64))
                words, held = [words[i] for i in listed.tolist()], held[:, listed]
                used = np.flatnonzero((np.diff(pairs) > 0) | (np.diff(single) > 0))
                cut = [(pairs[k], pairs[k + 1], single[k], single[k + 1]) for k in used.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()), pa.array(np.full(len(used), blocks[a])), pa.array([_zipped(sent[:, i:j]) for i, j, _, _ in cut], pa.binary()),
                        pa.array([_zipped(b" ".join(words[i:j])) for _, _, i, j in cut], pa.binary()), pa.array([_zipped(_planes(held[:, i:j].ravel())) for _, _, i, j in cut], pa.binary()),
                    ],
                    ["cell", "block", "pairs", "words", "n"],
                )

        return step

    return make


def _token_column(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The same as `tokens` of all texts as one column, with an end before the first text; and where each text's tokens begin, without that end."""
    data, lengths, counts = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for block in text_blocks(texts):
        raw = block.data
        inside = (raw != 32) & (raw - np.uint8(9) > 4)
        found = word_spans(block, inside)
        length = np.zeros(len(found.starts) + len(block), np.int64)
        length[np.arange(len(found.starts)) + found.docs] = found.ends - found.starts
        lengths.append(length)
        counts.append(found.counts + 1)
        raw = raw[inside]
        data.append(raw + (raw - np.uint8(65) < 26) * np.uint8(32))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    raw = np.concatenate([np.zeros(0, np.uint8), *data])
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), np.cumsum(np.concatenate(counts))


def _listed_bytes(column: pa.Array) -> list[bytes]:
    """The values of a large binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    raw = column.buffers()[2].to_pybytes() if column.buffers()[2] is not None else b""
    return [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _sorted_pairs(codes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and how often each is in training."""
    both = np.sort(codes << 1 | train)
    new = np.ones(len(both), bool)
    np.greater(both[1:] ^ both[:-1], 1, out=new[1:])
    starts = np.flatnonzero(new)
    return both[starts] >> 1, np.add.reduceat(both & 1, starts) if len(starts) else starts


def _paired(texts: pa.Array | pa.ChunkedArray, train: pa.Array | pa.ChunkedArray, places: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct words, distinct pairs (place of the context * number of words + place of the word), their training counts,
    with `places` for each token its pair, and where each text's tokens begin. A text's first context is the end."""
    column, bounds = _token_column(texts)
    listed = column.dictionary_encode()  # the end is the first word
    words, at = _listed_bytes(listed.dictionary), listed.indices.to_numpy().astype(np.int64)
    codes = at[:-1] * len(words) + at[1:]  # each text ends with the end, whose place is 0
    held = np.repeat(train.to_numpy(zero_copy_only=False).astype(bool) if isinstance(train, pa.Array) else train.to_numpy().astype(bool), np.diff(bounds))
    if not places:
        return words, *_sorted_pairs(codes, held), None, bounds
    codes, pair = np.unique(codes, return_inverse=True)
    return words, codes, np.bincount(pair[held], minlength=len(codes)), pair, bounds


def _merged_pairs(batches: Iterator[pa.RecordBatch], summed: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows of context, word, block, n in which those of a pair stand together. kind 0: pairs with their training count and
    blocks, without those that one block has at most once, and in `more` how many rows after the first have training counts;
    with `summed`, kinds 1 and 2: for contexts and for words, how many distinct training pairs have them (the other column is null)."""

    def rows(kind, context, word, c, blocks=None, more=None):
        n = len(context)
        blocks = pa.nulls(n, pa.list_(pa.int64())) if blocks is None else blocks
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind)), none if kind == 2 else pa.array(context), none if kind == 1 else pa.array(word), pa.array(c), blocks, none if more is None else pa.array(more)], ["kind", "context", "word", "c", "blocks", "more"])

    def sums(held):
        for kind in (1, 2):
            h, n = np.unique(np.concatenate(held[kind]), return_counts=True)
            yield rows(kind, h, h, n)

    def merged(x):
        context, word, block, n = x
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(context) != 0) | (np.diff(word) != 0)]))
        k, c = np.diff(np.append(starts, len(n))), np.add.reduceat(n, starts)
        if summed:
            seen = starts[c > 0]
            held[1].append(context[seen])
            held[2].append(word[seen])
        keep = (c > 1) | ((c == 1) & (k > 1))
        more = np.add.reduceat((n > 0).astype(np.int64), starts)[keep] - 1
        return rows(0, context[starts[keep]], word[starts[keep]], c[keep], _listed(block[np.repeat(keep, k)], k[keep]), more)

    held, left = {1: [], 2: []}, None
    for batch in batches:
        x = [batch.column(k).to_numpy() for k in ("context", "word", "block", "n")]
        if left is not None:
            x = [np.concatenate(z) for z in zip(left, x, strict=True)]
        if not len(x[0]):
            continue
        last = int(np.flatnonzero((x[0] != x[0][-1]) | (x[1] != x[1][-1]))[-1]) + 1 if (x[0][0], x[1][0]) != (x[0][-1], x[1][-1]) else 0
        left = [z[last:] for z in x]
        if last:
            yield merged([z[:last] for z in x])
        if sum(map(len, held[1])) > SUM_WORDS:
            yield from sums(held)
            held[1].clear(), held[2].clear()
    if left is not None:
        yield merged(left)
    if held[1]:
        yield from sums(held)


def _listed(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _packed(blocks: pa.ListArray) -> pa.Array:
    """Lists of blocks as bytes."""
    offsets, values = blocks.offsets.to_numpy().astype(np.int64), blocks.values.to_numpy().astype("<i4")
    values = values[offsets[0] : offsets[-1]]
    return pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(((offsets - offsets[0]) * 4).astype(np.int32)), pa.py_buffer(values)])


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of all lists of _packed, and the places of the lists that they are in."""
    bounds = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data = packed.buffers()[2]
    return np.frombuffer(data if data is not None else b"", "<i4")[bounds[0] // 4 : bounds[-1] // 4], np.repeat(np.arange(len(packed)), np.diff(bounds) // 4)


def _split_words(joined: bytes, n: int) -> pa.Array:
    """The n words that are joined by blanks."""
    raw = np.frombuffer(joined, np.uint8)
    blank = raw == 32
    ends = np.append(np.flatnonzero(blank), len(raw))[:n] - np.arange(n)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw[~blank])])


#: `second` and `first`: the distinct training pairs that have the word there, by blocks; pairs of several are counted `more` often too often.
MERGED = "kind long, context long, word long, c long, blocks binary, more long, second long, first long, text binary"


def _merged_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _block_cells sorted by cell, as MERGED has them: kind 0 of _merged_pairs, but that pairs which training has once
    are kind 3, with their key as word; and words as kind 4, with their hash (as word), training count and blocks. A task
    holds one cell."""

    def pairs(cell, block, sent):
        sent = [np.frombuffer(_unzipped(x), np.uint8).reshape(_ENTRY, -1) for x in sent]
        sizes, planes = np.array([x.shape[1] for x in sent]), np.concatenate(sent, axis=1)
        context, n = signed(np.concatenate([np.cumsum(_whole(x[:8], "<u8"), dtype=np.uint64) for x in sent])), _whole(planes[15:], "<i4").astype(np.int64)
        word = _whole(np.concatenate([((context ^ cell) & 255).astype(np.uint8)[None], planes[8:15]]), "<i8")
        key = _pair_keys(context, word)
        order = np.argsort(key)
        if (np.diff(context[order])[np.diff(key[order]) == 0] != 0).any():  # two pairs of one key
            order = np.lexsort((word, context))
        return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (context, word, np.repeat(block, sizes), n)], ["context", "word", "block", "n"])

    def words(block, sent, counts):
        n = [_whole(np.frombuffer(_unzipped(x), np.uint8).reshape(4, -1), "<i4").reshape(3, -1) for x in counts]
        sizes = np.array([x.shape[1] for x in n])
        listed = _split_words(b" ".join(_unzipped(x) for x, size in zip(sent, sizes.tolist(), strict=True) if size), int(sizes.sum())).dictionary_encode()
        at, text = listed.indices.to_numpy(), listed.dictionary.cast(pa.binary())
        order, k = np.argsort(at, kind="stable"), np.bincount(at, minlength=len(text))
        c, second, first = (pa.array(np.bincount(at, x, len(text)).astype(np.int64)) for x in np.concatenate(n, axis=1))
        h, none = signed(_keys(_listed_bytes(listed.dictionary))), pa.nulls(len(text), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), 4)), none, pa.array(h), c, _packed(_listed(np.repeat(block, sizes)[order], k)), none, second, first, text], names)

    def cells():
        cell, parts = None, []
        for batch in batches:
            at = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.diff(at, prepend=at[:1] - 1))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True):
                if parts and at[a] != cell:
                    yield cell, parts
                    parts = []
                cell = int(at[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield cell, parts

    def opened():
        for cell, parts in cells():
            block = np.concatenate([x.column("block").to_numpy() for x in parts])
            of = {k: [y for x in parts for y in x.column(k).to_pylist()] for k in ("pairs", "words", "n")}
            texts.append(words(block, of["words"], of["n"]))
            yield pairs(cell, block, of["pairs"])

    def widened(x):
        context, word, c = (x.column(k).to_numpy() for k in ("context", "word", "c"))
        once, none = c == 1, pa.nulls(x.num_rows, pa.int64())
        kind, key = pa.array(np.where(once, 3, 0)), np.where(once, _pair_keys(context, word), word)
        return pa.RecordBatch.from_arrays([kind, pa.array(context, mask=once), pa.array(key), pa.array(c), _packed(x.column("blocks")), x.column("more"), none, none, pa.nulls(x.num_rows, pa.binary())], names)

    names, texts = ["kind", "context", "word", "c", "blocks", "more", "second", "first", "text"], []
    for x in _merged_pairs(opened(), summed=False):
        yield widened(x)
        while texts:
            yield texts.pop()
    yield from texts
    trim()


#: `block` and `keys`: a block, and as bytes the keys of pairs (kind 5) or the hashes of words (kind 6) that it has.
SETTLED = MERGED + ", block int, keys binary"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of _merged_cells the pairs and words that training has more than once, as SETTLED. Those it has once, and several blocks
    have, are gathered by block, as kinds 5 and 6. Kind 7: how often (as c) the words it has once have a trigram (as word);
    -1 has the number of these words."""

    def gathered(kind):
        block, (keys,) = _by_block(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))
        held[kind].clear()
        size[kind] = 0
        return rows(len(block), kind=pa.array(np.full(len(block), kind)), block=pa.array(block, pa.int32()), keys=keys)

    def rows(n, **columns):
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in (x.split() for x in SETTLED.split(", "))])
    held, size, codes, n, words = {5: [], 6: []}, {5: 0, 6: 0}, np.zeros(0, np.int64), np.zeros(0), 0
    for batch in _merged_cells(batches):
        kind, c = batch.column("kind").to_numpy(), batch.column("c").to_numpy()
        kept = batch.filter(pa.array((kind == 0) | (c > 1)))
        yield rows(kept.num_rows, **dict(zip(kept.schema.names, kept.columns, strict=True)))
        once = batch.filter(pa.array((kind != 0) & (c == 1)))
        block, owner = _unpacked(once.column("blocks"))
        several = np.bincount(owner, minlength=once.num_rows)[owner] > 1
        kind, key = once.column("kind").to_numpy(), once.column("word").to_numpy()
        for new, old in ((5, 3), (6, 4)):
            wanted = np.flatnonzero(several & (kind[owner] == old))
            if len(wanted):
                held[new].append((block[wanted], key[owner[wanted]]))
                size[new] += len(wanted)
            if size[new] > SENT:
                yield gathered(new)
        if len(seen := np.flatnonzero(kind == 4)):
            own, counts = np.unique(_column_trigrams(once.column("text").take(pa.array(seen)))[0], return_counts=True)
            codes, inverse = np.unique(np.concatenate([codes, own]), return_inverse=True)
            n, words = np.bincount(inverse, np.concatenate([n, counts]), len(codes)), words + len(seen)
    for kind in held:
        if held[kind]:
            yield gathered(kind)
    yield rows(len(codes) + 1, kind=pa.array(np.full(len(codes) + 1, 7)), word=pa.array(np.append(codes, -1)), c=pa.array(np.append(n, words).astype(np.int64)))


@dataclass
class PairModel:
    discount: float
    words: DataFrame  # of words that training has more than once h, c (training tokens), and means over the samples: p (word restaurant), t (tables of its own restaurant)
    seats: DataFrame  # context, word, t: mean tables of pairs seen more than once
    tables: list[DataFrame]  # what `words` and `seats` read
    once: int  # words that training has once
    rare: RareWords  # all other words


def _reseat(discount: float, sweep: int, sampled: bool):
    """Draws the tables of pairs; `total` sums those of the kept sweeps."""

    def make():
        def step(batch):
            context, word, c, p, tables, total = (batch.column(k).to_numpy() for k in ("context", "word", "c", "p", "t", "total"))
            t = seat(c.astype(float), p, discount, STRENGTH, tables, combine(context.view(np.uint64), word.view(np.uint64)), sweep)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (context, word, c, t, total + t * sampled)], ["context", "word", "c", "drawn", "total"])

        return step

    return make


def _priced(shared, discount: float, salt: int):
    """Fills base, the spelling's probability of a word, and drawn, its tables in the word restaurant. shared: the spelling, and the tables to draw with."""

    def make():
        spelling, tables = shared.value

        def step(batch):
            base = spelling.of(*_column_trigrams(batch.column("word")), batch.num_rows)
            t = seat(batch.column("m").to_numpy(), base, discount, STRENGTH, tables, batch.column("h").to_numpy().view(np.uint64), salt)
            new = {"base": pa.array(base), "drawn": pa.array(t)}
            yield pa.RecordBatch.from_arrays([new.get(k, batch.column(k)) for k in batch.schema.names], batch.schema.names)

        return step

    return make


def _customers(words: DataFrame) -> DataFrame:
    """code, n: customers that the drawn tables bring to the two-symbol cells; code -1 has the number of tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums, taken = np.zeros(0, np.int64), np.zeros(0), 0.0
        for batch in batches:
            t = batch.column("drawn").to_numpy()
            own, owner = _column_trigrams(batch.column("word"))
            codes, inverse = np.unique(np.concatenate([codes, own]), return_inverse=True)
            sums, taken = np.bincount(inverse, np.concatenate([sums, t[owner]]), len(codes)), taken + t.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(codes, -1)), pa.array(np.append(sums, taken))], ["code", "n"])

    return words.where("drawn > 0").select("word", "drawn").mapInArrow(run, "code long, n double").groupBy("code").agg(F.sum("n").alias("n"))


def _gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = rows.toPandas()
    return table["code"].to_numpy(np.int64), table["n"].to_numpy(float)


def _total(codes: np.ndarray, n: np.ndarray) -> float:
    return float(n[codes == -1].sum())


@dataclass
class RareWords:
    """Words with one customer or none, which has its own table. states: of kept sweeps the spelling, what a base is multiplied
    with, and what all is divided by."""

    discount: float  # of the word restaurant
    states: list[tuple[Spelling, float, float]]

    def p(self, words: list[bytes], m: np.ndarray) -> np.ndarray:
        """Mean p of words with m customers, with each base as Spelling.of has it; a trigram is looked up once for all states."""
        codes, owner = trigram_codes(words)
        bits, ranks, logs = self._tables()
        word, bit = codes >> 6, (codes & 63).astype(np.uint64)
        inside, one = bits[word], np.uint64(1)
        at = ranks[word] + np.bitwise_count(inside & ((one << bit) - one))
        miss = np.flatnonzero((inside >> bit & one) == 0)
        at[miss] = 0
        missing, p = codes[miss], np.zeros(len(words))
        for (spelling, weight, total), known in zip(self.states, logs, strict=True):
            own = known[at]
            own[miss] = spelling.unseen(missing)
            p += (m - self.discount * m + weight * np.exp(np.bincount(owner, own, len(words)))) / total
        return p / len(self.states)

    def _tables(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The states' cells as bits, how many cells there are before each 64 of them, and the cells' log probabilities by state."""
        if (own := getattr(self, "_looked_up", None)) is None:
            cells = np.unique(np.concatenate([spelling.cells[2] for spelling, _, _ in self.states]))
            bits = np.zeros((SYMBOLS**3 >> 6) + 1, np.uint64)
            np.bitwise_or.at(bits, cells >> 6, np.uint64(1) << (cells & 63).astype(np.uint64))
            count, logs = np.bitwise_count(bits).astype(np.int64), []
            for spelling, _, _ in self.states:
                known = spelling.unseen(cells)
                known[np.searchsorted(cells, spelling.cells[2])] = spelling._tables()[1]
                logs.append(known if len(known) else np.zeros(1))
            own = self._looked_up = bits, np.cumsum(count) - count, logs
        return own


def fit_pairs(merged: DataFrame, scratch: Scratch) -> PairModel:
    """Gibbs sweeps over pairs, words and spelling. merged: the rows of _settled.

    A sweep's tables go as the next one's are there. Of each word a sweep keeps its base and the tables drawn for it; its
    probability is a sum of columns once the sweep's totals are known, which the next sweep and the means take. Words that
    training has once are in no pair that is seated, and have one customer and one table: sweeps need their sums only."""
    sc, written = merged.sparkSession.sparkContext, scratch.written
    zero = F.lit(0.0)
    # a pair seen once has one table; those seen more often have `drawn`
    twice = merged.where("kind = 0 AND more > 0").select(F.expr("stack(2, word, more, 0L, context, 0L, more) AS (h, d2, d1)")).groupBy("h").agg(F.sum("d2").alias("d2"), F.sum("d1").alias("d1"))
    table = merged.where("kind = 4").select(F.col("text").alias("word"), F.col("word").alias("h"), "c", "second", "first").join(twice.hint("shuffle_hash"), "h", "left")
    of = lambda name, d: (F.col(name) - F.coalesce(d, F.lit(0))).cast("double")
    start = written(table.select("word", "h", "c", of("second", "d2").alias("m1"), of("first", "d1").alias("t1")))
    pairs = merged.where("kind = 0").select("context", "word", "c")
    twos, many = pairs.agg(F.count_if(F.col("c") == 2), F.count("*")).first()
    rare_codes, rare_n = _gathered(merged.where("kind = 7").groupBy(F.col("word").alias("code")).agg(F.sum("c").cast("double").alias("n")))
    once = int(_total(rare_codes, rare_n))
    rare_codes, rare_n, states = rare_codes[rare_codes >= 0], rare_n[rare_codes >= 0], []
    s = start.agg(F.coalesce(F.sum("m1"), zero).alias("m"), F.count_if(F.col("m1") > 0).alias("v"), F.count_if(F.col("m1") == 1).alias("n1"), F.count_if(F.col("m1") == 2).alias("n2")).first()
    discount, own = _discount(int(s.m) + once - many, twos), _discount(s.n1 + once, s.n2)
    spelling, tables, customers = Spelling.empty(), float(s.v + once), s.m + once
    words = start.select("*", F.col("m1").alias("m"), F.col("t1").alias("t"), zero.alias("base"), zero.alias("drawn"), zero.alias("p_sum"), zero.alias("t_sum"))
    priced = lambda of, salt: map_batches(of, _priced(sc.broadcast((spelling, tables)), own, salt), "word binary, h long, c long, m1 double, t1 double, m double, t double, base double, drawn double, p_sum double, t_sum double")
    price = lambda: (F.col("m") - F.lit(own) * F.col("drawn") + F.lit(STRENGTH + own * tables) * F.col("base")) / F.lit(STRENGTH + customers)
    seats = pairs.withColumn("total", zero)
    old, prices = [], priced(words, BURN_IN + SAMPLES).select("h", price().alias("p"), "t")
    for sweep in range(BURN_IN + SAMPLES):
        joined = seats.select("context", "word", "c", "total").join(prices.select(F.col("h").alias("word"), "p").hint("shuffle_hash"), "word").join(words.select(F.col("h").alias("context"), "t").hint("shuffle_hash"), "context")
        held = sweep > BURN_IN  # the sweep before was a kept one
        moved = words.select("word", "h", "c", "m1", "t1", "base", "drawn", *((F.col("p_sum") + price()).alias("p_sum") if held else F.col("p_sum"), (F.col("t_sum") + F.col("t")).alias("t_sum") if held else F.col("t_sum")))
        seats = written(map_batches(joined, _reseat(discount, sweep, sweep >= BURN_IN), "context long, word long, c long, drawn double, total double"))
        more = seats.where("drawn > 1").select(F.expr("stack(2, word, drawn - 1, 0D, context, 0D, drawn - 1) AS (h, dm, dt)")).groupBy("h").agg(F.sum("dm").alias("dm"), F.sum("dt").alias("dt"))
        moved = moved.join(more.hint("shuffle_hash"), "h", "left")
        moved = moved.select("word", "h", "c", "m1", "t1", (F.col("m1") + F.coalesce("dm", zero)).alias("m"), (F.col("t1") + F.coalesce("dt", zero)).alias("t"), "base", "drawn", "p_sum", "t_sum")
        words = written(priced(moved, sweep))
        for x in old:
            scratch.drop(x)
        old = [seats, words]
        codes, n = _gathered(_customers(words))
        tables, customers = _total(codes, n) + once, float(words.agg(F.coalesce(F.sum("m"), zero)).first()[0]) + once
        if sweep >= BURN_IN:
            states.append((spelling, STRENGTH + own * tables, STRENGTH + customers))
        spelling = Spelling.sampled(np.concatenate([codes[codes >= 0], rare_codes]), np.concatenate([n[codes >= 0], rare_n]), spelling, sweep)
        prices = words.select("h", price().alias("p"), "t")
    mean = words.select("h", "c", ((F.col("p_sum") + price()) / SAMPLES).alias("p"), ((F.col("t_sum") + F.col("t")) / SAMPLES).alias("t"))
    return PairModel(discount, mean, seats.select("context", "word", (F.col("total") / SAMPLES).alias("t")), [start, words, seats], once, RareWords(own, states))


#: Entries that a task gathers before it sends them to their blocks.
SENT = 1 << 18


def _by_block(block: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The distinct blocks, and the values of each as bytes."""
    order = np.argsort(block, kind="stable")
    block, values = block[order], [x[order] for x in values]
    starts = np.flatnonzero(np.diff(block, prepend=block[:1] - 1)).tolist()
    return block[starts], [pa.array([x[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(block)], strict=True)], pa.binary()) for x in values]


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, key, c, p, t: the rows of key, c, p, t (p and t null: pairs) with `blocks`, gathered by block, columns as bytes."""

    def sent(kind):
        block, cut = _by_block(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))
        held[kind].clear()
        return pa.RecordBatch.from_arrays([pa.array(block), *cut, *[pa.nulls(len(block), pa.binary())] * (4 - len(cut))], ["block", "key", "c", "p", "t"])

    held = {False: [], True: []}
    for batch in batches:
        block, owner = _unpacked(batch.column("blocks"))
        word = batch.column("p").is_valid().to_numpy(zero_copy_only=False)[owner]
        for kind, names in ((False, ("key", "c")), (True, ("key", "c", "p", "t"))):
            wanted = np.flatnonzero(word == kind)
            if len(wanted):
                held[kind].append((block[wanted], *(batch.column(k).to_numpy(zero_copy_only=False)[owner[wanted]] for k in names)))
            if sum(len(x[0]) for x in held[kind]) > SENT:
                yield sent(kind)
    for kind in held:
        if held[kind]:
            yield sent(kind)
    trim()


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted keys stand; both are sorted, as looking up in order is faster."""
    order, asked = np.argsort(keys), np.argsort(wanted)
    out = np.empty(len(wanted), np.int64)
    out[asked] = order[np.searchsorted(keys[order], wanted[asked])]
    return out


def _score_block(bottom: float, discount: float, shared, left: pa.Table, right: pa.Table) -> pa.Table:
    """left: doc_id, text, train; right: rows of _sent, for words with their hash, c, p, t, for pairs with their key and c - discount * t,
    and rows without c, for pairs (as key) and words (as t) that training has once; bottom: log10 of the base's denominator; shared:
    RareWords. A pair or word without a row is of this block alone, or training doesn't have it: it has the block's count."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    if not left.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
    words, codes, n, pair, bounds = _paired(left.column("text"), left.column("train"))
    h = signed(_keys(words))
    u, w = codes // len(words), codes % len(words)
    once, right = right.filter(right.column("c").is_null()), right.filter(right.column("c").is_valid())
    single, double = right.filter(right.column("p").is_valid()), right.filter(right.column("p").is_null())
    column = lambda of, name, kind=float: np.frombuffer(b"".join(of.column(name).drop_null().to_pylist()), kind)
    c, p = np.bincount(w, n, len(words)), np.zeros(len(words))
    hashes, alone = column(single, "key", np.int64), column(once, "t", np.int64)
    at = _places(h, np.concatenate([hashes, alone]))
    c[at[len(hashes) :]], at = 1, at[: len(hashes)]
    t, rare = c.copy(), np.ones(len(words), bool)
    c[at], p[at], t[at] = (column(single, k) for k in ("c", "p", "t"))
    rare[at] = False
    rare = np.flatnonzero(rare)
    p[rare] = shared.value.p([words[i] for i in rare.tolist()], c[rare])
    seated, keys = n - discount * (n > 0), (column(double, "key", np.int64), column(once, "key", np.int64))
    seated[_places(_pair_keys(h[u], h[w]), np.concatenate(keys))] = np.concatenate([column(double, "c"), np.full(len(keys[1]), 1 - discount)])
    lp = np.log10(np.maximum((seated + (STRENGTH + discount * t[u]) * p[w]) / (STRENGTH + c[u]), 1e-300))
    base = np.log10(c + 1.0) - bottom
    own = w[pair]
    known = np.add.reduceat((c > 0).astype(np.int64)[own], bounds[:-1])  # each text has the end at least
    sums = [[math.fsum(of[at[a:b]].tolist()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] for of, at in ((base, own), (lp, pair))]
    return pa.table([left.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(known), *(pa.array(x, pa.float64()) for x in sums)], names)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    docs: doc_id and text; other columns are ignored. Null and empty texts have the end as their only token. Without
    training documents counts are 0: the base is uniform over the end alone (log10 of 1) and the model is its spelling.
    """
    place = "monotonically_increasing_id()"
    numbered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(fold_crc(F.col("doc_id"), 7) != 2, F.lit(True)).alias("train"),
        F.expr(f"cast(((({place} >> 33) << 12) ^ (({place} & {(1 << 33) - 1}) >> {BLOCK_DOCS.bit_length() - 1})) & {(1 << 31) - 1} AS INT)").alias("block"),  # blocks that share a number are one
    )
    # an Arrow batch may end within a block, so that a block's word or pair can come in several rows
    blocks = numbered.select("block", "text", "train")
    scratch = Scratch(docs.sparkSession, free=True, codec="zstd")
    bits = max(8, math.ceil(math.log2(max(4 * shuffle_partitions(docs.sparkSession), numbered.count() / BLOCK_DOCS))))
    found = map_batches(blocks, _block_cells(bits), "cell int, block int, pairs binary, words binary, n binary").repartition("cell").sortWithinPartitions("cell")
    merged = scratch.written(found.mapInArrow(_settled, SETTLED))  # the largest shuffle, before the other tables
    model = fit_pairs(merged, scratch)
    total, distinct = (x + model.once for x in merged.where("kind = 4").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first())
    bottom = math.log10(total + distinct + 1)

    none = F.lit(None).cast("double")
    seated = lambda t: F.col("c") - F.lit(model.discount) * t
    # a pair's key and context tell its word; rows are looked up by the key alone, which is faster than by two columns
    places = model.seats.select(F.expr(PAIR_KEY).alias("seat_key"), F.col("context").alias("seat_context"), "t").hint("shuffle_hash")
    many = merged.where("kind = 0").select(F.expr(PAIR_KEY).alias("key"), "context", "c", "blocks")
    many = many.join(places, (F.col("key") == F.col("seat_key")) & (F.col("context").bitwiseXOR(F.col("seat_context")) == 0))
    many = many.select("key", seated(F.col("t")).alias("c"), none.alias("p"), none.alias("t"), "blocks")
    nothing = F.lit(None).cast("binary")
    once = merged.where("kind IN (5, 6)").select("block", F.expr("if(kind = 5, keys, null)").alias("key"), nothing.alias("c"), nothing.alias("p"), F.expr("if(kind = 6, keys, null)").alias("t"))
    own = merged.where("kind = 4").select(F.col("word").alias("h"), "blocks").join(model.words.hint("shuffle_hash"), "h").select(F.col("h").alias("key"), F.col("c").cast("double").alias("c"), "p", "t", "blocks")
    send = lambda rows: rows.mapInArrow(_sent, "block int, key binary, c binary, p binary, t binary")
    start, words, seats = model.tables
    parts = [scratch.written(send(own))]
    for x in (start, words):  # before the larger part
        scratch.drop(x)
    parts.append(scratch.written(send(many).unionByName(once)))
    for x in (merged, seats):
        scratch.drop(x)
    sent, shared = parts[0].unionByName(parts[1]), docs.sparkSession.sparkContext.broadcast(model.rare)
    scored = None
    for k in range(SLICES):
        inside = F.pmod("block", F.lit(SLICES)) == k
        left, right = numbered.where(inside).select("block", "doc_id", "text", "train"), sent.where(inside)
        part = scratch.written(
            left.groupBy("block").cogroup(right.groupBy("block"))
            .applyInArrow(partial(_score_block, bottom, model.discount, shared), "doc_id long, n_tokens long, n_known long, base_score double, score double")
        )
        scored = part if scored is None else scored.unionByName(part)
    for x in parts:
        scratch.drop(x)
    return scored.select("doc_id", (fold_crc(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
