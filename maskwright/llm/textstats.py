"""Statistics of whole documents, counted block by block with numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Block, combine, find_words, hash_words, map_batches, mix, text_blocks

#: Whole-number statistics, in the order of `counts`.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the learned models, in the order of `features`.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "alpha_share", "distinct_share", "bar_share", "bang_share",
    "log_lines", "words_per_line", "end_share", "long_word_share", "top_word_share", "punct_word_share", "space_share",
)
WINDOW = 8

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _DIGIT, _END, _PUNCT = _bytes("#*$%&|<>"), _bytes("0123456789"), _bytes('.!?:;"'), _bytes("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_ALPHA[0xC3:0xF5] = True  # first bytes of non-ASCII letters, nearly
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character
_BAR, _BANG = _bytes("|"), _bytes("!")


def _per_doc(block: Block, marks: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks)])
    return sums[block.offsets[1:]] - sums[block.offsets[:-1]]


def _duplicates(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Marks all members of the groups of equal (document, hash) with two or more."""
    key = (docs.astype(np.uint64) << np.uint64(52)) | hashes >> np.uint64(12)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _repeat_words(hashes: np.ndarray, words) -> np.ndarray:
    """Words of each document inside WINDOW-word windows that it holds twice or more."""
    n = len(hashes) - WINDOW + 1
    out = np.zeros(len(words.bounds) - 1, np.int64)
    if n <= 0:
        return out
    docs = words.docs
    two = combine(hashes[:-1], hashes[1:])
    with np.errstate(over="ignore"):
        four = mix(two[: len(hashes) - 3] * np.uint64(3) + two[2 : len(hashes) - 1])
        eight = mix(four[:n] * np.uint64(5) + four[4 : 4 + n])
    whole = np.flatnonzero(docs[:n] == docs[WINDOW - 1 :])
    again = whole[_duplicates(docs[whole], eight[whole])]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    np.add.at(out, docs[np.cumsum(edge)[:-1] > 0], 1)
    return out


def statistics(block: Block, learned: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray | None]:
    """Counts by name, and the feature matrix (documents x FEATURES)."""
    data, n_docs = block.data, len(block)
    words = find_words(block)
    h = hash_words(block, words, lower=False)
    first = _FIRST[data]
    word_chars = _per_doc(block, first & ~_SPACE[data])
    n_words = words.counts
    lines = find_words(block, _NEWLINE)
    filled = np.concatenate([[0], np.cumsum(~_SPACE[data])])
    has_word = filled[lines.ends] > filled[lines.starts]
    line_docs = lines.docs[has_word]
    line_hash = hash_words(block, lines, lower=False)[has_word]
    n_lines = np.bincount(line_docs, minlength=n_docs)
    key = np.unique((line_docs.astype(np.uint64) << np.uint64(52)) | line_hash >> np.uint64(12))
    distinct = np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=n_docs)
    counts = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": _per_doc(block, _SYMBOL[data]), "n_dup_lines": n_lines - distinct, "n_repeat_words": _repeat_words(h, words),
    }
    if not learned:
        return counts, None
    docs = words.docs
    key, times = np.unique((docs.astype(np.uint64) << np.uint64(52)) | h >> np.uint64(12), return_counts=True)
    owner = (key >> np.uint64(52)).astype(np.int64)
    kinds = np.bincount(owner, minlength=n_docs)
    top = np.zeros(n_docs, np.int64)
    np.maximum.at(top, owner, times)
    length = words.ends - words.starts
    last_line = np.bincount(line_docs, _END[data[lines.ends[has_word] - 1]], n_docs) if len(line_docs) else np.zeros(n_docs)
    by_word = lambda m: np.bincount(docs, m, n_docs) if len(docs) else np.zeros(n_docs)
    w, c, chars, l = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(_per_doc(block, first), 1), np.maximum(n_lines, 1)
    x = np.stack(
        [
            np.log1p(n_words), word_chars / w, counts["n_symbols"] / c, counts["n_dup_lines"] / l, counts["n_repeat_words"] / w, _per_doc(block, _UPPER[data]) / c, _per_doc(block, _DIGIT[data]) / c,
            _per_doc(block, _ALPHA[data]) / c, kinds / w, _per_doc(block, _BAR[data]) / c, _per_doc(block, _BANG[data]) / c, np.log1p(n_lines), n_words / l, last_line / l,
            by_word(length > 20) / w, top / w, by_word(_PUNCT[data[words.ends - 1]] if len(docs) else np.zeros(0)) / w, (chars - word_chars) / chars,
        ],
        axis=1,
    )
    return counts, x


def add_statistics(docs: DataFrame, scorer: Callable[[], Callable[[dict, np.ndarray], dict[str, np.ndarray]]], columns: str, keep: str = "doc_id long") -> DataFrame:
    """`keep` and the `columns` that scorer()(counts, features) makes of each document; null texts count as empty."""
    names, kept = [c.split()[0] for c in columns.split(", ")], [c.split()[0] for c in keep.split(", ")]

    def make():
        score = scorer()

        def step(batch):
            for block in text_blocks(batch.column("text")):
                made = score(*statistics(block))
                own = [batch.column(k).slice(block.first, len(block)) for k in kept]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(made[k]) for k in names)], [*kept, *names])

        return step

    types = dict(c.split() for c in keep.split(", "))
    return map_batches(docs.select(*(docs[k].cast(t).alias(k) for k, t in types.items()), docs["text"].cast("string").alias("text")), make, f"{keep}, {columns}")


def feature_frame(docs: DataFrame, keep: str = "doc_id long") -> DataFrame:
    """One double column for each of FEATURES."""
    return add_statistics(docs, lambda: lambda counts, x: dict(zip(FEATURES, x.T.astype(float), strict=True)), ", ".join(f"{f} double" for f in FEATURES), keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled documents, those with the smallest hashes of their ids."""
    from pyspark.sql import functions as F

    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    ids = ids.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    rows = feature_frame(some, "doc_id long, label double").toPandas().sort_values(["doc_id", *FEATURES])
    return rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float)
