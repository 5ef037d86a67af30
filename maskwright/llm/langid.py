"""Language identification as inference in a multilingual mixture.

Learned from documents with a language: the counts of byte trigrams of letters (all other ASCII counts as one blank), in
a fixed number of buckets, and from them each language's log-likelihoods. A document is a mixture of languages; each of
its words comes from one of them. Expectation-maximisation over the words' n-gram likelihoods estimates the document's
proportions. The languages are ordered by these, and among the best one, the best two and so on the set with the highest
penalised likelihood is chosen. The prediction is the set's largest language, the score its proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, find_words, fold_crc, map_batches, text_blocks

BUCKETS = 1 << 16
SMOOTHING = 0.05
#: Rounds of expectation-maximisation, the most languages in a set, and the penalty of each further language:
#: half the logarithm of the number of words, and a share of that number.
ROUNDS, MOST_SET, PENALTY_SHARE = 6, 3, 0.02

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True


def folded(block: Block) -> Block:
    return Block(block.first, _FOLD[block.data], block.offsets)


def trigrams(block: Block, words) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all trigrams that begin one byte before a word's byte and end one byte after it, and their words."""
    data = np.concatenate([[0x20], block.data, [0x20]]).astype(np.uint32)
    length = words.ends - words.starts
    owner = np.repeat(np.arange(len(length)), length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - words.starts, length)
    before, after = data[at].copy(), data[at + 2].copy()
    before[np.cumsum(length) - length] = 0x20  # words end at their document's ends too
    after[np.cumsum(length) - 1] = 0x20
    code = before << np.uint32(16) | data[at + 1] << np.uint32(8) | after
    return (code * np.uint32(2654435761)) >> np.uint32(16), owner


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # buckets x languages

    def predict(self, block: Block) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per document: the language, its proportion in the chosen set, and the set's size."""
        n_docs = len(block)
        pred, score, sizes = np.zeros(n_docs, np.int64), np.zeros(n_docs), np.zeros(n_docs, np.int64)
        names = ["und"] * n_docs
        words = find_words(b := folded(block), _BLANK)
        counts = words.counts
        own = np.flatnonzero(counts)
        k = len(self.languages)
        if not len(own) or not k:
            return names, score, sizes
        bucket, owner = trigrams(b, words)
        edges = np.searchsorted(owner, np.arange(len(words.starts)))
        ll = np.add.reduceat(self.logp[bucket], edges, axis=0).astype(np.float64)  # words x languages
        top = ll.max(axis=1, keepdims=True)
        like = np.exp(np.maximum(ll - top, -30))
        counts, starts = counts[own], words.bounds[:-1][own]
        docs = np.repeat(np.arange(len(own)), counts)

        def em(theta, rounds):
            for _ in range(rounds):
                r = theta[docs] * like
                r /= r.sum(axis=1, keepdims=True)
                theta = np.add.reduceat(r, starts, axis=0) / counts[:, None]
            return theta

        def total(theta):
            return np.add.reduceat(np.log((theta[docs] * like).sum(axis=1)), starts)

        theta = em(np.full((len(own), k), 1 / k), ROUNDS)
        order = np.argsort(-theta, axis=1, kind="stable")
        single = np.add.reduceat(ll - top, starts, axis=0)
        best = single.max(axis=1)
        chosen = np.zeros((len(own), k))
        chosen[np.arange(len(own)), single.argmax(axis=1)] = 1.0
        size = np.ones(len(own), np.int64)
        for m in range(2, min(k, MOST_SET) + 1):
            mask = np.zeros((len(own), k))
            np.put_along_axis(mask, order[:, :m], 1.0, axis=1)
            part = np.maximum(theta, 1e-6) * mask
            part = em(part / part.sum(axis=1, keepdims=True), 2)
            value = total(part) - (m - 1) * (0.5 * np.log(counts) + PENALTY_SHARE * counts)
            better = value > best
            chosen[better], size[better], best[better] = part[better], m, value[better]
        pred[own], sizes[own] = chosen.argmax(axis=1), size
        score[own] = np.clip(chosen.max(axis=1), 0, 1)
        for i, d in enumerate(own.tolist()):
            if _has_letter(block, d):
                names[d] = self.languages[pred[d]]
            else:
                score[d], sizes[d] = 0.0, 0
        return names, score, sizes


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = True
_LETTER[97:123] = True


def _has_letter(block: Block, d: int) -> bool:
    part = block.data[block.offsets[d] : block.offsets[d + 1]]
    return bool(_LETTER[part[:64]].any() or _LETTER[part].any()) or any(c.isalpha() for c in part.tobytes().decode())


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all documents (lang, text); a task sums its own before it sends."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for block in text_blocks(batch.column("text")):
                b = folded(block)
                words = find_words(b, _BLANK)
                bucket, owner = trigrams(b, words)
                names, code = np.unique(np.array(langs[block.first : block.first + len(block)], object).astype(str), return_inverse=True)
                lang = code[words.docs][owner]
                n = np.bincount(lang * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for i, x in enumerate(names):
                    held[x] = held.get(x, 0) + n[i]
        for x, n in held.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(seen), pa.string()), pa.array(seen), pa.array(n[seen])], ["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Learns from all rows of docs (text, lang) with both; the model has BUCKETS numbers for each language."""
    rows = count_trigrams(docs.where("lang IS NOT NULL AND text IS NOT NULL")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    for i, x in enumerate(languages):
        own = rows[rows["lang"] == x]
        counts[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    logp = np.log(counts / counts.sum(axis=1, keepdims=True)) if languages else np.zeros((0, BUCKETS))
    return LanguageModel([str(x) for x in languages], np.ascontiguousarray(logp.T, np.float32))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and n_languages (the set's size) of each row.

    Null and empty texts, and texts without a letter, are `und` with score 0, as is everything if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages

    def make():
        def step(batch):
            for block in text_blocks(batch.column("text")):
                names, score, sizes = shared.value.predict(block)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, len(block)), pa.array(names), pa.array(score), pa.array(sizes)], ["doc_id", "lang_pred", "score", "n_languages"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, lang_pred string, score double, n_languages long")


def training_fold(docs: DataFrame) -> DataFrame:
    return docs.where(fold_crc(F.col("doc_id"), 4) != 2)
