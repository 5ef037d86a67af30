"""Quality rules: base limits on document statistics, then gradient-boosted trees with monotonic constraints.

The trees are fitted on labelled documents (at most SAMPLE_ROWS, a bounded sample) and flattened into numpy node arrays,
which each task uses to score its blocks. The score may not rise with the shares of symbols, repeated lines and repeated
words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .gbt import Trees, fit
from .textstats import COUNTS, FEATURES, add_statistics, labelled_sample

#: Labelled documents that the trees are fitted on, at most.
SAMPLE_ROWS = 10_000
#: A document whose score is below is not kept.
KEEP_FROM = 0.3
MONOTONE = {FEATURES.index(f): -1 for f in ("symbol_share", "dup_line_share", "repeat_share")}


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    return fit(*labelled_sample(docs, labels, "quality", sample_rows), trees=60, depth=3, monotone=MONOTONE)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def apply_rules(docs: DataFrame, model: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and quality_score of each row.

    docs: doc_id and text; other columns are ignored. Null and empty texts have no words and fail the base limits. Without
    labels of both kinds the model is a constant and all documents that pass the base limits are kept.
    """
    constant = not len(model.roots)

    def scorer():
        def score(counts, x):
            failed, s = base_failed(counts), model.score(x)
            return {k: counts[k].astype(np.int64) for k in COUNTS} | {"base_failed": failed, "kept": ~failed & ((s >= keep_from) | constant), "quality_score": s}

        return score

    return add_statistics(docs, scorer, ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, quality_score double")
