"""Quality classifier: a sparse ensemble of rules.

Boosted trees of small depth on document statistics give paths; each path is a rule, a conjunction of limits. A logistic
regression with lasso penalty over the rules keeps few of them, and these are compiled into one Spark column expression,
so that the model is readable and scoring is a sum of weights inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold_crc, map_batches, text_blocks
from .gbt import fit, lasso_logistic, paths
from .textstats import FEATURES, feature_frame, labelled_sample, statistics

#: Labelled documents that the rules are fitted on, at most; rules; and the lasso penalty.
SAMPLE_ROWS, MOST_RULES, PENALTY = 10_000, 300, 1e-3
#: Documents whose score is at least this are predicted as label 1.
THRESHOLD = 0.3


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]]

    def column(self) -> Column:
        """The score over the columns named in FEATURES."""
        total = F.lit(self.intercept)
        for weight, conjunction in self.rules:
            test = F.lit(True)
            for f, at_most, t in conjunction:
                test = test & ((F.col(FEATURES[f]) <= t) if at_most else (F.col(FEATURES[f]) > t))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f}: " + " and ".join(f"{FEATURES[f]} {'<=' if a else '>'} {t:.4g}" for f, a, t in c) for w, c in sorted(self.rules, key=lambda r: -abs(r[0]))]


def holds(x: np.ndarray, conjunction) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, at_most, t in conjunction:
        out &= x[:, f] <= t if at_most else x[:, f] > t
    return out


def fit_on(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Without rows of both labels: no rule, and the prior as the score (0.5 without rows)."""
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(p / (1 - p))), [])
    rules = paths(fit(x, y, trees=30, depth=3, rate=0.3, sample=0.6))
    marks = np.stack([holds(x, r) for r in rules], axis=1)
    share = marks.mean(axis=0)
    good = np.flatnonzero((share > 0.005) & (share < 0.995))[:MOST_RULES]
    b, w = lasso_logistic(marks[:, good], y, PENALTY)
    return RuleModel(b, [(float(w[k]), rules[good[k]]) for k in range(len(good)) if abs(w[k]) > 1e-6])


def fit_classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Learns from labels whose document is outside the held-out fold (crc32 of doc_id as text, modulo 5, is 0)."""
    return fit_on(*labelled_sample(docs, labels.where(fold_crc(F.col("doc_id"), 5) != 0), "quality", sample_rows))


def classify(docs: DataFrame, model: RuleModel, keep: str = "doc_id long") -> DataFrame:
    """`keep`, score and predicted of each row; null and empty texts are scored as texts without words."""
    return feature_frame(docs, keep).withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop(*FEATURES)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier doesn't reject; a row's columns stay as they are. docs also trains the model."""
    model = fit_classifier(docs, labels)
    own = [f for f in docs.schema.fields if f.name != "text"]
    held = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in own)).alias("row_fields"), "text")
    return _with_scores(held, model).where(f"score >= {THRESHOLD}").select(*(F.col(f"row_fields.`{f.name}`") if f.name != "text" else F.col("text") for f in docs.schema.fields))


def _with_scores(held: DataFrame, model: RuleModel) -> DataFrame:
    def make():
        def step(batch):
            for block in text_blocks(batch.column("text")):
                _, x = statistics(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_fields").slice(block.first, len(block)), batch.column("text").slice(block.first, len(block)), *(pa.array(x[:, k].astype(float)) for k in range(len(FEATURES)))],
                    ["row_fields", "text", *FEATURES],
                )

        return step

    schema = StructType([*held.schema.fields, *(StructField(f, DoubleType()) for f in FEATURES)])
    return map_batches(held, make, schema).withColumn("score", model.column())
