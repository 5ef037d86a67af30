"""Precision and recall of entity tables, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _scores(counts: DataFrame) -> DataFrame:
    """Without predictions precision is 1, without gold recall is 1."""
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    out = counts.withColumn("predicted", F.col("tp") + F.col("fp")).withColumn("gold", F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", share("tp", "predicted")).withColumn("recall", share("tp", "gold"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1).drop("predicted", "gold")


def match_values(predicted: DataFrame, gold: DataFrame, doc: str = "doc_id") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by type: distinct (text, type) of each document; types without gold are ignored."""
    g = gold.select(doc, "type", "text").distinct().withColumn("in_gold", F.lit(1))
    p = predicted.select(doc, "type", "text").distinct().withColumn("in_predicted", F.lit(1)).join(g.select(doc, "type").distinct(), [doc, "type"], "left_semi")
    both = g.join(p, [doc, "type", "text"], "full")
    one = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = both.groupBy("type").agg(F.sum(one("in_gold") * one("in_predicted")).alias("tp"), F.sum((1 - one("in_gold")) * one("in_predicted")).alias("fp"), F.sum(one("in_gold") * (1 - one("in_predicted"))).alias("fn"))
    return _scores(counts)


def match_spans(predicted: DataFrame, gold: DataFrame, doc: str = "doc_id", tolerance: int = 3) -> DataFrame:
    """The same with spans: a prediction and a gold span of one type match if both ends differ by at most `tolerance`.

    Starts fall into bins of tolerance + 1 characters, so that the join is an equi-join on neighbouring bins. Each span is
    matched once: gold spans in their order take the first prediction that is near and free. The near pairs of a document
    and type are folded in that order.
    """
    width = tolerance + 1
    p = predicted.select(doc, "type", F.col("start").alias("ps"), F.col("end").alias("pe")).withColumn("pid", F.monotonically_increasing_id())
    g = gold.select(doc, "type", F.col("start").alias("gs"), F.col("end").alias("ge")).withColumn("gid", F.monotonically_increasing_id())
    bins = p.withColumn("bin", F.explode(F.array(*(F.floor(F.col("ps") / width) + k for k in (-1, 0, 1)))))
    near = bins.join(g.withColumn("bin", F.floor(F.col("gs") / width)), [doc, "type", "bin"]).where(f"abs(ps - gs) <= {tolerance} AND abs(pe - ge) <= {tolerance}")
    pairs = near.groupBy(doc, "type").agg(F.array_sort(F.collect_list(F.struct("gs", "ge", "gid", "ps", "pe", "pid"))).alias("near"))
    folded = F.expr(
        "aggregate(near, named_struct('taken', cast(array() AS array<bigint>), 'last', -1L), (s, x) -> if(x.gid = s.last OR array_contains(s.taken, x.pid), s, "
        "named_struct('taken', array_append(s.taken, x.pid), 'last', x.gid)), s -> size(s.taken))"
    )
    tp = pairs.groupBy("type").agg(F.sum(folded.cast("long")).alias("tp"))
    total = lambda d, n: d.groupBy("type").agg(F.count("*").alias(n))
    counts = total(p, "np").join(total(g, "ng"), "type", "full").join(tp, "type", "left").fillna(0, ["np", "ng", "tp"])
    return _scores(counts.select("type", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn")))


def survival(df: DataFrame, values: str, redacted: str, restored: str, tokens: str | None = None) -> DataFrame:
    """Adds privacy (share of values gone from the redacted text), reversibility (share back in the restored one) and,
    with `tokens`, utility (share of these that the redacted text keeps); 1 for an empty array."""

    def share(items: str, text: str, there: bool):
        hit = F.filter(items, lambda v: F.contains(F.col(text), v) if there else ~F.contains(F.col(text), v))
        return F.when(F.size(items) == 0, 1.0).otherwise(F.size(hit) / F.size(items))

    out = df.withColumn("privacy", share(values, redacted, False)).withColumn("reversibility", share(values, restored, True))
    return out.withColumn("utility", share(tokens, redacted, True)) if tokens else out


def median_gate(runs: DataFrame, baseline: DataFrame, allowed: float = 0.1) -> DataFrame:
    """workload, p50, baseline, ok: whether the median of a workload's runs is within `allowed` of its baseline."""
    p50 = runs.groupBy("workload").agg(F.percentile("ms", 0.5).alias("p50"))
    return p50.join(baseline, "workload").withColumn("ok", F.col("p50") <= F.col("baseline") * (1 + allowed))
