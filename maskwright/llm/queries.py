"""The queries of this subpackage: thin opN_<name> functions over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_crc, read_table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules, fit_rules

    docs = read_table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, read_table(spark, sf_dir, "labels")))


def op3_hpyp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_hpyp import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_forest import scan, trained_forest

    return scan(read_table(spark, sf_dir, "documents"), trained_forest(spark)).drop("candidate")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, identify, training_fold

    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, fit_languages(training_fold(docs)))
    return found.select("doc_id", (fold_crc(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "n_languages")


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .wavelet import read_documents, write_shards

    folder = write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, folder)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify, fit_classifier

    docs = read_table(spark, sf_dir, "documents")
    scored = classify(docs, fit_classifier(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_crc(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import link_components

    return link_components(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    words = f"regexp_extract_all({_ASCII_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+')"
    plain = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+')"
    return {
        "op9_decontamination": f"""
WITH w AS (SELECT doc_id, {words} AS v FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS v FROM benchmark),
win AS (SELECT DISTINCT item_id, m, v[i:i + m - 1] AS g FROM (SELECT item_id, v, least(8, len(v)) AS m, unnest(generate_series(1, len(v) - least(8, len(v)) + 1)) AS i FROM b WHERE len(v) > 0)),
d AS (SELECT doc_id, m, i, v[i:i + m - 1] AS g FROM (SELECT doc_id, v, m, unnest(generate_series(1, len(v) - m + 1)) AS i FROM w, (SELECT DISTINCT m FROM win) WHERE len(v) >= m)),
hit AS (SELECT doc_id, i, d.m, item_id FROM d JOIN win ON d.m = win.m AND d.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(v) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n, 0) >= 2 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
        "op10_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {plain} AS v FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(v[i:i + 2]) AS g FROM (SELECT doc_id, v, unnest(generate_series(1, greatest(len(v) - 2, least(len(v), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) c ON c.a = w.doc_id""",
    }
