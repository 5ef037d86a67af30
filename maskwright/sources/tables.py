"""Readers and writers: tables, whole text files, CSV, keys, options, and metrics of runs."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_texts(df: DataFrame, path: str, column: str = "text", mode: str = "errorifexists") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and content, for redact_csv."""
    return read_texts(spark, path).withColumnRenamed("text", "content")


def key_rows(df: DataFrame, id_column: str, key: str = "redacted.key") -> DataFrame:
    """The long form of keys: id, replacement, original."""
    return df.select(id_column, F.explode(key).alias("replacement", "original"))


def write_keys(df: DataFrame, path: str, id_column: str, key: str = "redacted.key", mode: str = "errorifexists") -> None:
    """Keys as a table of their own, to be put where only those who restore can read; the committer makes it atomic."""
    key_rows(df, id_column, key).write.mode(mode).parquet(path)


def read_keys(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """id and key (map) from the long form."""
    return spark.read.parquet(path).groupBy(id_column).agg(F.map_from_entries(F.collect_list(F.struct("replacement", "original"))).alias("key"))


def load_options(path: str) -> dict:
    """Options from a JSON file, or YAML if a parser is there."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("YAML options need the yaml package; use JSON") from e
            return yaml.safe_load(f) or {}
        return json.load(f)


def perf_records(timed: DataFrame, text: str = "text", detected: str = "detected", ms: str = "ms", slow_ms: float = 50.0, rate: float = 0.01, mode: str = "fast") -> DataFrame:
    """One row per text of frames.detect(..., timed=ms): sizes, entities, milliseconds, slow and sampled. Slow texts are all
    there, of the others a share of `rate`, chosen by a hash of the row so that a task that runs again keeps the same."""
    chosen = F.pmod(F.xxhash64(text, F.lit("perf")), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))
    rows = timed.where(F.col(text).isNotNull()).select(
        F.length(text).cast("long").alias("text_len"), (F.length(F.regexp_replace(text, "[^\\x00-\\x7f]", "")) / F.greatest(F.length(text), F.lit(1))).alias("text_ascii_ratio"), F.col(f"{detected}.langs").alias("lang"),
        F.lit(mode).alias("mode"), F.col(ms).alias("total_ms"), F.size(f"{detected}.entities").cast("long").alias("entities_found"),
        F.array_sort(F.array_distinct(F.transform(f"{detected}.entities", lambda e: e["type"]))).alias("entity_types"), (F.col(ms) >= slow_ms).alias("slow"), chosen.alias("sampled"),
    )
    return rows.where("slow OR sampled").withColumn("sampled", F.col("sampled") & ~F.col("slow"))


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines."""
    records.write.mode(mode).json(path)


class RunMetrics:
    """Counts of a redaction run, gathered while it runs: `watch` the frame, act on it, then `record`."""

    def __init__(self, name: str = "redact"):
        self.name, self.observation, self.began = name, Observation(name), time.time()

    def watch(self, df: DataFrame, text: str = "text", entities: str = "redacted.entities") -> DataFrame:
        return df.observe(
            self.observation, F.count(F.lit(1)).alias("rows"), F.sum(F.length(text)).alias("chars"), F.sum(F.size(entities)).alias("entities"), F.count_if(F.size(entities) > 0).alias("rows_with_entities"),
            F.count_if(F.col(text).isNull()).alias("null_rows"),
        )

    def record(self) -> dict:
        return {"name": self.name, "seconds": round(time.time() - self.began, 3), **self.observation.get}
