"""Nested columns, JSON texts and CSV files: every string leaf is redacted, one key for a row (JSON) or a file (CSV)."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .entities import Detector
from .frames import KEY, append_columns
from .replacing import check_config, fix_grammar, replace, restore


def parse_path(path: str) -> tuple[str, ...]:
    """'messages[*].content' -> ('messages', '*', 'content'); * is any name and any list item."""
    return tuple(path.replace("[*]", ".*").split("."))


def wanted(at: tuple[str, ...], paths: list[tuple[str, ...]] | None) -> bool:
    return paths is None or any(len(p) == len(at) and all(x in ("*", y) for x, y in zip(p, at, strict=True)) for p in paths)


def walk(value, leaf: Callable[[str], str], paths=None, at: tuple[str, ...] = ()):
    if isinstance(value, str):
        return leaf(value) if wanted(at, paths) else value
    if isinstance(value, dict):
        return {k: walk(v, leaf, paths, (*at, k)) for k, v in value.items()}
    if isinstance(value, list):
        return [walk(v, leaf, paths, (*at, "*")) for v in value]
    return value


class LeafRedactor:
    """Redacts strings in turn with one growing key."""

    def __init__(self, detector: Detector, salt, config, key=None):
        self.detector, self.salt, self.config, self.key, self.types, self.last = detector, salt, check_config(config), dict(key or {}), {}, ()

    def __call__(self, text: str) -> str:
        d = self.detector.detect(text)
        r = replace(text, d.entities, salt=self.salt, key=self.key, config=self.config, langs=d.langs)
        self.key = r.key
        self.types.update(r.types)
        self.last = tuple(r.types)  # the replacements of this text
        return fix_grammar(r.text, r.key) if d.langs[:1] == ["en"] else r.text


def redact_json(df: DataFrame, column: str, *, salt, lang="zh", config=None, paths: list[str] | None = None, key: str | None = None, out: str = "redacted", **options) -> DataFrame:
    """column: JSON texts. Adds `out`: struct of json, key, types, valid. A text that isn't JSON is null with valid false."""
    parsed = [parse_path(p) for p in paths] if paths is not None else None
    Detector(lang, **options)

    def make():
        detector = Detector(lang, **options)

        def one(t, had=None):
            if t is None:
                return (None,)
            try:
                data = json.loads(t)
            except ValueError:
                return ({"json": None, "key": None, "types": None, "valid": False},)
            leaf = LeafRedactor(detector, salt, config, dict(had or ()))
            done = walk(data, leaf, parsed)
            return ({"json": json.dumps(done, ensure_ascii=False), "key": list(leaf.key.items()), "types": list(leaf.types.items()), "valid": True},)

        return one

    return append_columns(df, [column, *([key] if key else [])], {out: f"struct<json:string,key:{KEY},types:{KEY},valid:boolean>"}, make)


def restore_json(df: DataFrame, column: str, key: str, out: str = "restored") -> DataFrame:
    def make():
        return lambda t, k: (None if t is None or k is None else json.dumps(walk(json.loads(t), lambda s: restore(s, dict(k))), ensure_ascii=False),)

    return append_columns(df, [column, key], {out: "string"}, make)


def map_leaves(schema: DataType, column: Column, f: Callable[[Column], Column], paths: list[tuple[str, ...]] | None = None, at: tuple[str, ...] = ()) -> Column:
    """A native walk of a typed column: f on every string leaf at the paths; leaves outside are not touched."""
    if isinstance(schema, StringType):
        return f(column) if wanted(at, paths) else column
    if isinstance(schema, StructType):
        inner = [map_leaves(x.dataType, column.getField(x.name), f, paths, (*at, x.name)).alias(x.name) for x in schema.fields]
        return F.when(column.isNotNull(), F.struct(*inner))
    if isinstance(schema, ArrayType):
        return F.transform(column, lambda x: map_leaves(schema.elementType, x, f, paths, (*at, "*")))
    if isinstance(schema, MapType):
        return F.transform_values(column, lambda _, v: map_leaves(schema.valueType, v, f, paths, (*at, "*")))
    return column


def redact_struct(df: DataFrame, column: str, *, salt, paths: list[str] | None = None, out: str = "redacted", **options) -> DataFrame:
    """A nested column of any type: through JSON, so that one key holds for all its leaves, and back to the column's type."""
    kind = df.schema[column].dataType
    done = redact_json(df.withColumn("_json", F.to_json(column)), "_json", salt=salt, paths=paths, out="_done", **options)
    return done.withColumn(out, F.struct(F.from_json("_done.json", kind).alias("value"), F.col("_done.key").alias("key"))).drop("_json", "_done")


def redact_csv_text(text: str, leaf: Callable[[str], str]) -> str:
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return text
    held = io.StringIO()
    csv.writer(held).writerows([rows[0], *([leaf(c) for c in row] for row in rows[1:])])
    return held.getvalue().strip()


def redact_csv(df: DataFrame, column: str = "content", *, salt, lang="zh", config=None, out: str = "redacted", **options) -> DataFrame:
    """column: whole CSV files, one per row (spark.read.text(..., wholetext=True)); the header stays. One key for a file."""
    Detector(lang, **options)

    def make():
        detector = Detector(lang, **options)

        def one(t):
            if t is None:
                return (None,)
            leaf = LeafRedactor(detector, salt, config)
            return ({"csv": redact_csv_text(t, leaf), "key": list(leaf.key.items())},)

        return one

    return append_columns(df, [column], {out: f"struct<csv:string,key:{KEY}>"}, make)


def restore_csv(df: DataFrame, column: str, key: str, out: str = "restored") -> DataFrame:
    """column: CSV texts, restored as whole strings by the map column `key`; null gives null."""
    from .frames import restore_text

    return restore_text(df, column, key, out=out)


def redact_turns(df: DataFrame, session: str = "conv_id", turn: str = "turn", text: str = "text", *, salt, lang="zh", config=None, cumulate: bool = False, **options) -> DataFrame:
    """Many turns with one key for a session: adds redacted, and turn_key with the replacements of this turn. With `cumulate`
    also session_key, the session's key so far, whose rows grow with the session's length.

    Rows are dealt by session and sorted by turn; a task holds one session's key at a time, never its rows.
    """
    import pyarrow as pa

    Detector(lang, **options)
    schema = StructType([*df.schema.fields, *df.sparkSession.createDataFrame([], f"redacted string, turn_key {KEY}" + (f", session_key {KEY}" if cumulate else "")).schema.fields])
    ordered = df.repartition(session).sortWithinPartitions(session, turn, text)

    def run(batches):
        detector, leaf, now = Detector(lang, **options), None, object()
        for b in batches:
            done, own, keys = [], [], []
            for s, t in zip(b.column(session).to_pylist(), b.column(text).to_pylist(), strict=True):
                if s != now:
                    leaf, now = LeafRedactor(detector, salt, config), s
                done.append(None if t is None else leaf(t))
                own.append([] if t is None else [(r, leaf.key[r]) for r in leaf.last if r in leaf.key])
                if cumulate:
                    keys.append(list(leaf.key.items()))
            kind = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string()), pa.array(own, kind), *([pa.array(keys, kind)] if cumulate else [])], [*b.schema.names, "redacted", "turn_key", *(["session_key"] if cumulate else [])])

    return ordered.mapInArrow(run, schema)
