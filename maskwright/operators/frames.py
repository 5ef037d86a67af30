"""The public transformers: detection, redaction and restoring of a text column.

Each is one Arrow pass over the rows, without a shuffle: rows are independent, and each row has its own key. The salt is
mandatory, so that a retried task gives the same codes. Rows whose text is null get nulls; rows beyond MAX_CHARS
characters get null results and `oversize` true instead of failing the job.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from maskwright.functions.fakes import scan_reserved
from maskwright.functions.registry import REGISTRY
from maskwright.functions.text import MAX_CHARS
from maskwright.plans.profiles import with_profile

from .entities import ENTITY_TYPE, Detection, Detector, Entity, boost, merge
from .replacing import check_config, fix_grammar, mark, marker_of, replace, restore, restore_warnings, salt_bytes

HINT_TYPE = "struct<pii_count:int,density:string,intent:string,self_reference_tier:int,has_kinship:boolean,person_threshold:double,skip_ner:boolean,ner_confidence:double,near_misses:array<struct<start:int,end:int,text:string,type:string>>>"
DETECTED = f"struct<entities:array<{ENTITY_TYPE}>,langs:array<string>,hints:{HINT_TYPE},layer_counts:map<int,int>,layer_status:map<int,string>,oversize:boolean>"
KEY = "map<string,string>"


class PollutedInput(ValueError):
    """The text already holds values of the reserved ranges."""


def _row(d: Detection | None, oversize: bool = False) -> dict | None:
    if d is None:
        return {"entities": None, "langs": None, "hints": None, "layer_counts": None, "layer_status": None, "oversize": True} if oversize else None
    h = d.hints
    near = [{"start": e.start, "end": e.end, "text": e.text, "type": e.type} for e in h.near_misses]
    return {
        "entities": [e._asdict() for e in d.entities], "langs": d.langs, "layer_counts": list(d.layer_counts.items()), "layer_status": list(d.layer_status.items()), "oversize": oversize,
        "hints": {"pii_count": h.pii_count, "density": h.density, "intent": h.intent, "self_reference_tier": h.tier, "has_kinship": h.has_kinship, "person_threshold": h.person_threshold, "skip_ner": h.skip_ner, "ner_confidence": h.ner_confidence, "near_misses": near},
    }


def _arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(_parse_datatype_string(ddl))


#: Bytes of a scan's estimated size for each core below which rows are dealt out anew, as few row groups leave cores idle;
#: and bytes below which one core will do.
SPREAD_BYTES, LEAST_SPREAD = 64 << 20, 256 << 10


def spread(df: DataFrame) -> DataFrame:
    """Small inputs over all cores; large ones, which have row groups enough, stay where they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if not df.isStreaming and LEAST_SPREAD <= size < cores * SPREAD_BYTES else df


#: Rows and bytes of an Arrow batch that are turned into Python values at once; Spark's batches hold 10 000 rows or 64 MB.
PART_ROWS, PART_BYTES = 256, 2 << 20


def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in halves of halves, until each is small or one row; without a copy."""
    if b.num_rows > 1 and (b.num_rows > PART_ROWS or b.nbytes > PART_BYTES):
        half = b.num_rows // 2
        yield from parts(b.slice(0, half))
        yield from parts(b.slice(half))
    else:
        yield b


def append_columns(df: DataFrame, inputs: list[str], made: dict[str, str], make) -> DataFrame:
    """Adds columns: make() gives, once per task, a function from the inputs' values to a tuple of the new ones' values."""
    clash = set(made) & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = StructType([*df.schema.fields, *(f for n, t in made.items() for f in _parse_datatype_string(f"`{n}` {t}").fields)])
    kinds = {n: _arrow_type(t) for n, t in made.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for b in parts(whole):
                rows = [f(*values) for values in zip(*(b.column(c).to_pylist() for c in inputs), strict=True)] if b.num_rows else []
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *kinds])
            del whole, b, rows, columns  # before the next batch is read
            pa.default_memory_pool().release_unused()

    return spread(df).mapInArrow(run, schema)


def detect(df: DataFrame, text: str = "text", *, lang="zh", mode="fast", names=(), types=None, types_exclude=None, models=(), name_lists=None, packs=(), timed: str | None = None, out: str = "detected") -> DataFrame:
    """Adds `out`: entities, languages, hints and layers' counts. lang: a code, several, or "auto". `timed` names a column
    with the milliseconds that each text took."""
    options = dict(mode=mode, names=names, types=types, types_exclude=types_exclude, models=tuple(models), name_lists=name_lists, packs=tuple(packs))
    Detector(lang, **options)

    def make():
        detector = Detector(lang, **options)

        def one(t):
            began = time.perf_counter()
            done = None if t is None else _row(None, True) if len(t) > MAX_CHARS else _row(detector.detect(t))
            return (done, (time.perf_counter() - began) * 1000) if timed else (done,)

        return one

    return append_columns(df, [text], {out: DETECTED} | ({timed: "double"} if timed else {}), make)


def merged(df: DataFrame, column: str, text: str, out: str = "merged") -> DataFrame:
    """Adds `out`: the entities of the array column `column` (of several layers) merged, those of agreeing layers boosted."""

    def make():
        def one(es, t):
            if es is None or t is None:
                return (None,)
            own = [Entity(**e) for e in es]
            return ([e._asdict() for e in boost(merge(own, t), own)],)

        return one

    return append_columns(df, [column, text], {out: f"array<{ENTITY_TYPE}>"}, make)


def entities(detected: DataFrame, keys: list[str], column: str = "detected") -> DataFrame:
    """One row per entity: the keys, seq (its place in the text) and the entity's fields."""
    return detected.select(*keys, F.posexplode(f"{column}.entities").alias("seq", "e")).select(*keys, "seq", "e.*")


def redact(
    df: DataFrame, text: str = "text", *, salt, lang="zh", mode="fast", config=None, profile=None, names=(), types=None, types_exclude=None, models=(), name_lists=None, unified_prefix=None, key: str | None = None,
    packs=(), out: str = "redacted",
) -> DataFrame:
    """Adds `out`: struct of text, key (replacement -> original), types, entities, warnings, oversize.

    `key` names a map column with replacements to use again.
    """
    config, types = with_profile(profile, check_config(config), types)
    options = dict(mode=mode, names=names, types=types, types_exclude=types_exclude, models=tuple(models), name_lists=name_lists, packs=tuple(packs))
    Detector(lang, **options)
    made = f"struct<text:string,key:{KEY},types:{KEY},entities:array<{ENTITY_TYPE}>,langs:array<string>,warnings:array<string>,oversize:boolean>"

    def make():
        detector = Detector(lang, **options)

        def one(t, had=None):
            if t is None:
                return (None,)
            if len(t) > MAX_CHARS:
                return ({"text": None, "key": None, "types": None, "entities": None, "langs": None, "warnings": None, "oversize": True},)
            d = detector.detect(t)
            r = replace(t, d.entities, salt=salt, key=dict(had or ()), config=config, langs=d.langs, unified_prefix=unified_prefix, packs=detector.packs)
            body = fix_grammar(r.text, r.key) if d.langs and d.langs[0] == "en" else r.text
            return ({"text": body, "key": list(r.key.items()), "types": list(r.types.items()), "entities": [e._asdict() for e in d.entities], "langs": d.langs, "warnings": r.warnings, "oversize": False},)

        return one

    return append_columns(df, [text, *([key] if key else [])], {out: made}, make)


def three_forms(detector: Detector, text: str, *, salt, config: dict, existing=None, audit_existing=None, unified_prefix=None, marker=None) -> dict:
    """Audit codes, realistic text and marked text from one detection; keys of both replacements apart and together."""
    d = detector.detect(text)
    options = dict(salt=salt, langs=d.langs, unified_prefix=unified_prefix, packs=detector.packs)
    real = replace(text, d.entities, key=existing, config=config, **options)
    audit = replace(text, d.entities, key=audit_existing, config={k: {"strategy": "remove"} for k in config}, **options)
    grammar = d.langs[:1] == ["en"]
    downstream = fix_grammar(real.text, real.key) if grammar else real.text
    return {
        "audit_text": fix_grammar(audit.text, audit.key) if grammar else audit.text, "downstream_text": downstream, "display_text": mark(downstream, real.key, marker), "real_key": real.key, "audit_key": audit.key,
        "aliases": real.aliases, "entities": d.entities,
    }


def override_strategies(config: dict, overrides: dict[str, str] | None) -> dict:
    return check_config({**config, **{k: {**config.get(k, {}), "strategy": s} for k, s in (overrides or {}).items()}})


def redact3(
    df: DataFrame, text: str = "text", *, salt, lang="zh", mode="fast", names=(), types=None, types_exclude=None, models=(), name_lists=None, strict_input=True, reserved_names=None, strategy_overrides=None,
    unified_prefix=None, display_marker=None, existing_key: str | None = None, on_polluted: str = "flag", packs=(), out: str = "forms",
) -> DataFrame:
    """Adds `out`: audit, downstream and display texts, the joint key, aliases, polluted and oversize.

    Polluted rows (strict_input) have null texts and polluted = true; on_polluted="raise" fails the job instead.
    """
    config = override_strategies(with_profile("pseudonym-llm", None, None)[0], strategy_overrides)
    options = dict(mode=mode, names=names, types=types, types_exclude=types_exclude, models=tuple(models), name_lists=name_lists, packs=tuple(packs))
    Detector(lang, **options), salt_bytes(salt), marker_of(display_marker)
    made = f"struct<audit_text:string,downstream_text:string,display_text:string,key:{KEY},aliases:map<string,array<string>>,polluted:boolean,oversize:boolean>"
    empty = {"audit_text": None, "downstream_text": None, "display_text": None, "key": None, "aliases": None}

    def make():
        detector = Detector(lang, **options)

        def one(t, had=None):
            if t is None:
                return (None,)
            if len(t) > MAX_CHARS:
                return (empty | {"polluted": False, "oversize": True},)
            if strict_input and (hits := scan_reserved(t, reserved_names)):
                if on_polluted == "raise":
                    raise PollutedInput(f"reserved-range values in the input: {sorted({h[2] for h in hits})}")
                return (empty | {"polluted": True, "oversize": False},)
            r = three_forms(detector, t, salt=salt, config=config, existing=dict(had or ()), unified_prefix=unified_prefix, marker=display_marker)
            key = r["real_key"] | r["audit_key"]
            forms = {k: r[k] for k in ("audit_text", "downstream_text", "display_text")}
            return (forms | {"key": list(key.items()), "aliases": [(k, list(v)) for k, v in r["aliases"].items()], "polluted": False, "oversize": False},)

        return one

    return append_columns(df, [text, *([existing_key] if existing_key else [])], {out: made}, make)


def restore_text(df: DataFrame, text: str, key: str, *, aliases: str | None = None, display_marker: str | None = None, out: str = "restored") -> DataFrame:
    """Adds `out`: the text with originals put back by the map column `key`; null text or key gives null."""

    def make():
        return lambda t, k, a=None: (None if t is None or k is None else restore(t, dict(k), dict(a or ()), display_marker),)

    return append_columns(df, [text, key, *([aliases] if aliases else [])], {out: "string"}, make)


def safety_warnings(df: DataFrame, redacted: str, output: str, key: str, out: str = "warnings") -> DataFrame:
    """Adds `out`: array of warnings on a model's output, empty where it is safe."""
    return append_columns(df, [redacted, output, key], {out: "array<string>"}, lambda: lambda r, o, k: (None if r is None or o is None or k is None else restore_warnings(r, o, dict(k)),))


def wipe_key(df: DataFrame, *columns: str) -> DataFrame:
    """Drops key columns, so that nothing after this point can restore."""
    return df.drop(*columns)


def report(df: DataFrame, text: str = "text", *, lang: str = "zh", out: str = "report", **options) -> DataFrame:
    """Adds the redaction and the risk assessment of its entities."""
    from .risk import assess_column

    done = redact(df, text, lang=lang, out="_redacted", **options)
    risk = assess_column(F.col("_redacted.entities"), lang, REGISTRY)
    counts = F.struct(F.size("_redacted.entities").alias("entities"), F.length(text).alias("chars"))
    return done.withColumn(out, F.struct(F.col("_redacted.text").alias("redacted_text"), F.col("_redacted.key").alias("key"), F.col("_redacted.entities").alias("entities"), counts.alias("stats"), risk.alias("risk"))).drop("_redacted")
