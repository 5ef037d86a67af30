"""Risk scores and compliance roll-ups as column expressions over a document's entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.registry import PIPL_ORDER, PIPL_SENSITIVE, REGISTRY, UNKNOWN_SENSITIVITY, Registry

# Amplifiers of the score and the limits of levels.
LEVELS = {1: "low", 2: "medium", 3: "high", 4: "critical"}
SELF_WITH = (*PIPL_SENSITIVE, "phone", "id_number", "bank_card")
QUASI_IDENTIFIERS = (("address", "date_of_birth"), ("date_of_birth", "phone"), ("address", "phone"))
CUTS = ((0.3, "low"), (0.6, "medium"), (0.85, "high"))
MANY_ENTITIES = 3


def _lookup(values: dict, key: Column, default) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def assess_column(entities: Column, lang: str = "zh", registry: Registry = REGISTRY, sensitivities: Column | None = None) -> Column:
    """struct<score, level, reasons, pipl_articles, gdpr_special_category, hipaa_categories> of array<struct<type, ..>>.

    An empty array has score 0 and level none; null stays null. The registry's tables become literal maps (one entry per
    registered type).
    """
    names = list(dict.fromkeys(t.name for t in registry.list_types()))
    level_of = {n: registry.sensitivity(n) for n in names}
    known = {n: registry.resolve(n, lang) for n in names}
    kinds = F.transform(entities, lambda e: e["type"])
    levels = sensitivities if sensitivities is not None else F.transform(kinds, lambda k: _lookup(level_of, k, UNKNOWN_SENSITIVITY))
    have = F.array_distinct(kinds)
    has = lambda *xs: F.arrays_overlap(have, F.array(*map(F.lit, xs)))
    both = lambda a, b: F.array_contains(have, a) & F.array_contains(have, b)
    grave = F.size(F.filter(levels, lambda x: x >= 3)) >= 2
    linked = F.array_contains(have, "self_reference") & has(*SELF_WITH)
    combination = None
    for a, b in QUASI_IDENTIFIERS:
        text = F.lit(f"quasi-identifier combination: {a} + {b}")
        combination = F.when(both(a, b), text) if combination is None else combination.when(both(a, b), text)
    raw = F.array_max(levels) / 4.0 + F.when(grave, 0.1).otherwise(0.0) + F.when(linked, 0.15).otherwise(0.0) + F.when(combination.isNotNull(), 0.1).otherwise(0.0)
    score = F.least(raw, F.lit(1.0))
    level = F.when(score < CUTS[0][0], CUTS[0][1]).when(score < CUTS[1][0], CUTS[1][1]).when(score < CUTS[2][0], CUTS[2][1]).otherwise("critical")
    own = F.array_distinct(F.zip_with(kinds, levels, lambda k, x: F.concat(k, F.lit(" ("), _lookup(LEVELS, x, "unknown"), F.lit(")"))))
    reasons = F.concat(
        own,
        F.array_compact(F.array(F.when(grave, "multiple high/critical entities detected"), F.when(linked, "self-reference amplification: PII directly linked to user"), combination)),
    )
    of = {a: [n for n, t in known.items() if t and a in t.pipl_articles] for a in PIPL_ORDER}
    listed = [F.when((has(*of[a]) if of[a] else F.lit(False)) | ((F.size(entities) >= MANY_ENTITIES) if a == "PIPL Art.55" else F.lit(False)), a) for a in PIPL_ORDER]
    categories = sorted({t.hipaa_category for t in known.values() if t and t.hipaa_category})
    hipaa = [F.when(has(*[n for n, t in known.items() if t and t.hipaa_category == c]), c) for c in categories]
    special = [n for n, t in known.items() if t and t.gdpr_special]
    nothing = F.size(entities) == 0
    none = F.array().cast("array<string>")
    return F.when(
        entities.isNotNull(),
        F.struct(
            F.when(nothing, 0.0).otherwise(F.round(score, 2)).alias("score"), F.when(nothing, "none").otherwise(level).alias("level"), F.when(nothing, none).otherwise(reasons).alias("reasons"),
            F.when(nothing, none).otherwise(F.array_compact(F.array(*listed))).alias("pipl_articles"), F.when(nothing, False).otherwise(has(*special)).alias("gdpr_special_category"),
            F.when(nothing, none).otherwise(F.array_compact(F.array(*hipaa))).alias("hipaa_categories"),
        ),
    )


def assess(df: DataFrame, entities: str = "detected.entities", lang: str = "zh", out: str = "risk", registry: Registry = REGISTRY) -> DataFrame:
    return df.withColumn(out, assess_column(F.col(entities), lang, registry))


def assess_table(entity_rows: DataFrame, keys: list[str], lang: str = "zh", registry: Registry = REGISTRY) -> DataFrame:
    """The same from one row per entity (keys, seq, type): grouped by the keys, in the order of seq."""
    grouped = entity_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "type"))).alias("_e"))
    return grouped.withColumn("risk", assess_column(F.col("_e"), lang, registry)).drop("_e")
