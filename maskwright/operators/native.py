"""Detection, masking and merging as plain column expressions: nothing leaves the JVM.

A pattern's matches come from regexp_extract_all; their places from the lengths of the gaps that split leaves between
them. (?U) makes Java's classes Unicode-aware, as in the Arrow path. Named groups become two numbered groups, so that
the entity's place is its match's plus the length of what stands before it.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.gates import ODD_CASE, gate
from maskwright.functions.patterns import Pattern, patterns_for
from maskwright.functions.text import mask_column
from maskwright.functions.validators import column as valid

from .entities import CONTEXT, ENTITY_TYPE, FALSE_AFTER, FALSE_BEFORE, SELF
from .frames import spread

_EMPTY = f"array<{ENTITY_TYPE}>"


def java_regex(regex: str) -> str:
    """The same pattern in Java's syntax, without names of groups."""
    return "(?U)" + re.sub(r"\(\?P<\w+>", "(", regex)


def split_group(regex: str, name: str) -> str | None:
    """The pattern with what stands before the named group as group 1 and the named group as group 2; None where the group
    isn't a part of the pattern's outermost sequence."""
    parsed = _parser.parse(regex)
    number = parsed.state.groupdict[name]
    at = regex.index(f"(?P<{name}>")
    if not any(op is _constants.SUBPATTERN and value[0] == number for op, value in parsed) or re.compile(regex[:at]).groups:
        return None
    return f"({regex[:at]}){regex[at:]}"


def may_match(text: Column, regex: str) -> Column:
    """Whether the text holds what a match needs; a scan for literals is far cheaper than the pattern."""
    literals, digit = gate(regex)
    ok = text.rlike("(?U)\\d") if digit else F.lit(True)
    if literals:
        held = lambda s, xs: reduce(lambda x, y: x | y, (F.contains(s, F.lit(v)) for v in xs))
        plain, cased = (sorted(v for v in literals if (v.upper() == v) == p) for p in (True, False))
        found = [held(text, plain)] if plain else []
        if cased:  # one lower-case copy for all; letters whose case folding isn't that of lower() pass
            found += [F.exists(F.array(F.lower(text)), lambda low: held(low, cased)), text.rlike(f"[{''.join(sorted(ODD_CASE))}]")]
        ok = ok & reduce(lambda x, y: x | y, found)
    return ok


def spans(text: Column, regex: str, group: str = "") -> Column:
    """array<struct<start,end,text,mstart,mend>>: the named group's span (the whole match's where it is empty) and the match's."""
    split = split_group(regex, group) if group else None
    java = java_regex(split or regex)
    whole = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    gaps = F.transform(F.split(text, java, -1), lambda g: F.length(g))
    parts = F.regexp_extract_all(text, F.lit(java), F.lit(2 if split else re.compile(regex).groupindex[group])) if group else whole
    heads = F.regexp_extract_all(text, F.lit(java), F.lit(1)) if split else whole
    zipped = F.transform(whole, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("gap"), F.get(parts, i).alias("g"), F.get(heads, i).alias("h")))

    def step(state: Column, x: Column) -> Column:
        a = state["at"] + x["gap"]
        if split:
            inner = F.when(x["g"] == "", 0).otherwise(F.length(x["h"]))
        else:
            inner = F.when(x["g"] == "", 0).when(F.right(x["m"], F.length(x["g"])) == x["g"], F.length(x["m"]) - F.length(x["g"])).otherwise(F.instr(x["m"], x["g"]) - 1)
        value = F.when(x["g"] == "", x["m"]).otherwise(x["g"])
        found = F.struct((a + inner).alias("start"), (a + inner + F.length(value)).alias("end"), value.alias("text"), a.alias("mstart"), (a + F.length(x["m"])).alias("mend"))
        return F.struct((a + F.length(x["m"])).alias("at"), F.array_append(state["out"], found).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string,mstart:int,mend:int>>").alias("out"))
    found = F.aggregate(zipped, start, step)["out"]
    return F.when(may_match(text, regex) & text.rlike(java), found).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,mstart:int,mend:int>>"))


def false_positive(text: Column, start: Column, end: Column) -> Column:
    before = F.substr(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    after = F.substr(text, end + 1, F.lit(CONTEXT))
    return before.rlike("(?iU)" + FALSE_BEFORE) | after.rlike("(?U)" + FALSE_AFTER)


def pattern_entities(text: Column, p: Pattern) -> Column:
    """Entities of one pattern after its check and its context filter."""
    found = spans(text, p.regex, p.group)
    if p.validator:
        found = F.filter(found, lambda x: valid(p.validator, x["text"]))
    if p.context:
        found = F.filter(found, lambda x: ~false_positive(text, x["mstart"], x["mend"]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(p.type).alias("type"), F.lit(1.0).alias("confidence"), F.lit(1).alias("layer")))


def near_misses(text: Column, p: Pattern) -> Column:
    found = spans(text, p.regex, p.group)
    return F.filter(found, lambda x: ~valid(p.validator, x["text"])) if p.validator else F.array().cast("array<string>")


def merge_column(entities: Column) -> Column:
    """The greedy overlap merge of entities without self references, as a fold: longest, most certain, first."""
    order = F.array_sort(
        F.transform(entities, lambda e, i: F.struct(e["start"].alias("a"), (e["start"] - e["end"]).alias("neg"), i.alias("i"), e.alias("e")))
    )

    def step(kept: Column, x: Column) -> Column:
        e, last = x["e"], F.element_at(kept, -1)
        size, had = e["end"] - e["start"], last["end"] - last["start"]
        better = (size > had) | ((size == had) & (e["confidence"] > last["confidence"]))
        return F.when((F.size(kept) == 0) | (e["start"] >= F.try_element_at(kept, F.lit(-1))["end"]), F.array_append(kept, e)).when(
            better, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), e)
        ).otherwise(kept)

    return F.aggregate(order, F.array().cast(_EMPTY), step)


def detect_native(df: DataFrame, text: str = "text", langs: tuple[str, ...] = ("en",), types: tuple[str, ...] | None = None, out: str = "entities") -> DataFrame:
    """Adds merged entities of ASCII-safe patterns: no names, no normalization, no self references.

    With `types` only these types' patterns are tried. This prunes before merging, which may keep an entity that a longer
    one of another type would have replaced; use detect() where that matters.
    """
    chosen = [p for p in patterns_for(langs) if p.type != SELF and (types is None or p.type in types)]
    chosen.sort(key=lambda p: bool(p.validator))
    found = [pattern_entities(F.col(text), p) for p in chosen]
    return spread(df).withColumn("_found", F.concat(*found) if found else F.array().cast(_EMPTY)).withColumn(out, merge_column(F.col("_found"))).drop("_found")


def mask_native(df: DataFrame, text: str = "text", entities: str = "entities", out: str = "redacted") -> DataFrame:
    """Replaces merged entities by their type's mask (without numbers for equal masks)."""
    kinds = ("email", "phone", "bank_card", "credit_card", "id_number")

    def masked(e: Column) -> Column:
        return reduce(lambda c, k: c.when(e["type"] == k, mask_column(e["text"], k)), kinds[1:], F.when(e["type"] == kinds[0], mask_column(e["text"], kinds[0]))).otherwise(mask_column(e["text"], ""))

    t = F.col(text)
    folded = F.aggregate(
        F.col(entities), F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda s, e: F.struct(e["end"].alias("at"), F.concat(s["done"], F.substr(t, s["at"] + 1, e["start"] - s["at"]), masked(e)).alias("done")),
    )
    return df.withColumn("_fold", folded).withColumn(out, F.concat(F.col("_fold.done"), F.substr(t, F.col("_fold.at") + 1))).drop("_fold")
