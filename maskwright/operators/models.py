"""Model layers: any callable text -> entities; adapters for span lists and language models' answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import Entity

# Labels of each language's usual tagger as types, constant confidences by language.
_PLACES = {"GPE": "location", "LOC": "location"}
_SPACY = {"PERSON": "person", **_PLACES, "ORG": "organization", "FAC": "location"}
LABELS_BY_LANGUAGE = {
    "zh": {"PERSON": "person", "PER": "person", "NR": "person", "LOCATION": "location", **_PLACES, "NS": "location", "ORGANIZATION": "organization", "ORG": "organization", "NT": "organization"},
    "en": {**_SPACY, "NORP": "organization"}, "ja": {**_SPACY, "PRODUCT": "organization", "EVENT": "event"},
    "ko": {"PS": "person", "PERSON": "person", "LC": "location", **_PLACES, "OG": "organization", "ORG": "organization", "AF": "location"},
    "de": {"PER": "person", "PERSON": "person", **_PLACES, "ORG": "organization", "MISC": "organization"}, "uk": _SPACY,
    "in": {"PER": "person", "PERSON": "person", **_PLACES, "ORG": "organization"},
}
# Labels of external span lists.
LABELS = {
    "PERSON": "person", "PER": "person", "PERSON_NAME": "person", "ORG": "organization", "ORGANIZATION": "organization", "GPE": "location", "LOC": "location", "LOCATION": "location", "FAC": "location",
    "EMAIL_ADDRESS": "email", "PHONE_NUMBER": "phone", "CREDIT_CARD": "credit_card", "IP_ADDRESS": "ip_address", "US_SSN": "ssn", "IBAN_CODE": "iban", "EVENT": "event",
}
CONFIDENCE = {"zh": 0.85, "en": 0.85, "ja": 0.80, "ko": 0.80, "de": 0.80, "uk": 0.80, "in": 0.75}


class ModelProfile(NamedTuple):
    prefix: str = ""
    timeout: int = 30
    confidence: float = 0.7


# Prompt prefix, seconds and confidence by model.
PROFILES = {
    "qwen3:8b": ModelProfile("/no_think\n", 60, 0.75), "qwen3:4b": ModelProfile("/no_think\n", 30, 0.65), "qwen2.5:32b": ModelProfile("", 30, 0.7), "qwen2.5:7b": ModelProfile("", 30, 0.65),
    "qwen2.5:3b": ModelProfile("", 15, 0.5), "internlm2:7b": ModelProfile("", 30, 0.65),
}


def profile_of(model: str) -> ModelProfile:
    return PROFILES.get(model, ModelProfile())


def tagger(tag: Callable[[str], Iterable[tuple[int, int, str]]], lang: str = "en", labels: dict[str, str] | None = None):
    """A model from a function that gives (start, end, label); unknown labels are dropped."""
    labels = LABELS_BY_LANGUAGE.get(lang, LABELS) if labels is None else labels

    def model(text: str) -> list[Entity]:
        return [Entity(a, b, text[a:b], labels[x], CONFIDENCE.get(lang, 0.8), 2) for a, b, x in tag(text) if x in labels and text[a:b].strip()]

    return model


def language_model(ask: Callable[[str], str], confidence: float | None = None, tries: int = 2, name: str = ""):
    """A model from a function that answers a prompt with a JSON array of {text, type}; spans are found in the text. The
    profile of the model's name gives the prompt's prefix and, unless given, the confidence."""
    own = profile_of(name)
    confidence = own.confidence if confidence is None else confidence

    def model(text: str) -> list[Entity]:
        for k in range(tries):
            answer = ask(own.prefix + text)
            try:
                found = json.loads(answer[answer.index("[") : answer.rindex("]") + 1])
                break
            except ValueError:
                if k + 1 == tries:
                    return []
        out = []
        for x in found if isinstance(found, list) else []:
            value, kind = (x.get("text"), x.get("type")) if isinstance(x, dict) else (None, None)
            at = text.find(value) if value and kind else -1
            if at >= 0:
                out.append(Entity(at, at + len(value), value, kind, confidence, 3))
        return out

    return model


def external_entities(docs: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text", labels: dict[str, str] | None = None) -> DataFrame:
    """docs with `entities`: merged spans (doc, start, end, label, score) that another tool found."""
    from .native import merge_column

    known = F.create_map(*(F.lit(x) for kv in (labels or LABELS).items() for x in kv))
    typed = spans.withColumn("type", F.try_element_at(known, F.col("label"))).where("type IS NOT NULL")
    grouped = typed.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "score"))).alias("_s"))
    joined = docs.join(grouped, doc, "left")
    made = F.transform(
        F.coalesce("_s", F.array().cast("array<struct<start:int,end:int,type:string,score:double>>")),
        lambda s: F.struct(
            s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), F.substr(F.col(text), s["start"] + 1, s["end"] - s["start"]).alias("text"), s["type"].alias("type"), s["score"].cast("double").alias("confidence"),
            F.lit(2).alias("layer"),
        ),
    )
    return joined.withColumn("_made", made).withColumn("entities", merge_column(F.col("_made"))).drop("_s", "_made")
