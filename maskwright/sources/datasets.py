"""Readers of labelled public datasets from local files: text, lang, entities (text, type, start, end).

Three shapes are known: texts with span lists (as a column or as JSON in a string), tokens with BIO tags, and texts that
hold tagged values. `DATASETS` names each dataset's shape and columns; labels become types by a map, and other labels are
dropped. The files are JSON lines or Parquet, as the publishers ship them; nothing is downloaded.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = "array<struct<text:string,type:string,start:int,end:int>>"


class Dataset(NamedTuple):
    shape: str  # spans, json or tags
    text: str  # the text's column, or that of the tokens
    labels: str  # the column of spans or tags
    languages: tuple[str, ...]
    label: str = "label"
    lang: str = ""  # the language's column
    tags: tuple[str, ...] = ()  # names of numbered tags


_NER = ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC")
# The columns of each dataset.
DATASETS = {
    "ai4privacy": Dataset("spans", "source_text", "privacy_mask", ("en", "de", "fr", "it", "es", "nl"), lang="language"),
    "gretel_finance": Dataset("json", "generated_text", "pii_spans", ("en", "de", "fr", "es", "it", "nl", "sv"), lang="language"),
    "nemotron": Dataset("json", "text", "spans", ("en",)), "pii_bench_zh": Dataset("spans", "text", "entities", ("zh",), label="type"), "pii_bench_zh_chat": Dataset("spans", "text", "entities", ("zh",), label="type"),
    "n2c2_2014": Dataset("spans", "text", "entities", ("en",)), "conll2003": Dataset("tags", "tokens", "ner_tags", ("en",), tags=(*_NER, "B-MISC", "I-MISC")),
    "wikiann": Dataset("tags", "tokens", "ner_tags", ("zh", "en", "ja", "ko", "de", "uk"), lang="lang", tags=_NER), "kaggle_piilo": Dataset("tags", "tokens", "labels", ("en",)),
}
# Labels as types.
LABELS = {
    "PER": "person", "PERSON": "person", "NAME": "person", "NAME_STUDENT": "person", "FIRSTNAME": "person", "LASTNAME": "person", "first_name": "person", "last_name": "person", "name": "person", "ORG": "organization", "company": "organization",
    "LOC": "location", "EMAIL": "email", "email": "email", "PHONENUMBER": "phone", "PHONE": "phone", "PHONE_NUM": "phone", "phone_number": "phone", "SSN": "ssn", "ssn": "ssn", "CREDITCARDNUMBER": "credit_card",
    "credit_card_number": "credit_card", "IPV4": "ip_address", "IPV6": "ip_address", "ipv4": "ip_address", "ipv6": "ip_address", "MAC": "mac_address", "IBAN": "iban", "iban": "iban", "STREET": "address",
    "STREET_ADDRESS": "address", "street_address": "address", "DOB": "date_of_birth", "date_of_birth": "date_of_birth", "AGE": "age", "URL_PERSONAL": "url_token",
}


def _typed(label: Column, labels: dict[str, str] | None) -> Column:
    if labels is None:
        return label
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), label)


def span_samples(rows: DataFrame, text: str, spans: Column, label: str, lang: Column, labels: dict[str, str] | None) -> DataFrame:
    """spans: array of structs with start, end and the label; the value is cut from the text."""
    made = F.transform(spans, lambda s: F.struct(F.substr(F.col(text), s["start"].cast("int") + 1, s["end"].cast("int") - s["start"].cast("int")).alias("text"), _typed(s[label], labels).alias("type"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return rows.select(F.col(text).alias("text"), lang.alias("lang"), F.filter(made, lambda e: e["type"].isNotNull()).cast(ENTITIES).alias("entities"))


def tag_samples(rows: DataFrame, tokens: str, tags: Column, lang: Column, labels: dict[str, str] | None) -> DataFrame:
    """Tokens joined by blanks; B- begins an entity, I- of the same label goes on with it, and begins one where none is open."""
    step = F.expr(
        f"aggregate(sequence(1, size({tokens})), named_struct('at', 0, 'open', '', 'e', cast(array() AS array<struct<label:string,start:int,end:int>>)), (s, i) -> "
        f"named_struct('at', s.at + length({tokens}[i - 1]) + 1, 'open', if(_tags[i - 1] = 'O', '', substring(_tags[i - 1], 3)), 'e', CASE WHEN _tags[i - 1] = 'O' THEN s.e "
        f"WHEN _tags[i - 1] LIKE 'I-%' AND s.open = substring(_tags[i - 1], 3) THEN concat(slice(s.e, 1, size(s.e) - 1), array(named_struct('label', s.open, 'start', element_at(s.e, -1).start, 'end', s.at + length({tokens}[i - 1])))) "
        f"ELSE array_append(s.e, named_struct('label', substring(_tags[i - 1], 3), 'start', s.at, 'end', s.at + length({tokens}[i - 1]))) END), s -> s.e)"
    )
    folded = rows.withColumn("_tags", tags).withColumn("_spans", F.when(F.size(tokens) > 0, step)).withColumn("_text", F.array_join(tokens, " ")).withColumn("_lang", lang)
    return span_samples(folded, "_text", F.coalesce("_spans", F.array().cast("array<struct<label:string,start:int,end:int>>")), "label", F.col("_lang"), labels)


def samples(rows: DataFrame, name: str, lang: str | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """A dataset's rows as samples; `lang` keeps those of one language. Unknown names are a ValueError."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(DATASETS)}")
    d, labels = DATASETS[name], LABELS if labels is None and DATASETS[name].label == "label" else labels
    own = F.col(d.lang) if d.lang and d.lang in rows.columns else F.lit(d.languages[0])
    if d.shape == "tags":
        tags = F.col(d.labels)
        if d.tags:
            tags = F.transform(tags, lambda k: F.get(F.array(*map(F.lit, d.tags)), k.cast("int")))
        out = tag_samples(rows, d.text, tags, own, labels)
    else:
        spans = F.col(d.labels) if d.shape == "spans" else F.from_json(F.col(d.labels), f"array<struct<start:int,end:int,{d.label}:string>>")
        out = span_samples(rows, d.text, spans, d.label, own, labels)
    return out.where(F.col("lang") == lang) if lang else out


def read_samples(spark: SparkSession, path: str, name: str, lang: str | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """From a Parquet folder or JSON lines."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else spark.read.json(path)
    return samples(rows, name, lang, labels)
