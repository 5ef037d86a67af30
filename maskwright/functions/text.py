"""Text preparation: what detection sees, with offsets back to the original; language detection; masks."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain, count

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 1 << 20

# Characters that are dropped, look-alikes, digits and separators.
INVISIBLE = "​‌‍­﻿‎‏‪‫‬‭‮⁦⁧⁨⁩"
CONFUSABLE_FROM = "аеорсухіһвкмтнАВЕКМНОРСТХУοαεικνρτΟΑΒΕΗΙΚΜΝΡΤΧΖ"
CONFUSABLE_TO = "aeopcyxihbkmthABEKMHOPCTXYoaeikvptOABEHIKMNPTXZ"
CHINESE_DIGITS = "一二三四五六七八九零壹贰叁肆伍陆柒捌玖"
CHINESE_DIGIT_VALUES = "1234567890123456789"
DIGIT_SEPARATORS = " \t.-/，、·;；:："
LEAST_DIGIT_RUN = 7
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"

_LOOKS = str.maketrans(CONFUSABLE_FROM, CONFUSABLE_TO)
_CN = str.maketrans(CHINESE_DIGITS, CHINESE_DIGIT_VALUES)
_RUN = re.compile(rf"[\d²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐{CHINESE_DIGITS}](?:[{re.escape(DIGIT_SEPARATORS)}]*[\d²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐{CHINESE_DIGITS}])*")


_ODD = re.compile(f"[{INVISIBLE}{CONFUSABLE_FROM}]")
_CN_ANY = re.compile(f"[{CHINESE_DIGITS}]")


def _ascii_run(m: re.Match) -> str:
    run = m[0]
    digits = sum(c not in DIGIT_SEPARATORS for c in run)
    return run.translate(_CN) if digits >= LEAST_DIGIT_RUN and any(c in CHINESE_DIGITS for c in run) else run


def normalize(text: str) -> tuple[str, list[int] | None]:
    """The text that patterns see and, if it differs, each character's place in the original.

    Drops invisible characters, maps look-alikes to Latin, applies NFKC to each character, and writes Chinese digits in
    runs of LEAST_DIGIT_RUN or more digits as ASCII digits. ASCII text stays as it is.
    """
    if text.isascii():
        return text, None
    if not _ODD.search(text) and unicodedata.is_normalized("NFKC", text):
        out = _RUN.sub(_ascii_run, text) if _CN_ANY.search(text) else text
        return (text, None) if out == text else (out, list(range(len(out))))
    kept = [(i, c) for i, c in enumerate(text.translate(_LOOKS)) if c not in INVISIBLE]
    places, chars = [], []
    for i, c in kept:
        wide = c if c.isascii() else unicodedata.normalize("NFKC", c)
        chars.append(wide)
        places.extend([i] * len(wide))
    out = "".join(chars)
    out = _RUN.sub(_ascii_run, out)
    return (text, None) if out == text else (out, places)


def original_span(start: int, end: int, places: list[int] | None, size: int) -> tuple[int, int]:
    if places is None:
        return start, end
    first = places[start] if start < len(places) else size
    last = places[end - 1] + 1 if 0 < end <= len(places) else size
    return first, last


def detect_languages(text: str) -> list[str]:
    """Scripts decide: kana, Hangul, Chinese characters without these, three or more Latin letters; else Chinese."""
    kana, hangul, han = (re.search(p, text) for p in ("[぀-ヿ]", "[가-힣]", "[一-鿿]"))
    latin = len(re.findall("[A-Za-z]", text)) >= 3
    return [x for x, ok in (("ja", kana), ("ko", hangul), ("zh", han and not kana and not hangul), ("en", latin)) if ok] or ["zh"]


def languages_column(text: Column) -> Column:
    """detect_languages as a native column: array<string>."""
    kana, hangul, han = (text.rlike(p) for p in ("[぀-ヿ]", "[가-힣]", "[一-鿿]"))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", "")) >= 3
    found = F.array_compact(F.array(F.when(kana, "ja"), F.when(hangul, "ko"), F.when(han & ~kana & ~hangul, "zh"), F.when(latin, "en")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("zh")))


def simple_normal_column(text: Column) -> Column:
    """The native part of normalize (without NFKC and digit runs): exact for texts that need only it."""
    return F.translate(F.translate(text, INVISIBLE, ""), CONFUSABLE_FROM, CONFUSABLE_TO)


# ---- masks

#: Characters that stay at both ends, by type.
MASK_ENDS = {"phone": (3, 4), "bank_card": (6, 4), "credit_card": (6, 4), "id_number": (4, 4)}


def mask_value(value: str, kind: str, prefix: int = 0, suffix: int = 0) -> str:
    if kind == "email":
        at = value.find("@")
        return f"{value[0]}{'*' * max(at - 1, 3)}{value[at:]}" if at > 0 else value
    a, b = MASK_ENDS.get(kind, (3, 4))
    a, b = prefix or a, suffix or b
    return "*" * len(value) if len(value) <= a + b else value[:a] + "*" * (len(value) - a - b) + value[-b:]


def mask_name(value: str) -> str:
    shown = 0 if len(value) <= 1 else 1 if len(value) <= 3 else 2
    return value[:shown] + "*" * max(len(value) - shown, 1)


def mask_landline(value: str) -> str:
    dash = value.find("-")
    cut = dash + 1 if dash > 0 else (3 if value[1:2] in ("1", "2") and value[1:2] else 4) if value.startswith("0") else 0
    area, number = value[:cut], value[cut:]
    return area + ("*" * (len(number) - 3) + number[-3:] if len(number) > 3 else number)


def mask_regional_phone(value: str, region: str = "cn") -> str:
    digits = value.replace("-", "").replace(" ", "")
    by_length = {11: "cn", 8: "hk", 9: "tw"}
    a, b = {"cn": (3, 4), "hk": (2, 2), "tw": (2, 3)}.get(by_length.get(len(digits), "") if region == "auto" else region, (2, 2))
    return "*" * len(digits) if len(digits) <= a + b else digits[:a] + "*" * (len(digits) - a - b) + digits[-b:]


def mask_column(value: Column, kind: str, prefix: int = 0, suffix: int = 0) -> Column:
    """mask_value as a native column."""
    n = F.length(value)
    if kind == "email":
        at = F.instr(value, "@")
        return F.when(at > 1, F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), F.greatest(at - 2, F.lit(3))), F.substr(value, at))).otherwise(value)
    a, b = MASK_ENDS.get(kind, (3, 4))
    a, b = prefix or a, suffix or b
    return F.when(n <= a + b, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(a)), F.repeat(F.lit("*"), n - a - b), F.right(value, F.lit(b))))


def distinct_label(label: str, used: set[str]) -> str:
    """The label, with a circled number or (n) behind it if others have it already."""
    if label not in used:
        return label
    return next(x for x in chain((label + c for c in CIRCLED), (f"{label}({i})" for i in count(21))) if x not in used)
