"""Checks of matches: each as a Python predicate for Arrow batches, and as a Spark column for native plans.

`PREDICATES[name](value)` and `column(name, value)` agree on every string; tests compare them.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tables of public numbering schemes.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 "
    "UA29 VA22 VG24 XK20"
)
BANK_BINS = (
    "621700 621660 621662 621663 622202 622200 622208 621225 622848 622849 620059 621282 622568 622569 625912 625911 622588 622598 621483 622575 622155 622156 622157 621002 622689 622688 621691 "
    "622622 622668 622669 622670 622671 622630 622631 622632 622633 621283 621285 621286 621484 622580 622581 622582 622583 622150 622151 622152 622153 622700 622701 622690 622692"
)
CN_ID_WEIGHTS, CN_ID_CHECKS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"
CREDIT_CODE_ALPHABET, CREDIT_CODE_WEIGHTS = "0123456789ABCDEFGHJKLMNPQRTUWXY", (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
TW_ID_REGIONS = "A10 B11 C12 D13 E14 F15 G16 H17 I34 J18 K19 L20 M21 N22 O35 P23 Q24 R25 S26 T27 U28 V29 W32 X30 Y31 Z33"
HK_ID_WEIGHTS, TW_ID_WEIGHTS, MY_NUMBER_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2), (1, 9, 8, 7, 6, 5, 4, 3, 2, 1), (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
CNPJ_WEIGHTS = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
PAN_HOLDERS = "ABCFGHLJPT"
LEADING_NOISE = (
    "请查一下", "请查下", "请查", "查一下", "查下", "就职于", "供职于", "任职于", "毕业于", "就读于", "就读", "考入", "考上", "去过", "到过", "这是", "那是", "这个", "那个", "那里", "这里",
    "在", "去", "从", "到", "被", "给", "让", "有", "是", "的", "了", "和", "与", "把", "将", "已", "问", "看", "找", "一下",
)
ORGANIZATION_SUFFIXES = (
    "股份有限公司", "有限责任公司", "有限公司", "责任公司", "集团公司", "集团", "公司", "企业", "工厂", "银行", "保险", "证券", "基金", "医院", "诊所", "药房", "事务所", "研究院", "研究所", "实验室",
)
SCHOOL_SUFFIXES = ("大学", "学院", "中学", "小学", "高中", "初中", "附中", "附小", "实验学校", "外国语学校", "师范学校", "职业学校", "技术学校", "幼儿园", "书院", "学堂", "党校")

_IBAN = {x[:2]: int(x[2:]) for x in IBAN_LENGTHS.split()}
_BINS = frozenset(BANK_BINS.split())
_REGIONS = {x[0]: int(x[1:]) for x in TW_ID_REGIONS.split()}


def _strip(value: str, chars: str) -> str:
    return value.translate({ord(c): None for c in chars})


def digits_of(value: str) -> list[int]:
    return [int(c) for c in value if c.isdigit()]


def dot(digits: Sequence[int], weights: Sequence[int]) -> int:
    return sum(d * w for d, w in zip(digits, weights, strict=False))


def luhn_sum(digits: Sequence[int]) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))


def luhn_digit(body: str) -> int:
    return -luhn_sum([*map(int, body), 0]) % 10


def cn_id_check(body: str) -> str:
    return CN_ID_CHECKS[dot([int(c) for c in body], CN_ID_WEIGHTS) % 11]


def hk_id_check(letters: str, digits: str) -> str:
    values = [36] * (2 - len(letters)) + [ord(c) - 64 for c in letters] + [int(c) for c in digits]
    return "0123456789X"[-dot(values, HK_ID_WEIGHTS) % 11]


def tw_id_check(letter: str, digits: str) -> str:
    return str(-dot([*divmod(_REGIONS[letter], 10), *map(int, digits)], TW_ID_WEIGHTS) % 10)


def mod11_check(digits: Sequence[int], weights: Sequence[int]) -> int:
    r = dot(digits, weights) % 11
    return 0 if r < 2 else 11 - r


def _luhn(value: str) -> bool:
    d = digits_of(value)
    return len(d) >= 16 and luhn_sum(d) % 10 == 0


def _age(value: str) -> bool:
    m = re.search(r"\d+", value)
    return bool(m) and int(m[0]) <= 149


def _email(value: str) -> bool:
    local = value.split("@")[0] if "@" in value else ""
    return not (".." in local or local.startswith(".") or local.endswith("."))


def _iban(value: str) -> bool:
    v = value.replace(" ", "").upper()
    if len(v) != _IBAN.get(v[:2], -1) or not re.fullmatch(r"[0-9A-Z]+", v):
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _jwt(value: str) -> bool:
    parts = value.split(".")
    try:
        header = json.loads(base64.urlsafe_b64decode(parts[0] + "=" * (-len(parts[0]) % 4)))
    except ValueError:
        return False
    return len(parts) == 3 and isinstance(header, dict) and "alg" in header


def _cn_id(value: str) -> bool:
    v = _strip(value, " -").upper()
    return bool(re.fullmatch(r"[1-9]\d{16}[0-9X]", v)) and cn_id_check(v[:17]) == v[17]


def _hk_id(value: str) -> bool:
    m = re.fullmatch(r"([A-Z]{1,2})(\d{6})\((\d|X)\)", value)
    return bool(m) and hk_id_check(m[1], m[2]) == m[3]


def _tw_id(value: str) -> bool:
    return bool(re.fullmatch(r"[A-Z]\d{9}", value)) and tw_id_check(value[0], value[1:9]) == value[9]


def _bank_card(value: str) -> bool:
    d = "".join(c for c in value if c.isdigit())
    return len(d) >= 16 and (_luhn(value) or d[:6] in _BINS)


def _credit_code(value: str) -> bool:
    v = value.upper()
    if len(v) != 18 or any(c not in CREDIT_CODE_ALPHABET for c in v):
        return False
    return -dot([CREDIT_CODE_ALPHABET.index(c) for c in v[:17]], CREDIT_CODE_WEIGHTS) % 31 == CREDIT_CODE_ALPHABET.index(v[17])


def _named(suffixes: tuple[str, ...]) -> Callable[[str], bool]:
    noise = re.compile(f"(?:{'|'.join(sorted(LEADING_NOISE, key=len, reverse=True))})(?=.)", re.S)

    def check(value: str) -> bool:
        while m := noise.match(value):
            value = value[m.end() :]
        return any(value.endswith(s) and len(value) > len(s) for s in suffixes)

    return check


def _ssn(value: str) -> bool:
    return bool(re.fullmatch(r"(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}", _strip(value, "- ")))


def _cpf(value: str) -> bool:
    d = digits_of(value)
    return len(d) == 11 and len(set(d)) > 1 and all(d[n] == mod11_check(d[:n], range(n + 1, 1, -1)) for n in (9, 10))


def _cnpj(value: str) -> bool:
    d = digits_of(value)
    return len(d) == 14 and len(set(d)) > 1 and d[12] == mod11_check(d[:12], CNPJ_WEIGHTS) and d[13] == mod11_check(d[:13], (6, *CNPJ_WEIGHTS))


def _my_number(value: str) -> bool:
    v = value.replace(" ", "")
    return bool(re.fullmatch(r"\d{12}", v)) and mod11_check([int(c) for c in v[:11]], MY_NUMBER_WEIGHTS) == int(v[11])


PREDICATES: dict[str, Callable[[str], bool]] = {
    "luhn": lambda v: _strip(v, "- ").isdigit() and _luhn(v), "age": _age, "email": _email, "iban": _iban, "jwt": _jwt, "cn_id": _cn_id, "hk_id": _hk_id, "tw_id": _tw_id, "bank_card": _bank_card,
    "credit_code": _credit_code, "organization": _named(ORGANIZATION_SUFFIXES), "school": _named(SCHOOL_SUFFIXES), "ssn": _ssn, "jp_phone": lambda v: 10 <= len(v.replace("-", "")) <= 11,
    "my_number": _my_number, "de_tax_id": lambda v: bool(re.fullmatch(r"[1-9]\d{10}", v.replace(" ", ""))), "de_phone": lambda v: 10 <= len(digits_of(v)) <= 15,
    "aadhaar": lambda v: bool(re.fullmatch(r"[2-9]\d{11}", _strip(v, " -"))), "pan": lambda v: bool(re.fullmatch(rf"[^\W\d_]{{3}}[{PAN_HOLDERS}][^\W\d_]\d{{4}}[^\W\d_]", v)), "cpf": _cpf, "cnpj": _cnpj,
}

# ---- the same as columns


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _numbers(text: Column) -> Column:
    """array<int> of a string of ASCII digits."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.try_cast("int"))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, d: a + d)


def _dot(numbers: Column, weights: Sequence[int]) -> Column:
    return _sum(F.zip_with(F.slice(numbers, 1, len(weights)), F.array(*map(F.lit, weights)), lambda d, w: F.coalesce(d, F.lit(0)) * w))


def _last_check(total: Column) -> Column:
    r = total % 11
    return F.when(r < 2, 0).otherwise(F.lit(11) - r)


def luhn_column(value: Column) -> Column:
    doubled = F.transform(F.reverse(_numbers(_digits(value))), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return (F.length(_digits(value)) >= 16) & (_sum(doubled) % 10 == 0)


def _iban_column(value: Column) -> Column:
    v = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    lengths = F.create_map(*(F.lit(x) for kv in _IBAN.items() for x in kv))
    moved = F.filter(F.split(F.concat(F.substr(v, F.lit(5)), F.left(v, F.lit(4))), ""), lambda c: c != "")
    value_of = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + value_of(c)).otherwise(a * 100 + value_of(c)) % 97)
    return F.coalesce(F.try_element_at(lengths, F.left(v, F.lit(2))) == F.length(v), F.lit(False)) & v.rlike("^[0-9A-Z]+$") & (rest == 1)


def _hk_id_column(value: Column) -> Column:
    letters, body, check = (F.regexp_extract(value, r"^([A-Z]{1,2})(\d{6})\((\d|X)\)$", k) for k in (1, 2, 3))
    values = F.concat(F.when(F.length(letters) == 1, F.array(F.lit(36))).otherwise(F.array().cast("array<int>")), F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.ascii(c) - 64), _numbers(body))
    return (check != "") & (F.substr(F.lit("0123456789X"), F.pmod(-_dot(values, HK_ID_WEIGHTS), F.lit(11)) + 1, F.lit(1)) == check)


def _tw_id_column(value: Column) -> Column:
    region = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _REGIONS.items() for x in kv)), F.left(value, F.lit(1))), F.lit(0))
    values = F.concat(F.array(F.floor(region / 10).cast("int"), region % 10), _numbers(F.substr(value, F.lit(2), F.lit(8))))
    return value.rlike(r"^[A-Z]\d{9}$") & (F.pmod(-_dot(values, TW_ID_WEIGHTS), F.lit(10)).cast("string") == F.right(value, F.lit(1)))


def _credit_code_column(value: Column) -> Column:
    v = F.upper(value)
    numbers = F.transform(F.filter(F.split(v, ""), lambda c: c != ""), lambda c: F.instr(F.lit(CREDIT_CODE_ALPHABET), c) - 1)
    return v.rlike(f"^[{CREDIT_CODE_ALPHABET}]{{18}}$") & (F.pmod(-_dot(numbers, CREDIT_CODE_WEIGHTS), F.lit(31)) == F.try_element_at(numbers, F.lit(18)))


def _named_column(suffixes: tuple[str, ...]) -> Callable[[Column], Column]:
    noise = "|".join(sorted(LEADING_NOISE, key=len, reverse=True))
    return lambda v: F.regexp_replace(v, f"(?s)^(?:(?:{noise})(?=.))+", "").rlike(f"(?s).(?:{'|'.join(suffixes)})$")


def _twice(value: Column, size: int, first: Sequence[int], second: Sequence[int]) -> Column:
    n = _numbers(_digits(value))
    at = lambda k: F.try_element_at(n, F.lit(k))
    return (F.size(n) == size) & (F.size(F.array_distinct(n)) > 1) & (at(size - 1) == _last_check(_dot(n, first))) & (at(size) == _last_check(_dot(n, second)))


def _jwt_column(value: Column) -> Column:
    part = F.translate(F.substring_index(value, ".", 1), "-_", "+/")
    padded = F.rpad(part, (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    return (F.size(F.split(value, r"\.")) == 3) & F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.alg").isNotNull()


COLUMNS: dict[str, Callable[[Column], Column]] = {
    "luhn": lambda v: F.regexp_replace(v, "[- ]", "").rlike(r"^\d+$") & luhn_column(v), "age": lambda v: F.regexp_extract(v, r"\d+", 0).try_cast("int") <= 149,
    "email": lambda v: ~F.substring_index(v, "@", 1).rlike(r"\.\.|^\.|\.$"), "iban": _iban_column, "jwt": _jwt_column,
    "cn_id": lambda v: F.upper(F.regexp_replace(v, "[ -]", "")).rlike(r"^[1-9]\d{16}[0-9X]$")
    & (F.substr(F.lit(CN_ID_CHECKS), _dot(_numbers(F.left(F.regexp_replace(v, "[ -]", ""), F.lit(17))), CN_ID_WEIGHTS) % 11 + 1, F.lit(1)) == F.upper(F.right(v, F.lit(1)))),
    "hk_id": _hk_id_column, "tw_id": _tw_id_column, "bank_card": lambda v: (F.length(_digits(v)) >= 16) & (luhn_column(v) | F.left(_digits(v), F.lit(6)).isin(*sorted(_BINS))), "credit_code": _credit_code_column,
    "organization": _named_column(ORGANIZATION_SUFFIXES), "school": _named_column(SCHOOL_SUFFIXES), "ssn": lambda v: F.regexp_replace(v, "[- ]", "").rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$"),
    "jp_phone": lambda v: F.length(F.replace(v, F.lit("-"), F.lit(""))).between(10, 11),
    "my_number": lambda v: F.replace(v, F.lit(" "), F.lit("")).rlike(r"^\d{12}$") & (_last_check(_dot(_numbers(_digits(v)), MY_NUMBER_WEIGHTS)) == F.try_element_at(_numbers(_digits(v)), F.lit(12))),
    "de_tax_id": lambda v: F.replace(v, F.lit(" "), F.lit("")).rlike(r"^[1-9]\d{10}$"), "de_phone": lambda v: F.length(_digits(v)).between(10, 15), "aadhaar": lambda v: F.regexp_replace(v, "[ -]", "").rlike(r"^[2-9]\d{11}$"),
    "pan": lambda v: v.rlike(rf"^\p{{L}}{{3}}[{PAN_HOLDERS}]\p{{L}}\d{{4}}\p{{L}}$"), "cpf": lambda v: _twice(v, 11, range(10, 1, -1), range(11, 1, -1)), "cnpj": lambda v: _twice(v, 14, CNPJ_WEIGHTS, (6, *CNPJ_WEIGHTS)),
}


def column(name: str, value: Column) -> Column:
    """True where the named check passes; never null for a non-null value."""
    return F.coalesce(COLUMNS[name](value), F.lit(False))
