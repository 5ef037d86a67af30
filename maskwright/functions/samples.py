"""Labelled test data: valid values of Chinese types with real prefixes, and sentences with gold spans around them.

Each row depends on (seed, row number) alone, so that a frame of any size is made by its tasks without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .fakes import Stream
from .validators import BANK_BINS, CREDIT_CODE_ALPHABET, CREDIT_CODE_WEIGHTS, cn_id_check, dot, luhn_digit

# Our own short lists of parts.
AREAS = "110101 110105 310101 310115 440106 440305 330106 510104 320102 420106".split()
SURNAMES, GIVEN = "王 李 张 刘 陈 杨 赵 黄 周 吴 欧阳 司马".split(), "明 伟 芳 娜 秀英 敏 静 强 磊 洋 建国 志强".split()
CITIES = (("北京市", "朝阳区"), ("上海市", "浦东新区"), ("广东省广州市", "天河区"), ("浙江省杭州市", "西湖区"), ("四川省成都市", "武侯区"))
STREETS = "建国路 中山路 人民路 解放路 和平路 文化路".split()
PLATES, LETTERS, DIGITS = "京沪粤浙川苏鄂", "ABCDEFGHJKLMNPQRSTUVWXYZ", "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _text(s: Stream, alphabet: str, n: int) -> str:
    return "".join(s.pick(alphabet) for _ in range(n))


def _id(s: Stream) -> str:
    body = f"{s.pick(AREAS)}{s.integer(1960, 2005)}{s.integer(1, 12):02d}{s.integer(1, 28):02d}{s.integer(0, 999):03d}"
    return body + cn_id_check(body)


def _card(s: Stream) -> str:
    body = s.pick(BANK_BINS.split()) + s.digits(9)
    return body + str(luhn_digit(body))


def _credit_code(s: Stream) -> str:
    body = s.pick(("91", "92", "52", "51", "11", "12")) + s.pick(AREAS) + _text(s, CREDIT_CODE_ALPHABET, 9)
    return body + CREDIT_CODE_ALPHABET[-dot([CREDIT_CODE_ALPHABET.index(c) for c in body], CREDIT_CODE_WEIGHTS) % 31]


def _date(s: Stream) -> str:
    y, m, d = s.integer(1950, 2005), s.integer(1, 12), s.integer(1, 28)
    return s.pick((f"{y}年{m}月{d}日", f"{y}-{m:02d}-{d:02d}", f"{y}/{m:02d}/{d:02d}"))


#: kind -> (what stands before the value, the value)
SAMPLES: dict[str, tuple[tuple[str, ...], Callable[[Stream], str]]] = {
    "phone": (("手机",), lambda s: s.pick(("13", "15", "17", "18")) + s.digits(9)),
    "landline": (("座机",), lambda s: s.pick(("010", "021", "0755", "0571")) + "-" + str(s.integer(2, 8)) + s.digits(7)),
    "id_number": (("身份证",), _id),
    "bank_card": (("银行卡",), _card),
    "passport": (("护照号",), lambda s: s.pick("EG") + s.digits(8)),
    "license_plate": (("车牌",), lambda s: s.pick(PLATES) + s.pick(LETTERS) + _text(s, LETTERS + DIGITS, 5)),
    "person": (("客户", "患者", "联系人"), lambda s: s.pick(SURNAMES) + s.pick(GIVEN)),
    "address": (("住在",), lambda s: "".join(s.pick(CITIES)) + s.pick(STREETS) + f"{s.integer(1, 999)}号"),
    "credit_code": (("信用代码",), _credit_code),
    "qq": (("QQ",), lambda s: str(s.integer(1, 9)) + s.digits(s.integer(4, 10))),
    "wechat": (("微信号",), lambda s: s.pick(LOWER) + _text(s, LOWER + DIGITS + "_", s.integer(5, 15))),
    "date_of_birth": (("出生日期", "生日", "生于"), _date),
    "military_id": (("军字第", "武字第"), lambda s: s.digits(8)),
    "social_security": (("社保号", "社保卡号"), _id),
    "email": (("邮箱",), lambda s: _text(s, LOWER, s.integer(4, 9)) + str(s.integer(1, 999)) + "@" + s.pick(("corp.cn", "mail.cn"))),
}
TYPE_OF = {"landline": "phone"}
SCHEMA = "doc_id long, text string, entities array<struct<start:int,end:int,text:string,type:string>>"


def sample_row(number: int, seed: int = 0, values: int = 3) -> tuple[str, list[dict]]:
    """A sentence with so many values of different kinds, and their spans."""
    s = Stream(f"{seed}:{number}".encode())
    kinds, text, spans = list(SAMPLES), "", []
    for _ in range(min(values, len(kinds))):
        kind = kinds.pop(s.integer(0, len(kinds) - 1))
        before, value = SAMPLES[kind]
        text += ("，" if text else "") + s.pick(before)
        v = value(s)
        spans.append({"start": len(text), "end": len(text) + len(v), "text": v, "type": TYPE_OF.get(kind, kind)})
        text += v
    return text + "。", spans


def sample_documents(spark: SparkSession, rows: int, seed: int = 0, values: int = 3) -> DataFrame:
    def run(batches):
        for b in batches:
            made = [sample_row(i, seed, values) for i in b.column("id").to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("type", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([t for t, _ in made]), pa.array([e for _, e in made], kind)], ["doc_id", "text", "entities"])

    return spark.range(rows).mapInArrow(run, SCHEMA)
