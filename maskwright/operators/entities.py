"""Detection in one text: patterns, names, hints, merging. Free of Spark; the frames call it for Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import NamedTuple

from maskwright.functions.gates import Gated
from maskwright.functions.patterns import LANGUAGES, LanguagePack, patterns_for
from maskwright.functions.text import normalize, original_span
from maskwright.functions.validators import PREDICATES


class Entity(NamedTuple):
    start: int  # code points of the original text, end not included
    end: int
    text: str
    type: str
    confidence: float = 1.0
    layer: int = 1

    @property
    def size(self) -> int:
        return self.end - self.start


ENTITY_TYPE = "struct<start:int,end:int,text:string,type:string,confidence:double,layer:int>"
SELF = "self_reference"

# Words that make a match a false positive, within CONTEXT characters of it.
CONTEXT = 15
FALSE_BEFORE = r"(?:version|ver|v\.|order\s*#|product\s*code|serial\s*#|isbn|sku|calculate|计算|订单号|编号|版本|序列号)\s*$"
FALSE_AFTER = r"^\s*[/\*\+\-=%\^](?:\s*\d)"
# Kinship and commands in all languages, whatever the text's.
KINSHIP = (
    "我妈妈 我爸爸 我母亲 我父亲 我老公 我老婆 我丈夫 我妻子 我先生 我太太 我儿子 我女儿 我哥哥 我姐姐 我弟弟 我妹妹 我哥 我姐 我弟 我妹 我妈 我爸 我爷爷 我奶奶 我外公 我外婆 我叔叔 我阿姨 我舅舅 我姑姑 我家人 我家里人 我孩子 "
    "私の母 私の父 僕の母 僕の父 私の妻 私の夫 私の子 私の家族 私の息子 私の娘 母 父 妻 夫 제_아버지 저의_어머니 저의_아내 저의_남편 저의_아들 저의_딸 어머니 아버지 아내 남편 아이 가족 "
    "my_papa my_mummy my_mama my_didi my_bhaiya my_chacha my_mausi"
)
KINSHIP_PREFIXES = (
    "my ", "meine Mutter", "mein Vater", "meine Frau", "mein Mann", "mein Sohn", "meine Tochter", "meine Kinder", "meine Familie", "minha mãe", "meu pai", "minha esposa", "meu marido", "meu filho", "minha filha", "minha família",
)
COMMAND_PREFIXES = ("我想问", "我想知道", "我需要", "我要问", "帮我", "请帮我", "请告诉我", "告诉我", "我想让你", "我希望你", "我要你", "麻烦帮我", "能帮我", "可以帮我")
COMMAND_SUFFIXES = ("してください", "してくれ", "教えて", "教えてください", "連絡してください", "お願いします", "해주세요", "해 주세요", "가르쳐 주세요", "연락해 주세요", "도와주세요", "알려주세요")
COMMAND_PATTERNS = (
    r"^(?:can you |could you |please |would you )|\b(?:help me|tell me|show me|explain to me|let me know)\b|^I (?:want to |need to |would like to )(?:know|ask|understand)",
    r"\b(?:können|könnten|würden)\s+Sie\b|\bbitte\b|\bkontaktieren\s+Sie\s+mich\b|\bsagen\s+Sie\s+mir\b",
    r"\bcould you\b|\bplease\b|\bwould you mind\b|\bcheers,?\s+(?:could|can|please)\b",
    r"\bkindly\b|\bplease do the needful\b|\brevert\b|\bdo the needful\b",
    r"\bpor favor\b|\bvocê\s+(?:pode|poderia)\b|\bme\s+diga\b|\bme\s+ajude\b",
)
# Types that count as the same thing for agreement between layers.
COMPATIBLE = frozenset({("address", "location"), ("location", "address"), ("organization", "workplace"), ("workplace", "organization"), ("school", "organization"), ("organization", "school")})
AGREEMENT_BONUS = 0.1

_BEFORE, _AFTER = re.compile(FALSE_BEFORE, re.I), re.compile(FALSE_AFTER)
_KIN = frozenset(x.replace("_", " ") for x in KINSHIP.split())
_COMMAND = re.compile("|".join(f"(?:{p})" for p in COMMAND_PATTERNS), re.I)


@lru_cache(maxsize=256)
def _compiled(langs: tuple[str, ...], packs: tuple[LanguagePack, ...] = ()) -> tuple:
    """Patterns without a check first: among matches that begin together these come first; and their gates."""
    checks = PREDICATES | {k: f for x in packs for k, f in x.checks}
    listed = sorted(patterns_for(langs, packs), key=lambda p: bool(p.validator))
    return tuple((p, re.compile(p.regex), checks.get(p.validator)) for p in listed), Gated([p.regex for p in listed])


def false_positive(text: str, start: int, end: int) -> bool:
    return bool(_BEFORE.search(text[max(0, start - CONTEXT) : start]) or _AFTER.match(text[end : end + CONTEXT]))


def match_patterns(text: str, langs: Iterable[str], packs: tuple[LanguagePack, ...] = ()) -> tuple[list[Entity], list[Entity]]:
    """Matches in order of their start, and near misses: matches that fail their check (confidence 0.3)."""
    found, near = [], []
    listed, gates = _compiled(tuple(langs), packs)
    for (p, regex, check), may in zip(listed, gates.passing(text), strict=True):
        for m in regex.finditer(text) if may else ():
            g = p.group if p.group and m[p.group] else 0
            e = Entity(*m.span(g), m[g], p.type)
            if check and not check(e.text):
                near.append(e._replace(confidence=0.3))
            elif not (p.context and false_positive(text, *m.span())):
                found.append(e)
    return sorted(found, key=lambda e: e.start), near


class Hints(NamedTuple):
    pii_count: int
    density: str
    intent: str
    tier: int  # of self references; 0 without any
    has_kinship: bool
    near_misses: tuple[Entity, ...] = ()

    @property
    def person_threshold(self) -> float:
        return 1.2 if self.intent == "instruction" else 0.8

    @property
    def skip_ner(self) -> bool:
        return self.intent == "instruction" and self.pii_count == 0

    @property
    def ner_confidence(self) -> float:
        return {"high": 0.3, "medium": 0.4}.get(self.density, 0.5)


def is_command(text: str) -> bool:
    t = text.strip()
    return t.startswith(COMMAND_PREFIXES) or t.endswith(COMMAND_SUFFIXES) or bool(_COMMAND.search(t))


def hints_of(entities: list[Entity], text: str, near: Iterable[Entity] = ()) -> Hints:
    own = [e for e in entities if e.type == SELF]
    count = len(entities) - len(own)
    density = "high" if count >= 3 else "medium" if count else "none"
    if not own:
        return Hints(count, density, "narrative" if count else "neutral", 0, False, tuple(near))
    kin = any(e.text in _KIN or e.text.startswith(KINSHIP_PREFIXES) for e in own)
    command = is_command(text)
    tier = 1 if kin or count else 3 if command else 2
    return Hints(count, density, "instruction" if command else "narrative" if count else "casual", tier, kin, tuple(near))


def merge(entities: list[Entity], text: str) -> list[Entity]:
    """One entity for each stretch: the longest wins, then the most certain, then the first.

    Self references are kept whatever they overlap; what they overlap keeps only its part behind them.
    """
    order = lambda e: (e.start, -e.size)
    better = lambda a, b: (b.size, b.confidence) > (a.size, a.confidence)
    kept: list[Entity] = []
    for e in sorted((e for e in entities if e.type != SELF), key=order):
        if not kept or e.start >= kept[-1].end:
            kept.append(e)
        elif better(kept[-1], e):
            kept[-1] = e
    if len(kept) == len(entities):
        return kept
    final: list[Entity] = []

    def tail(e: Entity, start: int) -> None:
        rest = text[start : e.end]
        if start < e.end and rest.strip():
            final.append(e._replace(start=start, text=rest))

    for e in sorted([*kept, *(e for e in entities if e.type == SELF)], key=order):
        last = final[-1] if final else None
        if last is None or e.start >= last.end:
            final.append(e)
        elif e.type == SELF and last.type != SELF:
            final[-1] = e
            tail(last, e.end)
        elif last.type == SELF and e.type != SELF:
            tail(e, last.end)
        elif e.size > last.size or e.confidence > last.confidence:
            final[-1] = e
    return sorted(final, key=lambda e: e.start)


def boost(merged: list[Entity], before: list[Entity]) -> list[Entity]:
    """Adds to the confidence of entities on which two layers agree."""
    if len({e.layer for e in before}) < 2:
        return merged
    agree = lambda m: {e.layer for e in before if e.start < m.end and m.start < e.end and (e.type == m.type or (e.type, m.type) in COMPATIBLE)}
    return [m._replace(confidence=min(m.confidence + AGREEMENT_BONUS, 1.0)) if len(agree(m)) >= 2 else m for m in merged]


class Detection(NamedTuple):
    entities: list[Entity]
    langs: list[str]
    hints: Hints
    layer_counts: dict[int, int]
    layer_status: dict[int, str]


#: A model: text -> entities with types and confidences. Its layer (2 or 3) is set by the caller.
Model = Callable[[str], Iterable[Entity]]


class Detector:
    """Detects with fixed options; `models` are (layer, model) pairs: layer 2 runs in modes ner and auto, 3 in auto."""

    def __init__(self, langs="zh", *, mode="fast", names=(), types=None, types_exclude=None, models: tuple[tuple[int, Model], ...] = (), name_lists=None, packs: tuple[LanguagePack, ...] = ()):
        from .names import NameLists

        if mode not in ("fast", "ner", "auto"):
            raise ValueError(f"unknown mode {mode!r}; known: fast, ner, auto")
        if types is not None and types_exclude is not None:
            raise ValueError("types and types_exclude exclude each other")
        self.langs = [langs] if isinstance(langs, str) else list(langs)
        self.packs = tuple(packs)
        if self.langs != ["auto"]:
            patterns_for(self.langs, self.packs)
        self.mode, self.names, self.models = mode, tuple(n for n in names or () if n), models
        self.types, self.types_exclude = types and frozenset(types), types_exclude and frozenset(types_exclude)
        self.lists = name_lists or NameLists()

    def wants(self, kind: str) -> bool:
        return kind in self.types if self.types is not None else kind not in (self.types_exclude or ())

    def detect(self, text: str) -> Detection:
        from maskwright.functions.text import detect_languages

        from . import names as n

        langs = [x for x in detect_languages(text) if x in LANGUAGES] if self.langs == ["auto"] else self.langs
        seen, places = normalize(text)
        raw, near = match_patterns(seen, langs, self.packs)
        first = []
        for e in raw:
            a, b = original_span(e.start, e.end, places, len(text))
            first.append(e._replace(start=a, end=b, text=text[a:b]))
        hints = hints_of(first, text, near)
        found = list(first)
        if "zh" in langs:
            found += n.chinese_names(text, first, self.names, hints.person_threshold, self.lists)
        if "en" in langs:
            found += n.english_names(text, self.names, self.lists)
        if not {"zh", "en"} & set(langs):
            found += n.known_names(text, self.names)
        counts, status = {1: len(found), 2: 0, 3: 0}, {2: "skipped", 3: "skipped"}
        for layer, model in self.models:
            if self.mode == "fast" or (layer == 3 and self.mode != "auto") or (layer == 2 and hints.skip_ner):
                continue
            least = hints.ner_confidence if layer == 2 else 0.5
            try:
                own = [Entity(*e)._replace(layer=layer) for e in model(text)]
            except Exception:
                if layer == 2:
                    raise
                status[layer] = "error"  # a semantic model that fails doesn't stop detection
                continue
            own = [e for e in own if e.confidence >= least]
            found += own
            counts[layer] += len(own)
            status[layer] = "ok"
        if not self.wants(SELF):  # what isn't asked for cuts no other entity: the pronoun in our.12@corp.test
            found = [e for e in found if e.type != SELF]
        merged = boost(merge(found, text), found)
        if hints.tier != 1:
            merged = [e for e in merged if e.type != SELF]
        if self.types is not None:
            merged = [e for e in merged if e.type in self.types]
        elif self.types_exclude is not None:
            merged = [e for e in merged if e.type not in self.types_exclude]
        return Detection(merged, langs, hints, counts, status)
