"""Personal names without a model: evidence around Chinese candidates, name lists for English."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from .entities import SELF, Entity

# Chinese surnames, particles, titles and words around names.
SURNAMES = (
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段漕钱汤尹黎易常武乔贺赖龚文庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍"
    "韦申尤毕聂丛焦向柳邢骆岳齐沿雷詹欧"
)
COMPOUND_SURNAMES = "欧阳 司马 上官 诸葛 东方 皇甫 令狐 公孙 慕容 尉迟 长孙 宇文 司徒 端木 南宫 西门"
NOT_LAST = "的了在是有和与把被让从到给向因为而又也都就才会能要可将已完开做吗呢吧啊哦呀嘛啦哈嗯着过去来"
HONORIFICS = "先生|女士|老师|教授|医生|同学|师傅|经理|总监|主任|院长|局长|部长|校长|董事长|同志|阿姨|叔叔|哥|姐|弟|妹"
HONORIFIC_HEADS = "先女老教医同师经总主院局部校董阿叔哥姐弟妹志"
ROLE_BEFORE = (
    "客户|患者|用户|旅客|车主|联系人|收件人|寄件人|登记人|开户人|申请人|报案人|委托人|当事人|嫌疑人|负责人|经办人|签收人|担保人|受益人|借款人|持卡人|被保险人|投保人|参会人员|主治医生|医生|护士|教授|老板|同事|朋友|同学|"
    "姓名|乘客|住户|业主|租户|房东|我是|我叫|这是|那是|找|叫做|叫作|本人|通知|转告|联系|致电|询问"
)
DATA_AFTER = r"^(?:的(?:手机|电话|身份证|银行卡|账[户号]|地址|邮[箱件]|护照|车牌)|[，,](?:身份证|电话|手机|银行卡))"
PHONE_AFTER = r"^[（(]\s*1[3-9]\d{9}"
WINDOW = 20

# Our own short lists: common words that begin with a surname, and common two-character words. Longer ones are a parameter.
NOT_NAMES = (
    "王国 高中 高兴 高度 高级 高速 高山 黄金 黄色 马上 马路 白天 白色 白酒 金额 金融 金属 方法 方便 方面 方案 石油 石头 江湖 江南 江西 江苏 任何 任务 任意 安全 安排 安装 万一 常常 常见 常用 文化 文件 文章 温度 温馨 武器 "
    "武汉 严重 严格 易于 毛病 毛巾 田野 向前 向来 于是 何时 何必 何况 何处 许多 许可 程序 程度 陆续 史上 康复 夏天 秦朝 唐朝 宋朝 汤药 钱包 章节 章程 施工 陶瓷 洪水 牛奶 季节 季度 齐全 雷雨 段落 龙头 关于 计算 花园 成都 成功 成为 "
    "时间 时候 连续 连接 明天 明确 水平 水果 白云 黄河 黄埔 张开 余额 余地 余下 丁香 顾客 顾问 申请 申报 单位 单独 曾经 沿海 沿着 常州 温州 徐州 郑州 苏州 林业 林区 叶子 孔子 周围 周末 周期 周年 胡同 胡说 朱红 郭外 罗列 梁山 谢谢 "
    "谢意 韩国 冯河 董事 袁大 邓小 傅立 沈阳 彭湃 吕宋 卢沟 蒋介 蔡伦 贾宝 魏晋 薛定 阎王 潘多 杜绝 戴上 钟表 汪洋 姜汤 范围 姚明 谭嗣 廖廖 邹城 熊猫 郝然 崔嵬 邱北 侯爵 邵阳 孟子"
)
COMMON_WORDS = (
    "预订 预约 联系 电话 手机 地址 今天 明天 昨天 已经 没有 可以 需要 办理 申请 提交 购买 支付 收到 发送 确认 说明 表示 认为 知道 觉得 希望 要求 报告 来到 来自 住在 位于 工作 学习 生活 参加 负责 通知 询问 咨询 投诉 反馈 签收 "
    "登记 开户 转账 汇款 借款 还款 消费 就诊 住院 出院 手术 检查 诊断 治疗 用药 毕业 就读 入职 离职 结婚 离婚 生日 出生 身份 护照 银行 账户 账号 邮箱 微信"
)
# Our own lists of frequent English surnames and given names; longer ones are a parameter.
ENGLISH_SURNAMES = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis "
    "Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Gomez Phillips Evans Turner Diaz Parker Cruz Edwards Collins Reyes "
    "Stewart Morris Morales Murphy Cook Rogers Gutierrez Ortiz Morgan Cooper Peterson Bailey Reed Kelly Howard Ramos Kim Cox Ward Richardson Watson Brooks Chavez Wood James Bennett Gray Mendoza Ruiz Hughes Price "
    "Alvarez Castillo Sanders Patel Myers Long Ross Foster Jimenez Powell Jenkins Perry Russell Sullivan Bell Coleman Butler Henderson Barnes Fisher Vasquez Simmons Romero Jordan Patterson Alexander Hamilton Graham "
    "Reynolds Griffin Wallace Moreno West Cole Hayes Bryant Herrera Gibson Ellis Tran Medina Aguilar Stevens Murray Ford Castro Marshall Owens Harrison Fernandez McDonald"
)
ENGLISH_GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Christopher Karen Charles Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark "
    "Margaret Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Timothy Stephanie Ronald Rebecca Jason Sharon Edward Laura Jeffrey Cynthia "
    "Ryan Dorothy Jacob Amy Gary Kathleen Nicholas Angela Eric Shirley Jonathan Emma Stephen Brenda Larry Pamela Justin Nicole Scott Anna Brandon Samantha Benjamin Katherine Samuel Christine Gregory Debra Alexander "
    "Rachel Patrick Carolyn Frank Janet Raymond Maria Jack Olivia Dennis Heather Jerry Helen Tyler Catherine Aaron Diane Jose Julie Adam Victoria Nathan Joyce Henry Lauren Zachary Kelly Douglas Christina Peter Ruth "
    "Kyle Joan Noah Virginia Ethan Judith Jeremy Evelyn Christian Hannah Walter Andrea Keith Megan Austin Cheryl Roger Jacqueline Terry Madison Sean Teresa Gerald Abigail Carl Sophia Dylan Martha Harold Sara Jordan "
    "Gloria Jesse Janice Bryan Kathryn Lawrence Ann Arthur Isabella Gabriel Judy Bruce Charlotte Logan Julia Billy Grace Joe Amber Alan Alice Juan Jean Elijah Denise Willie Frances Albert Danielle Wayne Marilyn"
)

_ROLE, _DATA, _PHONE = re.compile(f"(?:{ROLE_BEFORE})[：:\\s]?$"), re.compile(DATA_AFTER), re.compile(PHONE_AFTER)
_TITLE = re.compile(f"(?:{HONORIFICS})")
_TOKEN = re.compile(r"\b[A-Z][a-z]+\b|\b[A-Z]\.")
_COMPOUND = COMPOUND_SURNAMES.split()
_START = re.compile(rf"(?:{'|'.join(_COMPOUND)})[一-鿿]{{1,2}}")
_SINGLE = re.compile(rf"[{SURNAMES}][一-鿿]{{1,2}}")


@dataclass(frozen=True)
class NameLists:
    """The word lists; give longer ones (from a file, or a table small enough for the driver) for better recall."""

    surnames: frozenset = field(default_factory=lambda: frozenset(ENGLISH_SURNAMES.split()))
    given: frozenset = field(default_factory=lambda: frozenset(ENGLISH_GIVEN.split()))
    not_names: frozenset = field(default_factory=lambda: frozenset(NOT_NAMES.split()))
    common_words: frozenset = field(default_factory=lambda: frozenset(COMMON_WORDS.split()))

    @classmethod
    def from_files(cls, **paths: str) -> NameLists:
        read = lambda p: frozenset(open(p, encoding="utf-8").read().split())  # noqa: E731, SIM115
        return cls(**{k: read(p) for k, p in paths.items()})


@lru_cache(maxsize=64)
def _any_of(names: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True))))


def known_names(text: str, names: tuple[str, ...]) -> list[Entity]:
    """Every occurrence of each of the caller's names."""
    return [Entity(m.start(), m.end(), n, "person") for n in names if n for m in re.finditer(re.escape(n), text)]


def english_names(text: str, names: tuple[str, ...], lists: NameLists) -> list[Entity]:
    """A listed surname right behind a capitalised word or initial; a listed given name before these belongs to it."""
    out = [Entity(m.start(), m.end(), m[0], "person") for m in _any_of(names).finditer(text)] if names else []
    spans = {(e.start, e.end) for e in out}
    near = lambda a, b: not text[a.end() : b.start()].strip(" \t.")
    tokens = list(_TOKEN.finditer(text))
    for i in range(1, len(tokens)):
        last, first = tokens[i], tokens[i - 1]
        if last[0] not in lists.surnames or not near(first, last):
            continue
        if i >= 2 and near(tokens[i - 2], first) and tokens[i - 2][0].rstrip(".") in lists.given:
            first = tokens[i - 2]
        span = (first.start(), last.end())
        if span not in spans:
            spans.add(span)
            out.append(Entity(*span, text[slice(*span)], "person", 1.0 if first[0].rstrip(".") in lists.given else 0.9))
    return out


def _candidates(text: str, lists: NameLists) -> list[list[tuple[int, int]]]:
    """Spans that may be names, by where they begin; of three characters with a single surname also the first two."""
    out: dict[int, list[tuple[int, int]]] = {}

    def offer(m: re.Match, compound: bool) -> None:
        a, word = m.start(), m[0]
        if a in out:
            return
        while len(word) > 1 and word[-1] in NOT_LAST:
            word = word[:-1]
        if len(word) < 2:
            return
        if len(word) == 3 and word[2] in HONORIFIC_HEADS and _TITLE.match(text, a + 2, a + 5):
            word = word[:2]
        single = len(word) == 3 and not compound
        ok = [w for w in ([word] if not (single and word[:2] in lists.not_names) else []) + ([word[:2]] if single else []) if w not in lists.not_names]
        if ok:
            out[a] = [(a, a + len(w)) for w in ok]

    for m in _START.finditer(text):
        offer(m, True)
    for m in _SINGLE.finditer(text):
        if not any(a <= m.start() and m.end() <= b for spans in out.values() for a, b in spans):
            offer(m, False)
    return [out[a] for a in sorted(out)]


def _score(text: str, a: int, b: int, data: list[Entity]) -> float:
    before, after = text[max(0, a - WINDOW) : a], text[b : b + WINDOW]
    evidence = 0.6 * bool(_ROLE.search(before)) + 0.5 * bool(_TITLE.match(after)) + 0.5 * bool(_DATA.match(after)) + 0.5 * bool(_PHONE.match(after))
    for e in data:  # the first entity that is near counts
        distance = min(abs(a - e.end), abs(e.start - b))
        if distance <= 150:
            evidence += 0.5 if distance <= 50 else 0.3
            break
    return min({2: 0.3, 3: 0.4}.get(b - a, 0.5) + evidence, 1.0) if evidence else 0.0


def chinese_names(text: str, entities: list[Entity], names: tuple[str, ...], threshold: float, lists: NameLists) -> list[Entity]:
    """Candidates with enough evidence around them, and the caller's names."""
    out = known_names(text, names)
    taken = [(e.start, e.end) for e in out]
    data = [e for e in entities if e.type != SELF]
    for spans in _candidates(text, lists):
        good = [(a, b, s) for a, b in spans if not any(x <= a and b <= y for x, y in taken) and (s := _score(text, a, b, data)) >= threshold]
        if not good:
            continue
        good.sort(key=lambda g: g[0] - g[1])
        pick = good[0]
        if len(good) > 1 and pick[1] - pick[0] == 3:
            behind = text[pick[1] - 1 : pick[1] + 2]
            if any(behind[:k] in lists.common_words for k in range(2, len(behind) + 1)):
                pick = next((g for g in good if g[1] - g[0] == 2), pick)
        out.append(Entity(pick[0], pick[1], text[pick[0] : pick[1]], "person", pick[2]))
    return sorted(out, key=lambda e: e.start)
