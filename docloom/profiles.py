"""Language profiles: the word lists and patterns that the text operators take as parameters.

Patterns are written in Python's syntax, in which white space and digits are those of Unicode; ``java``
and ``re2`` give the same pattern for Spark's and DuckDB's engines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: White space for stripping, as the inside of a bracket expression.
JAVA_SPACE = r"\s\x1c-\x1f"
RE2_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def java(pattern: str, flags: str = "") -> str:
    return f"(?U{flags}){pattern}"


def re2(pattern: str) -> str:
    return pattern.replace(r"\s", rf"[{RE2_SPACE}]").replace(r"\d", r"\p{Nd}")


def occurs(pattern: str) -> str:
    """A pattern that occurs where the given one does: a lazy beginning may be empty, so it is left out.

    Looking for the whole of it costs the square of a clause's length wherever it fails.
    """
    lazy = r"[^，。；]*?\s*"
    return pattern.removeprefix(lazy)


def any_of(patterns: list[str] | tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


@dataclass(frozen=True)
class Profile:
    """What depends on a language. ``classes`` are tried in order, and in each its patterns in order."""

    name: str
    terminators: str
    page_patterns: tuple[str, ...]
    boilerplate: tuple[str, ...]
    core_sections: tuple[str, ...]
    classes: tuple[tuple[str, tuple[str, ...]], ...]
    other: str
    clause: str
    query_instruction: str = ""
    terms: dict[str, list[str]] = field(default_factory=dict, hash=False, compare=False)


# ---- fixed values: they must be what they are for the results to be right ----

ZH_PAGE = (
    r"第\s*\d+\s*页",
    r"第\s*[一二三四五六七八九十百千万]+\s*页",
    r"Page\s*\d+",
    r"页码[：:]\s*\d+",
    r"^\s*\d+\s*$",
)
ZH_BOILERPLATE = (
    r"本合同未尽事宜",
    r"保险人保留最终解释权",
    r"本合同的解释权归.*?所有",
    r"其他未尽事宜.*?约定",
    r"本条款.*?解释权",
    r"最终解释权.*?保险人",
    r"保险人.*?有权.*?解释",
    r"本附加合同.*?未尽事宜",
    r"其他.*?以.*?为准",
)
ZH_CORE = ("保险责任", "保险金", "理赔", "给付", "保障范围", "保险金额", "保险费", "保险期间", "等待期")
ZH_PAYMENT = (
    r"保险人\s*(?:给付|赔付|支付|承担|负责)",
    r"按照\s*(?:合同|本条款|本协议)\s*(?:约定|规定)\s*(?:给付|赔付|支付)",
    r"给付\s*(?:保险金|赔偿金|金额)",
    r"赔付\s*(?:保险金|赔偿金|金额)",
    r"承担\s*(?:保险责任|赔偿责任)",
    r"负责\s*(?:给付|赔付|支付)",
)
ZH_EXCLUSION = (
    r"但\s*(?:是|为|在|如|若|当)",
    r"除外",
    r"不\s*(?:承担|负责|给付|赔付|支付|予赔付)",
    r"不予\s*(?:赔付|给付|支付)",
    r"免除\s*(?:责任|赔偿责任)",
    r"不\s*(?:在|属于)\s*(?:保险责任|保障范围)",
    r"不在\s*(?:保险责任|保障范围)\s*(?:内|之内)",
)
ZH_CONDITION = (
    r"因\s*[^，。；]*?\s*导致",
    r"在\s*[^，。；]*?\s*情况下",
    r"当\s*[^，。；]*?\s*时",
    r"若\s*[^，。；]*?[，。；]",
    r"如\s*[^，。；]*?[，。；]",
    r"如果\s*[^，。；]*?[，。；]",
    r"倘若\s*[^，。；]*?[，。；]",
    r"只要\s*[^，。；]*?[，。；]",
    r"除非\s*[^，。；]*?[，。；]",
)
ZH_DEFINITION = (
    r"[^，。；]*?\s*(?:指|是指|为|是指|系指|即)",
    r"[^，。；]*?\s*(?:包括|包含|涵盖|涉及)",
)
ZH_TERMS = {
    "保险金": ["保险金", "保险金额", "保险给付", "保险赔付", "保险赔偿", "保险赔款"],
    "保险责任": ["保险责任", "保障责任", "保障范围", "保险保障", "保险范围"],
    "保险费": ["保险费", "保费", "保险费用", "保险费率"],
    "保险期间": ["保险期间", "保障期间", "保险期限", "保障期限", "保险有效期"],
    "等待期": ["等待期", "观察期", "免责期", "等待期间"],
    "犹豫期": ["犹豫期", "冷静期", "撤销期", "退保期"],
    "免赔额": ["免赔额", "免赔", "免赔金额", "免赔额度"],
    "保险金额": ["保险金额", "保额", "保险额度", "保障金额"],
    "现金价值": ["现金价值", "退保价值", "保单价值", "解约金"],
    "受益人": ["受益人", "保险受益人", "受益方"],
    "被保险人": ["被保险人", "被保人", "受保人"],
    "投保人": ["投保人", "要保人", "保单持有人"],
    "保险人": ["保险人", "保险公司", "承保公司", "承保方"],
    "意外伤害": ["意外伤害", "意外事故", "意外", "意外事件"],
    "疾病": ["疾病", "疾病状态", "患病", "罹患疾病"],
    "身故": ["身故", "死亡", "身死", "去世"],
    "伤残": ["伤残", "残疾", "失能", "丧失劳动能力"],
    "重大疾病": ["重大疾病", "重疾", "重大疾病保险", "重疾险"],
    "轻症": ["轻症", "轻度疾病", "轻症疾病"],
    "中症": ["中症", "中度疾病", "中症疾病"],
    "理赔": ["理赔", "索赔", "申请理赔", "申请索赔"],
    "给付": ["给付", "支付", "赔付", "赔偿", "支付保险金"],
    "免责": ["免责", "除外", "不承担", "不予赔付", "免除责任"],
    "续保": ["续保", "续期", "续保保费", "续保申请"],
    "退保": ["退保", "解除合同", "终止合同", "取消保险"],
    "保单": ["保单", "保险合同", "保险单", "保险凭证"],
    "条款": ["条款", "保险条款", "合同条款", "约定条款"],
}
ZH_CLAUSE = r"第\s*[一二三四五六七八九十\d]+\s*[条款项]"
ZH_INSTRUCTION = "为这个句子生成表示以用于检索相关文章："
NUMBERED = r"[（(]?\s*[一二三四五六七八九十\d]+[、.)）]\s*"
HEADING = r"^(#{1,6})\s+(.+)$"
IMAGE = r"!\[.*?\]\((.*?)\)"
LIST_ITEM = r"^(?:[-*+]\s+|\d+\.\s+|\$\\[a-zA-Z]+\$\s+)"
#: A line that an unfinished line above may not be joined with.
SPECIAL_LINE = r"^(?:[#|<]|[-*+]\s|\d+\.\s|[一二三四五六七八九十]+[、.])"
BOOSTS = {"section": 0.1, "table": 0.05, "list": 0.03, "top_level": 0.02}
PROMPT_HEAD = "你是一个专业的保险知识助手。请根据以下文档内容回答用户的问题。\n\n## 参考文档：\n\n"
PROMPT_TAIL = "\n\n## 用户问题：\n\n{query}\n\n## 回答要求：\n\n1. 基于参考文档中的内容回答问题\n2. 如果文档中没有相关信息，请明确说明\n3. 回答要准确、专业、易懂\n4. 如果涉及具体条款，请引用文档中的原文\n\n## 回答："

# ---- end of the fixed values ----

ZH = Profile("zh", "。！？；", ZH_PAGE, ZH_BOILERPLATE, ZH_CORE, (("给付", ZH_PAYMENT), ("免责", ZH_EXCLUSION), ("条件", ZH_CONDITION), ("定义", ZH_DEFINITION)), "其他", ZH_CLAUSE, ZH_INSTRUCTION, ZH_TERMS)

LATIN = Profile(
    "latin",
    ".!?;",
    (r"Page\s*\d+", r"^\s*\d+\s*$"),
    (r"all rights reserved", r"final interpretation", r"subject to change without notice"),
    ("coverage", "benefit", "premium", "claim"),
    (("payment", (r"(?:insurer|company)\s+(?:pays|refunds)", r"pays\s+the")), ("exclusion", (r"excludes", r"does\s+not\s+cover")), ("condition", (r"[Ii]f\s[^,.;]*[,.;]", r"unless\s[^,.;]*")), ("definition", (r"[^,.;]*\bmeans\b",))),
    "other",
    r"(?:clause|section)\s*\d+",
)
