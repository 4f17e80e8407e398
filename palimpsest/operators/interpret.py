"""Rule proposals for plain sentences.

A sentence is cut into tokens.  At each token the longest phrase of a declared
vocabulary is looked up, then a phase, a span of time or a named field is read; what
nothing takes is the free-text query.  All of it works on one short string at the
driver; the proposal goes through ``rules.compile_rule`` like any other rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: What a phrase says, by rule field and value.
PHRASES = {
    ("registries", "NCT"): ("NCT", "ClinicalTrials.gov"),
    ("registries", "ChiCTR"): ("ChiCTR",),
    ("registries", "CTR"): ("CTR",),
    ("registries", "ICTRP"): ("ICTRP",),
    ("registries", "CTIS"): ("CTIS",),
    ("registries", "ISRCTN"): ("ISRCTN",),
    ("registries", "EUCTR"): ("EUCTR", "EudraCT"),
    ("statuses", "Not yet recruiting"): ("not yet recruiting", "尚未招募"),
    ("statuses", "Active, not recruiting"): ("active, not recruiting", "active not recruiting"),
    ("statuses", "Recruiting"): ("recruiting", "currently recruiting", "still recruiting", "open for recruitment", "正在招募", "招募中", "仍在招募"),
    ("statuses", "Completed"): ("completed", "已完成"),
    ("study_types", "Interventional"): ("interventional", "干预性研究", "药物干预"),
    ("study_types", "Observational"): ("observational", "观察性研究"),
    ("country", "China"): ("中国", "在中国"),
    ("country", "United States"): ("美国",),
    ("country", "United Kingdom"): ("英国",),
}
#: Countries that count only after a preposition.
PLACES = {"China": ("china", "prc"), "United States": ("united states", "usa"), "United Kingdom": ("united kingdom",)}
#: Words whose meaning is open, and wishes that no rule can express.
UNCLEAR = {"Chinese registry": ("chinese registry", "中国注册平台"), "active": ("active",), "open": ("open",), "recent": ("recent", "近期", "最近")}
UNSUPPORTED = {
    "Europe": ("europe", "in europe", "欧洲"),
    "promising": ("promising", "most promising", "最有前景"),
    "high quality": ("high quality", "高质量"),
    "best": ("best", "最佳"),
    "breakthrough": ("breakthrough", "突破性"),
    "likely to succeed": ("likely to succeed", "成功率高"),
}
#: Words that say nothing, words that end a named field, and units of time.
FILLER = ("clinical", "trial", "trials", "study", "studies", "for", "of", "the", "with", "only", "updated", "in", "on", "about", "临床试验", "试验", "研究", "开展的", "的", "仍在", ",", "，", "、", "。", ";", "；")
FIELD_MARKS = {"sponsor": (("sponsored", "by"), ("sponsor", ":")), "condition": (("condition", ":"),), "intervention": (("intervention", ":"),)}
FIELD_ENDS = {"trial", "trials", "study", "studies", "in"}
UNITS = {"hour", "hours", "day", "days", "month", "months", "year", "years"}
CJK_UNITS = ("小时", "天", "个月", "年")
CJK_AMOUNTS = "半一二三六十"
#: Numerals of phases.
NUMERALS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "ⅰ": 1, "ⅱ": 2, "ⅲ": 3, "ⅳ": 4, "1": 1, "2": 2, "3": 3, "4": 4}
WINDOW = "update window"

_TOKEN = re.compile(r"\d+|[^\W\d_Ⅰ-ⅿ㐀-鿿][\w.+'&-]*\w|\S")


@dataclass(frozen=True)
class Token:
    low: str
    start: int
    end: int


def tokens(text: str) -> list[Token]:
    """Words, numbers and single other signs, CJK characters among them."""
    out = []
    for m in _TOKEN.finditer(text):
        word = re.match(r"[^㐀-鿿]+", m[0])
        stop = m.end() if not word or len(word[0]) == len(m[0]) else m.start() + len(word[0])
        out.append(Token(text[m.start() : stop].lower(), m.start(), stop))
        out += [Token(text[i].lower(), i, i + 1) for i in range(stop, m.end())]
    return out


def _lexicon() -> dict[tuple[str, ...], tuple[str, str]]:
    """Phrase (its tokens) -> field or kind, and value."""
    found: dict[tuple[str, ...], tuple[str, str]] = {}

    def add(phrase: str, meaning: tuple[str, str]) -> None:
        found[tuple(t.low for t in tokens(phrase))] = meaning

    for word in FILLER:
        add(word, ("", ""))
    for kind, table in (("?", UNCLEAR), ("!", UNSUPPORTED)):
        for name, phrases in table.items():
            for p in phrases:
                add(p, (kind, name))
    for meaning, phrases in PHRASES.items():
        for p in phrases:
            add(p, meaning)
    for country, names in PLACES.items():
        for name in names:
            for lead in ("in", "within", "in the", "within the"):
                add(f"{lead} {name}", ("country", country))
    return found


LEXICON = _lexicon()
LONGEST = max(map(len, LEXICON))


@dataclass
class Reading:
    """What has been understood so far."""

    words: list[Token]
    rule: dict[str, list[str]] = field(default_factory=dict)
    unclear: list[str] = field(default_factory=list)
    unsupported: list[str] = field(default_factory=list)

    def low(self, i: int) -> str:
        return self.words[i].low if i < len(self.words) else ""

    def say(self, kind: str, *values: str) -> None:
        target = {"?": self.unclear, "!": self.unsupported}.get(kind)
        if target is None:
            target = self.rule.setdefault(kind, [])
        target += [v for v in values if v not in target]


def _phrase(r: Reading, i: int) -> int:
    """Tokens of the longest phrase at ``i``."""
    for n in range(min(LONGEST, len(r.words) - i), 0, -1):
        meaning = LEXICON.get(tuple(r.low(k) for k in range(i, i + n)))
        if meaning:
            if meaning[0]:
                r.say(*meaning)
            return n
    return 0


def _phase(r: Reading, i: int) -> int:
    """``phase 2``, ``phase 2/3``, ``phase 2 or 3``, ``II期``, ``II/III 期``."""
    western = r.low(i) == "phase"
    at = i + western
    first, joint, second = NUMERALS.get(r.low(at)), r.low(at + 1), NUMERALS.get(r.low(at + 2))
    paired = first and second and joint in ("/", "or") and second == first + 1
    end = at + (3 if paired else 1)
    if not first or not (western or r.low(end) == "期"):
        return 0
    if paired and joint == "/" and first != 2:
        r.say("phase", f"Phase {first}/Phase {second}")
    else:
        r.say("phase", f"Phase {first}", *[f"Phase {second}"] * bool(paired))
    return end - i + (not western)


def _span_of_time(r: Reading, i: int) -> int:
    """``in the last 6 months``, ``since May 2024``, ``过去半年``, ``自2024年5月以来``: no rule has them."""
    k = i
    while r.low(k) in ("updated", "in", "the"):
        k += 1
    if r.low(k) in ("last", "past") and r.low(k + 1).isdigit() and r.low(k + 2) in UNITS:
        r.say("!", WINDOW)
        return k + 3 - i
    if r.low(i) == "since" and r.low(i + 1).isalpha() and re.fullmatch(r"\d{4}", r.low(i + 2)):
        r.say("!", WINDOW)
        return 3
    lead = "".join(r.low(k) for k in (i, i + 1))
    amount = r.low(i + 2)
    if lead in ("过去", "最近") and amount and (amount.isdigit() or amount in CJK_AMOUNTS):
        rest = "".join(r.low(k) for k in (i + 3, i + 4))
        unit = next((u for u in CJK_UNITS if rest.startswith(u)), None)
        if unit:
            r.say("!", WINDOW)
            return 3 + len(unit)
    if [r.low(i + k) for k in (0, 2, 4, 5, 6)] == ["自", "年", "月", "以", "来"] and r.low(i + 1).isdigit() and r.low(i + 3).isdigit():
        r.say("!", WINDOW)
        return 7
    return 0


def _named_field(r: Reading, i: int, text: str) -> int:
    """``sponsored by X``, ``condition: X``: up to a word that ends it."""
    for name, marks in FIELD_MARKS.items():
        for mark in marks:
            start = i + len(mark)
            if tuple(r.low(k) for k in range(i, start)) != mark or not r.low(start)[:1].isalpha():
                continue
            ends = FIELD_ENDS | ({"phase", "with"} if name == "sponsor" else set())
            end = start
            while end < len(r.words) and (end == start or r.low(end) not in ends) and not re.fullmatch(r"[,，、。;；]", r.low(end)):
                end += 1
            r.rule[name] = [text[r.words[start].start : r.words[end - 1].end]]
            return end - i
    return 0


def _unread(r: Reading, text: str) -> Iterator[str]:
    """Pieces of the text that nothing took, as they stand."""
    i, begin = 0, None
    while i < len(r.words):
        taken = _span_of_time(r, i) or _named_field(r, i, text) or _phase(r, i) or _phrase(r, i)
        if taken and begin is not None:
            yield text[begin : r.words[i - 1].end]
            begin = None
        elif not taken and begin is None:
            begin = r.words[i].start
        i += taken or 1
    if begin is not None:
        yield text[begin:]


def interpret(text: str) -> dict:
    """A rule proposal for a sentence: ``rule``, ``ambiguities``, ``unsupported``, ``confidence``."""
    if not isinstance(text, str) or not text.strip() or len(text) > 500:
        raise ValueError("a query has 1 to 500 characters")
    reading = Reading(tokens(text))
    rest = " ".join(" ".join(_unread(reading, text)).split())
    if rest:
        reading.rule["query"] = [rest]
    doubtful = bool(reading.unclear or reading.unsupported)
    return {"query": text, "rule": reading.rule, "ambiguities": reading.unclear, "unsupported": reading.unsupported, "confidence": "low" if doubtful else "high"}


def validate_proposal(rule: dict) -> dict[str, list[str]]:
    """A proposal of any provider with blanks trimmed and repeats dropped, or ValueError.

    Lists only; fields with a closed vocabulary hold its values.
    """
    from .rules import MAX_VALUE, MAX_VALUES, RULE_FIELDS

    closed: dict[str, set[str]] = {"phase": {f"Phase {n}" for n in range(1, 5)} | {f"Phase {n}/Phase {n + 1}" for n in range(1, 4)}, "country": set(PLACES)}
    for name, value in PHRASES:
        closed.setdefault(name, set()).add(value)
    if not isinstance(rule, dict) or set(rule) - set(RULE_FIELDS):
        raise ValueError("unknown rule field")
    out = {}
    for name, values in rule.items():
        if not isinstance(values, list) or not 0 < len(values) <= MAX_VALUES:
            raise ValueError(f"invalid {name} rule")
        if not all(isinstance(v, str) and v.strip() and len(v) <= MAX_VALUE for v in values):
            raise ValueError(f"invalid {name} value")
        out[name] = list(dict.fromkeys(v.strip() for v in values))
        if not set(out[name]) <= closed.get(name, set(out[name])):
            raise ValueError(f"unknown {name} value")
    return out
