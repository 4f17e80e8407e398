"""Text functions as columns: keyword matching, phase buckets, cleaning, splitting."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .columns import let

CJK = "[一-鿿]"
#: Roman numerals and their numbers, and texts that mean no phase.
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4"}
_NO_PHASE = ("n/a", "na", "not applicable", "not selected", "unknown", "")
#: What follows the word: one number, or two that a sign or "to" joins.
_NUMBERS = r"^\s*([ivx]{1,3}|[0-4])(?:\s*(?:[-/,&]|to\b)\s*([ivx]{1,3}|[0-4]))?(?![\p{L}\p{N}_])"
_BEFORE_CJK = r"([0-4])\s*期"


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


_EDGE = r"[\p{L}\p{N}]"


def _escaped(key: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", key)


def keyword_matches(text: Column, keyword: str) -> Column:
    """A CJK keyword anywhere, another one between characters that are no letters or digits."""
    low = F.lower(F.coalesce(text, F.lit("")))
    key = keyword.lower()
    if re.search(CJK, key):
        return low.contains(key)
    return low.contains(key) & low.rlike(f"(?<!{_EDGE}){_escaped(key)}(?!{_EDGE})")


def keywords_found(text: Column, keywords: Sequence[str]) -> Column:
    """Array of the keywords that match, once each.

    Keywords of letters and digits cannot overlap, so one pattern finds all of them in one
    reading; the others are looked for one by one.
    """
    names = {k.lower(): k for k in keywords}
    plain = [k for k in names if re.fullmatch(r"[^\W_]+", k) and not re.search(CJK, k)]
    parts = [F.array_compact(F.array(*[F.when(keyword_matches(text, names[k]), F.lit(names[k])) for k in names if k not in plain])).cast("array<string>")]
    if plain:
        known = F.create_map(*[F.lit(x) for k in plain for x in (k, names[k])])
        pattern = f"(?<!{_EDGE})(?:{'|'.join(sorted(plain, key=len, reverse=True))})(?!{_EDGE})"
        found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
        parts.append(F.transform(F.array_distinct(found), lambda k: F.element_at(known, k)))
    return F.concat(*parts)


def keyword_profile(columns: Sequence[Column], keywords: Sequence[str], ambiguous: Sequence[str] = (), context: Sequence[str] = ()) -> Column:
    """Any keyword in any column; an ambiguous one only beside a context term somewhere in the row."""
    hay = F.lower(F.concat_ws(" ", *columns))
    near = F.lit(False)
    for term in context:
        near = near | hay.contains(term.lower())
    out = F.lit(False)
    for keyword in keywords:
        hit = F.lit(False)
        for c in columns:
            hit = hit | keyword_matches(c, keyword)
        out = out | (hit & near if keyword in ambiguous else hit)
    return out


def phase_bucket(raw: Column) -> Column:
    """``Phase n``, ``Phase a/b``, ``N/A`` or ``Other``: numbers in order of appearance, once each.

    The text is cut at the word "phase", and each part is read from its start (``_NUMBERS``);
    numbers before the CJK word for phase are read after those.
    """
    text = F.translate(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "ⅰⅱⅲⅳ", "1234")
    parts = F.slice(F.split(text, "phase"), 2, F.size(F.split(text, "phase")))
    read = F.flatten(F.transform(parts, lambda p: F.array(*[F.regexp_extract(p, _NUMBERS, k) for k in (1, 2)])))
    names = F.create_map(*[F.lit(x) for n in range(5) for x in (str(n), str(n))], *[F.lit(x) for kv in _ROMAN.items() for x in kv])
    found = F.transform(F.concat(read, F.regexp_extract_all(text, F.lit(_BEFORE_CJK), F.lit(1))), lambda t: F.element_at(names, t))
    numbers = F.array_distinct(F.array_compact(found))
    return F.when(text.isin(*_NO_PHASE), "N/A").when(F.size(numbers) == 0, "Other").otherwise(F.concat(F.lit("Phase "), F.array_join(numbers, "/")))


def phase_bucket_of(term: str) -> str:
    """``phase_bucket`` of one constant, at the driver."""
    text = term.strip().lower().translate(str.maketrans("ⅰⅱⅲⅳ", "1234"))
    if text in _NO_PHASE:
        return "N/A"
    read = [m for part in text.split("phase")[1:] for m in regex.findall(_NUMBERS, part)]
    numbers = [_ROMAN.get(t, t) for pair in [*read, *re.findall(_BEFORE_CJK, text)] for t in pair]
    kept = list(dict.fromkeys(n for n in numbers if n.isdigit()))
    return "Phase " + "/".join(kept) if kept else "Other"


def phase_label(raw: Column) -> Column:
    """``PHASE1|PHASE2`` lists of codes as ``Phase 1/Phase 2``."""
    return F.array_join(F.transform(F.split(raw, r"[|,]\s*"), lambda p: F.regexp_replace(F.regexp_replace(p, "^(EARLY_)?PHASE", "Phase "), "^NA$", "N/A")), "/")


def clean_markup(text: Column) -> Column:
    """Line breaks for ``<br>``, no other tags, at most two newlines in a row."""
    broken = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    bare = F.regexp_replace(broken, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def unescape_markup(text: pd.Series) -> pd.Series:
    """HTML entities and backslash escapes undone until nothing changes."""

    def undo(t: str | None) -> str | None:
        while t is not None:
            new = html.unescape(t).replace("\\n", "\n").replace('\\"', '"').replace("\\/", "/")
            if new == t:
                break
            t = new
        return t

    return text.map(undo, na_action="ignore")


def list_items(text: Column) -> Column:
    """Array of a JSON array, or of lines; trimmed, blanks dropped; null where nothing is left."""
    parsed = F.from_json(text, "array<string>")
    items = F.coalesce(parsed, F.split(text, r"[;\n]"))
    flat = F.flatten(F.transform(items, lambda x: F.split(F.coalesce(F.get_json_object(x, "$.name"), x), ";")))
    clean = F.array_distinct(F.filter(F.transform(flat, lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", ""))), lambda x: x != ""))
    return F.when(F.size(clean) > 0, clean)


def to_json_array(text: Column) -> Column:
    """JSON array text of the non-blank lines; null where there are none."""
    items = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) > 0, F.to_json(items))


def or_terms(query: Column) -> Column:
    """Terms of an ``a OR "b c"`` query."""
    return F.filter(F.transform(F.split(query, r"\s+OR\s+"), lambda t: F.trim(F.regexp_replace(t, '"', ""))), lambda t: t != "")


def merge_queries(queries: Sequence[str]) -> str:
    """One OR query of several, terms once whatever their case, the first spelling kept."""
    seen: dict[str, str] = {}
    for q in queries:
        for t in re.split(r"\s+OR\s+", q):
            t = t.strip().strip('"')
            if t:
                seen.setdefault(t.lower(), t)
    return " OR ".join(f'"{t}"' if " " in t else t for t in seen.values())


def first_integer(text: Column) -> Column:
    """The first run of digits after dropping thousands commas."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"(\d+)", 1).try_cast("long")


def all_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "").try_cast("long")


def labelled_sum(text: Column, label: str = "样本量") -> Column:
    """Sum of the numbers that follow ``label:``."""
    found = F.regexp_extract_all(text, F.lit(label + r"\s*[:：]\s*(\d+)"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def group_sum(text: Column) -> Column:
    """Sum of ``name:n;name:n``."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"[^:;]+:\s*(\d+)"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def iso_date(text: Column, pad_partial: bool = False) -> Column:
    """A date out of ``yyyy-mm-dd``, ``dd/mm/yyyy``, CJK and separated forms; null else.

    Partial dates (a year, a year and month) are padded only where asked.
    """
    t = F.trim(text)
    joined = lambda p, y, m, d: F.try_to_date(F.concat_ws("-", F.regexp_extract(t, p, y), F.lpad(F.regexp_extract(t, p, m), 2, "0"), F.lpad(F.regexp_extract(t, p, d), 2, "0")))
    ymd, dmy, cjk = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})年(\d{1,2})月(\d{1,2})日"
    out = F.when(t.rlike(ymd), joined(ymd, 1, 2, 3)).when(t.rlike(dmy), joined(dmy, 3, 2, 1)).when(t.rlike(cjk), joined(cjk, 1, 2, 3))
    if pad_partial:
        out = out.when(t.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(t, F.lit("-01")))).when(t.rlike(r"^\d{4}$"), F.try_to_date(F.concat(t, F.lit("-01-01"))))
    return out


def ordered_map(text: Column, exact: dict[str, str], partial: Sequence[tuple[str, str]] = (), default: Column | None = None) -> Column:
    """Exact value first, then the first substring in the given order, then the default."""
    low = F.lower(F.trim(text))
    out = default if default is not None else F.lit(None).cast("string")
    for key, value in reversed(list(partial)):
        out = F.when(low.contains(key.lower()), value).otherwise(out)
    for key, value in exact.items():
        out = F.when(low == key.lower(), value).otherwise(out)
    return out


#: Words of a status and its display bucket; an earlier line wins.
STATUS_WORDS = (
    ("other", ("not yet recruiting", "active, not recruiting", "active,not recruiting", "尚未招募", "未开始招募", "不再招募", "招募结束", "招募完成", "招募停止", "招募暂停")),
    ("recruiting", ("recruiting", "招募", "正在进行")),
    ("completed", ("completed", "完成")),
    ("terminated", ("terminat", "终止", "停止")),
)


def status_bucket(label: Column) -> Column:
    """``recruiting``, ``completed``, ``terminated`` or ``other``; not yet or no longer recruiting is other."""
    low = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r",\s+", ", ")
    out = F.lit("other")
    for bucket, words in reversed(STATUS_WORDS):
        hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        out = F.when(hit, bucket).otherwise(out)
    return out


def dated_status(explicit: Column, start: Column, end: Column, as_of: str) -> Column:
    """A status from dates where none is given; never from the clock."""
    day = F.lit(as_of).cast("date")
    return F.coalesce(explicit, F.when(end < day, "Completed").when(start > day, "Not yet recruiting").when(start <= day, "Recruiting"))


def prefixed_id(registry: Column, value: Column) -> Column:
    """An id with its registry's prefix, once."""
    return F.when(F.startswith(F.upper(value), F.upper(registry)), value).otherwise(F.concat(registry, value))


def eligibility_parts(text: Column, limit: int = 2000) -> Column:
    """Struct of inclusion and exclusion criteria, split at the exclusion label."""
    label = r"(?is)exclusion criteria\s*:?|(?is)排除标准\s*[:：]?"
    at = F.regexp_instr(text, F.lit(label))
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?is)^\s*(inclusion criteria|exclusion criteria|入选标准|排除标准)\s*[:：]?", ""), r"^\s+|\s+$", "")
    inclusion = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    exclusion = F.when(at > 0, F.substr(text, at))
    return F.struct(F.substring(strip(inclusion), 1, limit).alias("inclusion"), F.substring(strip(exclusion), 1, limit).alias("exclusion"))


def criteria_items(text: Column) -> Column:
    """Numbered, bulleted or plain lines as items, those of equal first 50 characters once."""
    lines = F.filter(F.transform(F.split(text, r"\n|(?<=[.;])\s+(?=\d+[.)]\s)"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:\d+[.)、]|[-*•·])\s*", ""))), lambda x: x != "")
    heads = lambda ls: F.transform(ls, lambda y: F.substring(y, 1, 50))
    return let(F.array_distinct(lines), lambda ls: let(heads(ls), lambda hs: F.filter(ls, lambda x: F.array_position(hs, F.substring(x, 1, 50)) == F.array_position(ls, x))))


def outcome_parts(text: Column, primary: str = "primary", secondary: str = "secondary") -> Column:
    """Struct of primary and secondary outcomes, by the marker that starts a line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pick = lambda mark: F.transform(F.filter(lines, lambda x: F.lower(x).startswith(mark)), lambda x: F.trim(F.regexp_replace(x, r"^[^:：]*[:：]", "")))
    return F.struct(pick(primary).alias("primary"), pick(secondary).alias("secondary"))


def redact(text: Column) -> Column:
    """Secrets out of log lines."""
    return F.regexp_replace(text, r"(?i)((?:token|secret|password|api[_-]?key)\s*[=:]\s*)\S+", "$1***")


def display_list(text: Column, width: int = 60) -> Column:
    """A JSON list as one line of bounded width."""
    line = F.coalesce(F.array_join(F.from_json(text, "array<string>"), ", "), text)
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)


def title_prefix(code: Column) -> Column:
    """What stands before the first hyphen, without digits at its end."""
    return F.regexp_replace(F.substring_index(code, "-", 1), r"\d+$", "")


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of the lower-cased text."""
    # by the array of characters: a substring of a long UTF-8 text would be searched from its start
    pieces = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))
    return F.when(F.length(text) >= 3, let(F.split(F.lower(text), ""), lambda c: F.array_distinct(pieces(c)))).otherwise(F.array().cast("array<string>"))


def ngram_words(text: Column) -> Column:
    """Lower-cased words between white space, without punctuation around them."""
    return F.filter(F.transform(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()\[\]/\"']+|[.,;:()\[\]/\"']+$", "")), lambda w: w != "")


def word_ngrams(text: Column, low: int, high: int, stop: Sequence[str] = (), longest: int = 60) -> Column:
    """Distinct word n-grams without stop words, of 3 to ``longest`` characters."""

    def grams_of(w: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            span = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
            grams = F.transform(span, _slice_of(w, n))
            if stop:
                grams = F.filter(grams, lambda g: ~F.arrays_overlap(g, F.array(*[F.lit(s) for s in stop])))
            parts.append(F.transform(grams, lambda g: F.array_join(g, " ")))
        return F.array_distinct(F.filter(F.concat(*parts), lambda p: F.length(p).between(3, longest)))

    return let(ngram_words(text), grams_of)


def _slice_of(words: Column, n: int):
    return lambda i: F.slice(words, i, n)
