"""Entity resolution: identifiers, candidates, similarity, components, review queue."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from math import ceil, floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.text import trigrams
from .components import connected_components

@dataclass(frozen=True)
class IdFormat:
    """A registry's number: letters, then groups of digits joined by hyphens."""

    letters: str
    groups: tuple[int, ...]
    begins: str = ""  # the first digits
    longer: bool = False  # more digits may follow
    ends: bool = False  # no digit, and no further group of a longer format, may follow
    any_case: bool = False

    def pattern(self) -> str:
        first, *others = self.groups
        body = self.begins + f"[0-9]{{{first - len(self.begins)}{',' * self.longer}}}" * (first > len(self.begins)) + "".join(f"-[0-9]{{{n}}}" for n in others)
        before = "(?<![A-Za-z])" if self.letters else "(?<![A-Za-z0-9])"
        after = "(?![0-9]|-[0-9]{2})" if self.ends and not self.letters and len(self.groups) == 3 else "(?![0-9])" if self.ends else ""
        return f"{'(?i)' * self.any_case}{before}({self.letters}{body}){after}"


#: The published formats of registry numbers, by type.
FORMATS = {
    "NCT": IdFormat("NCT", (8,), any_case=True),
    "CTR": IdFormat("CTR", (8,), begins="20"),
    "ChiCTR": IdFormat("ChiCTR", (8,), longer=True, any_case=True),
    "UTN": IdFormat("U", (4, 4, 4), begins="1111"),
    "CTIS": IdFormat("", (4, 6, 2, 2), begins="20", ends=True),
    "ISRCTN": IdFormat("ISRCTN", (8,), ends=True, any_case=True),
    "EudraCT": IdFormat("", (4, 6, 2), begins="20", ends=True),
}
IDENTIFIERS = {name: f.pattern() for name, f in FORMATS.items()}
#: A sponsor's protocol code: capitals or digits, a hyphen, then a digit and more; it stands alone between these signs.
CODE_ENDS = r"[\s\"'\[\]{}:,<>/]+"
CODE = r"^[A-Z][A-Z0-9]+-[0-9][\w-]{2,}$"
#: Confidence by where an identifier stands, and the least that links without review.
CONFIDENCE = {"own": 1.0, "secondary": 0.95, "text": 0.8, "sponsor": 0.7, "protocol": 0.6}
AUTO = 0.9


def identifier_type(value: Column) -> Column:
    out = F.lit("ProtocolNumber")
    for name, pattern in reversed(IDENTIFIERS.items()):
        out = F.when(F.trim(value).rlike(f"^(?:{pattern})$".replace("^(?:(?i)", "(?i)^(?:")), name).otherwise(out)
    return out


def normal_id(value: Column) -> Column:
    v = F.trim(value)
    return F.when(F.upper(v).startswith("NCT") | F.upper(v).startswith("ISRCTN"), F.upper(v)).otherwise(v)


def _found(text: Column, patterns: dict[str, str], field: str, confidence: float) -> Column:
    each = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)), _identifier(name, field, confidence)) for name, p in patterns.items()]
    return F.concat(*each)


def _identifier(name: str, field: str, confidence: float):
    return lambda v: F.struct(F.lit(name).alias("type"), normal_id(v).alias("value"), F.lit(field).alias("field"), F.lit(confidence).alias("confidence"))


def extract_identifiers(records: DataFrame, record: str, own: str, payload: str, secondary_path: str | None = None) -> DataFrame:
    """``(record, type, value, field, confidence)``: own id, secondary ids, ids in the text, one loose protocol.

    Of one type and value the first source in that order counts.
    """
    own_id = F.when(F.trim(own) != "", F.array(F.struct(identifier_type(F.col(own)).alias("type"), normal_id(F.col(own)).alias("value"), F.lit("own").alias("field"), F.lit(CONFIDENCE["own"]).alias("confidence"))))
    parts = [F.coalesce(own_id, F.array().cast("array<struct<type:string,value:string,field:string,confidence:double>>"))]
    if secondary_path:
        parts.append(_found(F.get_json_object(payload, secondary_path), IDENTIFIERS, "secondary", CONFIDENCE["secondary"]))
    parts.append(_found(F.col(payload), IDENTIFIERS, "text", CONFIDENCE["text"]))
    codes = F.filter(F.split(F.coalesce(F.col(payload), F.lit("")), CODE_ENDS), lambda w: w.rlike(CODE))
    parts.append(F.transform(F.slice(codes, 1, 1), _identifier("ProtocolNumber", "protocol", CONFIDENCE["protocol"])))
    rows = records.select(record, F.posexplode(F.concat(*parts)).alias("__at", "x")).select(record, "__at", "x.*")
    return rows.groupBy(record, "type", "value").agg(F.min_by(F.struct("field", "confidence"), "__at").alias("s")).select(record, "type", "value", "s.*")


#: Where feeds keep identifiers in their payloads, in order; confidence; and the type, where it is sure.
#: Several paths of a step are alternatives; ``keys`` name the identifier inside objects of a list.
PAYLOAD_STEPS = (
    ("who_aggregator", ("$._aggregator._who_source_trial_id",), 1.0, None, ()),
    ("secondary_id", ("$.secondary_ids",), 0.95, None, ("id",)),
    ("ctis_number", ("$._detail.ctNumber", "$._search.ctNumber"), 1.0, "CTIS", ()),
    ("ctis_secondary_id", ("$._detail.authorizedApplication.authorizedPartI.trialDetails.clinicalTrialIdentifiers.secondaryIdentifyingNumbers.additionalRegistries",), 0.95, None, ("registryNumber", "number")),
    ("secondary_id", ("$.protocolSection.identificationModule.secondaryIdInfos", "$.identificationModule.secondaryIdInfos"), 0.95, None, ("secondaryId", "id")),
    ("lead_sponsor", ("$.protocolSection.sponsorCollaboratorsModule.leadSponsor.name", "$.sponsorCollaboratorsModule.leadSponsor.name"), 0.7, "ProtocolNumber", ()),
)
_IDENTIFIERS = "array<struct<type:string,value:string,field:string,confidence:double>>"


def _payload_step(payload: Column, field: str, paths: Sequence[str], confidence: float, kind: str | None, keys: Sequence[str]) -> Column:
    """Identifiers of one step; a list gives one per item, a plain value one."""
    found = F.coalesce(*[F.get_json_object(payload, p) for p in paths])
    items = F.coalesce(F.from_json(found, "array<string>"), F.array(found)) if keys else F.array(found)
    named = F.transform(items, lambda x: F.trim(F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in keys], x)))
    kept = F.filter(named, lambda v: F.coalesce(v != "", F.lit(False)))
    of = lambda v: F.struct((F.lit(kind) if kind else identifier_type(v)).alias("type"), normal_id(v).alias("value"), F.lit(field).alias("field"), F.lit(confidence).alias("confidence"))
    return F.coalesce(F.transform(kept, of), F.array().cast(_IDENTIFIERS))


def record_identifiers(records: DataFrame, record: str, own: str, payload: str) -> DataFrame:
    """``(record, type, value, field, confidence, nth)``: all identifiers of a record, in order of extraction.

    The own id, the payload's steps, known formats anywhere in the payload, and a loose protocol code
    if no step gave one.  Of one type and value the first counts.
    """
    none = F.array().cast(_IDENTIFIERS)
    mine = F.array(F.struct(identifier_type(F.col(own)).alias("type"), normal_id(F.col(own)).alias("value"), F.lit("own").alias("field"), F.lit(CONFIDENCE["own"]).alias("confidence")))
    steps = F.concat(F.when(F.trim(own) != "", mine).otherwise(none), *[_payload_step(F.col(payload), *step) for step in PAYLOAD_STEPS], _found(F.col(payload), IDENTIFIERS, "raw_payload", CONFIDENCE["text"]))
    codes = F.filter(F.split(F.coalesce(F.col(payload), F.lit("")), CODE_ENDS), lambda w: w.rlike(CODE))
    loose = F.transform(F.slice(codes, 1, 1), _identifier("ProtocolNumber", "raw_payload", CONFIDENCE["protocol"]))
    found = records.select(record, steps.alias("__ids"), loose.alias("__loose")).select(record, F.when(F.exists("__ids", lambda x: x["type"] == "ProtocolNumber"), F.col("__ids")).otherwise(F.concat("__ids", "__loose")).alias("__ids"))
    rows = found.select(record, F.posexplode("__ids").alias("nth", "x")).select(record, "nth", "x.*")
    first = rows.groupBy(record, "type", "value").agg(F.min("nth").alias("nth"), F.min_by(F.struct("field", "confidence"), "nth").alias("s"))
    return first.select(record, "type", "value", "s.field", "s.confidence", "nth")


def identifier_pairs(identifiers: DataFrame, record: str) -> DataFrame:
    """``(a, b, confidence)``: each record of an identifier with the identifier's smallest record.

    A star per identifier, so a popular identifier gives as many rows as it has records.
    """
    hubs = identifiers.groupBy("type", "value").agg(F.min(record).alias("b"), F.count_distinct(record).alias("n")).filter("n > 1")
    return identifiers.join(hubs, ["type", "value"]).filter(F.col(record) > F.col("b")).groupBy(F.col(record).alias("a"), "b").agg(F.max("confidence").alias("confidence"))


def resolve_entities(identifiers: DataFrame, record: str) -> DataFrame:
    """``(record, master)``: components over identifiers that link without review.

    The master is the smallest record of the component, whatever the order of arrival.
    """
    strong = identifiers.filter(F.col("confidence") >= AUTO)
    links = identifier_pairs(strong, record)
    found = connected_components(links, "a", "b").withColumnsRenamed({"node": record, "component": "master"})
    return identifiers.select(record).distinct().join(found, record, "left").select(record, F.coalesce("master", record).alias("master"))


def review_queue(identifiers: DataFrame, masters: DataFrame, record: str) -> DataFrame:
    """``(record, master, confidence)``: possible matches of different masters, never linked by themselves."""
    weak = identifier_pairs(identifiers.filter(F.col("confidence") < AUTO), record)
    m = masters.select(F.col(record).alias("r"), "master")
    a = weak.join(m.withColumnsRenamed({"r": "a", "master": "own"}), "a").join(m.withColumnsRenamed({"r": "b"}), "b")
    return a.filter("own <> master").groupBy(F.col("a").alias(record), "master").agg(F.max("confidence").alias("confidence"))


#: Identifier types that link without review whatever their confidence.
REGISTRY_TYPES = ("NCT", "ChiCTR", "CTR", "CTIS", "ISRCTN", "EudraCT")


def master_matches(identifiers: DataFrame, masters: DataFrame, record: str, titles: DataFrame | None = None) -> DataFrame:
    """``(record, master, method, confidence, status, rank)``: the masters a record may belong to.

    ``identifiers`` (record, type, value, confidence, nth) in order of extraction, ``masters``
    (record, master).  A master is reached through an identifier that another record of it holds;
    of several the first counts.  Registry numbers and confidences from ``AUTO`` on are
    AUTO_CONFIRMED.  ``titles`` (a, b, ratio) serve records without such a match only.  The confirmed
    come first, then by confidence, then by master.  Records of equal identifiers are one profile,
    which is matched and ranked once.
    """
    # the only holder of an identifier may not reach its master by it, and is a profile of its own
    held = identifiers.join(masters, record).groupBy("type", "value", "master").agg(F.min(record).alias("first"), F.max(record).alias("last"))
    sole = held.filter("first = last").select(F.col("first").alias(record)).distinct().withColumn("own", F.col(record))
    lists = identifiers.filter(F.col(record).isNotNull()).groupBy(record).agg(F.array_sort(F.collect_list(F.struct("nth", "type", "value", "confidence"))).alias("ids"))
    # 256 bits: no two lists have one name
    named = lists.join(sole, record, "left").withColumn("profile", F.unhex(F.sha2(F.to_json(F.struct("own", "ids")), 256)))
    profiles = named.select("profile", "own", "ids").distinct().select("profile", "own", F.explode("ids").alias("x")).select("profile", "own", "x.*")
    asked = profiles.join(held, ["type", "value"]).filter(F.col("own").isNull() | (F.col("first") != F.col("last")) | (F.col("first") != F.col("own")))
    auto = F.col("type").isin(*REGISTRY_TYPES) | (F.col("confidence") >= AUTO)
    by_id = asked.groupBy("profile", "master").agg(F.min_by(F.struct(F.concat(F.lit("identifier_match "), F.col("type")).alias("method"), "confidence", F.when(auto, "AUTO_CONFIRMED").otherwise("POSSIBLE").alias("status")), F.struct("nth", "type", "value")).alias("m"))
    by_profile = by_id.select("profile", "master", "m.*")
    order = ["status", F.desc("confidence"), "master"]
    if titles is None:
        by_profile = by_profile.withColumn("rank", F.row_number().over(Window.partitionBy("profile").orderBy(*order)))
    found = named.select(record, "profile").join(by_profile, "profile").drop("profile")
    if titles is not None:
        sure = found.filter("status = 'AUTO_CONFIRMED'").select(record).distinct()
        either = titles.select(F.col("a").alias(record), F.col("b").alias("__other"), "ratio").unionByName(titles.select(F.col("b").alias(record), F.col("a").alias("__other"), "ratio"))
        named = either.join(masters.select(F.col(record).alias("__other"), "master"), "__other").groupBy(record, "master").agg(F.max("ratio").alias("confidence"))
        more = named.join(sure, record, "left_anti").join(found.select(record, "master"), [record, "master"], "left_anti")
        found = found.unionByName(more.select(record, "master", F.lit("title_similarity").alias("method"), F.round("confidence", 4).alias("confidence"), F.lit("POSSIBLE").alias("status")))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(record).orderBy(*order)))
    return found


def decide(queue: DataFrame, decisions: DataFrame, key: Sequence[str]) -> DataFrame:
    """The queue after decisions: approval only of pending items, rejection of any."""
    d = decisions.select(*key, F.col("decision").alias("__d"))
    state = F.when((F.col("__d") == "approve") & (F.col("state") == "pending"), "approved").when(F.col("__d") == "reject", "rejected").otherwise(F.col("state"))
    return queue.join(d, list(key), "left").withColumn("state", state).drop("__d")


def trigram_candidates(texts: DataFrame, key: str, text: str, least: int, k: int = 200) -> DataFrame:
    """``(a, b, shared)``: pairs of ``a > b`` that share at least ``least`` trigrams, the best ``k`` per ``a``.

    A pair with ``least`` common trigrams out of at most ``g`` keeps one among the
    ``g - least + 1`` rarest of either side (prefix filter), so only those are joined;
    the count itself is over all trigrams.
    """
    grams = texts.select(key, trigrams(F.col(text)).alias("g"))
    long = grams.select(key, F.size("g").alias("n"), F.explode("g").alias("gram"))
    df = long.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = long.join(df, "gram").withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("df", "gram")))
    prefix = ranked.filter(F.col("nth") <= F.col("n") - least + 1).select(key, "gram")
    a, b = prefix.withColumnRenamed(key, "a"), prefix.withColumnRenamed(key, "b")
    pairs = a.join(b, "gram").filter("a > b").select("a", "b").distinct()
    sets = grams.filter(F.size("g") >= least)
    full = pairs.join(sets.select(F.col(key).alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col(key).alias("b"), F.col("g").alias("gb")), "b")
    shared = full.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("shared")).filter(F.col("shared") >= least)
    return shared.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))).filter(F.col("rank") <= k).drop("rank")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two lower-cased texts; not symmetric, so the order is the caller's."""
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)])


@F.pandas_udf(StringType())
def _lowered(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.lower())


@F.pandas_udf(DoubleType())
def _either_ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The larger ratio of both orders, null if it is below ``least``; cheap upper bounds come first."""

    def one(x: str | None, y: str | None, floor_: float) -> float | None:
        if x is None or y is None:
            return None
        m = SequenceMatcher(None, x, y)
        if m.real_quick_ratio() < floor_ or m.quick_ratio() < floor_:
            return None
        best = max(m.ratio(), SequenceMatcher(None, y, x).ratio())
        return best if best >= floor_ else None

    return pd.Series([one(x, y, z) for x, y, z in zip(a, b, least)], dtype="float64")


def _partners(n: int, ratio: float) -> range:
    """Lengths that a text may have to reach the ratio with one of length ``n``."""
    return range(ceil(n * ratio / (2 - ratio) - 1e-9), floor(n * (2 - ratio) / ratio + 1e-9) + 1)


def shared_bound(n: int, m: int, ratio: float, q: int) -> int:
    """Least number of common ``q``-grams, repeats counted, of texts of ``n`` and ``m`` characters that reach the ratio.

    ``k`` matched characters leave ``u = n + m - 2k`` others, hence at most ``u + 1`` blocks,
    and a block of ``x`` characters has ``x - q + 1`` grams.
    """
    k = ceil(ratio * (n + m) / 2 - 1e-9)
    return k - (q - 1) * (n + m - 2 * k + 1)


@lru_cache(maxsize=65536)
def _least_shared(n: int, ratio: float, q: int) -> int:
    return min((shared_bound(n, m, ratio, q) for m in _partners(n, ratio)), default=1)


def _short_below(ratio: float) -> int | None:
    """From this length on, two texts that reach the ratio share a pair of characters; None if that is never sure."""
    if 1.5 * ratio - 1 <= 1e-6:
        return None
    top = ceil(2 / (1.5 * ratio - 1)) + 1
    return max([n + 1 for n in range(1, top) for m in _partners(n, ratio) if shared_bound(n, m, ratio, 2) < 1], default=0)


def _gram_pairs(texts: DataFrame, ratio: float, q: int) -> DataFrame:
    """``(a, b)`` of texts ``(rep, t)`` that share a gram within the prefixes that the bound leaves."""

    def numbered(t: str | None) -> list[str]:
        t = t or ""
        seen, out = Counter(), []
        for i in range(len(t) - q + 1):
            g = t[i : i + q]
            out.append(f"{seen[g]}:{g}")
            seen[g] += 1
        return out

    @F.pandas_udf("array<string>")
    def grams(text: pd.Series) -> pd.Series:
        return text.map(numbered)

    @F.pandas_udf("struct<n:int,low:int,high:int,keep:int>")
    def sizes(text: pd.Series) -> pd.DataFrame:
        n = [len(x or "") for x in text]  # the optimizer may ask before nulls are filtered
        reach = [_partners(x, ratio) for x in n]
        return pd.DataFrame({"n": n, "low": [r.start for r in reach], "high": [r.stop - 1 for r in reach], "keep": [x - q + 2 - _least_shared(x, ratio, q) for x in n]})

    long = texts.select("rep", sizes("t").alias("x"), grams("t").alias("g")).select("rep", "x.*", F.explode("g").alias("gram"))
    df = long.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = long.join(df, "gram").withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("df", "gram")))
    prefix = ranked.filter(F.col("nth") <= F.col("keep"))
    a = prefix.select("gram", F.col("rep").alias("a"), "low", "high")
    b = prefix.select("gram", F.col("rep").alias("b"), "n")
    return a.join(b, "gram").filter("a > b AND n BETWEEN low AND high").select("a", "b").distinct()


def _title_pairs(texts: DataFrame, ratio: float) -> DataFrame:
    """``(a, b)`` of texts ``(rep, t)``: every pair that can reach the ratio is among them.

    Texts that are long enough meet by pairs of characters, the others by single characters.
    """
    short = _short_below(ratio)
    if short is None:
        return _gram_pairs(texts, ratio, 1)
    found = _gram_pairs(texts.filter(F.length("t") >= short), ratio, 2)
    if short:
        found = found.union(_gram_pairs(texts.filter(F.length("t") < _partners(short, ratio).stop), ratio, 1)).distinct()
    return found


def similar_titles(texts: DataFrame, key: str, text: str, ratio: float = 0.85, least: int = 0) -> DataFrame:
    """``(a, b, ratio)``: whole texts that are similar enough, without a limit on the number of partners.

    Texts that are equal in lower case are one group, named by its smallest key: each other member
    is linked with that key at 1.0, and groups are linked by their keys (``a > b``), so that a group
    of ``n`` copies gives ``n - 1`` rows.  The ratio of two groups is the larger of both orders.
    Candidates follow from the ratio (``shared_bound``); ``least`` asks for so many common trigrams
    on top.  Null texts link with nothing.
    """
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("a"), _lowered(F.col(text).cast("string")).alias("t"))
    groups = rows.groupBy("t").agg(F.min("a").alias("rep"))
    members = rows.join(groups, "t").filter("a > rep").select("a", F.col("rep").alias("b"), F.lit(1.0).alias("ratio"))
    left, right = groups.select(F.col("rep").alias("a"), F.col("t").alias("ta")), groups.select(F.col("rep").alias("b"), F.col("t").alias("tb"))
    pairs = _title_pairs(groups, ratio).join(left, "a").join(right, "b")
    if least > 0:
        pairs = pairs.filter(F.size(F.array_intersect(trigrams(F.col("ta")), trigrams(F.col("tb")))) >= least)
    links = pairs.select("a", "b", _either_ratio("ta", "tb", F.lit(float(ratio))).alias("ratio")).filter("ratio IS NOT NULL AND NOT isnan(ratio)")
    return members.unionByName(links)
