"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by their patterns and checked: payment cards by the Luhn sum, IBANs
modulo 97, social security numbers and IPv4 addresses by their ranges, dates by the
calendar.  A checked value goes through an unbalanced Feistel network over its own
domain (two residues ``l < a`` and ``r < b``), keyed and tweaked by kind and length,
and is written back into its own format with new check digits.  The map is a
permutation of the domain, so equal values stay equal and different ones differ, in
every document.  E-mail addresses and quoted secrets have no numeric domain: their
keyed digest of 64 bits or more is written in the place of the name or the value.

Everything is DataFrame functions; the network's rounds are an ``aggregate`` over a
sequence, so that no expression is copied.

Cards and IBANs have no sure end: the number or word after them looks like one more
group.  What the other kinds leave is cut into runs of groups, and every stretch of
groups that has the form and passes the check is a candidate.  Stretches in a usual
card layout, and IBANs, come first, then the leftmost, then the longest; none overlap.
In lists of numbers some stretches pass the Luhn sum by chance and are replaced, too.

Dates: the years 1601-1900, 1901-2000 and 2001-2099 are three domains; other years
stay.  With slashes the month comes first where that is a date, else the day; with
dots the day comes first.

Defined results.  Null text stays null, a text without checked values stays as it
is, other columns are kept.  A row per input row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

ROUNDS = 10

# Loops over one class repeat without recursion; those with a fixed left boundary start once a run.
_NAME = r"\p{L}\p{N}._%+\-"
EMAIL = rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@(?!\.)[A-Za-z0-9.\-]*(?<!\.)\.[A-Za-z]{{2,}}"
SECRET = r"(?i:token|secret|api_?key|password)\s*[=:]\s*\"[0-9A-Za-z+/_\-]{16,}+\""
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![\p{L}\p{N}])"
IP = r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])"
DATE = r"(?<![\p{L}\p{N}/.\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\p{L}\p{N}/\-]|\.[0-9])"
SSN = r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])"
PHONE = r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\+[0-9](?:[ .\-]?\(?[0-9]\)?){7,14}(?![\p{L}\p{N}])|\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.\-])[0-9]{3}([.\-])[0-9]{3}\1[0-9]{4}(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}])[0-9](?:[ \-]?[0-9]){12,18}(?![\p{L}\p{N}])"
#: The one group of PHONE's last form is the first of the whole pattern, too.
PATTERN = "|".join([EMAIL, SECRET, IP, DATE, SSN, PHONE])
#: Runs of groups, one separator between two, in which cards and IBANs may stand; the loop never backtracks.
_GROUP = r"[0-9A-Z]++(?![\p{L}\p{N}])"
RUN = rf"(?<![\p{{L}}\p{{N}}])(?=[0-9]|[A-Z]{{2}}[0-9]{{2}})(?=[0-9A-Z \-]{{13}}){_GROUP}(?:[ \-]{_GROUP})*+"
USUAL = r"^(?:[A-Z].*|[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{4,5})$"
MOST_GROUPS, LONGEST = 19, 60


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def feistel(l: Column, r: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """Struct ``(l, r)``: a keyed permutation of the pairs below ``(a, b)``."""

    def value(i: Column, half: Column) -> Column:
        return _number(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256), 1, 15))

    def turn(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(acc["l"] + F.pmod(value(i, acc["r"]), a), a)).otherwise(acc["l"])
        right = F.when(i % 2 == 1, F.pmod(acc["r"] + F.pmod(value(i, acc["l"]), b), b)).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A digit string (2 to 36 long) permuted among those of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    name = F.concat_ws(":", tweak, F.length(digits).cast("string"))
    out = feistel(F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1, rest).cast("long"), _power(half), _power(rest), key, name)
    return let(out, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, one by one, by those of ``digits``."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.struct(F.concat(acc["s"], F.substr(acc["d"], acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"), acc["d"].alias("d"))).otherwise(
            F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"), acc["d"].alias("d"))
        )

    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"), digits.alias("d"))
    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["s"])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum modulo 10 with every second digit from the right doubled."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(acc["k"] % 2 == 1, 2).otherwise(1)
        return F.struct((acc["s"] + F.when(d > 9, d - 9).otherwise(d)).alias("s"), (acc["k"] + 1).alias("k"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("k"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, step, lambda acc: acc["s"] % 10)


def mod97(text: Column) -> Column:
    """An IBAN's letters and digits, its first four moved to the end, modulo 97."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(F.concat(F.substring(text, 5, 99), F.substring(text, 1, 4)), ""), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        payload = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
        checked = let(payload, lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0")))) % 10).cast("string")))
        return F.when(luhn_sum(d) == 0, refill(m, checked))

    return let(digits_of(m), body)


def _iban(m: Column, key: str) -> Column:
    def renumbered(c: Column) -> Column:
        body = F.substring(c, 5, 99)
        digits = digits_of(body)
        fresh = F.when(F.length(digits) >= 2, let(digits, lambda d: refill(body, permute_digits(d, key, F.concat(F.lit("iban"), F.substring(c, 1, 2)))))).otherwise(body)
        return let(fresh, lambda b: F.concat(F.lpad((98 - mod97(F.concat(F.substring(c, 1, 2), F.lit("00"), b))).cast("string"), 2, "0"), digits_of(b)))

    return let(F.replace(m, F.lit(" "), F.lit("")), lambda c: F.when(F.length(c).between(15, 34) & (mod97(c) == 1), refill(m, renumbered(c))))


def _ip(m: Column, key: str) -> Column:
    def body(o: Column) -> Column:
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
        written = let(pair, lambda p: F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string")))
        return F.when(F.array_max(o) <= 255, written)

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), body)


def _ssn(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        area, group, serial = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 2).cast("long"), F.substring(d, 6, 4).cast("long")
        rank = area - 1 - F.when(area > 666, 1).otherwise(0)  # of the 898 areas 001-665 and 667-899
        pair = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))

        def written(p: Column) -> Column:
            back = F.floor(p["l"] / 99) + 1
            back = back + F.when(back >= 666, 1).otherwise(0)
            return F.concat_ws("-", F.lpad(back.cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

        return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), let(pair, written))

    return let(digits_of(m), body)


#: First day, and two factors of the number of days, of each range of years.
_SPANS = (("1601-01-01", "1900-12-31", 276, 397), ("1901-01-01", "2000-12-31", 75, 487), ("2001-01-01", "2099-12-31", 51, 709))


def _day_after(first: str, b: int) -> Callable[[Column], Column]:
    return lambda p: F.date_add(F.lit(first).cast("date"), (p["l"] * b + p["r"]).cast("int"))


def _permuted_date(day: Column, key: str) -> Column:
    out = F.lit(None).cast("date")
    for first, last, a, b in _SPANS:
        x = F.datediff(day, F.lit(first).cast("date"))
        pair = feistel(F.floor(x / b), x % b, F.lit(a), F.lit(b), key, F.lit(f"date{first}"))
        moved = let(pair, _day_after(first, b))
        out = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), moved).otherwise(out)
    return out


def _date(m: Column, key: str) -> Column:
    def of(order: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(order)).cast("date")
        return let(day, lambda d: F.when(d.isNotNull(), F.date_format(_permuted_date(d, key), order)))

    return F.when(m.contains("-"), of("yyyy-MM-dd")).when(m.contains("/"), F.coalesce(of("MM/dd/yyyy"), of("dd/MM/yyyy"))).otherwise(of("dd.MM.yyyy"))


def _phone(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        country = F.substr(d, F.lit(1), F.length(d) - 10)
        return refill(m, F.concat(country, permute_digits(F.right(d, F.lit(10)), key, F.concat(F.lit("phone"), country))))

    return let(digits_of(m), body)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 20), F.lit("@example.org"))


def _secret(m: Column, key: str) -> Column:
    def body(v: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), v), 256)
        fresh = F.substr(F.repeat(digest, F.ceil(F.length(v) / 64).cast("int")), F.lit(1), F.length(v))
        return F.concat(F.substring_index(m, '"', 1), F.lit('"'), fresh, F.lit('"'))

    return let(F.element_at(F.split(m, '"'), 2), body)


_KINDS = (("email", EMAIL, _email), ("secret", SECRET, _secret), ("ip", IP, _ip), ("date", DATE, _date), ("ssn", SSN, _ssn), ("phone", PHONE, _phone))
_NO_KINDS = "array<string>"


def _marked(kind: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.when(v.isNotNull(), F.lit(kind)).alias("kind"), v.alias("value"))


def replacement(m: Column, key: str) -> Column:
    """Struct ``(kind, value)`` of a found value; both null where its check fails."""
    out = F.lit(None)
    for kind, pattern, fresh in reversed(_KINDS):
        made = let(fresh(m, key), _marked(kind))
        out = F.when(m.rlike(whole(pattern)), made).otherwise(out)
    return out


def _passes(c: Column) -> Column:
    """Whether a stretch of groups is a card or an IBAN."""
    plain = F.replace(c, F.lit(" "), F.lit(""))
    card = F.when(c.rlike(whole(CARD)), luhn_sum(digits_of(c)) == 0)
    iban = F.when(c.rlike(whole(IBAN)) & F.length(plain).between(15, 34), mod97(plain) == 1)
    return F.coalesce(card, iban, F.lit(False))


def _run(m: Column, key: str) -> Column:
    """Struct ``(text, kinds)``: a run of groups with its cards and IBANs replaced."""

    def of(groups: Column) -> Column:
        n = F.size(groups)
        join = lambda first, count: F.array_join(F.slice(groups, first, count), "")
        stretch = lambda s, e: F.rtrim(join(s, e - s + 1), F.lit(" -"))

        def ends(s: Column) -> Column:
            each = F.transform(F.sequence(F.least(s + MOST_GROUPS - 1, n), s, F.lit(-1)), lambda e: F.struct(e.alias("e"), stretch(s, e).alias("c")))
            good = F.filter(each, lambda x: (F.length(x["c"]) <= LONGEST) & _passes(x["c"]))
            return F.transform(good, lambda x: F.struct(s.alias("s"), (-x["e"]).alias("less"), x["e"].alias("e"), x["c"].rlike(USUAL).alias("usual")))

        starts = F.filter(F.sequence(F.lit(1), n), lambda k: F.get(groups, k - 1).rlike("^(?:[0-9]|[A-Z]{2}[0-9]{2})"))
        # by start, the longest first: a stretch can only meet the one taken before it
        found = F.flatten(F.transform(starts, ends))
        usual = lambda all_: _apart(F.filter(all_, lambda x: x["usual"]))

        def with_others(all_: Column, first: Column) -> Column:
            rest = F.filter(all_, lambda x: ~x["usual"])
            held = lambda flags: _apart(F.filter(rest, lambda x: ~F.exists(F.slice(flags, x["s"], x["e"] - x["s"] + 1), lambda f: f)))
            return F.array_sort(F.concat(first, let(_taken_flags(first, n), held)))

        def written(taken: Column) -> Column:
            def piece(x: Column, before: Column) -> Column:
                c = stretch(x["s"], x["e"])
                fresh = let(c, lambda v: F.concat(F.when(v.rlike("^[0-9]"), _card(v, key)).otherwise(_iban(v, key)), F.substr(join(x["s"], x["e"] - x["s"] + 1), F.length(v) + 1)))
                return F.concat(join(before + 1, x["s"] - before - 1), fresh)

            last = F.coalesce(F.try_element_at(taken, F.lit(-1))["e"], F.lit(0))
            text = F.concat(F.array_join(F.zip_with(taken, _ends_before(taken), piece), ""), join(last + 1, n - last))
            kinds = F.transform(taken, lambda x: F.when(F.get(groups, x["s"] - 1).rlike("^[0-9]"), "card").otherwise("iban"))
            return F.struct(text.alias("text"), kinds.alias("kinds"))

        return let(found, lambda all_: let(usual(all_), lambda first: let(with_others(all_, first), written)))

    return let(F.regexp_extract_all(m, F.lit(r"[0-9A-Z]+[ \-]?"), F.lit(0)), of)


_SPAN = "struct<s:int,e:int>"


def _apart(stretches: Column) -> Column:
    """Of stretches sorted by start, each that begins after the last one taken."""
    free = lambda acc, x: x["s"] > F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(0))
    return F.aggregate(stretches, F.array().cast(f"array<{_SPAN}>"), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))).otherwise(acc))


def _ends_before(taken: Column) -> Column:
    """For each stretch the end of the one before it, 0 for the first."""
    return F.concat(F.array(F.lit(0)), F.transform(F.slice(taken, 1, F.greatest(F.size(taken) - 1, F.lit(0))), lambda x: x["e"]))


def _taken_flags(taken: Column, n: Column) -> Column:
    """A boolean per group: whether a stretch holds it."""
    run = lambda x, before: F.concat(F.array_repeat(F.lit(False), x["s"] - before - 1), F.array_repeat(F.lit(True), x["e"] - x["s"] + 1))
    last = F.coalesce(F.try_element_at(taken, F.lit(-1))["e"], F.lit(0))
    spans = F.filter(F.zip_with(taken, _ends_before(taken), lambda x, before: F.when(x.isNotNull(), run(x, before))), lambda a: a.isNotNull())
    return F.concat(F.flatten(spans), F.array_repeat(F.lit(False), n - last))


def _numbers(piece: Column, key: str) -> Column:
    """Struct ``(text, kinds)``: a text between other values, with its cards and IBANs replaced."""
    runs = F.transform(F.regexp_extract_all(piece, F.lit(RUN), F.lit(0)), lambda m: _run(m, key))
    text = lambda r: F.array_join(F.zip_with(F.split(piece, RUN, -1), r, lambda a, b: F.concat(a, F.coalesce(b["text"], F.lit("")))), "")
    plain = F.struct(piece.alias("text"), F.array().cast(_NO_KINDS).alias("kinds"))
    return F.when(piece.rlike(RUN), let(runs, lambda r: F.struct(text(r).alias("text"), F.flatten(F.transform(r, lambda x: x["kinds"])).alias("kinds")))).otherwise(plain)


def pseudonyms(docs: DataFrame, key: str, text: str = "text", counts: tuple[str, str] = ("n_replaced", "kinds")) -> DataFrame:
    """``docs`` with checked values replaced, and two columns named by ``counts``.

    They hold the number of replaced values (long) and their kinds (sorted, comma-joined), and
    take the place of columns of these names.
    """
    number, names = counts
    kept = [c for c in docs.columns if c not in counts]
    # the caller's other columns travel in one, so none of their names can clash
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text], F.lit(0)).alias("row"), F.col(text).alias("body"))
    body = F.col("body")
    some = F.coalesce(body.rlike("[0-9]{2}|[0-9]\\.[0-9]|[0-9][ \\-][0-9]|@|\""), F.lit(False))
    found = F.when(some, F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))
    fresh = F.transform("found", lambda m: replacement(m, key))
    between = F.when(some, F.transform(F.split(body, PATTERN, -1), lambda p: _numbers(p, key)))
    written = F.array_join(F.zip_with("between", F.zip_with("found", "fresh", lambda m, r: F.coalesce(r["value"], m)), lambda piece, m: F.concat(piece["text"], F.coalesce(m, F.lit("")))), "")
    others = F.transform(F.filter("fresh", lambda r: r["kind"].isNotNull()), lambda r: r["kind"])
    hits = F.concat(others, F.flatten(F.transform("between", lambda p: p["kinds"])))
    return (
        given.withColumn("found", found)
        .withColumn("fresh", fresh)
        .withColumn("between", between)
        .withColumn("hits", F.coalesce(hits, F.array().cast(_NO_KINDS)))
        .withColumn("n_hits", F.size("hits").cast("long"))
        .withColumn("hidden", F.when(F.col("n_hits") > 0, written).otherwise(body))
        .select(*[F.col("hidden").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept], F.col("n_hits").alias(number), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias(names))
    )
