"""A second implementation of every kind of pseudonym, and texts that are hostile to patterns."""

import hashlib
import random
import re
import time
from datetime import date, timedelta

from palimpsest.llm import pii

KEY = "k"


def feistel(left, right, a, b, tweak):
    value = lambda i, h: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{h}".encode()).hexdigest()[:15], 16)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            right = (right + value(i, left) % b) % b
        else:
            left = (left + value(i, right) % a) % a
    return left, right


def digits_moved(d, tweak):
    half = len(d) // 2
    left, right = feistel(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), f"{tweak}:{len(d)}")
    return f"{left:0{half}d}{right:0{len(d) - half}d}"


def put(shape, digits):
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in shape)


def luhn_ok(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def card(m):
    d = re.sub(r"\D", "", m)
    body = digits_moved(d[:-1], "card")
    return put(m, next(body + c for c in "0123456789" if luhn_ok(body + c)))


def mod97(c):
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97


def iban(m):
    c = m.replace(" ", "")
    body = put(c[4:], digits_moved(re.sub(r"\D", "", c[4:]), "iban" + c[:2]))
    check = 98 - mod97(c[:2] + "00" + body)
    return put(m, f"{check:02d}" + re.sub(r"\D", "", body))


def ip(m):
    o = list(map(int, m.split(".")))
    left, right = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    left, right = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    area = left // 99 + 1
    return f"{area + (area >= 666):03d}-{left % 99 + 1:02d}-{right + 1:04d}"


def day(m):
    parts = list(map(int, re.split(r"\D", m)))
    d = date(*parts) if "-" in m else date(parts[2], parts[0], parts[1]) if "/" in m else date(parts[2], parts[1], parts[0])
    first, b = {1: (date(1601, 1, 1), 397), 2: (date(1901, 1, 1), 487), 3: (date(2001, 1, 1), 709)}[1 + (d.year > 1900) + (d.year > 2000)]
    a = {397: 276, 487: 75, 709: 51}[b]
    left, right = feistel(*divmod((d - first).days, b), a, b, f"date{first}")
    out = first + timedelta(days=left * b + right)
    return out.strftime({"-": "%Y-%m-%d", "/": "%m/%d/%Y", ".": "%d.%m.%Y"}[re.search(r"\D", m)[0]])


def phone(m):
    d = re.sub(r"\D", "", m)
    return put(m, d[:-10] + digits_moved(d[-10:], "phone" + d[:-10]))


def email(m):
    return "u" + hashlib.sha256(f"{KEY}|email|{m.lower()}".encode()).hexdigest()[:20] + "@example.org"


def secret(m):
    value = m.split('"')[1]
    h = hashlib.sha256(f"{KEY}|secret|{value}".encode()).hexdigest()
    return f'{m.split(chr(34))[0]}"{(h * (len(value) // 64 + 1))[: len(value)]}"'


def values(rng):
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for _ in range(12):
        body = n(15)
        d = next(body + c for c in "0123456789" if luhn_ok(body + c))
        yield "card", rng.choice([d, " ".join(re.findall("....", d)), "-".join(re.findall("....", d))]), card
        country, body = rng.choice([("DE", n(18)), ("GB", "NWBK" + n(14)), ("NO", n(11))])
        c = f"{country}{98 - mod97(country + '00' + body):02d}{body}"
        yield "iban", rng.choice([c, " ".join(re.findall(".{1,4}", c))]), iban
        yield "ip", ".".join(str(rng.randint(0, 255)) for _ in range(4)), ip
        yield "ssn", f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", ssn
        d = date(1601, 1, 1) + timedelta(days=rng.randint(0, 182000))
        yield "date", d.strftime(rng.choice(["%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y"])), day
        yield "phone", rng.choice(["+1 (499) 555-", "(499) 555-", "499-555-", "+49 499 555 "]) + n(4), phone
        yield "email", rng.choice(["Foo.bar", "a", "x_y+z", "é1"]) + n(3) + "@mail7.exa-mple." + rng.choice(["com", "co.uk"]), email
        yield "secret", rng.choice(["token = ", "API_KEY:", "password="]) + '"' + n(rng.choice([16, 64, 65, 300])) + '"', secret


def test_every_kind_equals_a_second_implementation(spark):
    found = list(values(random.Random(4)))
    df = spark.createDataFrame([(i, f"say {v} and") for i, (_, v, _) in enumerate(found)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonyms(df, KEY).collect()}
    for i, (kind, value, fresh) in enumerate(found):
        assert (got[i]["kinds"], got[i]["n_replaced"]) == (kind, 1), (value, got[i])
        assert got[i]["text"] == f"say {fresh(value)} and", (kind, value)


def test_hostile_texts_end_soon(spark):
    long_secret = "s3" * 10_000
    texts = {
        "labels": "x@" + "a." * 100_000 + "com 12",
        "word": "w" * 1_000_000 + " 12",
        "digits": "1" * 300_000,
        "base64": "Ab9+/" * 200_000 + "@",
        "spaces": "1" + " " * 100_000 + "4111111111111111",
        "hyphens": "1 2 3 4 5 6 " + "-" * 100_000 + " 22",
        "numbers": "12 " * 20_000,
        "cards": "4111 1111 1111 1111 " * 2_000,
        "secret": f'token = "{long_secret}"',
        "two": "a@b.com.x@y.com",
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    got = dict(zip(texts, sorted(pii.pseudonyms(df, KEY).collect())))
    assert time.perf_counter() - began < 120
    assert got["labels"]["kinds"] == "email" and got["labels"]["text"].endswith("@example.org 12")
    for name in ("word", "digits", "base64"):
        assert got[name]["text"] == texts[name]
    assert got["spaces"]["kinds"] == "card" and len(got["spaces"]["text"]) == len(texts["spaces"])
    assert got["cards"]["n_replaced"] == 2_000 and len(set(re.findall(r"(?:\d{4} ){4}", got["cards"]["text"]))) == 1
    assert len(got["secret"]["text"]) == len(texts["secret"]) and long_secret not in got["secret"]["text"]
    assert got["two"]["n_replaced"] >= 1 and "@y.com" not in got["two"]["text"]
