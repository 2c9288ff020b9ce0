"""The pseudonym query against a plain version, value by value."""

from __future__ import annotations

import hashlib
import re
from datetime import date, timedelta

import pytest

from finweave.llm import pii, queries

SF = "/root/testdata/sf0.001"
KEY = "a key of the tests"


def sha(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def f(kind, n, half, at, radix):
    return int(sha(sha(KEY, kind, str(n), half), str(at))[:12], 16) % radix


def shift(text, kind, n, by):
    out = []
    for i, c in enumerate(text):
        for lo, size in (("0", 10), ("a", 26), ("A", 26)):
            if ord(lo) <= ord(c) < ord(lo) + size:
                c = chr(ord(lo) + (ord(c) - ord(lo) + f(kind, n, by, i, size)) % size)
                break
        out.append(c)
    return "".join(out)


def network(text, kind):
    m = -(-len(text) // 2)
    a, b = text[:m], text[m:]
    for n in range(pii.ROUNDS):
        if n % 2 == 0:
            a = shift(a, kind, n, b)
        else:
            b = shift(b, kind, n, a)
    return a + b


def number(x, kind, side, below, fits=lambda x: True):
    while True:
        a, b = divmod(x, side)
        for n in range(pii.ROUNDS):
            a, b = b, (a + f(kind, n, str(b), 0, side)) % side
        x = a * side + b
        if x < below and fits(x):
            return x


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def refill(shape, chars, pattern):
    it = iter(chars)
    return "".join(next(it) if re.fullmatch(pattern, c) else c for c in shape)


def day(y, m, d):
    try:
        got = (date(int(y), int(m), int(d)) - date(1900, 1, 1)).days
    except ValueError:
        return None
    return got if 0 <= got < pii.DAYS else None


def replaced(m):
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        low = m.lower()
        body, _, last = low.rpartition(".")
        return network(body, "email") + "." + last
    if re.fullmatch(r"\d{4}[-/]\d\d[-/]\d\d|\d\d[./-]\d\d[./-]\d{4}", m):
        sep, p = re.search("[-./]", m)[0], re.split("[-./]", m)
        forms = [((0, 1, 2), ("y", "m", "d"))] if len(p[0]) == 4 else [((2, 1, 0), ("d", "m", "y")), ((2, 0, 1), ("m", "d", "y"))]
        for at, order in forms:
            n = day(*(p[i] for i in at))
            if n is not None:
                late = order == ("m", "d", "y")
                start = date(1900, 1, 1)
                x = number(n, "month-first", pii.SIDE, pii.DAYS, lambda x: (start + timedelta(x)).day > 12) if late else number(n, "date", pii.SIDE, pii.DAYS)  # noqa: B023
                new = start + timedelta(x)
                return sep.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[x] for x in order)
        return m
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        x = number(int.from_bytes(bytes(map(int, m.split("."))), "big"), "ip", 65536, 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        bad = m.startswith(("000", "666", "9")) or m[4:6] == "00" or m[7:] == "0000"
        if bad:
            return m
        areas = [a for a in range(1, 900) if a != 666]
        x = number((areas.index(int(m[:3])) * 99 + int(m[4:6]) - 1) * 9999 + int(m[7:]) - 1, "ssn", pii.SSN_SIDE, pii.SSNS)
        return f"{areas[x // (99 * 9999)]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"
    if re.fullmatch(r"(\+\d{1,3}[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", m):
        return refill(m, digits[:-10] + network(digits[-10:], "phone"), "[0-9]")
    if re.fullmatch(r"\d([ -]?\d){12,18}", m):
        body = network(digits[:-1], "card")
        return refill(m, body + str(-luhn(body + "0") % 10), "[0-9]") if luhn(digits) == 0 else m
    plain = m.replace(" ", "")
    if mod97(plain) == 1 and 15 <= len(plain) <= 34:
        body = network(plain[4:], "iban")
        return refill(m, plain[:2] + f"{98 - mod97(plain[:2] + '00' + body):02d}" + body, "[A-Z0-9]")
    return m


def brute(text):
    n = 0

    def one(hit):
        nonlocal n
        new = replaced(hit[0])
        n += new != hit[0]
        return new

    return re.sub(pii.ANY, one, text, flags=re.A) if text is not None else None, n


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    spark.conf.set(pii.KEY, KEY)
    got = queries.op7_pseudonyms(spark, SF).collect()
    assert len(got) == len(texts)
    found = 0
    for r in got:
        want = brute(texts[r["doc_id"]])
        assert (r["text"], r["n_replaced"]) == want, r["doc_id"]
        found += want[1]
    assert found > 5


@pytest.mark.parametrize(
    "text",
    [
        "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000.",
        "on 2024-02-29, 12/25/2020, 31.01.1999, 99.99.1999 and 1850-01-01",
        "a@b.co x_Y.z%+-9@Mail-7.Example.co.uk",
        "123-45-6789 666-12-3456 5555555555554444 6011 1111 1111 1117",
        "0.0.0.0 255.255.255.255 1.2.3 1.2.3.4.5",
    ],
)
def test_kinds_equal_brute_force(spark, text):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.pseudonymise(d, KEY).first()
    assert (r["text"], r["n_replaced"]) == brute(text)


#: A candidate of every kind that goes on and on, or nearly is one.
LONG = ["a@b" + ".b" * 20_000, "a" * 30_000 + "@b.co", "a@" + "b" * 30_000 + ".co", "a@" * 20_000, "1 " * 20_000, "12-" * 20_000, "1." * 20_000, "DE89" + " 3704" * 8_000, "A1" * 20_000, "123-45-" * 8_000, "(555) " * 8_000, "2024-01-" * 5_000]


@pytest.mark.parametrize("text", LONG, ids=lambda t: t[:8])
def test_long_candidates(spark, text):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.pseudonymise(d, KEY).first()
    assert (r["text"], r["n_replaced"]) == brute(text)
    assert len(r["text"]) == len(text)


def test_dates_are_permuted_within_their_format(spark):
    days = [date(1990, 1, 1) + timedelta(i) for i in range(13_000)]
    texts = {f"{d:%d/%m/%Y}" for d in days} | {f"{d:%m/%d/%Y}" for d in days if d.day > 12}
    got = {r["text"] for r in pii.pseudonymise(spark.createDataFrame([(x,) for x in texts], "text string"), KEY).collect()}
    assert len(got) == len(texts) > 20_000
    late = {f"{d:%m/%d/%Y}" for d in days if d.day > 12}
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(x,) for x in late], "text string"), KEY).collect()]
    assert all(int(x[3:5]) > 12 for x in out)


def test_social_security_numbers_stay_valid(spark):
    texts = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 2, 665, 667, 899) for g in (1, 50, 99) for s in range(1, 9_999, 61)]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(x,) for x in texts], "text string"), KEY).collect()]
    assert len(set(got)) == len(texts)
    assert all(1 <= int(x[:3]) <= 899 and x[:3] != "666" and x[4:6] != "00" and x[7:] != "0000" and re.fullmatch(r"\d{3}-\d\d-\d{4}", x) for x in got)


def test_a_key_is_needed(spark):
    d = spark.createDataFrame([("a@b.co", 1, 2)], "text string, __found int, __new int")
    with pytest.raises(ValueError):
        pii.pseudonymise(d, "")
    with pytest.raises(TypeError):
        pii.pseudonymise(d)
    one, two = (pii.pseudonymise(d, k).first() for k in ("k1", "k2"))
    assert one["text"] != two["text"] and one["__found"] == 1 and one["__new"] == 2
    spark.conf.unset(pii.KEY)
    assert pii.session_key(spark) == pii.session_key(spark) != ""
