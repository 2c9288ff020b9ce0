"""Format-preserving Feistel pseudonyms for personal data, in Spark SQL."""

from __future__ import annotations

import secrets as py_secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.llm.shared import free

# What is taken for personal data. A candidate must also be valid.
# Repeats without a bound are possessive: Java walks those in a loop, others on its stack.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
DATE = r"(?<![\d./-])(?:\d{4}([-/])\d{2}\1\d{2}|\d{2}([./-])\d{2}\2\d{4})(?![\d/-]|\.\d)"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+(.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
CARD = r"(?<![A-Za-z0-9.-])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9-]|\.\d)"
ANY = "|".join((EMAIL, DATE, IP, SSN, PHONE, CARD, IBAN))

#: Rounds of every Feistel network.
ROUNDS = 8
#: Dates of these days are permuted among each other.
FIRST_DAY, DAYS, SIDE = "1900-01-01", 73_049, 271  # to 2099-12-31; SIDE * SIDE >= DAYS
#: Valid social security numbers (898 areas, 99 groups, 9,999 serials) and the side of their square.
SSNS, SSN_SIDE = 898 * 99 * 9_999, 29_816


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once: inside a lambda every
    mention of an expression would compute it anew."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _f(key: str, kind: str, parity: Column, half: Column, at: Column, radix: Column) -> Column:
    """The round function: a keyed digest of round and half, then of it and a
    place, as a number below radix. The half is digested once for all places,
    so a text takes work in proportion to its length."""
    return _at(_digest(key, kind, parity, half), at, radix)


def _digest(key: str, kind: str, parity: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), parity.cast("string"), half), 256)


def _at(digest: Column, at: Column, radix: Column) -> Column:
    placed = F.sha2(F.concat_ws("|", digest, at.cast("string")), 256)
    return F.pmod(F.conv(F.substring(placed, 1, 12), 16, 10).cast("long"), radix.cast("long"))


def _alphabet(c: Column) -> tuple[Column, Column]:
    """A character's place in its class and the class's size: digits, lower
    and upper letters; all else stays, as a class of one."""
    code = F.ascii(c)
    kind = lambda a, b: code.between(ord(a), ord(b))
    base = F.when(kind("0", "9"), 48).when(kind("a", "z"), 97).when(kind("A", "Z"), 65).otherwise(code)
    size = F.when(kind("0", "9"), 10).when(kind("a", "z") | kind("A", "Z"), 26).otherwise(1)
    return base, size


def _shift(text: Column, key: str, kind: str, n: Column, by: Column) -> Column:
    """Each character moved within its class by what the round function says of ``by``."""

    def moved(digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            base, size = _alphabet(c)
            return F.when(size == 1, c).otherwise(F.char(base + F.pmod(F.ascii(c) - base + _at(digest, i, size), size)))

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return F.when(F.length(text) == 0, F.lit("")).otherwise(let(_digest(key, kind, n, by), moved))


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of one shape (length and class of
    each character): an alternating Feistel network whose halves shift each
    other, character by character, within the classes. One character alone is
    shifted by a keyed constant."""
    return let(text, lambda t: _network(t, key, kind))


def _network(text: Column, key: str, kind: str) -> Column:
    m = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), m).alias("a"), F.substring(text, m + 1, F.length(text)).alias("b"))

    def step(acc: Column, n: Column) -> Column:
        even = n % 2 == 0
        moved = _shift(F.when(even, acc["a"]).otherwise(acc["b"]), key, kind, n, F.when(even, acc["b"]).otherwise(acc["a"]))
        return F.struct(F.when(even, moved).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(moved).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def feistel_number(n: Column, key: str, kind: str, side: int, below: int, fits: Callable[[Column], Column] | None = None, walks: int = 24) -> Column:
    """A keyed permutation of 0..below-1 inside a square of ``side``: a network
    on quotient and remainder, walked until it is below and, if asked for, one
    of those that ``fits`` holds for (which ``n`` must be itself, so the walk
    comes back at the latest). A step misses with the share of numbers that do
    not fit: 24 steps suffice for sides that fit closely, 96 if half fit."""

    def once(x: Column) -> Column:
        def step(acc: Column, r: Column) -> Column:
            a, b = acc["a"], acc["b"]
            return F.struct(b.alias("a"), F.pmod(a + _f(key, kind, r, b.cast("string"), F.lit(0), F.lit(side)), F.lit(side)).alias("b"))

        start = F.struct(F.floor(x / side).cast("long").alias("a"), F.pmod(x, F.lit(side)).cast("long").alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["a"] * side + acc["b"])

    walked = F.struct(F.lit(False).alias("done"), n.cast("long").alias("x"))

    def walk(acc: Column, _: Column) -> Column:
        moved = F.when(acc["done"], acc["x"]).otherwise(once(acc["x"]))
        # the step is computed once: both fields speak of it
        return let(moved, lambda x: F.struct((acc["done"] | ((x < below) & fits(x) if fits else x < below)).alias("done"), x.alias("x")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), walked, walk, lambda acc: acc["x"])


def luhn(digits: Column) -> Column:
    """Sum of the Luhn scheme, its check digit last."""
    twice = lambda c: F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10).cast("int")
    each = lambda d: F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 1, twice(c)).otherwise(c.cast("int")))
    return F.aggregate(each(digits), F.lit(0), lambda a, x: a + x)


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN without blanks, its first four characters moved to the end."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.pmod(F.when(value(c) >= 10, a * 100).otherwise(a * 10) + value(c), F.lit(97)))


def _refill(shape: Column, chars: Column, pattern: str) -> Column:
    """``shape`` with its characters of ``pattern`` replaced, in order, by ``chars``."""
    return let(chars, lambda c: _filled(shape, c, pattern))


def _filled(shape: Column, chars: Column, pattern: str) -> Column:
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        hit = c.rlike(pattern)
        return F.struct(F.concat(acc["t"], F.when(hit, F.substring(chars, acc["k"], F.lit(1))).otherwise(c)).alias("t"), (acc["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["t"])


def _email(m: Column, key: str) -> Column:
    """Local part and all of the domain but its last label are permuted; case is folded for the link."""
    low = F.lower(m)
    last = F.concat(F.lit("."), F.substring_index(low, ".", -1))
    return F.concat(feistel_text(F.substring(low, F.lit(1), F.length(low) - F.length(last)), key, "email"), last)


def _card(m: Column, key: str) -> Column:
    def changed(digits: Column) -> Column:
        body = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        check = lambda b: F.pmod(10 - F.pmod(luhn(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return F.when(F.pmod(luhn(digits), F.lit(10)) == 0, _refill(m, let(body, lambda b: F.concat(b, check(b))), "[0-9]")).otherwise(m)

    return let(F.regexp_replace(m, "[^0-9]", ""), changed)


def _iban(m: Column, key: str) -> Column:
    def changed(plain: Column) -> Column:
        country = F.substring(plain, 1, 2)
        check = lambda b: F.lpad((98 - mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0")
        new = let(feistel_text(F.substring(plain, F.lit(5), F.length(plain)), key, "iban"), lambda b: F.concat(country, check(b), b))
        return F.when((mod97(plain) == 1) & F.length(plain).between(15, 34), _refill(m, new, "[A-Z0-9]")).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), changed)


def _phone(m: Column, key: str) -> Column:
    """The last ten digits are permuted, country code and format stay."""
    new = lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), feistel_text(F.substring(d, -10, 10), key, "phone"))
    return _refill(m, let(F.regexp_replace(m, "[^0-9]", ""), new), "[0-9]")


def _ssn(m: Column, key: str) -> Column:
    """Valid numbers (area 001-899 but 666, group 01-99, serial 0001-9999) are permuted among each other."""
    valid = ~m.rlike("^(000|666|9)") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    part = lambda at, n: F.substring(m, at, n).cast("long")
    area = part(1, 3) - 1 - F.when(part(1, 3) > 666, 1).otherwise(0)
    number = (area * 99 + part(5, 2) - 1) * 9_999 + part(8, 4) - 1

    def told(x: Column) -> Column:
        a = F.floor(x / (99 * 9_999)) + 1
        return F.format_string("%03d-%02d-%04d", a + F.when(a >= 666, 1).otherwise(0), F.pmod(F.floor(x / 9_999), F.lit(99)) + 1, F.pmod(x, F.lit(9_999)) + 1)

    return F.when(valid, let(feistel_number(number, key, "ssn", SSN_SIDE, SSNS), told)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    part = lambda o, i: F.element_at(o, i).cast("long")
    number = let(F.split(m, r"\."), lambda o: part(o, 1) * 16777216 + part(o, 2) * 65536 + part(o, 3) * 256 + part(o, 4))
    at = lambda x, k: F.pmod(F.floor(x / k), F.lit(256)).cast("string")
    return let(feistel_number(number, key, "ip", 65536, 1 << 32), lambda x: F.concat_ws(".", at(x, 16777216), at(x, 65536), at(x, 256), at(x, 1)))


def _date(m: Column, key: str) -> Column:
    """Year first, or year last with the day first if that is a date, else with
    the month first. All dates are permuted among each other, the same way in
    the first two formats; those of the third, whose days are above 12 (others
    would be read day first), among themselves."""
    sep = F.regexp_extract(m, "([-./])", 1)
    p = F.split(m, "[-./]")
    a, b, c = (F.element_at(p, i) for i in (1, 2, 3))
    first = F.lit(FIRST_DAY).cast("date")
    iso = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")
    late = lambda x: F.dayofmonth(F.date_add(first, x.cast("int"))) > 12
    forms = (
        (F.length(a) == 4, iso(a, b, c), "yyyy MM dd", {"kind": "date"}),
        (F.length(c) == 4, iso(c, b, a), "dd MM yyyy", {"kind": "date"}),
        (F.length(c) == 4, iso(c, a, b), "MM dd yyyy", {"kind": "month-first", "fits": late, "walks": 96}),
    )
    out = m
    for cond, day, order, how in reversed(forms):
        n = F.datediff(day, first)
        new = F.date_add(first, feistel_number(n, key, side=SIDE, below=DAYS, **how).cast("int"))
        out = F.when(cond & n.between(0, DAYS - 1), F.replace(F.date_format(new, order), F.lit(" "), sep)).otherwise(out)
    return out


#: Kinds in order: a candidate takes the first whose pattern is all of it.
KINDS: tuple[tuple[str, str, Callable[[Column, str], Column]], ...] = (
    ("email", r"^[^@]+@.*$", _email),
    ("date", r"^(\d{4}[-/]\d\d[-/]\d\d|\d\d[./-]\d\d[./-]\d{4})$", _date),
    ("ip", r"^\d{1,3}(\.\d{1,3}){3}$", _ip),
    ("ssn", r"^\d{3}-\d{2}-\d{4}$", _ssn),
    ("phone", r"^(\+\d{1,3}[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$", _phone),
    ("card", r"^\d([ -]?\d){12,18}$", _card),
    ("iban", r"^[A-Z]{2}\d{2}( ?[A-Z0-9]){11,30}$", _iban),
)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate; what is not valid stays as it is."""
    out = value
    for _, pattern, of in reversed(KINDS):
        out = F.when(value.rlike(pattern), of(value, key)).otherwise(out)
    return out


KEY = "spark.finweave.pseudonym.secret"


def session_key(spark: SparkSession) -> str:
    """The key that the session's configuration names, so that pseudonyms stay
    the same from run to run; where it names none, a random one that holds for
    this session alone. (Spark hides settings with ``secret`` in their names;
    plans and event logs tell the key, so they need the care of the data.)"""
    if not spark.conf.get(KEY, None):
        spark.conf.set(KEY, py_secrets.token_hex(32))
    return spark.conf.get(KEY)


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with personal data in ``column`` replaced by pseudonyms, and
    n_replaced (long), the number of values replaced. Whoever knows the key can
    undo them; an empty key is refused.

    Emails, dates, IPv4 addresses, card numbers (Luhn), IBANs (mod 97), phone
    numbers and US social security numbers that are valid are permuted within
    their format by a key, so equal values stay equal in all documents and
    checks stay valid. Null texts stay null, with 0; other columns pass
    through. The text between the values is kept to the character. Candidates
    of any length take work in proportion to it.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(column)
    some = text.rlike("[0-9@]")
    found, new = free(docs, "__found"), free(docs, "__new")
    work = docs.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    work = work.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))))
    parts = F.split(text, ANY, -1)
    rest = F.zip_with(new, F.slice(parts, F.lit(2), F.size(new)), lambda a, b: F.concat(a, b))
    done = F.when(F.col(new).isNull(), text).otherwise(F.concat(F.element_at(parts, 1), F.array_join(rest, "")))
    n = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    return work.withColumn("n_replaced", F.when(F.col(new).isNull(), F.lit(0)).otherwise(n).cast("long")).withColumn(column, done).drop(found, new)
