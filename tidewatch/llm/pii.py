"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Numbers and dates that pass their validation are permuted by a keyed Feistel network within their own
format: a card number becomes another number that passes the Luhn test, a phone number another
number of the numbering plan, an address another address, a date another date written alike. A permutation
keeps values apart and equal values equal, so documents stay linked. Mail names and secrets
go through a Feistel network over their characters, each within its own class.

All of it is one projection: a text is cut at the matches of one pattern, the matches are
mapped, and the parts are joined again. No rows move.

Defined results: a null text stays null, a text without matches stays as it is, matches that
fail validation stay as they are, repeated rows give repeated rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "tidewatch-example-key"  # a parameter; production passes its own

# names, domains and secrets have no upper length; possessive quantifiers keep the search linear
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ACCESS = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = r"(?i:password|passwd|secret|token|api_?key)[ ]?[=:][ ]?\"?[A-Za-z0-9+/_-]{8,}+(?:\.[A-Za-z0-9+/_-]{8,}+)*+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?<![vV])(?<!(?i:version|release|build)[ =:])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+(])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])"
ABROAD = r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
ANY = "|".join((EMAIL, ACCESS, SECRET, IBAN, IP, DATE, SSN, PHONE, CARD, ABROAD))
HINT = r"[0-9@=:]"

#: Dates move within blocks of so many days, counted from EPOCH either way, dealt as a product of two numbers. What is left of
#: the years 1 to 9999 before the first whole block and behind the last has products of its own, so no date leaves them.
EPOCH, BLOCK = "1900-01-01", (270, 270)
FIRST_DAY, LAST_DAY, FIRST, LAST = -693_595, 2_958_463, (5, 7499), (32, 1327)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _mix(key: str, tweak: str, step: Column, half: Column, modulus: Column | int) -> Column:
    """The round function: a keyed digest of the other half as a number below ``modulus``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), step.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def feistel(x: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """A keyed permutation of 0 .. a*b-1."""
    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        left = F.pmod(acc["l"] + _mix(key, tweak, i * 2, acc["r"], F.lit(a)), F.lit(a))
        return let(left, lambda v: F.struct(v.alias("l"), F.pmod(acc["r"] + _mix(key, tweak, i * 2 + 1, v, F.lit(b)), F.lit(b)).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: acc["l"] * b + acc["r"])


def feistel_digits(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings of as many digits (18 at most)."""

    def of(n: int) -> Column:
        a, b = 10 ** (n - n // 2), 10 ** (n // 2)
        return F.lpad(feistel(digits.cast("long"), a, b, key, f"{tweak}{n}").cast("string"), n, "0")

    size = F.length(digits)
    return reduce(lambda rest, n: F.when(size == n, of(n)).otherwise(rest), range(1, 19), digits)


def _shifted(text: Column, digest: Column) -> Column:
    """Every letter and digit moved within its class by a number that the digest and the place give."""

    def one(c: Column, i: Column) -> Column:
        by = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", digest, i.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(2340)).cast("int")
        code = F.ascii(c)

        def turn(first: str, last: str, radix: int) -> Column:
            return F.when(c.between(first, last) & (F.length(c) == 1), F.char(F.lit(ord(first)) + F.pmod(code - ord(first) + by, F.lit(radix))))

        return F.coalesce(turn("0", "9", 10), turn("A", "Z", 26), turn("a", "z", 26), c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def feistel_text(text: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the strings with letters, digits and other characters in the same places."""
    half = F.floor(F.length(text) / 2).cast("int")

    def digest(i: Column, part: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), part), 256)

    left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    start = F.struct(left.alias("l"), right.alias("r"), digest(F.lit(0), right).alias("d"))

    def step(acc: Column, i: Column) -> Column:
        return let(_shifted(acc["l"], acc["d"]), lambda v: F.struct(acc["r"].alias("l"), v.alias("r"), digest(i, v).alias("d")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _luhn(digits: Column) -> Column:
    """The sum that a valid number has as a multiple of ten."""
    ordered = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(ordered, lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + v)


def _spread(shape: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``shape``, which has as many."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("s"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9") & (F.length(c) == 1)
        return F.struct((acc["n"] + is_digit.cast("int")).alias("n"), F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["s"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    """First digit kept, the check digit made anew; without a valid check digit not a card."""

    def of(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), feistel_digits(F.substring(d, F.lit(2), n - 2), key, "card"))
        whole = let(body, lambda v: F.concat(v, F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(v, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(F.pmod(_luhn(d), F.lit(10)) == 0, _spread(m, whole))

    return let(_digits(m), of)


def _ten(ten: Column, key: str) -> Column:
    """Ten digits of the numbering plan (area and exchange begin with 2 to 9) as ten digits of the plan, others as others:
    two permutations, of two sets that don't meet."""
    n = ten.cast("long")
    area, exchange, line = F.floor(n / 10_000_000), F.pmod(F.floor(n / 10_000), F.lit(1000)), F.pmod(n, F.lit(10_000))
    whole = lambda a, e, x: (a * 10_000_000 + e * 10_000 + x).cast("long")
    inside = let(
        feistel(((area - 200) * 800 + (exchange - 200)) * 10_000 + line, 80_000, 80_000, key, "phone"),
        lambda y: whole(F.floor(y / 8_000_000) + 200, F.pmod(F.floor(y / 10_000), F.lit(800)) + 200, F.pmod(y, F.lit(10_000))),
    )
    # areas below 200 first, then exchanges below 200 of the other areas: 3.6e9 numbers
    low = 200 * 10_000_000
    outside = let(
        feistel(F.when(area < 200, n).otherwise(low + ((area - 200) * 200 + exchange) * 10_000 + line), 60_000, 60_000, key, "phone-other"),
        lambda y: F.when(y < low, y).otherwise(let(y - low, lambda z: whole(F.floor(z / 2_000_000) + 200, F.pmod(F.floor(z / 10_000), F.lit(200)), F.pmod(z, F.lit(10_000))))),
    )
    return F.lpad(F.when((area >= 200) & (exchange >= 200), inside).otherwise(outside).cast("string"), 10, "0")


def _phone(m: Column, key: str) -> Column:
    """The ten digits permuted; a leading 1 stays."""

    def of(d: Column) -> Column:
        return _spread(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _ten(F.substring(d, -10, 10), key)))

    return let(_digits(m), of)


def _abroad(m: Column, key: str) -> Column:
    """International numbers: 7 to 15 digits; the first two, of the country, are kept. Those of the numbering plan are its phones."""

    def of(d: Column) -> Column:
        n = F.length(d)
        other = F.concat(F.substring(d, 1, 2), feistel_digits(F.substring(d, F.lit(3), n - 2), key, "abroad"))
        plan = F.concat(F.lit("1"), _ten(F.substring(d, 2, 10), key))
        return F.when(n.between(7, 15), _spread(m, F.when((n == 11) & d.startswith("1"), plan).otherwise(other)))

    return let(_digits(m), of)


def _ip(m: Column, key: str) -> Column:
    """Four numbers to 255, written without leading zeros."""

    def of(p: Column) -> Column:
        number = F.aggregate(p, F.lit(0).cast("long"), lambda s, v: s * 256 + v.cast("long"))
        made = let(feistel(number, 65536, 65536, key, "ip"), lambda y: F.concat_ws(".", *[F.pmod(F.floor(y / F.lit(256**k)), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]))
        return F.when(~F.exists(p, lambda v: (v.cast("int") > 255) | (v.cast("int").cast("string") != v)), made)

    return let(F.split(m, r"\."), of)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    made = let(
        feistel((index * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn"),
        lambda y: let(
            F.floor(y / F.lit(99 * 9999)),
            lambda i: F.concat_ws(
                "-",
                F.lpad(F.when(i >= 665, i + 2).otherwise(i + 1).cast("string"), 3, "0"),
                F.lpad((F.pmod(F.floor(y / 9999), F.lit(99)) + 1).cast("string"), 2, "0"),
                F.lpad((F.pmod(y, F.lit(9999)) + 1).cast("string"), 4, "0"),
            ),
        ),
    )
    return F.when(valid, made)


def _moved(day: Column, key: str, inside) -> Column:
    """Another date of the same block; where ``inside`` is asked for, the first that has it (a cycle walk)."""
    size = BLOCK[0] * BLOCK[1]
    first, last = FIRST_DAY + FIRST[0] * FIRST[1], LAST_DAY + 1 - LAST[0] * LAST[1]

    def once(d: Column) -> Column:
        def of(n: Column) -> Column:
            return (
                F.when(n < first, FIRST_DAY + feistel(n - FIRST_DAY, *FIRST, key, "date-first"))
                .when(n >= last, last + feistel(n - last, *LAST, key, "date-last"))
                .otherwise(F.floor(n / F.lit(size)) * size + feistel(F.pmod(n, F.lit(size)), *BLOCK, key, "date"))
            )

        return F.date_add(F.to_date(F.lit(EPOCH)), let(F.datediff(d, F.to_date(F.lit(EPOCH))).cast("long"), of).cast("int"))

    if inside is None:
        return once(day)
    start = F.struct(once(day).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, lambda acc, _: F.when(inside(acc["d"]), acc).otherwise(F.struct(once(acc["d"]).alias("d"))), lambda acc: acc["d"])


def _date(m: Column, key: str) -> Column:
    """2001-12-31; 12/31/2001, or 31/12/2001 where that alone is a date; 31.12.2001."""

    def as_written(form: str, inside=None) -> Column:
        return let(F.try_to_timestamp(m, F.lit(form)).cast("date"), lambda d: F.when(F.year(d) >= 1, F.date_format(_moved(d, key, inside), form)))

    return F.coalesce(as_written("yyyy-MM-dd"), as_written("MM/dd/yyyy"), as_written("dd/MM/yyyy", lambda d: F.dayofmonth(d) > 12), as_written("dd.MM.yyyy"))


def _mod97(text: Column) -> Column:
    values = F.transform(F.split(text, ""), lambda c: F.when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string")))
    return F.aggregate(F.split(F.array_join(values, ""), ""), F.lit(0), lambda s, c: F.pmod(s * 10 + c.cast("int"), F.lit(97)))


def _regrouped(shape: Column, made: Column) -> Column:
    """``made`` with blanks where ``shape`` has them: both are in groups of four, or in none."""
    return F.when(shape.contains(" "), F.rtrim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made)


def _iban(m: Column, key: str) -> Column:
    """Account part permuted, check digits made anew; without valid check digits not an account. Of groups that are set apart by
    blanks the last ones may be words behind the account."""

    def whole(t: Column) -> Column:
        plain = F.replace(t, F.lit(" "), F.lit(""))
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        made = let(
            feistel_text(account, key, country),
            lambda v: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(v, country, F.lit("00")))).cast("string"), 2, "0"), v),
        )
        valid = (F.length(plain) >= 15) & (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1)
        return F.when(valid, _regrouped(t, made))

    def without(last: int) -> Column:
        head = F.regexp_replace(m, f"(?: [A-Z0-9]+){{{last}}}$", "")
        return F.when(m.contains(" "), let(head, lambda h: F.concat(whole(h), F.substring(m, F.length(h) + 1, F.length(m)))))

    return F.coalesce(whole(m), without(1), without(2))


def _email(m: Column, key: str) -> Column:
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(feistel_text(name, key, F.lower(domain)), F.lit("@"), domain)


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_.-]+$", 0)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), feistel_text(value, key, F.lit("secret")))


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one match; the match itself where validation fails."""
    access = F.concat(F.lit("AKIA"), feistel_text(F.substring(m, 5, 16), key, F.lit("access")))
    kinds = ((EMAIL, _email(m, key)), (ACCESS, access), (SECRET, _secret(m, key)), (IBAN, _iban(m, key)), (IP, _ip(m, key)), (DATE, _date(m, key)), (SSN, _ssn(m, key)), (PHONE, _phone(m, key)), (CARD, _card(m, key)), (ABROAD, _abroad(m, key)))
    made = reduce(lambda rest, k: F.when(m.rlike(f"^(?:{k[0]})$"), k[1]).otherwise(rest), reversed(kinds), F.lit(None).cast("string"))
    return F.coalesce(made, m)


def pseudonymised(text: Column, key: str = KEY) -> Column:
    """``text`` with every validated match replaced."""
    parts, matches = F.split(text, ANY), F.regexp_extract_all(text, F.lit(ANY), 0)
    whole = F.zip_with(parts, F.transform(matches, lambda m: pseudonym(m, key)), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(HINT), F.array_join(whole, "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with the same columns and rows; only ``text`` changes."""
    return docs.withColumn(text, pseudonymised(docs[text], key))
