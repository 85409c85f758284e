"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Found values are checked (card and account numbers by their check digits, dates by the calendar, network addresses by
their octets, social security numbers by their ranges, telephone numbers by grouping and number of digits) and then permuted within their own format by a keyed Feistel network, so that
equal values get equal pseudonyms in every document, different values different ones, and whoever has the key can
undo it. What fails its check stays as it is.

 - card: 13 to 19 digits in one run or in the usual groups; all digits but the last are permuted, and the last makes
   the check digit right again.
 - phone: grouped in threes and four with or without a country code: the last ten digits are permuted; with a plus sign
   and other groups (8 to 15 digits): all but the first two; with a leading zero and groups (9 to 12 digits): all but
   the zero. Country code, brackets and separators stay. A run of one digit is no number.
 - ip: the four octets, none with a leading zero, are permuted as two 16-bit halves.
 - ssn: three, two and four digits with hyphens, in the ranges that are given out; permuted among these.
 - iban: the digits after the first four characters are permuted, and the two check digits made right again.
 - date: year-month-day with - or /, or day and month before the year with . / or -, years 1000 to 9999. A date is
   permuted within its 400-year cycle and written as it was, days up to the 12th (57,600 = 240 x 240) and later ones
   (88,497 = 9 x 9833) each among themselves. With day and month in doubt the day comes first.
 - email: addresses have no format to permute in; the local part becomes a keyed digest of the address.

The key is a secret: whoever runs this sets spark.pseudonyms.key in the session, or passes it. Without either there is a
key that everyone can read here, for tests.

Null texts stay null, empty ones empty; every occurrence is treated, in texts of any length; repeated rows get equal
pseudonyms; an empty table stays empty; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

KEY = "a key of your own"
SETTING = "spark.pseudonyms.key"
ROUNDS = 8

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
DATE = r"(?<![\p{L}\p{N}_./-])(?:[1-9]\d{3}([-/])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2[1-9]\d{3})(?![\p{L}\p{N}_]|[./-]\d)"
PHONE = r"(?<![\p{L}\p{N}_+.])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}_]|[.-]\d)"
IP = r"(?<![\p{L}\p{N}_.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}_]|\.\d)"
ABROAD = r"(?<![\p{L}\p{N}_+.])\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,5}(?![\p{L}\p{N}_]|[.-]\d)"
NATIONAL = r"(?<![\p{L}\p{N}_+./-])0\d{1,4}[ -]\d{3,5}(?:[ -]\d{3,5}){1,2}(?![\p{L}\p{N}_]|[ .-]\d)"
SSN = r"(?<![\p{L}\p{N}_.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_]|[.-]\d)"
IBAN = r"(?<![\p{L}\p{N}_])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}_])"
CARD = r"(?<![\p{L}\p{N}_])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{4}|\d{4}([ -])\d{6}\4\d{5})(?![\p{L}\p{N}_])"
ANY = "|".join((EMAIL, DATE, PHONE, IP, CARD, SSN, ABROAD, NATIONAL, IBAN))
KINDS = ("email", "date", "phone", "ip", "card", "ssn", "iban")


def _number(key: str, tweak: str, i: Column, half: Column, below: Column) -> Column:
    """A keyed pseudo-random number under a bound."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), i.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), below)


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: str) -> Column:
    """(a, b), a below size_a and b below size_b, permuted within that range by an even number of rounds."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), size_a.cast("long").alias("m"), size_b.cast("long").alias("n"))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _number(key, tweak, i, s["b"], s["m"]), s["m"]).alias("b"), s["n"].alias("m"), s["m"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 18 digits, permuted."""
    left = F.floor(F.length(digits) / 2).cast("int")
    right = F.length(digits) - left
    ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
    out = feistel(F.substr(digits, F.lit(1), left).cast("long"), F.substr(digits, left + 1).cast("long"), ten(left), ten(right), key, tweak)
    return _once(out, lambda o: F.concat(F.lpad(o["a"].cast("string"), left, "0"), F.lpad(o["b"].cast("string"), right, "0")))


def _luhn(digits: Column, of_check: bool) -> Column:
    """The sum whose last digit is 0 for a valid number; of_check: digits lack the check digit."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = lambda v, i: F.when(F.pmod(i + int(of_check), F.lit(2)) == 1, F.pmod(v * 2, F.lit(10)) + F.floor(v * 2 / 10).cast("int")).otherwise(v)
    return F.aggregate(F.transform(values, doubled), F.lit(0), lambda s, v: s + v)


def _into_format(shape: Column, digits: Column) -> Column:
    """The digits written over those of shape, in order."""
    marks = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(marks, start, put, lambda s: s["out"])


def _card(m: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        changed = _digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        full = _once(changed, lambda p: F.concat(p, F.pmod(10 - F.pmod(_luhn(p, True), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(F.pmod(_luhn(d, False), F.lit(10)) == 0, _into_format(m, full))

    return _once(F.regexp_replace(m, "[ -]", ""), valid)


def _phone(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        grouped = m.rlike(rf"^(?:{PHONE})$")
        kept = F.when(grouped, F.length(d) - 10).when(m.startswith("+"), 2).otherwise(1)
        fine = grouped | F.when(m.startswith("+"), F.length(d).between(8, 15)).otherwise(F.length(d).between(9, 12))
        new = F.concat(F.substr(d, F.lit(1), kept), _digits(F.substr(d, kept + 1), key, "phone"))
        return F.when(fine & ~d.rlike(r"^(\d)\1*$"), _into_format(m, new))

    return _once(F.regexp_replace(m, "[^0-9]", ""), body)


#: Groups (1 to 99) and serials (1 to 9999) of social security numbers; areas are 1 to 899 but 666.
GROUPS, SERIALS, AREAS = 99, 9999, 898


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    fine = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    moved = feistel(place * GROUPS + group - 1, serial - 1, F.lit(AREAS * GROUPS), F.lit(SERIALS), key, "ssn")

    def write(x: Column) -> Column:
        at = F.floor(x["a"] / GROUPS)
        wide = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat_ws("-", wide(at + F.when(at >= 665, 2).otherwise(1), 3), wide(F.pmod(x["a"], F.lit(GROUPS)) + 1, 2), wide(x["b"] + 1, 4))

    return F.when(fine, _once(moved, write))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of the number that letters (10 to 35) and digits make."""
    values = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda s, v: F.pmod(s * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _iban(m: Column, key: str) -> Column:
    def body(c: Column) -> Column:
        land, rest = F.substring(c, 1, 2), F.substr(c, F.lit(5))

        def moved(d: Column) -> Column:
            # Up to 30 digits: permuted in two parts of at most 18.
            half = F.floor(F.length(d) / 2).cast("int")
            parts = F.when(F.length(d) > 18, F.concat(_digits(F.substr(d, F.lit(1), half), key, "iban1"), _digits(F.substr(d, half + 1), key, "iban2"))).when(F.length(d) > 1, _digits(d, key, "iban")).otherwise(d)
            return _into_format(rest, parts)

        new = _once(_once(F.regexp_replace(rest, "[^0-9]", ""), moved), lambda r: F.concat(land, F.lpad((98 - _mod97(F.concat(r, land, F.lit("00")))).cast("string"), 2, "0"), r))
        return F.when((F.length(c) >= 15) & (_mod97(F.concat(rest, F.substring(c, 1, 4))) == 1), _once(new, lambda n: _spaced(m, n)))

    return _once(F.regexp_replace(m, " ", ""), body)


def _spaced(shape: Column, text: Column) -> Column:
    """The text with blanks where shape has them."""
    marks = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    put = lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(text, s["at"], F.lit(1)))).alias("out"), (s["at"] + (c != " ").cast("int")).alias("at"))
    return F.aggregate(marks, start, put, lambda s: s["out"])


def _ip(m: Column, key: str) -> Column:
    def body(o: Column) -> Column:
        at = lambda i: F.get(o, F.lit(i))
        size = F.lit(65536)
        out = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), size, size, key, "ip")
        octets = lambda x: F.concat_ws(".", *(p.cast("string") for h in ("a", "b") for p in (F.floor(x[h] / 256), F.pmod(x[h], F.lit(256)))))
        return F.when(~F.exists(o, lambda v: v > 255) & ~m.rlike(r"(?:^|\.)0\d"), _once(out, octets))

    return _once(F.transform(F.split(m, r"\."), lambda p: p.cast("int")), body)


#: Days of a month that could be a month. Later ones are permuted among themselves, so that what is written with the
#: month first never reads as another date with the day first, and all notations of a date get one pseudonym.
LAST = 12


def _early(w: Column, key: str) -> Column:
    """Another date with a day up to LAST, in the same 400 years."""
    start = w["cycle"] * 400 + 1600
    at = ((w["y"] - start) * 12 + w["m"] - 1) * LAST + w["d"] - 1  # of 57,600
    back = lambda f: _once(f["a"] * 240 + f["b"], lambda x: F.struct((start + F.floor(x / 144)).alias("y"), (F.pmod(F.floor(x / 12), F.lit(12)) + 1).alias("m"), (F.pmod(x, F.lit(12)) + 1).alias("d")))
    return _once(feistel(F.floor(at / 240), F.pmod(at, F.lit(240)), F.lit(240), F.lit(240), key, "early"), back)


def _late(w: Column, key: str) -> Column:
    """Another date with a day over LAST, in the same 400 years: they are numbered, 221 or 222 a year, 88,497 in all."""
    start = w["cycle"] * 400 + 1600
    before = lambda y: y * 221 + F.ceil(y / 4) - F.ceil(y / 100) + F.ceil(y / 400)  # noqa: E731  of the years before
    year = w["y"] - start
    at = before(year) + w["n"] - w["m"] * LAST - 1
    lengths = F.array(*(F.lit(n) for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)))

    def back(x: Column) -> Column:
        guess = F.floor(x / 221.2425).cast("long")
        y = F.when(before(guess + 1) <= x, guess + 1).when(before(guess) <= x, guess).otherwise(guess - 1)
        return _once(F.struct(y.alias("y"), (x - before(y)).alias("r")), month)

    def month(p: Column) -> Column:
        leap = ((F.pmod(p["y"], F.lit(4)) == 0) & (F.pmod(p["y"], F.lit(100)) != 0)) | (p["y"] == 0)
        each = F.transform(lengths, lambda n: n - LAST + F.when(leap & (n == 28), 1).otherwise(0))
        step = lambda s, n: F.when(s["done"] | (s["r"] < n), F.struct(F.lit(True).alias("done"), s["m"].alias("m"), s["r"].alias("r"))).otherwise(F.struct(F.lit(False).alias("done"), (s["m"] + 1).alias("m"), (s["r"] - n).alias("r")))
        first = F.struct(F.lit(False).alias("done"), F.lit(1).alias("m"), p["r"].alias("r"))
        return F.aggregate(each, first, step, lambda s: F.struct((start + p["y"]).alias("y"), s["m"].alias("m"), (s["r"] + LAST + 1).alias("d")))

    return _once(feistel(F.floor(at / 9833), F.pmod(at, F.lit(9833)), F.lit(9), F.lit(9833), key, "late"), lambda f: back(f["a"] * 9833 + f["b"]))


def _date(m: Column, key: str) -> Column:
    def body(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i))
        first = F.length(part(0)) == 4
        as_date = lambda y, mo, d: F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
        ymd, dmy, mdy = as_date(part(0), part(1), part(2)), as_date(part(2), part(1), part(0)), as_date(part(2), part(0), part(1))
        order = F.when(first & ymd.isNotNull(), "ymd").when(~first & dmy.isNotNull(), "dmy").when(~first & mdy.isNotNull(), "mdy")
        date = F.when(first, ymd).otherwise(F.coalesce(dmy, mdy))

        def write(x: Column) -> Column:
            mark = F.regexp_extract(m, "[-/.]", 0)
            wide = lambda i, v: F.when(F.length(part(i)) == 2, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
            y, mo, d = F.lpad(x["y"].cast("string"), 4, "0"), x["m"], x["d"]
            return F.when(order == "ymd", F.concat(y, mark, wide(1, mo), mark, wide(2, d))).when(order == "dmy", F.concat(wide(0, d), mark, wide(1, mo), mark, y)).otherwise(F.concat(wide(0, mo), mark, wide(1, d), mark, y))

        whole = lambda c: F.struct(F.floor((F.year(c) - 1600) / 400).alias("cycle"), F.year(c).alias("y"), F.month(c).alias("m"), F.day(c).alias("d"), F.dayofyear(c).alias("n"))
        moved = _once(date, lambda c: _once(whole(c), lambda w: F.when(w["d"] > LAST, _late(w, key)).otherwise(_early(w, key))))
        return F.when(order.isNotNull(), _once(moved, write))

    return _once(F.split(m, "[-/.]"), body)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@"), F.substring_index(m, "@", -1))


def _treated(m: Column, key: str) -> Column:
    """kind and pseudonym of one match; kind is null where it fails its check, and the text then stays."""
    whole = lambda p: m.rlike(rf"^(?:{p})$")
    card = CARD.replace(r"\3", r"\1").replace(r"\4", r"\2")
    kind = F.when(m.contains("@"), "email").when(whole(IP), "ip").when(whole(DATE), "date").when(whole(SSN), "ssn").when(whole(IBAN), "iban").when(whole(card), "card").otherwise("phone")
    new = F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "date", _date(m, key)).when(kind == "card", _card(m, key)).when(kind == "ssn", _ssn(m, key)).when(kind == "iban", _iban(m, key)).otherwise(_phone(m, key))
    return _once(F.struct(kind.alias("kind"), new.alias("new")), lambda x: F.struct(F.when(x["new"].isNotNull(), x["kind"]).alias("kind"), F.coalesce(x["new"], m).alias("new")))


def pseudonymised(docs: DataFrame, key: str | None = None, counts: bool = False) -> DataFrame:
    """docs with pseudonyms in text; counts: with n_<kind> columns added, replacing columns of these names."""
    key = key or docs.sparkSession.conf.get(SETTING, KEY)
    names = [f"n_{k}" for k in KINDS]
    kept = [c for c in docs.columns if not (counts and c.lower() in names)]
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    treated = F.transform(found, lambda m: _treated(m, key))
    name = unused(docs, "found")
    out = docs.withColumn(name, F.coalesce(treated, F.array()))
    # The pieces between matches, each followed by its match's pseudonym.
    pieces = F.split("text", ANY, -1)
    joined = F.when(F.size(name) > 0, F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(name), i)["new"], F.lit("")))), "")).otherwise(F.col("text"))
    of_kind = lambda k: F.size(F.filter(name, lambda x: x["kind"].eqNullSafe(F.lit(k)))).cast("long")
    return out.select(
        *(joined.alias(c) if c == "text" else F.col(f"`{c}`") for c in kept),
        *(of_kind(k).alias(n) for k, n in zip(KINDS, names) if counts),
    )
