"""Format-preserving pseudonyms for personal numbers and dates, in Spark SQL functions only.

Each value found is validated (check digits, calendar, octets), and permuted within
its own format under a key by a Feistel network: the value is cut in two halves,
and for ``rounds`` rounds one half is shifted by what a keyed SHA-256 of the other
half gives.  That is a bijection on the values of a format, so equal values get
equal pseudonyms in every document and different values different ones, and with
the key it can be undone (``undo=True``).

* card: 13 to 19 digits with a valid Luhn digit, also in groups; all digits but the
  last are permuted and the check digit is set anew.
* phone: international numbers, and the national forms (123) 456-7890, 123-456-7890 and 123.456.7890.  The
  digits after the country code, which is told from the digits, are permuted by themselves and laid between the signs that
  stood there, so a number has one pseudonym in every notation, with the code of the national forms' country or without.
  Phone numbers have no check digit: their form is all there is to validate.
* ssn: ddd-dd-dddd that can be issued; digits permuted.
* ip: dotted quads; the 32-bit number is permuted.
* email: letters and digits of the local part, each within its kind; the domain stays.  Case doesn't
  matter to the permutation, so addresses that differ in it stay linked.
* date: yyyy-mm-dd, dd.mm.yyyy and mm/dd/yyyy from 1900 to 2099 that are in the
  calendar; the day's number among those 73,049 is permuted.  With slashes the month
  comes first: dd/mm/yyyy with a day over 12 is found but stays, as there is no way
  to permute both orders apart from each other and undo it.

Texts without digit or @ pass unchanged without a look at the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The days from 1900-01-01 to 2099-12-31 are 229 * 319.
FIRST_DAY, DAYS, DAY_HIGH, DAY_LOW = "1900-01-01", 73_049, 229, 319

_EDGE, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: Fixed patterns of the formats, tried in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9A-Za-z_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z_]|\.[0-9])",
    "date": _EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})" + _END,
    "ssn": r"(?<![0-9A-Za-z_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z_+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4})" + _END
    + r"|(?<![0-9A-Za-z_+.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9A-Za-z_]|[-.][0-9])",
    "card": r"(?<![0-9A-Za-z_.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z_]|-[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digest(key: str, kind: str, r: int, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(r)), F.lower(other)), 256)


def _number(digest: Column, at: Column | int = 1, n: int = 12) -> Column:
    return F.conv(digest.substr(F.lit(at) if isinstance(at, int) else at, F.lit(n)), 16, 10).cast("long")


def _shifted(half: Column, digest: Column, sign: int) -> Column:
    """Each digit and ASCII letter moved on within its kind; the rest as it is."""

    def move(c: Column, i: Column) -> Column:
        by = _number(digest, (i * 2) % 62 + 1, 2) * sign
        code = F.ascii(c)
        turned = lambda base, n: F.char((F.pmod(code - base + by, F.lit(n)) + base).cast("long"))
        return F.when(code.between(48, 57), turned(48, 10)).when(code.between(97, 122), turned(97, 26)).when(code.between(65, 90), turned(65, 26)).otherwise(c)

    return F.array_join(F.transform(_chars(half), move), "")


def feistel_text(value: Column, key: str, kind: str, rounds: int, undo: bool) -> Column:
    """A permutation of the strings with the same pattern of digits, letters and other characters."""
    at = F.floor(F.length(value) / 2).cast("int")
    pair = F.struct(value.substr(F.lit(1), at).alias("l"), value.substr(at + 1, F.length(value)).alias("r"))
    shift = lambda half, r, other, sign: _shifted(half, _digest(key, kind, r, other), sign)
    return F.element_at(F.transform(_rounds(pair, rounds, undo, shift, shift), lambda x: F.concat(x["l"], x["r"])), 1)


def feistel_number(value: Column, high: int, low: int, key: str, kind: str, rounds: int, undo: bool) -> Column:
    """A permutation of 0 .. high * low - 1."""
    pair = F.struct(F.floor(value / low).cast("long").alias("l"), F.pmod(value, F.lit(low)).cast("long").alias("r"))

    def shift(size: int):
        return lambda half, r, other, sign: F.pmod(half + _number(_digest(key, kind, r, other.cast("string"))) * sign, F.lit(size))

    return F.element_at(F.transform(_rounds(pair, rounds, undo, shift(high), shift(low)), lambda x: x["l"] * low + x["r"]), 1)


def _rounds(pair: Column, rounds: int, undo: bool, shift_l, shift_r) -> Column:
    """The Feistel rounds on a pair of halves, as an array of one: each step is then computed once."""
    sign = -1 if undo else 1

    def step(r: int):  # of one argument: a second would be taken for the index
        if r % 2:
            return lambda x: F.struct(shift_l(x["l"], r, x["r"], sign).alias("l"), x["r"].alias("r"))
        return lambda x: F.struct(x["l"].alias("l"), shift_r(x["r"], r, x["l"], sign).alias("r"))

    steps = F.array(pair)
    for r in reversed(range(rounds)) if undo else range(rounds):
        steps = F.transform(steps, step(r))
    return steps


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one counting once."""
    return F.aggregate(
        F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )


def _laid(m: Column, digits: Column) -> Column:
    """m with its digits replaced, one after the other, by these."""
    nth = lambda i: F.length(F.regexp_replace(m.substr(F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(_chars(m), lambda c, i: F.when(F.ascii(c).between(48, 57), digits.substr(nth(i), F.lit(1))).otherwise(c)), "")


def _card(m: Column, key: str, rounds: int, undo: bool) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    body = feistel_text(digits.substr(F.lit(1), F.length(digits) - 1), key, "card", rounds, undo)
    full = F.element_at(F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))), 1)
    laid = F.element_at(F.transform(F.array(full), lambda d: _laid(m, d)), 1)
    return F.when(_luhn(digits) % 10 == 0, laid).otherwise(m)


#: The country codes of one digit, and those of two; all others have three.
CODES_1, CODES_2 = "[17]", "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _phone(m: Column, key: str, rounds: int, undo: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    code = F.when(~m.startswith("+"), 0).when(digits.rlike(f"^{CODES_1}"), 1).when(digits.rlike(f"^(?:{CODES_2})"), 2).otherwise(3)
    new = F.concat(digits.substr(F.lit(1), code), feistel_text(digits.substr(code + 1, F.length(digits)), key, "phone", rounds, undo))
    return F.element_at(F.transform(F.array(new), lambda d: _laid(m, d)), 1)


def _ssn_valid(m: Column) -> Column:
    return ~m.rlike("^(000|666|9)|-00-|-0000$")


def _ssn(m: Column, key: str, rounds: int, undo: bool) -> Column:
    area, group, serial = (m.substr(a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    number = (F.when(area < 666, area - 1).otherwise(area - 2) * 99 + group - 1) * 9999 + serial - 1

    def written(n: Column) -> Column:
        a = F.floor(n / (99 * 9999)).cast("long")
        return F.concat_ws("-", F.lpad(F.when(a < 665, a + 1).otherwise(a + 2).cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(n / 9999), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"))

    made = F.element_at(F.transform(F.array(feistel_number(number, 898 * 99, 9999, key, "ssn", rounds, undo)), written), 1)
    return F.when(_ssn_valid(m), made).otherwise(m)


def _ip(m: Column, key: str, rounds: int, undo: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    made = F.element_at(F.transform(F.array(feistel_number(number, 65536, 65536, key, "ip", rounds, undo)), lambda n: F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])), 1)
    return F.when(F.forall(parts, lambda p: p <= 255) & ~m.rlike(r"(^|\.)0[0-9]"), made).otherwise(m)


def _email(m: Column, key: str, rounds: int, undo: bool) -> Column:
    at = F.instr(m, "@")
    return F.concat(feistel_text(m.substr(F.lit(1), at - 1), key, "email", rounds, undo), m.substr(at, F.length(m)))


def _date(m: Column, key: str, rounds: int, undo: bool) -> Column:
    out = m
    for shape, pattern in ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), (r"^[0-9]{2}/", "MM/dd/yyyy")):
        day = F.datediff(F.try_to_date(m, pattern), F.lit(FIRST_DAY).cast("date"))
        made = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), feistel_number(day.cast("long"), DAY_HIGH, DAY_LOW, key, "date", rounds, undo).cast("int")), pattern)
        out = F.when(m.rlike(shape), F.when(day.between(0, DAYS - 1), made).otherwise(m)).otherwise(out)
    return out


_MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kind(m: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, p in PATTERNS.items():
        out = out.when(m.rlike(f"^(?:{p})$"), F.lit(kind))
    return out.otherwise(F.lit("card"))


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8, undo: bool = False) -> DataFrame:
    """Per row: the id, the text with its values replaced, n_found, n_replaced, and n_<kind> of those replaced.

    A null text stays null and an empty one empty, with counts of 0; values that fail validation are found
    but not replaced; a value that its permutation maps to itself counts as replaced.  Null ids, repeated
    rows and extra columns don't matter; an empty table gives an empty result.
    """
    if rounds < 4 or rounds % 2:
        raise ValueError("rounds must be even and at least 4")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    text = F.col("_text")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    rows = rows.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))

    def made(m: Column) -> Column:
        out = F.when(F.lit(False), F.struct(m.alias("new"), F.lit("").alias("kind"), F.lit(False).alias("done")))
        kind = _kind(m)
        valid = {
            "email": F.lit(True), "phone": F.lit(True), "ssn": _ssn_valid(m), "card": _luhn(F.regexp_replace(m, "[ -]", "")) % 10 == 0,
            "ip": F.forall(F.split(m, r"\."), lambda p: p.cast("int") <= 255) & ~m.rlike(r"(^|\.)0[0-9]"),
            "date": F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "dd.MM.yyyy"), F.try_to_date(m, "MM/dd/yyyy")).between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")),
        }
        for name, maker in _MAKERS.items():
            out = out.when(kind == name, F.struct(maker(m, key, rounds, undo).alias("new"), F.lit(name).alias("kind"), F.coalesce(valid[name], F.lit(False)).alias("done")))
        return out

    rows = rows.withColumn("_made", F.when(F.size("_found") > 0, F.transform("_found", made)))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("_made"), i)["new"], F.lit("")))), "")
    count = lambda name: F.coalesce(F.size(F.filter("_made", lambda x: x["done"] & (x["kind"] == name))), F.lit(0)).cast("long").alias(f"n_{name}")
    done = F.coalesce(F.size(F.filter("_made", lambda x: x["done"])), F.lit(0)).cast("long")
    return rows.select(F.col("_id").alias(id_col), F.when(F.size("_found") > 0, joined).otherwise(text).alias(text_col), F.size("_found").cast("long").alias("n_found"), done.alias("n_replaced"), *[count(k) for k in PATTERNS])
