"""Format-preserving pseudonyms of personal numbers and dates. DataFrame functions only.

A value found by its pattern is validated (check digits, calendar, ranges), reduced to its
digits and permuted by a keyed Feistel network over exactly the values of its format, and
the new digits are laid into the old punctuation. The same value has the same pseudonym in
every document, and two values never share one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspot.llm.common import fresh

ROUNDS = 8
KEY = "pseudonym-key"

# fixed values: formats looked for, tried in this order at every position
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
# a match with borders inside that a value of least length may end at
_LONG = r"^(?:[0-9]|[A-Z]{2}[0-9]{2})[A-Z0-9 -]{11,}$"
# no text holds all of these non-characters; one that it does not hold marks the ends of values
_MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]
#: Rounds of marking: what is left of a match may make one with what follows.
MARKING = 2
#: Days from 1900-01-01 that the date permutation covers: 256 * 286, to the middle of 2100.
DATE_START, DATE_A, DATE_B = "1900-01-01", 256, 286


def _draw(key: str, what: Column, mod: Column) -> Column:
    """Keyed pseudo-random number below ``mod`` (at most 10^9)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key + "|"), what), 256), 1, 15), 16, 10).cast("long") % mod


def feistel(value: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """Keyed permutation of 0 .. a * b - 1: an unbalanced Feistel network on value = left * b + right,
    whose halves take turns in receiving the keyed sum of the other."""

    pair = feistel_pair(F.floor(value / b).cast("long"), value % b, a, b, tweak, key)
    return _let(pair, lambda s: s["l"] * b + s["r"])


def feistel_digits(digits: Column, tweak: Column, key: str) -> Column:
    """Keyed permutation of the digit strings of each length (2 to 18 digits), zeros kept in front."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel_pair(F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n).cast("long"), ten(half), ten(n - half), F.concat_ws("|", tweak, n.cast("string")), key)
    return F.concat(F.lpad(out["l"].cast("string"), half, "0"), F.lpad(out["r"].cast("string"), n - half, "0"))


def feistel_pair(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """The network on a pair (left < a, right < b); a struct of l and r."""

    def step(s: Column, i: Column) -> Column:
        odd = (i % 2) == 1
        w = lambda x: F.concat_ws("|", tweak, i.cast("string"), x.cast("string"))
        return F.struct(
            F.when(odd, (s["l"] + _draw(key, w(s["r"]), a)) % a).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise((s["r"] + _draw(key, w(s["l"]), b)) % b).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")), step)


def _digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string; 0 modulo 10 with a right check digit."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return s + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), add)


def _lay(m: Column, digits: Column) -> Column:
    """The match with its digits replaced, in order, by the given ones."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    state = F.struct(F.lit("").alias("s"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        d = c.rlike("[0-9]")
        return F.struct(F.concat(s["s"], F.when(d, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("s"), F.when(d, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(chars, state, put, lambda s: s["s"])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value to a name, so that it is not written out (and worked out) again at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _card(m: Column, key: str) -> Column:
    """13 to 19 digits with a right Luhn digit; the others are permuted and the check digit follows."""

    def new(d: Column) -> Column:
        body = feistel_digits(F.substring(d, F.lit(1), F.length(d) - 1), F.lit("card"), key)
        return _let(body, lambda b: _lay(m, F.concat(b, ((F.lit(10) - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))

    return _let(_digits_of(m), lambda d: F.when(_luhn(d) % 10 == 0, new(d)))


def _mod97(s: Column) -> Column:
    """Remainder by 97 of an IBAN in its check order, letters as 10 to 35."""
    up = F.upper(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4)))
    chars = F.filter(F.split(up, ""), lambda c: c != "")

    def add(r: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """15 to 34 signs with right check digits; the digits of the account are permuted in place,
    check digits follow. Country and letters stay."""

    def new(s: Column) -> Column:
        account = F.substring(s, F.lit(5), F.length(s))

        def with_digits(d: Column) -> Column:
            # up to 18 digits make one block; longer accounts two, the second tweaked by nothing of the first
            two = F.concat(feistel_digits(F.substring(d, 1, 15), F.concat(F.lit("iban"), F.substring(s, 1, 2)), key), F.when(F.length(d) > 16, feistel_digits(F.substring(d, F.lit(16), F.length(d)), F.concat(F.lit("iban2"), F.substring(s, 1, 2)), key)).otherwise(F.substring(d, F.lit(16), F.length(d))))
            whole = F.when(F.length(d) < 2, d).when(F.length(d) <= 18, feistel_digits(d, F.concat(F.lit("iban"), F.substring(s, 1, 2)), key)).otherwise(two)
            return _let(_lay(account, whole), lambda acc: _let(F.lpad((F.lit(98) - _mod97(F.concat(F.substring(s, 1, 2), F.lit("00"), acc))).cast("string"), 2, "0"), lambda chk: _lay(m, F.concat(chk, _digits_of(acc)))))

        return _let(_digits_of(account), with_digits)

    return _let(F.regexp_replace(m, " ", ""), lambda s: F.when((_mod97(s) == 1) & F.length(s).between(15, 34), new(s)))


def _date(m: Column, key: str) -> Column:
    """A calendar date from 1900 to the middle of 2100; the day is permuted, the format stays."""
    iso = F.try_to_date(m, "yyyy-MM-dd")
    european = F.try_to_date(m, "dd.MM.yyyy")
    us = F.try_to_date(m, "MM/dd/yyyy")
    day_first = F.try_to_date(m, "dd/MM/yyyy")

    def new(d: Column) -> Column:
        n = F.datediff(d, F.lit(DATE_START).cast("date")).cast("long")
        a, b = F.lit(DATE_A).cast("long"), F.lit(DATE_B).cast("long")
        out = feistel(n, a, b, F.lit("date"), key)
        day = F.date_add(F.lit(DATE_START).cast("date"), out.cast("int"))
        form = F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(m.contains("."), F.date_format(day, "dd.MM.yyyy")).when(us.isNotNull(), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
        return F.when((n >= 0) & (n < DATE_A * DATE_B), form)

    return _let(F.coalesce(iso, european, us, day_first), new)


def _ip(m: Column, key: str) -> Column:
    """Four numbers up to 255: the 32 bits are permuted."""

    def new(p: Column) -> Column:
        part = lambda i: F.element_at(p, i).cast("long")
        good = F.forall(p, lambda x: x.cast("int") <= 255)
        full = F.lit(65536).cast("long")
        out = feistel_pair(part(1) * 256 + part(2), part(3) * 256 + part(4), full, full, F.lit("ip"), key)
        text = _let(out, lambda o: F.concat_ws(".", F.floor(o["l"] / 256).cast("string"), (o["l"] % 256).cast("string"), F.floor(o["r"] / 256).cast("string"), (o["r"] % 256).cast("string")))
        return F.when(good, text)

    return _let(F.split(m, r"\."), new)


def _phone(m: Column, key: str) -> Column:
    """7 to 15 digits: the last ten (or all but the country code) are permuted."""

    def new(d: Column) -> Column:
        keep = F.greatest(F.length(d) - 10, F.lit(0))
        own = feistel_digits(F.substring(d, keep + 1, F.length(d)), F.lit("phone"), key)
        return F.when(F.length(d).between(7, 15), _lay(m, F.concat(F.substring(d, F.lit(1), keep), own)))

    return _let(_digits_of(m), new)


def _ssn(m: Column, key: str) -> Column:
    """Area neither 000, 666 nor 9xx, group not 00, serial not 0000: permuted within those, as mixed radix."""

    def new(d: Column) -> Column:
        area, group, serial = d.substr(1, 3).cast("long"), d.substr(4, 2).cast("long"), d.substr(6, 4).cast("long")
        good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        index = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
        a, b = F.lit(898 * 9).cast("long"), F.lit(11 * 9999).cast("long")

        def back(i: Column) -> Column:
            ar = F.floor(i / (99 * 9999)).cast("long")
            ar = F.when(ar >= 665, ar + 2).otherwise(ar + 1)
            return F.concat_ws("-", F.lpad(ar.cast("string"), 3, "0"), F.lpad((F.floor(i / 9999).cast("long") % 99 + 1).cast("string"), 2, "0"), F.lpad((i % 9999 + 1).cast("string"), 4, "0"))

        return F.when(good, _let(feistel(index, a, b, F.lit("ssn"), key), back))

    return _let(_digits_of(m), new)


def _email(m: Column, key: str) -> Column:
    """Local part and domain give way to keyed hex digits of the address in lower case, so that equal
    addresses stay linked; the form of an address stays."""
    low = F.lower(m)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key + "|email|"), low), 256), 1, 16), F.lit("@"), F.lit("m"), F.substring(F.sha2(F.concat(F.lit(key + "|domain|"), F.substring_index(low, "@", -1)), 256), 1, 8), F.lit(".example"))


_KINDS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}


def _kind(m: Column) -> Column:
    """Kind of a match: the first of the patterns that fits the whole of it."""
    bare = {k: p.replace(r"\b", "") for k, p in PATTERNS.items()}
    out = None
    for k, p in bare.items():
        test = m.rlike(f"^(?:{p})$")
        out = F.when(test, k) if out is None else out.when(test, k)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY, text_col: str = "text", keep_values: bool = False, pii_col: str = "pii") -> DataFrame:
    """``docs`` with pseudonyms in place of personal numbers, dates and e-mail addresses.

    Adds ``pii`` (``pii_col``): an array of ``(kind, pseudonym)`` of what was replaced, in text order; with
    ``keep_values`` the private value as well, for whoever may re-link them.
    A card number or IBAN is parted from groups that follow it (an expiry date, a year, a word in
    capitals, the next value): the longest valid value ended at a group border is taken, and what is
    left is looked at again. Matches that do not validate (wrong check digit, no such day, number above 255) stay. A null
    text stays null with a null ``pii``; empty texts stay empty; a column already of that name is
    replaced, all others are kept. Rows are handled one by one: repeated rows give equal results,
    and nothing is shuffled.
    """
    own = F.col(text_col)
    any_ = "|".join(f"(?:{p})" for p in PATTERNS.values())
    mark, text_with = fresh("mark"), fresh("text")
    # only texts with long runs of digits or capitals need their values parted from what follows
    long_ = own.rlike(f"{PATTERNS['card']}|{PATTERNS['iban']}")
    out = docs.withColumn(mark, F.when(long_, F.coalesce(*(F.when(~own.contains(c), c) for c in _MARKS)))).withColumn(text_with, own)
    text = F.col(text_with)
    for _ in range(MARKING):
        matches, pieces = F.regexp_extract_all(text, F.lit(any_), F.lit(0)), F.split(text, any_, -1)
        behind = F.zip_with(matches, F.slice(pieces, F.lit(2), F.size(pieces)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
        parted = F.transform(F.filter(behind, lambda x: x["m"].isNotNull()), lambda x: _part(x["m"], x["p"], F.col(mark)))
        joined = F.array_join(F.zip_with(pieces, parted, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
        out = out.withColumn(text_with, F.when(F.col(mark).isNotNull(), joined).otherwise(text))
    # rows without a digit or an at sign have nothing to look for
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(any_), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))
    new = lambda m: _let(_kind(m), lambda k: _case(k, m, key))
    out = out.withColumn(pii_col, found).withColumn(pii_col, F.transform(pii_col, new))
    pieces = F.split(text, any_, -1)
    joined = F.array_join(F.zip_with(pieces, F.col(pii_col), lambda p, m: F.concat(p, F.coalesce(m["pseudonym"], m["value"], F.lit("")))), "")
    plain = F.when(F.col(mark).isNotNull(), F.replace(joined, F.col(mark), F.lit(""))).otherwise(joined)
    out = out.withColumn(text_col, F.when(F.size(pii_col) > 0, plain).otherwise(own)).drop(mark, text_with)
    out = out.withColumn(pii_col, F.filter(pii_col, lambda m: m["pseudonym"].isNotNull()))
    return out if keep_values else out.withColumn(pii_col, F.transform(pii_col, lambda m: m.dropFields("value")))


def _valid(m: Column) -> Column:
    """Whether the whole of a card or IBAN match has right check digits."""
    s = F.regexp_replace(m, "[ -]", "")
    card = F.length(s).between(13, 19) & (_luhn(s) % 10 == 0)
    return F.when(m.rlike("^[0-9]"), card).otherwise(F.length(s).between(15, 34) & (_mod97(s) == 1))


def _part(m: Column, after: Column, mark: Column) -> Column:
    """A card or IBAN match that is too long, with a mark behind the longest valid value that it begins
    with and ends at a border of its groups; behind what is left as well, if that is a value by itself
    or only white space (``after``) parts it from the next match."""

    def cut(n: Column) -> Column:
        left = F.substring(m, n + 1, F.length(m))
        whole = F.regexp_replace(left, "^[ -]", "")
        again = F.when(after.rlike(r"^\s+$") | (whole.rlike(_LONG) & _valid(whole)), mark).otherwise("")
        return F.concat(F.substring(m, F.lit(1), n), mark, left, again)

    ends = F.filter(F.reverse(F.sequence(F.lit(13), F.length(m) - 1)), lambda n: F.substring(m, n + 1, F.lit(1)).isin(" ", "-") & _valid(F.substring(m, F.lit(1), n)))
    inside = _let(ends, lambda e: F.when(F.size(e) > 0, _let(F.get(e, F.lit(0)), cut)).otherwise(m))
    return F.when(m.rlike(_LONG) & (_kind(m).isin("card", "iban")), F.when(_valid(m), m).otherwise(inside)).otherwise(m)


def _case(kind: Column, m: Column, key: str) -> Column:
    out = None
    for k, f in _KINDS.items():
        out = F.when(kind == k, f(m, key)) if out is None else out.when(kind == k, f(m, key))
    return F.struct(kind.alias("kind"), m.alias("value"), out.alias("pseudonym"))
