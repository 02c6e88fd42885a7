"""Format-preserving pseudonyms for validated numbers and dates.

Card numbers (Luhn), IBANs (mod 97), telephone numbers, IPv4 addresses, social security numbers
and calendar dates are found in the text, validated, and replaced by another valid value of the
same format: the value is an index into its domain, and a keyed Feistel network permutes the domain.
Equal values get equal pseudonyms in every document, different values different ones, and nothing
is stored.  The local part of e-mail addresses is permuted the same way, letter by letter class.
What fails its validation stays as it is.

Cards are compact, in groups of four, or 4-6-5.  Dates are year first, day first or month first; with ``/`` the month is first
where both could be, with ``-`` and ``.`` the day, and as a date of the other order may look the same, two dates that are
written in different orders can get one pseudonym.  Not found: dates with month names, two-digit years or spaces, with points, year
first and one-digit parts (as versions are), and of years outside 1800 to 2199; telephone numbers without ``+`` but those of
ten digits in groups 3-3-4 with or without a bare 1 before (so neither 00 and a country code nor a leading area zero); cards in
other groups; IPv6; social security numbers without hyphens.

Everything is built-in Column work on one row at a time: no Python on the executors, no shuffle.

Defined results: null text stays null (no values); empty text stays empty; a null id or repeated rows
are treated like any other row; other columns are passed through untouched by ``pseudonymise``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Stands in for the secret that a deployment passes as ``key``.
EXAMPLE_KEY = "example key, replace it"

_KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "date": r"(?:[0-9]{4}(?:([-/])[0-9]{1,2}\1[0-9]{1,2}|\.[0-9]{2}\.[0-9]{2})|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?|1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}"
    r"|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}",
    "card": r"[0-9]{4}(?:([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|([ -])[0-9]{6}\2[0-9]{5}|[0-9]{9,15})",
}
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])(?<![\p{N}][.,-])", r"(?![\p{L}\p{N}_])(?![.,-][\p{N}])"


def _renumbered(patterns: list[str]) -> str:
    """One alternation; group references are shifted to the groups of the whole."""
    parts, groups = [], 1
    for p in patterns:
        own = re.compile(p).groups
        for i in range(own, 0, -1):
            p = p.replace(f"\\{i}", f"\\{i + groups}")
        parts.append(p)
        groups += own
    return f"{_BEFORE}({'|'.join(parts)}){_AFTER}"


PATTERN = _renumbered(list(_KINDS.values()))
#: A text without these characters in a row has nothing to replace; cheap to test.
_HINT = r"[0-9][0-9./+ ()-]*[0-9]|@"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"), F.lit(key)), 256)


def _halves(l: Column, r: Column, a: Column, b: Column, key: str, kind: str, finish) -> Column:
    """A keyed permutation of the pairs l < a, r < b: an alternating Feistel network with addition mod a and mod b.

    ``finish`` gets the permuted halves.
    """

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other, size = F.when(even, s["r"]).otherwise(s["l"]), F.when(even, a).otherwise(b)
        return _let(
            F.conv(F.substring(_digest(key, kind, i, other), 1, 15), 16, 10).cast("long") % size,
            lambda f: F.when(even, F.struct(((s["l"] + f) % a).alias("l"), s["r"].alias("r"))).otherwise(
                F.struct(s["l"].alias("l"), ((s["r"] + f) % b).alias("r"))
            ),
        )

    start = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, finish)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("long")


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def permute_digits(d: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""

    def of(x: Column) -> Column:
        left = F.floor(F.length(x) / 2).cast("int")
        right = F.length(x) - left
        return _halves(
            F.substring(x, F.lit(1), left),
            F.substring(x, left + 1, right),
            _power(left),
            _power(right),
            key,
            kind,
            lambda s: F.concat(_pad(s["l"], left), _pad(s["r"], right)),
        )

    return _let(d, of)


def permute_letters(value: Column, key: str, kind: str) -> Column:
    """Letters and digits permuted within their class and place; a Feistel network on the two halves of the string."""

    def shifted(half: Column, other: Column, i: Column) -> Column:
        stream = F.concat(_digest(key, kind, i, other), _digest(key, kind + "+", i, other))

        def move(c: Column, k: Column) -> Column:
            byte = F.conv(F.substring(stream, (k * 2) % 128 + 1, F.lit(2)), 16, 10).cast("int")
            cycle = lambda low, n: F.chr((F.ascii(c) - ord(low) + byte) % n + ord(low))
            return (
                F.when(c.rlike("^[a-z]$"), cycle("a", 26)).when(c.rlike("^[A-Z]$"), cycle("A", 26)).when(c.rlike("^[0-9]$"), cycle("0", 10)).otherwise(c)
            )

        return F.array_join(F.transform(F.split(half, ""), move), "")

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i).alias("r"))
        )

    def of(x: Column) -> Column:
        cut = F.floor(F.length(x) / 2).cast("int")
        start = F.struct(F.substring(x, F.lit(1), cut).alias("l"), F.substring(x, cut + 1, F.length(x)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))

    return _let(value, of)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced, in order, by ``digits``."""

    def step(s: Column, c: Column) -> Column:
        return F.when(
            c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check, the last digit being the check digit."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: _let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)),
        ),
        F.lit(0),
        lambda s, v: s + F.coalesce(v, F.lit(0)),
    )


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d)
        body = permute_digits(F.substring(d, F.lit(1), n - 1), key, "card")
        made = _let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when((n >= 13) & (n <= 19) & (luhn_sum(d) % 10 == 0), refill(m, made)).otherwise(m)

    return _let(_digits(m), of)


def _mod97(text: Column) -> Column:
    """Remainder of letters and digits, letters counting from 10 as in IBANs."""

    def step(r: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.when(digit, (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    def of(plain: Column) -> Column:
        land, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        valid = _mod97(F.concat(account, F.substring(plain, 1, 4))) == 1
        made = _let(
            permute_letters(account, key, "iban"),
            lambda x: F.concat(land, _pad(98 - _mod97(F.concat(x, land, F.lit("00"))), 2), x),
        )
        spaced = lambda x: F.when(
            F.instr(m, " ") > 0, F.rtrim(F.regexp_replace(x, "(.{4})", "$1 "))
        ).otherwise(x)
        return F.when(valid & (F.length(plain) >= 15), spaced(made)).otherwise(m)

    return _let(F.replace(m, F.lit(" "), F.lit("")), of)


_FIRST_DAY, _DAYS = "1800-01-01", 146_097  # the 400 years of one whole calendar cycle
_DAYS_A, _DAYS_B = 189, 773


def _date(m: Column, key: str) -> Column:
    sep = F.regexp_extract(m, "([-/.])", 1)
    at = lambda k: F.element_at(F.split(m, "[-/.]"), k)
    two = lambda k: F.lpad(at(k), 2, "0")
    year_first = m.rlike("^[0-9]{4}")
    month_first = ~year_first & (two(1) <= "12") & ((sep == "/") | (two(2) > "12"))
    iso = (
        F.when(year_first, F.concat(at(1), two(2), two(3)))
        .when(month_first, F.concat(at(3), two(1), two(2)))
        .otherwise(F.concat(at(3), two(2), two(1)))
    )
    bare = F.length(m) < 10  # without leading zeros

    def of(day: Column) -> Column:
        made = _halves(
            F.floor(day / _DAYS_B),
            day % _DAYS_B,
            F.lit(_DAYS_A).cast("long"),
            F.lit(_DAYS_B).cast("long"),
            key,
            "date",
            lambda s: F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["l"] * _DAYS_B + s["r"]).cast("int")),
        )
        part = lambda p, x: F.date_format(x, p)
        text = _let(
            made,
            lambda x: F.when(year_first, F.concat_ws(sep_of, part("yyyy", x), part("MM", x), part("dd", x)))
            .when(month_first, F.concat_ws(sep_of, part("MM", x), part("dd", x), part("yyyy", x)))
            .otherwise(F.concat_ws(sep_of, part("dd", x), part("MM", x), part("yyyy", x))),
        )
        shown = F.when(bare, F.regexp_replace(text, f"(^|{sep_of})0", "$1")).otherwise(text)
        return F.when((day >= 0) & (day < _DAYS), F.replace(shown, F.lit(sep_of), sep)).otherwise(m)

    sep_of = "~"
    day = F.datediff(F.try_to_timestamp(iso, F.lit("yyyyMMdd")).cast("date"), F.lit(_FIRST_DAY).cast("date")).cast("long")
    return _let(day, of)


def _ip(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        n = F.transform(o, lambda x: x.cast("int"))
        get = lambda k: F.element_at(n, k)
        made = _halves(
            get(1) * 256 + get(2),
            get(3) * 256 + get(4),
            F.lit(65536).cast("long"),
            F.lit(65536).cast("long"),
            key,
            "ip",
            lambda s: F.concat_ws(
                ".",
                F.floor(s["l"] / 256).cast("string"),
                (s["l"] % 256).cast("string"),
                F.floor(s["r"] / 256).cast("string"),
                (s["r"] % 256).cast("string"),
            ),
        )
        return F.when(F.forall(o, lambda x: (x.cast("int") <= 255) & ((x == "0") | ~x.startswith("0"))), made).otherwise(m)

    return _let(F.split(m, r"\."), of)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""

    def of(d: Column) -> Column:
        area, group, serial = F.substring(d, 1, 3).cast("int"), F.substring(d, 4, 2).cast("int"), F.substring(d, 6, 4).cast("int")
        place = F.when(area > 666, area - 2).otherwise(area - 1)

        def finish(s: Column) -> Column:
            return _let(
                F.floor(s["l"] / 99),
                lambda p: F.concat_ws(
                    "-", _pad(F.when(p >= 665, p + 2).otherwise(p + 1), 3), _pad(s["l"] % 99 + 1, 2), _pad(s["r"] + 1, 4)
                ),
            )

        made = _halves(place * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn", finish)
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        return F.when(valid, made).otherwise(m)

    return _let(_digits(m), of)


# Calling codes of one and two digits; all others have three.
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"


def _phone(m: Column, key: str) -> Column:
    """The calling code stays, read from the digits alone: a number gets the same digits however it is spaced."""
    head = F.regexp_extract(m, rf"^(\+(?:{_COUNTRY})|1[ .-])?", 0)

    def of(h: Column) -> Column:
        body = F.substring(m, F.length(h) + 1, F.length(m))

        def made(d: Column) -> Column:
            # Ten digits in the North American plan: area and exchange start with 2 to 9.
            exchange = F.substring(d, 4, 3).cast("int") - 200
            planned = _halves(
                (F.substring(d, 1, 3).cast("int") - 200) * 100 + F.substring(d, 9, 2).cast("int"),
                exchange * 100 + F.substring(d, 7, 2).cast("int"),
                F.lit(80_000).cast("long"),
                F.lit(80_000).cast("long"),
                key,
                "phone",
                lambda s: F.concat(
                    (F.floor(s["l"] / 100) + 200).cast("string"),
                    (F.floor(s["r"] / 100) + 200).cast("string"),
                    _pad(s["r"] % 100, 2),
                    _pad(s["l"] % 100, 2),
                ),
            )
            plan = (F.length(d) == 10) & d.rlike("^[2-9]..[2-9]") & h.isin("", "+1", "1 ", "1.", "1-")
            abroad = h.startswith("+") & (F.length(d) >= 5) & (F.length(d) <= 14)
            return (
                F.when(plan, F.concat(h, refill(body, planned)))
                .when(abroad, F.concat(h, refill(body, permute_digits(d, key, "phone"))))
                .otherwise(m)
            )

        return _let(_digits(body), made)

    return _let(head, of)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_letters(local, key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: str = EXAMPLE_KEY) -> Column:
    """The replacement of one found value; the value itself if it is not valid."""
    whole = lambda kind: m.rlike(f"^(?:{_KINDS[kind]})$")
    return (
        F.when(whole("email"), _email(m, key))
        .when(whole("iban") & m.rlike("^[A-Z]"), _iban(m, key))
        .when(whole("date"), _date(m, key))
        .when(whole("ip"), _ip(m, key))
        .when(whole("ssn"), _ssn(m, key))
        .when(whole("card"), _card(m, key))
        .otherwise(_phone(m, key))
    )


def replace_all(text: Column, key: str = EXAMPLE_KEY) -> Column:
    """struct(text, n_found, n_replaced) of a text; null for a null text."""

    def of(found: Column) -> Column:
        made = F.transform(found, lambda m: pseudonym(m, key))

        def joined(new: Column) -> Column:
            gaps = F.split(text, PATTERN)
            parts = F.flatten(F.zip_with(gaps, new, lambda g, n: F.array(g, F.coalesce(n, F.lit("")))))
            changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
            return F.struct(
                F.array_join(parts, "").alias("text"), F.size(found).cast("long").alias("n_found"), changed.cast("long").alias("n_replaced")
            )

        return _let(made, joined)

    none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_found"), F.lit(0).cast("long").alias("n_replaced"))
    return F.when(text.rlike(_HINT), _let(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), of)).otherwise(none)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = EXAMPLE_KEY) -> DataFrame:
    """The documents, with every valid value in ``text_col`` replaced; columns and rows stay as they are."""
    return docs.withColumn(text_col, replace_all(F.col(text_col).cast("string"), key)["text"])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = EXAMPLE_KEY) -> DataFrame:
    """One row per document: doc_id, the new text, values found and values replaced."""
    d = docs.select(F.col(id_col).alias("doc_id"), replace_all(F.col(text_col).cast("string"), key).alias("r"))
    return d.select("doc_id", "r.text", "r.n_found", "r.n_replaced")
