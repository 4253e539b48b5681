"""Format-preserving pseudonyms for numbers and dates, in DataFrame operations only.

Numbers and dates are found by pattern and validated. A valid one is a place
in a finite domain of its kind, Z_p x Z_q, and a keyed Feistel network permutes
that domain: a to a + f(b) mod p, then b to b + f(a) mod q, in turns. So its
pseudonym is valid in the same format, equal values stay equal in all
documents, and who has the key can undo it.

    card    13 to 19 digits that pass the Luhn check; the check digit is renewed
    phone   ten digits, in groups; a country code +1 stays
    ssn     nnn-nn-nnnn with a valid area, group and serial number
    ipv4    four numbers up to 255
    date    from 1800-01-01 to 2199-12-31, which are 189 * 773 days. With slashes the
            month is first where that is valid; the others (days after the 12th,
            day first) are 9 * 9833 days of their own
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import prepare

ROUNDS = 10
FIRST_DAY, DAYS_P, DAYS_Q = "1800-01-01", 189, 773
DAY_FIRST_P, DAY_FIRST_Q = 9, 9833
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999

#: What may be a number or date to replace; the first alternative that fits is its kind.
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
CARD = r"\d(?:[ -]?\d){12,18}"
#: Addresses may stand in URLs and before a prefix length, ISO dates before a time.
FOUND = (
    rf"(?<![\w.+-]){IPV4}(?![\w-])|(?<![\w.+/-])\d{{4}}-\d{{2}}-\d{{2}}(?=T\d)"
    rf"|(?<![\w.+/-])(?:{DATE}|{SSN}|{PHONE}|{CARD})(?![\w/-])"
)

DATE_FORMATS = {
    r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd",
    r"^\d{2}\.\d{2}\.\d{4}$": "dd.MM.yyyy",
    r"^\d{2}/\d{2}/\d{4}$": "MM/dd/yyyy",
}


def _feistel(a: Column, b: Column, p: Column, q: Column, key: str, kind: str, undo: bool) -> Column:
    """The struct (a, b) that the place (a, b) of Z_p x Z_q becomes."""

    def f(x: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), p, q, i, x), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    sign = -1 if undo else 1

    def step(s: Column, i: Column) -> Column:
        one = F.struct(F.pmod(s["a"] + sign * (f(s["b"], i) % p), p).alias("a"), s["b"].alias("b"))
        other = F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * (f(s["a"], i) % q), q).alias("b"))
        return F.when(i % 2 == 0, one).otherwise(other)

    order = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*(F.lit(i) for i in order)), start, step)


def _digits(number: Column, width: Column) -> Column:
    return F.call_function("lpad", number.cast("string"), width, F.lit("0"))


def _permuted_digits(digits: Column, key: str, kind: str, undo: bool) -> Column:
    """A string of up to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    rest = n - half
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    s = _feistel(
        F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1, rest).cast("long"),
        power(half), power(rest), key, kind, undo,
    )
    return F.concat(_digits(s["a"], half), _digits(s["b"], rest))


def _in_format(found: Column, digits: Column) -> Column:
    """``found`` with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        put = F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
        keep = F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))
        return F.when(c.between("0", "9"), put).otherwise(keep)

    return F.aggregate(F.split(found, ""), start, step, lambda s: s["out"])


def _only_digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _card(found: Column, key: str, undo: bool) -> Column:
    digits = _only_digits(found)
    body = _permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", undo)
    check = F.filter(
        F.array(*(F.lit(str(d)) for d in range(10))), lambda d: F.call_function("luhn_check", F.concat(body, d))
    )
    return F.when(F.call_function("luhn_check", digits), _in_format(found, F.concat(body, F.element_at(check, 1))))


def _phone(found: Column, key: str, undo: bool) -> Column:
    digits = _only_digits(found)
    own = F.call_function("right", digits, F.lit(10))
    code = F.substr(digits, F.lit(1), F.length(digits) - 10)
    return _in_format(found, F.concat(code, _permuted_digits(own, key, "phone", undo)))


def _ssn(found: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.split_part(found, F.lit("-"), F.lit(k)).cast("long") for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    s = _feistel(
        area - F.when(area > 666, 2).otherwise(1), (group - 1) * SSN_SERIALS + serial - 1,
        F.lit(SSN_AREAS), F.lit(SSN_GROUPS * SSN_SERIALS), key, "ssn", undo,
    )
    new = s["a"] + F.when(s["a"] >= 665, 2).otherwise(1)
    return F.when(
        valid,
        F.concat_ws(
            "-",
            _digits(new, F.lit(3)),
            _digits(F.floor(s["b"] / SSN_SERIALS) + 1, F.lit(2)),
            _digits(s["b"] % SSN_SERIALS + 1, F.lit(4)),
        ),
    )


def _ipv4(found: Column, key: str, undo: bool) -> Column:
    parts = [F.split_part(found, F.lit("."), F.lit(k)).cast("long") for k in (1, 2, 3, 4)]
    valid = F.greatest(*parts) <= 255
    # Numbers with leading zeros are no canonical addresses; they could not be undone.
    plain = ~found.rlike(r"(^|\.)0\d")
    s = _feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), key, "ipv4", undo)
    new = [F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256]
    return F.when(valid & plain, F.concat_ws(".", *(n.cast("string") for n in new)))


def _date(found: Column, key: str, undo: bool) -> Column:
    out = F.lit(None).cast("string")
    for pattern, form in DATE_FORMATS.items():
        day = F.datediff(F.try_to_timestamp(found, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        s = _feistel(F.floor(day / DAYS_Q), day % DAYS_Q, F.lit(DAYS_P), F.lit(DAYS_Q), key, "date", undo)
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS_Q + s["b"]).cast("int"))
        inside = day.between(0, DAYS_P * DAYS_Q - 1)
        made = F.when(inside, F.date_format(new, form))
        if form == "MM/dd/yyyy":
            made = F.when(day.isNotNull(), made).otherwise(_day_first(found, key, undo))
        out = F.when(found.rlike(pattern), made).otherwise(out)
    return out


def _day_first(found: Column, key: str, undo: bool) -> Column:
    """The pseudonym of a date dd/MM/yyyy after the 12th, again such a date."""
    first = F.lit(FIRST_DAY).cast("date")
    date = F.try_to_timestamp(found, F.lit("dd/MM/yyyy")).cast("date")
    # The days up to the 12th of this month and those before are left out.
    place = F.datediff(date, first) - 12 * (_month(date) + 1)
    inside = (F.dayofmonth(date) > 12) & F.year(date).between(1800, 2199)
    s = _feistel(F.floor(place / DAY_FIRST_Q), place % DAY_FIRST_Q, F.lit(DAY_FIRST_P), F.lit(DAY_FIRST_Q), key, "day-first", undo)
    new = s["a"] * DAY_FIRST_Q + s["b"]
    about = F.floor(new * 4800 / (DAY_FIRST_P * DAY_FIRST_Q)).cast("int")  # months, nearly
    candidates = F.transform(
        F.array(*(F.lit(k) for k in range(-2, 3))),
        lambda k: F.struct((about + k).alias("m"), F.date_add(first, (new + 12 * (about + k + 1)).cast("int")).alias("d")),
    )
    right = F.filter(candidates, lambda c: (_month(c["d"]) == c["m"]) & (F.dayofmonth(c["d"]) > 12))
    return F.when(inside, F.date_format(F.try_element_at(right, F.lit(1))["d"], "dd/MM/yyyy"))


def _month(date: Column) -> Column:
    return (F.year(date) - 1800) * 12 + F.month(date) - 1


KINDS = {"ipv4": (IPV4, _ipv4), "date": (DATE, _date), "ssn": (SSN, _ssn), "phone": (PHONE, _phone), "card": (CARD, _card)}


def pseudonym(found: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of what ``FOUND`` found; null where it is not valid."""
    out = F.lit(None).cast("string")
    for pattern, make in reversed(list(KINDS.values())):
        out = F.when(found.rlike(f"^(?:{pattern})$"), make(found, key, undo)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """doc_id, n_found, n_replaced and text of every row of ``docs`` (doc_id, text).

    ``key`` is the secret; with ``undo`` the pseudonyms become the values
    again. Found are all places of the pattern, replaced those that are valid.
    A null text stays null and has none. Repeated rows are returned each.
    Extra columns are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = F.coalesce(F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)), F.array().cast("array<string>"))
    new = own.withColumn("found", found).withColumn("new", F.transform("found", lambda m: pseudonym(m, key, undo)))
    between = F.split("text", FOUND)
    put = F.zip_with("found", "new", lambda old, made: F.coalesce(made, old))
    joined = F.array_join(
        F.flatten(F.zip_with(between, F.array_append(put, ""), lambda gap, value: F.array(gap, value))), ""
    )
    return new.select(
        "doc_id",
        F.size("found").cast("long").alias("n_found"),
        F.size(F.filter("new", lambda m: m.isNotNull())).cast("long").alias("n_replaced"),
        F.when(F.size("found") == 0, F.col("text")).otherwise(joined).alias("text"),
    )
