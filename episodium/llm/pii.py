"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their check (card numbers by check digit, telephone numbers and IPv4
addresses by form, dates by calendar), addresses of e-mail and hexadecimal secrets are replaced by a
keyed Feistel permutation of their own format.  The permutation depends on the key, the kind and the
value alone, so equal values stay equal in all documents and different ones stay different.

Strings are cut in two halves; in turn each half is shifted, character by character within its
class (digit, lower-case letter, ...), by a digest of the other.  Addresses and dates are numbers of
a domain A x B, whose two parts are shifted in turn modulo A and B.  Eight rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodium.functions.text import let
from episodium.llm.common import column

ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
LATIN_LOWER, LATIN_UPPER = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: 400 years of the calendar are 146,097 days = 189 x 773; the first of them.
DAYS_A, DAYS_B, FIRST_DAY = 189, 773, "1800-01-01"

# The forms that are looked for; the first that fits at a place counts.  Each starts at
# the beginning of a run of its characters only, and no group is repeated, so that a run of any
# length is walked once and without recursion.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[._%+-]*+[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
IPV4 = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE_ISO = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])"
DATE_DOT = r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])"
DATE_SLASH = r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9]|/[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9])"
PHONE = r"(?<![0-9])\+[0-9]{1,3} ?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ -]?[0-9]{2,4}){2,3}(?![0-9])"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
PATTERN = "|".join([SECRET, EMAIL, IPV4, DATE_ISO, DATE_DOT, DATE_SLASH, CARD, PHONE])


def _rounds() -> Column:
    return F.array(*[F.lit(i) for i in range(ROUNDS)])


def _digest(key: str, kind: str, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 512)


def _shifted(char: Column, by: Column, classes: list[str]) -> Column:
    """The character moved on within the first class that holds it; others stay."""
    out = char
    for letters in reversed(classes):
        place = F.call_function("locate", char, F.lit(letters))
        moved = F.substring(F.lit(letters), ((place - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))
        out = F.when((char != "") & (place > 0), moved).otherwise(out)
    return out


def feistel_string(value: Column, key: str, kind: str, classes: list[str]) -> Column:
    """``value`` permuted within its format: each character stays in its class."""
    half = F.floor(F.length(value) / 2).cast("int")

    def turned(part: Column, other: Column, turn: Column) -> Column:
        def shifted(digest: Column) -> Column:
            by = lambda i: F.conv(F.substring(digest, ((i % 32) * 4 + 1).cast("int"), F.lit(4)), 16, 10)
            return F.array_join(F.transform(F.split(part, ""), lambda c, i: _shifted(c, by(i).cast("int"), classes)), "")

        # one digest for a half, not one for each of its characters
        return let(_digest(key, kind, turn, other), shifted)

    start = F.struct(
        F.substring(value, F.lit(1), half).alias("a"),
        F.substring(value, half + 1, F.length(value)).alias("b"),
    )
    done = F.aggregate(
        _rounds(),
        start,
        lambda s, turn: F.when(
            turn % 2 == 0, F.struct(turned(s["a"], s["b"], turn).alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(s["a"].alias("a"), turned(s["b"], s["a"], turn).alias("b"))),
        lambda s: F.concat(s["a"], s["b"]),
    )
    return done


def feistel_number(value: Column, key: str, kind: str, a: int, b: int) -> Column:
    """``value`` in 0 .. a * b - 1 permuted within that domain."""

    def shift(other: Column, turn: Column) -> Column:
        return F.conv(F.substring(_digest(key, kind, turn, other.cast("string")), 1, 12), 16, 10).cast("long")

    start = F.struct(F.floor(value / b).cast("long").alias("a"), (value % b).cast("long").alias("b"))
    return F.aggregate(
        _rounds(),
        start,
        lambda s, turn: F.when(
            turn % 2 == 0, F.struct(((s["a"] + shift(s["b"], turn)) % a).alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + shift(s["a"], turn)) % b).alias("b"))),
        lambda s: s["a"] * b + s["b"],
    )


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by those of ``digits``."""
    chars = F.split(form, "")
    return F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.between("0", "9"),
            F.struct(
                F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"),
                (s["at"] + 1).alias("at"),
            ),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )


def _check_digit(body: Column) -> Column:
    """The digit that makes ``body`` and itself pass the card number check."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(body), ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(
                c.cast("int")
            ),
        ),
        F.lit(0),
        lambda s, x: s + x,
    )
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _card(found: Column, key: str) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    body = feistel_string(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", [DIGITS])
    new = F.transform(F.array(body), lambda x: F.concat(x, _check_digit(x)))[0]
    return F.when(F.call_function("luhn_check", digits), _refilled(found, new)).otherwise(found)


def _phone(found: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(found, r"^\+[0-9]{1,3}(?=[ (])|^\+[0-9]", 0)
    rest = F.substring(found, F.length(code) + 1, F.length(found))
    new = feistel_string(F.regexp_replace(rest, "[^0-9]", ""), key, "phone", [DIGITS])
    return F.concat(code, _refilled(rest, new))


def _ipv4(found: Column, key: str) -> Column:
    parts = F.transform(F.split(found, "[.]"), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    new = F.transform(F.array(feistel_number(number, key, "ipv4", 1 << 16, 1 << 16)), lambda n: F.concat_ws(
        ".", *[(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))).cast("string") for i in (3, 2, 1, 0)]
    ))[0]
    return F.when(F.forall(parts, lambda p: p <= 255), new).otherwise(found)


def _date(found: Column, key: str, year: int, month: int, day: int, form: str) -> Column:
    """A date whose year, month and day start at the given places."""
    parts = [(year, 4), (month, 2), (day, 2)]
    real = F.concat_ws("-", *[F.substring(found, at, n) for at, n in parts]).try_cast("date")
    number = F.datediff(real, F.lit(FIRST_DAY).cast("date"))
    new = F.date_add(
        F.lit(FIRST_DAY).cast("date"), feistel_number(number, key, "date", DAYS_A, DAYS_B).cast("int")
    )
    inside = (number >= 0) & (number < DAYS_A * DAYS_B)
    return F.when(inside, F.date_format(new, form)).otherwise(found)


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one match of ``PATTERN``; a value that fails its check stays."""

    def whole(pattern: str) -> Column:
        return F.regexp_like(found, F.lit(f"^(?:{pattern})$"))

    at = F.call_function("locate", F.lit("@"), found)
    # marks before the first letter or digit belong to the text, not to the address
    lead = F.length(F.regexp_extract(found, "^[._%+-]*", 0))
    local = F.substring(found, lead + 1, at - 1 - lead)
    email = F.concat(
        F.substring(found, F.lit(1), lead),
        feistel_string(local, key, "email", [DIGITS, LOWER, UPPER, LATIN_LOWER, LATIN_UPPER]),
        F.substring(found, at, F.length(found)),
    )
    secret = F.when(
        found == F.lower(found), feistel_string(found, key, "secret", [HEX])
    ).otherwise(feistel_string(found, key, "secret", [HEX.upper()]))
    return (
        F.when(at > 0, email)
        .when(whole(SECRET) & (F.length(found) >= 32), secret)
        .when(whole("[0-9]{4}-[0-9]{2}-[0-9]{2}"), _date(found, key, 1, 6, 9, "yyyy-MM-dd"))
        .when(whole("[0-9]{2}[.][0-9]{2}[.][0-9]{4}"), _date(found, key, 7, 4, 1, "dd.MM.yyyy"))
        .when(whole("[0-9]{2}/[0-9]{2}/[0-9]{4}"), _date(found, key, 7, 1, 4, "MM/dd/yyyy"))
        .when(found.contains("."), _ipv4(found, key))
        .when(found.startswith("+"), _phone(found, key))
        .otherwise(_card(found, key))
    )


def pseudonymise(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, n_replaced) for every row of ``docs``.

    ``n_replaced`` counts the values that changed.  A null text stays null with none replaced.
    Repeated rows are treated alike; other columns are not read.  Dates outside 1800 to 2199 and
    dates that do not exist stay as they are, like numbers that fail their check.
    """
    text = F.col("text")
    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    found = F.when(
        text.rlike("[0-9@]") | text.rlike("[a-fA-F]{32}"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    )
    rows = rows.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    rows = rows.withColumn("new", F.transform("found", lambda x: pseudonym(x, key)))
    pieces = F.split(text, PATTERN, -1)
    joined = F.array_join(
        F.zip_with(pieces, F.col("new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), ""
    )
    changed = F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x)
    return rows.select(
        "doc_id",
        F.when(F.size("found") > 0, joined).otherwise(text).alias("text"),
        F.size(changed).cast("long").alias("n_replaced"),
    )
