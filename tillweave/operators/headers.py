"""Header fields of receipt text: merchant, date, tender, contact, staff, references, flags.

Every function takes the cleaned text column (``text.body``) and returns a column. Patterns run
once over the whole text with line anchors, so "first line that matches" is simply the first match.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillweave.functions import fixed, text as tx

_MONTH = "(?:" + "|".join(fixed.MONTH_WORDS) + ")"
_YMD = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"
_MDY = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})$"
_WORD_FIRST = r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
_DAY_FIRST = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
# Cheap scan for anything date-like; each find is then read by its shape.
_ANY_DATE = (
    r"(?<![\d/-])(?:\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}[/-]\d{1,2}[/-](?:\d{4}|\d{2})|\d{1,2}[ \t]+[A-Za-z]{3,9}+[ \t]+\d{4})(?!\d)"
    r"|\b[A-Za-z]{3,9}+[ \t]+\d{1,2},?[ \t]+\d{4}(?!\d)"
)

_STREET = "(?:" + "|".join(fixed.STREET_WORDS) + ")"
_PLACE_LINE = r"[A-Za-z .]+,[ \t]*(?-i:[A-Z]{2})(?:[ \t]+\d{5})?"
# The street line, and the line after it when that is a city line.
_ADDRESS = rf"(?im)^.*?\d+[ \t]+[a-z0-9 \t.\-]+{_STREET}.*$(?:\n{_PLACE_LINE}$)?"
_PLACE = r"([A-Za-z .\t]+),[ \t]*([A-Z]{2})\b[ \t]*(\d{5})?"

UNKNOWN_MERCHANT = "Unknown Merchant"


def merchant(clean: Column) -> Column:
    """First of five lines still longer than 2 characters without a trailing store-type word."""
    words = "|".join(fixed.STORE_TYPE_WORDS)
    head = F.slice(F.split(clean, "\n", 6), 1, 5)
    short = F.transform(head, lambda l: F.regexp_replace(l, rf"(?i)\s+(?:{words})$", ""))
    named = F.get(F.filter(short, lambda n: F.length(n) > 2), F.lit(0))
    return F.coalesce(named, F.nullif(F.get(head, F.lit(0)), F.lit("")), F.lit(UNKNOWN_MERCHANT))


def _parse_day(found: Column) -> Column:
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(found, pattern, group).try_cast("int")

    a, b, year = part(_MDY, 1), part(_MDY, 2), part(_MDY, 3)
    full = F.when(year >= 100, year).when(year < 70, year + 2000).otherwise(year + 1900)
    return (
        F.when(
            found.rlike(r"^[A-Za-z]"),
            tx.day_of(part(_WORD_FIRST, 3), tx.month_number(F.regexp_extract(found, _WORD_FIRST, 1)), part(_WORD_FIRST, 2)),
        )
        .when(found.rlike(r"^\d{4}"), tx.day_of(part(_YMD, 1), part(_YMD, 2), part(_YMD, 3)))
        .when(
            found.rlike(r"[A-Za-z]"),
            tx.day_of(part(_DAY_FIRST, 3), tx.month_number(F.regexp_extract(found, _DAY_FIRST, 2)), part(_DAY_FIRST, 1)),
        )
        # Month first; read day first where the month would be impossible.
        .otherwise(F.coalesce(tx.day_of(full, a, b), tx.day_of(full, b, a)))
    )


def transaction_day(clean: Column) -> Column:
    """First readable date in reading order; null when the text has none."""
    first = tx.let(tx.first_match(clean, _ANY_DATE, 0), _parse_day)
    # Only a text whose first find is no real date is scanned to its end.
    every = F.transform(tx.all_matches(clean, _ANY_DATE), _parse_day)
    return F.coalesce(first, F.get(F.array_compact(every), F.lit(0)))


def payment_method(clean: Column) -> Column:
    return F.coalesce(tx.case_rules(F.lower(clean), fixed.PAYMENT_RULES), F.lit("other"))


def card(clean: Column) -> Column:
    """The first card tender, lower-cased: network, mark and last four digits."""
    return tx.first_match(F.lower(clean), fixed.CARD_PATTERN, 0)


def card_network(found_card: Column) -> Column:
    network = F.regexp_extract(found_card, r"^(visa|mastercard|amex|american express|discover)", 1)
    return F.when(network == "american express", F.lit("amex")).otherwise(network)


def card_last4(found_card: Column) -> Column:
    return F.right(found_card, F.lit(4))


def phone(clean: Column) -> Column:
    return tx.first_match(clean, r"(\(?\d{3}\)?[-. \t]?\d{3}[-. \t]?\d{4})")


def address(clean: Column) -> Column:
    """First street line, joined with a following city line."""
    return F.replace(tx.first_match(clean, _ADDRESS, 0), F.lit("\n"), F.lit(", "))


def place(clean: Column, found_address: Column) -> Column:
    """City, state and zip as text, from the address or else from the first city line."""
    in_address = tx.first_match(found_address, _PLACE, 0)
    return F.coalesce(in_address, tx.first_match(clean, rf"(?m)^({_PLACE_LINE})$", 1))


def place_parts(found_place: Column) -> dict[str, Column]:
    return {
        "merchant_city": F.nullif(F.trim(F.regexp_extract(found_place, _PLACE, 1)), F.lit("")),
        "merchant_state": tx.first_match(found_place, _PLACE, 2),
        "merchant_zip": tx.first_match(found_place, _PLACE, 3),
    }


def staff(clean: Column) -> Column:
    """Text after the first colon of the first staff line that names someone."""
    return tx.first_match(clean, r"(?im)^(?=.*(?:cashier|server|associate):)[^:\n]*:[ \t]*(\S.*)$")


def order_number(clean: Column) -> Column:
    return tx.first_match(clean, r"(?im)^(?=.*order #)[^#\n]*#[ \t]*:?[ \t]*(\S.*)$")


def transaction_id(clean: Column) -> Column:
    return tx.first_match(
        clean, r"(?im)^(?!.*order #)(?=.*transaction id:)[^:\n]*:[ \t]*(\S.*)$"
    )


def store_number(clean: Column) -> Column:
    return tx.first_match(
        clean, r"(?im)^(?!.*(?:order #|transaction id:))(?=.*store #)[^#\n]*#[ \t]*:?[ \t]*(\S.*)$"
    )


def warranty_text(rows: Column) -> Column:
    """Distinct warranty lines in order, joined; null when there are none. Takes ``text.rows``."""
    references = ["order #", "transaction id:", "store #"]
    own = F.filter(rows, lambda r: r["low"].contains("warranty") & ~tx.contains_any(r["low"], references))
    texts = F.array_distinct(F.transform(own, lambda r: r["line"]))
    return F.nullif(F.array_join(texts, " | "), F.lit(""))


def is_return(clean: Column, total: Column) -> Column:
    """Negative total, or refund words outside the phrase "return policy"."""
    words = F.regexp_replace(F.lower(clean), r"return[ \n]policy", "")
    low = F.lower(clean)
    worded = (low.contains("refund") | low.contains("return") | low.contains("credit")) & words.rlike(fixed.RETURN_WORDS)
    return F.coalesce(total < 0, F.lit(False)) | F.coalesce(worded, F.lit(False))
