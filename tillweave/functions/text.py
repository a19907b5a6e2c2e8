"""Column helpers over receipt text. Everything here is a narrow built-in expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tillweave.functions import fixed

MONEY = "decimal(12,2)"


def any_of(words: list[str], whole_words: bool = False) -> str:
    """One alternation for a list of patterns."""
    body = "|".join(words)
    return rf"\b(?:{body})\b" if whole_words else f"(?:{body})"


def quoted(words: list[str]) -> list[str]:
    """Literal words as patterns."""
    return [rf"\Q{w}\E" for w in words]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Computes a value once and uses it many times.

    Inside array lambdas Spark does not share repeated sub-expressions, so a repeated ``lower`` or
    regular expression would run again at every mention.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the literal words occurs; cheaper than one alternation on short text."""
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


def literals(words: list[str]) -> str:
    """A pattern that finds any of the literal words; words that hold another one are left to it.

    Grouped by first letter, so most places of a text are left after a few comparisons. Where no code is generated,
    inside array lambdas, it is cheaper than a long ``contains_any``.
    """
    least = [w for w in words if not any(v != w and v in w for v in words)]
    groups: dict[str, list[str]] = {}
    for word in dict.fromkeys(least):
        groups.setdefault(word[0], []).append(word[1:])
    return "|".join(rf"\Q{first}\E(?:" + "|".join(quoted(rests)) + ")" for first, rests in groups.items())


# --- Fixed values: characters stripped from both ends of a line ---
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def lines(raw: Column) -> Column:
    """Stripped, non-empty lines in order."""
    stripped = F.transform(F.split(raw, "\n"), lambda l: F.btrim(l, F.lit(BLANKS)))
    return F.filter(stripped, lambda l: l != "")


def body(line_array: Column) -> Column:
    """The lines as one text, which whole-text patterns with line anchors run on."""
    return F.array_join(line_array, "\n")


def rows(clean: Column) -> Column:
    """Each line of a cleaned text beside its lower-cased form."""
    both = F.zip_with(
        F.split(clean, "\n"),
        F.split(F.lower(clean), "\n"),
        lambda line, low: F.struct(line.alias("line"), low.alias("low")),
    )
    return F.when(clean == "", F.array().cast("array<struct<line:string,low:string>>")).otherwise(both)


def rows_with(clean: Column, pattern: str) -> Column:
    """The ``rows`` of a cleaned text whose line holds the pattern, found by one scan of the whole text.

    Only these lines are looked at one by one, which costs far more than the scan. In the pattern only a newline ends a line.
    """
    found = all_matches(clean, rf"(?dm)^(?=.*?(?:{pattern})).+$")
    return F.transform(found, lambda line: F.struct(line.alias("line"), F.lower(line).alias("low")))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of the pattern, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def last_of(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def first_of(values: Column) -> Column:
    return F.get(values, F.lit(0))


def case_rules(text: Column, rules: list[tuple]) -> Column:
    """First rule (label, pattern) whose pattern is found in the text, else null.

    A rule may add words of which any find of its pattern holds one; they are cheaper to look for first.
    """
    out = F.lit(None).cast("string")
    for label, pattern, *words in reversed(rules):
        found = contains_any(text, *words) & text.rlike(pattern) if words else text.rlike(pattern)
        out = F.when(found, F.lit(label)).otherwise(out)
    return out


def labels_for(rules: list[tuple[Column, str]], empty_label: str | None = None) -> Column:
    """The labels whose condition holds, in rule order, as an array."""
    tagged = F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in rules]))
    if empty_label is None:
        return tagged
    return F.when(F.size(tagged) == 0, F.array(F.lit(empty_label))).otherwise(tagged)


def amount(line: Column) -> Column:
    """Amount of a labelled line: the last ``$n`` with no gap, else a number ending the line.

    Thousands separators and a leading minus are understood.
    """
    marked = last_of(all_matches(line, r"(?:(?<!\w)-)?\$-?\d[\d,]*(?:\.\d{2})?"))
    ending = F.regexp_extract(line, r"((?:(?<!\w)-)?\d[\d,]*(?:\.\d{2})?)\s*$", 1)
    return F.translate(F.coalesce(marked, ending), "$,", "").try_cast(MONEY)


def day_of(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts, null when there is no such day."""
    return F.try_make_timestamp_ntz(
        years=year, months=month, days=day, hours=F.lit(0), mins=F.lit(0), secs=F.lit(0)
    ).cast("date")


_MONTH_NUMBERS = ", ".join(f"'{word}', {n}" for n, spellings in enumerate(fixed.MONTH_WORDS, 1) for word in spellings.split("|"))


def month_number(word: Column) -> Column:
    """Month number of an English month word in any case, null otherwise."""
    return F.try_element_at(F.expr(f"map({_MONTH_NUMBERS})"), F.lower(word))
