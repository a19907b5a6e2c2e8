"""Merchant names: normal form, names mentioned in questions, matching against known names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from tillweave.functions import fixed, text as tx


def normalise(name: Column) -> Column:
    """Lower case, letters, digits and single spaces only, one trailing type word removed."""
    plain = F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", "")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.coalesce(F.trim(F.regexp_replace(plain, rf"\s+{tx.any_of(fixed.NAME_SUFFIXES)}$", "")), F.lit(""))


_CUT = rf"(?is)\s+{tx.any_of(fixed.NAME_CUT_WORDS)}\s+.*$"


def by_preposition(question: Column) -> Column:
    """Capitalised runs after a preposition, cut at the first time or place word."""
    none = F.array().cast("array<string>")
    runs = [
        F.when(
            question.contains(p),
            F.regexp_extract_all(question, F.lit(rf"\b{p}\s+([A-Z][A-Za-z0-9\s.&']+)"), F.lit(1)),
        ).otherwise(none)
        for p in fixed.PREPOSITIONS
    ]
    found = F.concat(*runs)
    cut = F.transform(
        found, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), _CUT, ""), r"[.,;!?\s]+$", "")
    )
    return F.filter(cut, lambda c: (F.length(c) > 2) & ~F.lower(c).isin(fixed.ARTICLES))


def tokens(question: Column) -> Column:
    """Candidate names: capitalised runs and capitalised words of each delimited part."""
    parts = F.split(question, r"[,;.!?]|\s+(?:and|or|in|at|from)\s+")
    runs = F.transform(
        parts, lambda p: F.regexp_extract_all(p, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0))
    )
    words = F.transform(
        parts, lambda p: F.regexp_extract_all(p, F.lit(r"(?<!\S)[A-Z]\S{2,}"), F.lit(0))
    )
    return F.array_distinct(F.concat(F.flatten(runs), F.flatten(words)))


def _dedupe(names: Column) -> Column:
    """One spelling per normal form, the first one, in order of appearance."""
    keyed = F.transform(
        names, lambda n, i: F.struct(normalise(n).alias("key"), i.alias("pos"), F.trim(n).alias("name"))
    )
    ordered = F.array_sort(keyed)
    shifted = F.concat(
        F.array(F.lit(None).cast("struct<key:string,pos:int,name:string>")),
        F.slice(ordered, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))),
    )
    firsts = F.array_compact(
        F.zip_with(
            ordered,
            shifted,
            lambda a, b: F.when(a.isNotNull() & (b.isNull() | (a["key"] != b["key"])), F.struct(a["pos"].alias("pos"), a["name"].alias("name"))),
        )
    )
    return F.transform(F.array_sort(firsts), lambda f: f["name"])


_STOP = sorted(set(fixed.TIME_WORDS + fixed.CATEGORY_WORDS))
_DATE_LIKE = rf"(?i)^\s*\b(?:{'|'.join(fixed.MONTH_WORDS)})\s+\d{{4}}\b"


def keep_names(names: Column) -> Column:
    """Candidates that are neither time words, category words nor a month with a year."""
    return F.filter(
        names,
        lambda n: (F.length(F.trim(n)) >= 2) & ~F.lower(F.trim(n)).isin(_STOP) & ~n.rlike(_DATE_LIKE),
    )


def known_names(receipts: DataFrame, name: str = "merchant_name") -> DataFrame:
    """The corpus: distinct names with their normal form."""
    return (
        receipts.filter(F.col(name).isNotNull() & (F.col(name) != ""))
        .select(F.col(name).alias("name"))
        .distinct()
        .withColumn("name_norm", normalise(F.col("name")))
    )


def corpus_size(receipts: DataFrame, name: str = "merchant_name") -> DataFrame:
    return known_names(receipts, name).agg(F.count(F.lit(1)).alias("corpus_size"))


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity of two strings, 2 * matched / total length."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.lit(1.0) - F.levenshtein(a, b) / longest


def _grams(column: Column) -> Column:
    """Distinct 3-letter substrings."""
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(column) - 2, F.lit(1))),
            lambda i: F.substring(column, i, F.lit(3)),
        )
    )


# --- q-gram index ----------------------------------------------------------------------------
#
# Two measures, each with a necessary condition on shared q-grams. Names are padded, so that ends count:
#
# edit    1 - edits / max(len) >= t: at most d = (1 - t) * max(len) edits, each of which spoils q grams at most.
#         q = 3, two pads at either end: len + 2 grams, of which max(len) + 2 - 3 d are shared.
# blocks  2 * matched / (len a + len b) >= t: at most D = (1 - t) * (len a + len b) letters are unmatched, which
#         leave the matched ones in at most D + 1 runs. q = 2, one pad at either end: the matched letters and both
#         pads share (len a + len b - D) / 2 + 1 - D grams.
#
# Shared grams keep within d or D places of each other. A name's grams are sorted by frequency, rarest first; of two
# names that share T grams the rarest shared one is not among the last T - 1 of either, so it suffices to
# look up all but those (the prefix), and pairs whose shared gram stands later than that are not candidates.

_QGRAM = {"edit": 3, "blocks": 2}


def _positional_grams(names: DataFrame, name: str, measure: str) -> DataFrame:
    """(name, len, letters, gram, pos): padded q-grams, and a bit for each letter and how often it occurred."""
    q = _QGRAM[measure]
    padded = F.concat(F.lit("\x01" * (q - 1)), F.col(name), F.lit("\x02" * (q - 1)))
    at = F.sequence(F.lit(1), F.length(name) + (q - 1))
    grams = F.transform(at, lambda i: F.struct(F.substring(padded, i, F.lit(q)).alias("gram"), i.alias("pos")))
    return names.select(
        name, F.length(name).alias("len"), _letter_bits(F.col(name)).alias("letters"), F.inline(grams)
    )


def _letter_bits(name: Column) -> Column:
    """64 bits that stand for letters with their counts: the k-th occurrence of a letter sets one of them.

    A letter that another name lacks, or has less often, sets a bit that the other doesn't set, or the same bit as
    another one; so the bits of one alone never outnumber the letters of one alone.
    """
    letters = F.array_sort(F.split(name, ""))
    place = lambda c, i: F.pmod(F.hash(c, i - F.array_position(letters, c)), F.lit(64)).cast("int")
    bit = F.transform(letters, lambda c, i: F.call_function("shiftleft", F.lit(1).cast("long"), place(c, i)))
    return F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _least_shared(measure: str, a: Column, b: Column, threshold: float) -> tuple[Column, Column]:
    """How many grams two names of these lengths share at least, and how far apart shared grams are at most."""
    miss = 1.0 - threshold
    if measure == "edit":
        longest = F.greatest(a, b)
        edits = F.floor(longest * miss + 1e-9)
        return longest + 2 - 3 * edits, edits
    unmatched = F.floor((a + b) * miss + 1e-9)
    return F.ceil((a + b - unmatched) / 2) + 1 - unmatched, unmatched


def gram_index(names: DataFrame, name: str, rarity: DataFrame, measure: str) -> DataFrame:
    """Grams of every name with ``rank``, their place from the rarest on, and ``n``, how many the name has."""
    own = Window.partitionBy(name)
    grams = _positional_grams(names, name, measure).join(rarity, "gram", "left")
    order = own.orderBy(F.coalesce("freq", F.lit(0)), "gram", "pos")
    return grams.withColumns({"rank": F.row_number().over(order), "n": F.col("len") + (_QGRAM[measure] - 1)}).drop("freq")


def candidates(toks: DataFrame, names: DataFrame, measure: str, threshold: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """Pairs (token_norm, name_norm) that can reach the threshold; no pair that does is missing.

    They meet on a gram of both prefixes, at places and lengths that allow the similarity; the letters and then
    the edit distance bound it from above. The threshold must be above 2/3: below, pairs need share no gram.
    """
    if threshold <= 2 / 3:
        raise ValueError("similar names need not share grams at thresholds up to 2/3")
    rarity = _positional_grams(names.select("name_norm"), "name_norm", measure).groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    shortest = threshold if measure == "edit" else threshold / (2.0 - threshold)

    def prefix(rows: DataFrame, name: str, tag: str) -> DataFrame:
        index = gram_index(rows.select(name), name, rarity, measure)
        # Without rounding, shared grams grow with the partner's length, so the shortest partner has the least.
        per_letter = 1.0 - 3 * (1.0 - threshold)
        least = F.col("len") * per_letter + 2 if measure == "edit" else F.col("len") * (1 + shortest) * per_letter / 2 + 1
        kept = index.filter(F.col("rank") <= F.col("n") - F.floor(least - 1e-9) + 1)
        return kept.select(name, "gram", *[F.col(c).alias(f"{c}_{tag}") for c in ("len", "letters", "pos", "rank", "n")])

    t, c = prefix(toks, "token_norm", "t"), prefix(names, "name_norm", "c")
    a, b = F.col("len_t"), F.col("len_c")
    shared, apart = _least_shared(measure, a, b, threshold)
    shared = F.greatest(shared, F.lit(1))
    most = F.least(
        a - F.bit_count(F.col("letters_t").bitwiseAND(F.bitwise_not("letters_c"))), b - F.bit_count(F.col("letters_c").bitwiseAND(F.bitwise_not("letters_t")))
    )
    enough = most >= F.greatest(a, b) * threshold - 1e-9 if measure == "edit" else 2 * most >= (a + b) * threshold - 1e-9
    near = (
        (F.least(a, b) >= F.greatest(a, b) * shortest - 1e-9)
        & (F.abs(F.col("pos_t") - F.col("pos_c")) <= apart)
        & (F.col("rank_t") <= F.col("n_t") - shared + 1)
        & (F.col("rank_c") <= F.col("n_c") - shared + 1)
        & enough
    )
    pairs = t.join(c, "gram").filter(near).select("token_norm", "name_norm").distinct()
    x, y = F.col("token_norm"), F.col("name_norm")
    # Letters outside of the matching blocks turn one string into the other, so edits never outnumber them.
    room = F.greatest(F.length(x), F.length(y)) if measure == "edit" else F.length(x) + F.length(y)
    return pairs.filter(F.levenshtein(x, y) <= room * (1.0 - threshold) + 1e-9)


def _contained(inner: DataFrame, inner_text: str, outer: DataFrame, outer_text: str) -> DataFrame:
    """Pairs where the inner text occurs in the outer one.

    They meet on the inner text's rarest 3-gram among the outer texts, so a gram that most texts
    share is never a key; an inner text with a gram no outer text has meets nothing.
    """
    outer_grams = outer.select(outer_text, F.explode(_grams(F.col(outer_text))).alias("_g"))
    counts = outer_grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        inner.select(inner_text, F.explode(_grams(F.col(inner_text))).alias("_g"))
        .join(counts, "_g", "left")
        .groupBy(inner_text)
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_r"))
        .filter(F.col("_r.n") > 0)
        .select(inner_text, F.col("_r._g").alias("_g"))
    )
    return rarest.join(outer_grams, "_g").filter(F.col(outer_text).contains(F.col(inner_text))).drop("_g")


def best_matches(
    toks: DataFrame, corpus: DataFrame, token: str = "token", measure: str = "blocks",
    threshold: float = fixed.MIN_SIMILARITY,
) -> DataFrame:
    """Best known name of every distinct token: ``(token_norm, name, score)``.

    A token and a name score their similarity, raised to 0.9 when one contains the other. ``measure`` is ``blocks``
    (matching blocks, Arrow batches over the pairs that pass every bound) or ``edit`` (JVM only). Only candidates
    of the q-gram index and contained names are scored, which loses no pair above the threshold.
    """
    typed = (
        toks.filter(F.length(token) >= fixed.MIN_TOKEN_LENGTH)
        .select(normalise(F.col(token)).alias("token_norm"))
        .filter(F.length("token_norm") >= fixed.MIN_TOKEN_LENGTH)
        .distinct()
    )
    names = (
        corpus.groupBy("name_norm").agg(F.min("name").alias("name")).filter(F.length("name_norm") >= 3)
    )
    # An equal name scores one, which nothing can beat, so such tokens need no candidates.
    same = F.col("token_norm") == F.col("name_norm")
    equal = typed.join(names, same).select("token_norm", "name", F.lit(1.0).alias("score"))
    typed = typed.join(names.select("name_norm"), same, "left_anti")
    pairs = (
        candidates(typed, names, measure, threshold)
        .unionByName(_contained(typed, "token_norm", names, "name_norm"))
        .unionByName(_contained(names, "name_norm", typed, "token_norm"))
        .distinct()
        .join(names, "name_norm")
    )
    a, b = F.col("token_norm"), F.col("name_norm")
    ratio = edit_ratio(a, b) if measure == "edit" else block_ratio(a, b)
    contained = a.contains(b) | b.contains(a)
    scored = pairs.withColumn("_ratio", ratio).withColumn(
        "score", F.when(contained, F.greatest("_ratio", F.lit(fixed.CONTAINMENT_SCORE))).otherwise(F.col("_ratio"))
    )
    best = (
        scored.filter(F.col("score") >= threshold - 1e-12)
        .groupBy("token_norm")
        .agg(F.min(F.struct((-F.col("score")).alias("neg"), "name")).alias("_best"))
    )
    scored_best = best.select("token_norm", F.col("_best.name").alias("name"), (-F.col("_best.neg")).alias("score"))
    return equal.unionByName(scored_best)


def with_prepositions(questions: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``merchants`` from prepositions alone; narrow."""
    return questions.withColumn("merchants", _dedupe(keep_names(by_preposition(F.col(text)))))


def extract_merchants(
    questions: DataFrame, corpus: DataFrame | None = None, question_id: str = "question_id",
    text: str = "text", measure: str = "blocks",
) -> DataFrame:
    """Adds ``merchants``: names after prepositions, else fuzzy matches against the corpus."""
    direct = with_prepositions(questions, text)
    if corpus is None:
        return direct
    open_ = direct.filter(F.size("merchants") == 0).select(
        question_id, F.posexplode(tokens(F.col(text))).alias("_pos", "token")
    ).withColumn("token_norm", normalise(F.col("token")))
    best = best_matches(open_, corpus, measure=measure)
    # One question names few merchants; the array is bounded by its own text.
    found = (
        open_.join(best, "token_norm")
        .groupBy(question_id)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "name"))).alias("_found"))
        .select(question_id, F.transform("_found", lambda f: f["name"]).alias("_found"))
    )
    joined = direct.join(found, question_id, "left")
    fuzzy = _dedupe(keep_names(F.coalesce("_found", F.array().cast("array<string>"))))
    return joined.withColumn(
        "merchants", F.when(F.size("merchants") > 0, F.col("merchants")).otherwise(fuzzy)
    ).drop("_found")


def resolve_names(
    params: DataFrame, corpus: DataFrame, question_id: str = "question_id", measure: str = "blocks"
) -> DataFrame:
    """Replaces merchants that equal no known name by their best known match.

    Equality of normal forms comes first; the rest, such as a chain's short name, goes through the
    fuzzy match with its containment rule. A name without any match stays as it is.
    """
    listed = params.select(question_id, F.posexplode("merchants").alias("_pos", "_name")).withColumn(
        "token_norm", normalise(F.col("_name"))
    )
    known = corpus.groupBy("name_norm").agg(F.min("name").alias("_same"))
    seen = listed.join(known, F.col("token_norm") == F.col("name_norm"), "left").drop("name_norm")
    best = best_matches(seen.filter(F.col("_same").isNull()), corpus, "_name", measure)
    named = seen.join(best.select("token_norm", F.col("name").alias("_near")), "token_norm", "left")
    final = F.struct("_pos", F.coalesce("_same", "_near", "_name").alias("name"))
    # One question names few merchants; the array is bounded by its own text.
    merged = named.groupBy(question_id).agg(F.array_sort(F.collect_list(final)).alias("_m"))
    joined = params.join(merged, question_id, "left")
    resolved = F.transform("_m", lambda m: m["name"])
    return joined.withColumn("merchants", F.coalesce(resolved, F.col("merchants"))).drop("_m").select(*params.columns)
