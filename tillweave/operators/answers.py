"""Questions meet facts: matching, exact audits, evidence and result records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillweave.functions import fixed, text as tx
from tillweave.operators import terms
from tillweave.operators.merchants import normalise
from tillweave.session import stored

# Days since 1970 are shifted so that all of them are positive. A block of level l holds BLOCK_DAYS ** l days.
DAY_SHIFT, LAST_DAY, BLOCK_DAYS, LEVELS = 1 << 22, 1 << 23, 8, 8

FLAGS = ["has_warranty", "is_return", "has_discounts", "has_delivery_fee", "has_tip"]


FILTER_COLUMNS = [
    "start_ts", "end_ts", "month_of_year", "merchants", "categories", "payment_method", "card_network",
    *FLAGS, "min_amount", "max_amount", "sum_basis", "metric",
]


# --- matching --------------------------------------------------------------------------------


def day_number(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("bigint") + DAY_SHIFT


def _last_day(end: Column) -> Column:
    """The day of the last moment before ``end``."""
    return day_number(end - F.expr("INTERVAL '0.000001' SECOND"))


_UP = "least(s.high, shiftright(s.low + 7, 3) * 8)"
_DOWN = f"greatest({_UP}, shiftright(s.high, 3) * 8)"
_DAYS = "if({0} < {1}, sequence({0}, {1} - 1), CAST(array() AS array<bigint>))"


def day_blocks(low: str, high: str) -> Column:
    """Keys of the aligned blocks that make up the days from column ``low`` to before column ``high``.

    Level by level, the numbers up to the next multiple of the block size are taken from either end; what lies between
    goes on as blocks of the next level. So a range has at most 14 keys a level, and a day is in one block of each level.
    """
    return F.expr(
        f"""aggregate(sequence(0, {LEVELS - 1}),
            named_struct('low', {low}, 'high', greatest({low}, {high}), 'keys', CAST(array() AS array<string>)),
            (s, l) -> named_struct('low', shiftright({_UP}, 3), 'high', shiftright({_DOWN}, 3), 'keys', concat(s.keys,
                transform(concat({_DAYS.format('s.low', _UP)}, {_DAYS.format(_DOWN, 's.high')}), x -> concat('d', l, ':', x)))),
            s -> s.keys)"""
    )


def _with_block_keys(ranges: DataFrame) -> DataFrame:
    """Rows with ``_key``, or with the days from ``_low`` to before ``_high``, as one row per key."""
    keys = F.when(F.col("_key").isNotNull(), F.array("_key")).otherwise(day_blocks("_low", "_high"))
    return ranges.withColumn("_key", F.explode(keys)).drop("_low", "_high")


def _ranges_of(start: Column, end: Column, month_of_year: Column) -> Column:
    """(low, high) day ranges, one unless a month of the year is asked for: then one for that month of each year."""
    first, beyond = F.coalesce(day_number(start), F.lit(0)), F.coalesce(_last_day(end) + 1, F.lit(LAST_DAY))
    last = (end - F.expr("INTERVAL '0.000001' SECOND")).cast("date")
    months = F.sequence(F.trunc(start.cast("date"), "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))
    by_month = F.transform(
        F.filter(months, lambda m: F.month(m) == month_of_year),
        lambda m: _range(F.greatest(first, day_number(m)), F.least(beyond, day_number(F.add_months(m, 1)))),
    )
    ranges = F.when(month_of_year.isNull(), F.array(_range(first, beyond))).otherwise(by_month)
    return F.when(F.coalesce(start < end, F.lit(True)), ranges)


def _range(low: Column, high: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("_key"), low.cast("bigint").alias("_low"), high.cast("bigint").alias("_high"))


def _keyed(keys: Column) -> Column:
    nothing = F.lit(None).cast("bigint")
    return F.transform(keys, lambda k: F.struct(k.alias("_key"), nothing.alias("_low"), nothing.alias("_high")))


def with_filter_id(params: DataFrame) -> DataFrame:
    """Adds a key shared by all questions that ask for the same facts."""
    return params.withColumn("filter_id", F.sha2(F.to_json(F.struct(*FILTER_COLUMNS)), 256))


def unique_questions(params: DataFrame) -> DataFrame:
    """One question, the lowest id, per distinct set of filters.

    Many people ask the same thing; matching each distinct question once keeps the work with the
    number of different questions, not with the number of askers.
    """
    first = [F.any_value(c).alias(c) for c in FILTER_COLUMNS]
    return with_filter_id(params).groupBy("filter_id").agg(F.min("question_id").alias("question_id"), *first)


def _tagged(values: Column, tag: str) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{tag}:"), v.cast("string")))


def names_within(params: DataFrame, corpus: DataFrame) -> DataFrame:
    """(asked, name_norm): every asked name with all known names that hold its words side by side.

    ``corpus`` has name_norm. They meet on the asked name's rarest word among the known names.
    """
    asked = params.select(F.explode(F.array_distinct(F.transform("merchants", normalise))).alias("asked")).filter("asked != ''").distinct()
    words = corpus.select("name_norm").distinct().select("name_norm", F.explode(F.array_distinct(F.split("name_norm", " "))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        asked.select("asked", F.explode(F.split("asked", " ")).alias("word"))
        .join(counts, "word", "left")
        .groupBy("asked")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r"))
        .select("asked", F.col("r.word").alias("word"))
    )
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return rarest.join(words, "word").filter(spaced("name_norm").contains(spaced("asked"))).select("asked", "name_norm")


def _merchant_keys(params: DataFrame, names: DataFrame | None) -> DataFrame:
    """One row per question that names merchants and normal form of a name it means."""
    rows = params.filter(F.size("merchants") > 0).withColumn("_name", F.explode(F.array_distinct(F.transform("merchants", normalise))))
    if names is not None:
        meant = names.select(F.col("asked").alias("_name"), F.col("name_norm").alias("_meant"))
        rows = rows.join(meant, "_name", "left").withColumn("_name", F.coalesce("_meant", "_name")).drop("_meant")
        rows = rows.dropDuplicates(["question_id", "_name"])
    return rows.withColumn("_key", F.concat(F.lit("m:"), "_name")).drop("_name")


def question_keys(params: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per question and join key.

    A question uses its most selective filter: merchants, else the blocks of its date range, else
    its month of the year, else its categories, else its payment method, else salts that cover all
    facts, as many as shuffles have partitions. Names are compared in their normal form; with ``names`` (see
    ``names_within``) a name means all known names that hold it.
    """
    starts, ends = F.col("start_ts").isNotNull(), F.col("end_ts").isNotNull()
    ranged = (starts & ends) | ((starts | ends) & F.col("month_of_year").isNull())
    salts = F.sequence(F.lit(0), F.lit(_salts(params) - 1))
    keys = (
        F.when(ranged, _ranges_of(F.col("start_ts"), F.col("end_ts"), F.col("month_of_year")))
        .when(F.col("month_of_year").isNotNull(), _keyed(F.array(F.concat(F.lit("y:"), F.col("month_of_year").cast("string")))))
        .when(F.size("categories") > 0, _keyed(_tagged(F.col("categories"), "c")))
        .when(F.col("payment_method").isNotNull(), _keyed(F.array(F.concat(F.lit("p:"), "payment_method"))))
        .otherwise(_keyed(_tagged(salts, "a")))
    )
    others = params.filter(F.coalesce(F.size("merchants"), F.lit(0)) <= 0).select("*", F.inline(keys))
    return _merchant_keys(params, names).unionByName(_with_block_keys(others))


def _salts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _kinds(keys: DataFrame) -> Column:
    """The kinds of key in use, as one value."""
    return keys.agg(F.collect_set(F.substring_index("_key", ":", 1))).scalar()


def amount_bucket(amount: Column) -> Column:
    """A number that grows with the amount: its cents below one, else its digits and the first two of them."""
    cents = F.floor(F.abs(amount) * 100).cast("bigint")
    digits = F.length(cents.cast("string"))
    size = F.when(cents < 100, cents).otherwise(digits * 100 + F.left(cents.cast("string"), F.lit(2)).cast("bigint"))
    return F.when(amount < 0, -size - 1).otherwise(size)


def fact_keys(facts: DataFrame, fact_id: str, kinds: Column | list[str], amount: str = "total_amount") -> DataFrame:
    """One row per fact and join key, for the kinds of key that the questions use: a list, or an array column."""
    day = day_number(F.col("transaction_date"))
    single = {
        "m": F.col("merchant_name_norm"),
        **{f"d{level}": F.shiftright(day, 3 * level) for level in range(LEVELS)},
        "y": F.month("transaction_date"),
        "p": F.col("payment_method"),
        "v": amount_bucket(F.col(amount)),
        "a": F.pmod(F.xxhash64(fact_id), F.lit(_salts(facts))),
    }
    if isinstance(kinds, list):
        used = lambda kind, key: key
        single, labelled = {kind: key for kind, key in single.items() if kind in kinds}, "c" in kinds
    else:
        facts = facts.withColumn("_kinds", kinds)
        used, labelled = lambda kind, key: F.when(F.array_contains("_kinds", kind), key), True
    keys = F.array(*[used(kind, F.concat(F.lit(f"{kind}:"), key.cast("string"))) for kind, key in single.items()])
    if labelled:
        labels = used("c", F.transform("categories", lambda c: F.concat(F.lit("c:"), c)))
        keys = F.concat(keys, F.coalesce(labels, F.array().cast("array<string>")))
    return facts.withColumn("_key", F.explode(F.array_compact(keys))).drop("_kinds")


def _optional(cond: Column, given: Column) -> Column:
    return F.when(given, F.coalesce(cond, F.lit(False))).otherwise(F.lit(True))


def _same_kind() -> Column:
    """Payment, network, category and flags of a question ``q`` against a fact or cell ``f``."""
    shared = F.array_intersect(F.col("f.categories"), F.col("q.categories"))
    any_asked, any_held = F.lit(False), F.lit(False)
    for name in FLAGS:
        flag = F.coalesce(F.col(f"q.{name}"), F.lit(False))
        any_asked = any_asked | flag
        any_held = any_held | (flag & F.coalesce(F.col(f"f.{name}"), F.lit(False)))
    return (
        _optional(F.size(shared) > 0, F.size("q.categories") > 0)
        & _optional(F.col("f.payment_method") == F.col("q.payment_method"), F.col("q.payment_method").isNotNull())
        & _optional(F.col("f.card_network") == F.col("q.card_network"), F.col("q.card_network").isNotNull())
        & (~any_asked | any_held)
    )


def match(
    params: DataFrame, facts: DataFrame, fact_id: str, amount: str, columns: list[str],
    question_columns: tuple[str, ...] = (), names: DataFrame | None = None,
) -> DataFrame:
    """Every (question, fact) pair that satisfies all the question's filters, each pair once.

    Facts need merchant_name_norm, transaction_date, payment_method, categories and the flag columns.
    One equi-join on the keys above finds the candidates; the full predicate is checked on each.
    Nothing runs while the plan is built: the kinds of key in use are a scalar subquery, and Spark chooses by the size
    of the question keys whether they are broadcast or both sides are shuffled and hot keys split at run time.
    A fact takes part in that join once by its merchant, and by a day or another key only where some question has it.
    ``params`` should be a stored table. The blocks of a range or a list of names meet a fact once; of
    several shared categories only the first produces the pair.
    """
    keys = question_keys(params, names)
    others = keys.filter(~_is_named())
    of_names = _join(keys.filter(_is_named()), _of_named(facts), amount, columns, question_columns)
    of_others = _join(others, _of_others(facts, others, _kinds(others), fact_id, amount), amount, columns, question_columns)
    return of_names.unionByName(of_others)


def _is_named() -> Column:
    return F.col("_key").startswith("m:")


def _of_named(facts: DataFrame) -> DataFrame:
    """Facts by merchant, each once."""
    return facts.withColumn("_key", F.concat(F.lit("m:"), "merchant_name_norm"))


def _of_others(facts: DataFrame, keys: DataFrame, kinds: Column | list[str], fact_id: str, amount: str) -> DataFrame:
    """Facts by those other keys that some question has, which are days, months, labels and salts: few beside the facts.

    Where all questions are bounded in time, facts outside of all bounds are left out where they are read.
    """
    first, beyond = _span()
    low, high = keys.agg(first).scalar(), keys.agg(beyond).scalar()
    day = F.col("transaction_date")
    own = facts.filter((low.isNull() | (day >= low)) & (high.isNull() | (day < high)))
    asked = F.broadcast(keys.select("_key").distinct())
    return fact_keys(own, fact_id, kinds, amount).join(asked, "_key", "left_semi")


def _span() -> tuple[Column, Column]:
    """The first and the last bound of questions in time; null where one has none."""
    return tuple(F.when(F.count_if(F.col(c).isNull()) == 0, f(c)) for c, f in (("start_ts", F.min), ("end_ts", F.max)))


def _join(keys: DataFrame, keyed_facts: DataFrame, amount: str, columns: list[str], question_columns: tuple[str, ...]) -> DataFrame:
    q, f = keys.alias("q"), keyed_facts.alias("f")
    ts = F.col("f.transaction_date")
    shared = F.array_intersect(F.col("f.categories"), F.col("q.categories"))
    first_shared = F.concat(F.lit("c:"), F.get(shared, F.lit(0)))
    cond = (
        (F.col("q._key") == F.col("f._key"))
        & _optional(ts >= F.col("q.start_ts"), F.col("q.start_ts").isNotNull())
        & _optional(ts < F.col("q.end_ts"), F.col("q.end_ts").isNotNull())
        & _optional(F.month(ts) == F.col("q.month_of_year"), F.col("q.month_of_year").isNotNull())
        & (~F.col("q._key").startswith("c:") | (F.col("q._key") == first_shared))
        & _optional(F.col(f"f.{amount}") > F.col("q.min_amount"), F.col("q.min_amount").isNotNull())
        & _optional(F.col(f"f.{amount}") < F.col("q.max_amount"), F.col("q.max_amount").isNotNull())
        & _same_kind()
    )
    return f.join(q, cond).select(
        "q.question_id", *[F.col(f"q.{c}") for c in question_columns], *[F.col(f"f.{c}") for c in columns]
    )


def flag_filter(flags: list[str]) -> Column:
    """Rows holding any of the flags."""
    out = F.lit(False)
    for name in flags:
        out = out | F.coalesce(F.col(name), F.lit(False))
    return out


def receipts_with_item(receipts: DataFrame, items: DataFrame, receipt: str, condition: Column) -> DataFrame:
    """Receipts with at least one item that satisfies the condition."""
    return receipts.join(items.filter(condition).select(receipt), receipt, "left_semi")


# --- audit -----------------------------------------------------------------------------------


def _answer_value(kind: Column) -> Column:
    return (
        F.when(kind == "sum", F.col("agg_sum"))
        .when(kind == "average", F.try_divide("agg_sum", "agg_count").cast("decimal(18,2)"))
        .when(kind == "count", F.col("agg_count").cast("decimal(18,2)"))
    )


def audit(params: DataFrame, receipts: DataFrame, items: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Exact sum, average or count per question over all its matches.

    Questions on a receipt basis read the metric column of receipts, those on an item basis the item
    price. Nulls are skipped; a question without values has null results. Each question is matched
    against one fact table only, and values are summed per task before the shuffle.
    """
    asked = with_filter_id(params.filter(F.col("aggregation").isNotNull()))
    sums = filter_sums(asked, receipts, items, names).withColumnRenamed("question_id", "filter_id")
    joined = asked.select("question_id", "filter_id", "aggregation").join(sums, "filter_id", "left")
    return joined.select(
        "question_id",
        "aggregation",
        F.coalesce("agg_count", F.lit(0)).alias("agg_count"),
        F.when(F.col("agg_count") > 0, _answer_value(F.col("aggregation"))).cast("decimal(18,2)").alias("agg_value"),
    )


def filter_sums(params: DataFrame, receipts: DataFrame, items: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Sum and count of the asked values, and the number of matches, per distinct filter.

    Questions that name merchants meet facts. All others meet summary cells, and facts only where a day or an amount is
    cut by a bound of theirs. What questions come to is stored first; the kinds of key in use, a dozen at most, decide
    which keys facts and cells get.
    """
    unique = unique_questions(params).withColumn("question_id", F.col("filter_id"))
    named = _merchant_keys(unique, names).withColumn("_cell", F.lit(False))
    pieces = stored(question_pieces(unique).unionByName(named), "question-pieces")
    kind = F.substring_index("_key", ":", 1)
    bounded = F.col("min_amount").isNotNull() | F.col("max_amount").isNotNull()
    used = pieces.filter(F.col("_key").isNotNull()).groupBy("sum_basis", "_cell", _is_named().alias("named")).agg(
        F.collect_set(kind).alias("kinds"), F.bool_or(bounded).alias("bounded"), *[c.cast("string").alias(n) for c, n in zip(_span(), ("first", "beyond"))]
    ).collect()
    ts_type = params.schema["start_ts"].dataType
    parts = []
    for row in used:
        own = (F.col("sum_basis") == row.sum_basis) & (F.col("_cell") == F.lit(row["_cell"])) & (_is_named() == F.lit(row.named))
        asked = pieces.filter(own).drop("_cell")
        by_item = row.sum_basis == "items"
        facts, fact_id, amount = (items, "item_id", "item_price") if by_item else (receipts, "receipt_id", "total_amount")
        measures = ["item_price"] if by_item else ["total_amount", "tax_amount", "tip_amount"]
        if row["_cell"]:
            day = F.col("transaction_date")  # cells of other days meet no question
            facts = facts if row.first is None else facts.filter(day >= F.lit(row.first).cast(ts_type))
            facts = facts if row.beyond is None else facts.filter(day < F.lit(row.beyond).cast(ts_type))
            cells = keyed_cells(summary_cells(facts, amount, measures, row.bounded), row.kinds)
            met = _join_cells(asked, cells, measures)
            sums, counts = ({m: F.col(f"{tag}_{m}") for m in measures} for tag in ("sum", "n"))
        else:
            keyed = _of_named(facts) if row.named else _of_others(facts, asked, row.kinds, fact_id, amount)
            met = _join(asked, keyed, amount, measures, ("metric",)).withColumn("n_matches", F.lit(1).cast("bigint"))
            sums = {m: F.col(m).cast(tx.MONEY) for m in measures}
            counts = {m: F.col(m).isNotNull().cast("bigint") for m in measures}
        value = _asked_measure(measures, sums).cast("decimal(22,2)")
        parts.append(met.select("question_id", value.alias("agg_sum"), _asked_measure(measures, counts).alias("agg_count"), "n_matches"))
    if not parts:
        nothing = "question_id string, agg_sum decimal(22,2), agg_count bigint, n_matches bigint"
        return params.sparkSession.createDataFrame([], nothing)
    met = reduce(DataFrame.unionByName, parts)
    return met.groupBy("question_id").agg(
        F.sum("agg_sum").cast("decimal(22,2)").alias("agg_sum"), F.sum("agg_count").alias("agg_count"), F.sum("n_matches").alias("n_matches")
    )


def _asked_measure(measures: list[str], values: dict[str, Column]) -> Column:
    out = values[measures[0]]
    for name in measures[1:]:
        out = F.when(F.col("metric") == name, values[name]).otherwise(out)
    return out


def question_pieces(params: DataFrame) -> DataFrame:
    """Questions without merchants in pieces that cover what they ask for once: rows with ``_key`` and ``_cell``.

    Whole days, or whole months of a month of the year, with amounts whose bucket lies within the bounds, are cells.
    Days that a bound cuts are met as facts, with all their amounts, and so are the buckets of the amount bounds, on whole days.
    """
    start, end, month = F.col("start_ts"), F.col("end_ts"), F.col("month_of_year")
    ts_type = params.schema["start_ts"].dataType
    midnight = lambda ts: ts == ts.cast("date").cast(ts_type)
    asked = params.filter((F.coalesce(F.size("merchants"), F.lit(0)) <= 0) & F.coalesce(start < end, F.lit(True)))
    # Whole days, and whole months where a month of the year is asked for.
    asked = asked.withColumn("_first", F.when(midnight(start), start.cast("date")).otherwise(F.date_add(start.cast("date"), 1)))
    next_month = F.add_months(F.trunc(F.date_sub("_first", 1), "month"), 1)
    asked = asked.withColumns(
        {
            "_from": F.when(month.isNull(), F.col("_first")).otherwise(next_month),
            "_to": F.when(month.isNull(), end.cast("date")).otherwise(F.trunc(end.cast("date"), "month")),
        }
    )
    low, high = F.col("_from"), F.col("_to")
    asked = asked.withColumn("_some", F.coalesce(low < high, F.lit(True)))
    none = F.array().cast("array<struct<_key:string,_low:bigint,_high:bigint>>")
    only = lambda condition, range_: F.when(condition, F.array(range_)).otherwise(none)
    whole = (
        F.when(~F.col("_some"), none)
        .when(month.isNotNull(), _keyed(F.array(F.concat(F.lit("y:"), month.cast("string")))))
        .when(start.isNotNull() | end.isNotNull(), F.array(_range(F.coalesce(day_number(low), F.lit(0)), F.coalesce(day_number(high), F.lit(LAST_DAY)))))
        .otherwise(_keyed(F.array(F.lit("a:"))))
    )
    # Without whole days or months between them, what both bounds cut is one range. Empty ranges have no keys.
    one = F.coalesce(low > high, F.lit(False))
    mine = lambda day: month.isNull() | (F.month(day) == month)
    from_start, to_end = day_number(start), _last_day(end) + 1
    cut = F.concat(
        only(one & mine(start), _range(from_start, to_end)),
        only(~one & start.isNotNull() & mine(start), _range(from_start, day_number(low))),
        only(~one & end.isNotNull() & mine(high), _range(day_number(high), to_end)),
    )
    bounds = F.array_distinct(F.array_compact(F.array(amount_bucket(F.col("min_amount")), amount_bucket(F.col("max_amount")))))
    piece = lambda keys, cell, low, high: F.transform(
        keys, lambda k: F.struct(k["_key"].alias("_key"), k["_low"].alias("_low"), k["_high"].alias("_high"), F.lit(cell).alias("_cell"), low.alias("start_ts"), high.alias("end_ts"))
    )
    of_day = lambda day: day.cast(ts_type)
    pieces = F.concat(
        piece(whole, True, of_day(low), of_day(high)),
        piece(cut, False, start, end),
        piece(F.when(F.col("_some"), _keyed(_tagged(bounds, "v"))).otherwise(none), False, of_day(low), of_day(high)),
    )
    rest = [c for c in params.columns if c not in ("start_ts", "end_ts")]
    return _with_block_keys(asked.select(*rest, F.inline(pieces))).select(*params.columns, "_key", "_cell")


_KIND_OF_FACT = ["payment_method", "card_network", "categories", *FLAGS]


def summary_cells(facts: DataFrame, amount: str, measures: list[str], by_amount: bool = False) -> DataFrame:
    """Facts summed by day, payment, network, categories and flags, and by amount bucket if ``by_amount``.

    Counts and sums only, so cells of several loads are merged by adding them up (see ``merged_cells``).
    """
    rows = facts.select(
        F.col("transaction_date").cast("date").alias("day"),
        *[F.col(c) for c in _KIND_OF_FACT if c != "categories"],
        F.sort_array(F.array_distinct("categories")).alias("categories"),
        (amount_bucket(F.col(amount)) if by_amount else F.lit(None).cast("bigint")).alias("bucket"),
        *[F.col(m).cast(tx.MONEY).alias(m) for m in measures],
    )
    sums = [f(m).alias(f"{tag}_{m}") for m in measures for tag, f in (("sum", F.sum), ("n", F.count))]
    return rows.groupBy("day", *_KIND_OF_FACT, "bucket").agg(*sums, F.count(F.lit(1)).alias("n_matches"))


def merged_cells(cells: DataFrame, *by: str) -> DataFrame:
    """Cells that are alike in day (or the columns ``by``), kind and bucket added up."""
    keys = [*(by or ("day",)), *_KIND_OF_FACT, "bucket"]
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cells.columns if c.startswith(("sum_", "n_"))])


def keyed_cells(cells: DataFrame, kinds: list[str]) -> DataFrame:
    """Cells merged to the grains in use: blocks of days of some levels, months of the year by month, and all days."""
    grain = lambda key, month: F.struct(key.cast("string").alias("_key"), month.cast("date").alias("month"))
    known = F.col("day").isNotNull()
    grains = {
        "a": grain(F.lit("a:"), F.lit(None)),
        "y": F.when(known, grain(F.concat(F.lit("y:"), F.month("day").cast("string")), F.trunc("day", "month"))),
    }
    for level in range(LEVELS):
        number = F.shiftright(day_number(F.col("day")), 3 * level).cast("string")
        grains[f"d{level}"] = F.when(known, grain(F.concat(F.lit(f"d{level}:"), number), F.lit(None)))
    some = F.array_compact(F.array(*[grains[k] for k in sorted(kinds)]))
    return merged_cells(cells.select("*", F.inline(some)), "_key", "month")


def _join_cells(keys: DataFrame, cells: DataFrame, measures: list[str]) -> DataFrame:
    q, f = keys.alias("q"), cells.alias("f")
    month = F.col("f.month")
    cond = (
        (F.col("q._key") == F.col("f._key"))
        & _optional(month >= F.col("q.start_ts").cast("date"), month.isNotNull() & F.col("q.start_ts").isNotNull())
        & _optional(month < F.col("q.end_ts").cast("date"), month.isNotNull() & F.col("q.end_ts").isNotNull())
        & _optional(F.col("f.bucket") > amount_bucket(F.col("q.min_amount")), F.col("q.min_amount").isNotNull())
        & _optional(F.col("f.bucket") < amount_bucket(F.col("q.max_amount")), F.col("q.max_amount").isNotNull())
        & _same_kind()
    )
    sums = [f"f.{tag}_{m}" for m in measures for tag in ("sum", "n")]
    return f.join(q, cond).select("q.question_id", "q.metric", "f.n_matches", *sums)


# --- evidence --------------------------------------------------------------------------------


def distinct_receipts(hits: DataFrame, score: str = "score") -> DataFrame:
    """Distinct receipts per question with their best score.

    ``hits`` has question_id, a score and the five receipt columns. A mergeable maximum stands in
    for a window, so a question with very many hits is never gathered.
    """
    columns = ["merchant_name", "total_amount", "transaction_date", "filename"]
    best = hits.groupBy("question_id", "receipt_id").agg(
        F.max(F.struct(F.col(score), *columns)).alias("_b")
    )
    return best.select(
        "question_id", "receipt_id", *[F.col(f"_b.{c}") for c in columns], F.col(f"_b.{score}").alias("best_score")
    )


def item_list(item_hits: DataFrame, receipt_hits: DataFrame) -> DataFrame:
    """Items of each question; a question without any gets one row per matched receipt instead."""
    columns = ["question_id", "name", "price", "category", "merchant", "filename"]
    standing_in = receipt_hits.join(
        item_hits.select("question_id").distinct(), "question_id", "left_anti"
    ).select(
        "question_id",
        F.concat(F.lit("Receipt from "), F.coalesce("merchant_name", F.lit("Unknown"))).alias("name"),
        F.col("total_amount").alias("price"),
        F.lit("Receipt").alias("category"),
        F.coalesce("merchant_name", F.lit("Unknown")).alias("merchant"),
        "filename",
    ).distinct()
    return item_hits.select(*columns).unionByName(standing_in)


def best_hits(hits: DataFrame, question: str, order: list[Column], k: int = fixed.TOP_K) -> DataFrame:
    """The k first hits per question with their rank; tasks prune to k before the shuffle."""
    w = Window.partitionBy(question).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def evidence(hits: DataFrame, question: str, content: str, rank: str = "rank") -> DataFrame:
    """Numbered hit texts of each question joined in rank order; at most k texts per question."""
    listed = hits.groupBy(question).agg(F.array_sort(F.collect_list(F.struct(rank, content))).alias("_h"))
    texts = F.transform(
        "_h",
        lambda h: F.concat(F.lit("--- Context "), h[rank].cast("string"), F.lit(" ---\n"), F.coalesce(h[content], F.lit(""))),
    )
    return listed.select(question, F.array_join(texts, "\n\n").alias("evidence"))


# --- result records --------------------------------------------------------------------------


def results(params: DataFrame, receipts: DataFrame, items: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One record per question, also for questions without a match.

    A result counts as verified when an audit ran over all its matches. Facts are read once: the
    same sums give the audit and the number of matches.
    """
    keyed = with_filter_id(params)
    sums = filter_sums(keyed, receipts, items, names).withColumnRenamed("question_id", "filter_id")
    joined = keyed.select("question_id", "filter_id", "query_type", "aggregation").join(sums, "filter_id", "left")
    joined = joined.withColumn(
        "agg_value", F.when(F.col("agg_count") > 0, _answer_value(F.col("aggregation"))).cast("decimal(18,2)")
    )
    found = F.coalesce(F.col("n_matches") > 0, F.lit(False))
    verified = found & F.col("agg_value").isNotNull()
    answer = (
        F.when(~found, F.lit(fixed.EMPTY_ANSWER))
        .when(
            verified,
            F.concat(
                F.initcap("aggregation"), F.lit(" over "), F.col("agg_count").cast("string"),
                F.lit(" values: "), F.col("agg_value").cast("string"),
            ),
        )
        .otherwise(F.concat(F.lit("Found "), F.col("n_matches").cast("string"), F.lit(" matching rows.")))
    )
    confidence = (
        F.when(~found, F.lit(0.0)).when(verified, F.lit(fixed.CONFIDENCE_VERIFIED)).otherwise(F.lit(fixed.CONFIDENCE_DEFAULT))
    )
    return joined.select(
        "question_id", answer.alias("answer"), confidence.alias("confidence"), "query_type",
        F.coalesce("agg_count", F.lit(0)).alias("agg_count"), "agg_value",
    )


RECEIPT_LIST = ["receipt_id", "merchant_name", "total_amount", "transaction_date", "filename"]
ITEM_LIST = ["name", "price", "category", "merchant", "filename"]


def hit_score(question_terms: Column, text: Column) -> Column:
    """The share of a question's distinct terms that a hit's text holds."""
    shared = F.size(F.array_intersect(question_terms, terms.terms(text)))
    return F.coalesce(F.try_divide(shared, F.size(question_terms)), F.lit(0.0))


def result_lists(
    params: DataFrame, receipts: DataFrame, items: DataFrame, k: int = fixed.TOP_K, names: DataFrame | None = None
) -> DataFrame:
    """question_id with ``receipts`` and ``items``: the k best hits of every question in order of rank, with their score.

    Hits are ordered by score, then from the newest on, then by receipt and what they show. Questions about items
    list items; the others, and those that match none, list a stand-in per receipt. Each task prunes to k hits per
    question before the shuffle, and a question asked by many in the same words is matched once.
    """
    asked = with_filter_id(params).withColumn("_terms", F.array_sort(F.array_distinct(terms.terms(F.col("original_query")))))
    asked = asked.withColumn("list_id", F.sha2(F.concat_ws("|", "filter_id", F.array_join("_terms", " ")), 256))
    first = [F.any_value(c).alias(c) for c in (*FILTER_COLUMNS, "_terms")]
    unique = asked.groupBy("list_id").agg(*first).withColumnRenamed("list_id", "question_id")
    unique = stored(unique, "asked-lists")
    kind = F.concat_ws(" ", "merchant_name", "payment_method", F.array_join("categories", " "))
    met = match(unique, receipts.withColumn("_text", kind), "receipt_id", "total_amount", [*RECEIPT_LIST, "_text"], ("_terms",), names)
    order = [F.desc("score"), F.desc_nulls_last("transaction_date"), F.asc("receipt_id")]
    met = best_hits(met.withColumn("score", hit_score(F.col("_terms"), F.col("_text"))), "question_id", order, k)
    of_items = items.withColumn("_text", F.concat_ws(" ", "item_name", "item_category", "merchant_name"))
    columns = ["receipt_id", "item_name", "item_price", "item_category", "merchant_name", "transaction_date", "filename", "_text"]
    bought = match(unique.filter(F.col("sum_basis") == "items"), of_items, "item_id", "item_price", columns, ("_terms",), names)
    bought = bought.withColumn("score", hit_score(F.col("_terms"), F.col("_text")))
    bought = best_hits(bought, "question_id", [*order, F.asc("item_name"), F.asc("item_price")], k).select(
        "question_id", "rank", "score", F.col("item_name").alias("name"), F.col("item_price").alias("price"),
        F.col("item_category").alias("category"), F.col("merchant_name").alias("merchant"), "filename",
    )

    def listed(rows: DataFrame, columns: list[str], out: str) -> DataFrame:
        entry = F.struct("rank", *columns, "score")  # k entries at most
        return rows.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias(out))

    lists = listed(met, RECEIPT_LIST, "receipts").join(listed(bought, ITEM_LIST, "items"), "question_id", "full")
    merchant = lambda r: F.coalesce(r["merchant_name"], F.lit("Unknown"))
    standing_in = F.transform(
        "receipts",
        lambda r: F.struct(
            r["rank"].alias("rank"), F.concat(F.lit("Receipt from "), merchant(r)).alias("name"), r["total_amount"].alias("price"),
            F.lit("Receipt").alias("category"), merchant(r).alias("merchant"), r["filename"].alias("filename"), r["score"].alias("score"),
        ),
    )
    lists = lists.select(F.col("question_id").alias("list_id"), "receipts", F.coalesce("items", standing_in).alias("items"))
    joined = asked.select("question_id", "list_id").join(lists, "list_id", "left")
    no = lambda name: F.from_json(F.lit("[]"), lists.schema[name].dataType)
    return joined.select("question_id", *[F.coalesce(name, no(name)).alias(name) for name in ("receipts", "items")])


def full_results(
    params: DataFrame, receipts: DataFrame, items: DataFrame, k: int = fixed.TOP_K, names: DataFrame | None = None
) -> DataFrame:
    """Result records with the ranked lists of receipts and items."""
    return results(params, receipts, items, names).join(result_lists(params, receipts, items, k, names), "question_id")


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_matches"))
