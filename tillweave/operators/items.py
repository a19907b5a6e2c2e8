"""Line items: which lines are items, what they say, and how wrapped items are put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillweave.functions import fixed, text as tx

_NON_ITEM = tx.literals(fixed.NON_ITEM_WORDS + fixed.TENDER_WORDS)
_PRICE = r"\d[\d,]*\.\d{2}"
_HEAD = rf"^(.*?)\s*\$\s*({_PRICE})"
_AFTER_SIGN = rf"^\s*({_PRICE})"
_NAME = r"[A-Za-z][\w\s().\-]+?"
_COUNTED = rf"^(\d+)\s*[xX]\s+({_NAME})\s+\$\s*{_PRICE}\s*$"
_AT_PRICE = rf"^({_NAME})\s+@\s+\$\s*{_PRICE}\s*$"
_PRICE_ONLY = rf"^(?:\$\s*)?({_PRICE})$"
_ANY_LONE = rf"(?dm)^(?:\$\s*)?{_PRICE}$"


def is_item_candidate(low: Column) -> Column:
    """False for totals, tender lines, rulers and labels; takes the lower-cased line."""
    return ~low.rlike(_NON_ITEM)


def clean_name(name: Column) -> Column:
    """Whitespace collapsed and a trailing pack size such as ``(4)`` removed."""

    def collapse(n: Column) -> Column:
        spaced = tx.contains_any(n, ["  ", "\t", "\n", "\r", "\x0b", "\x0c"])
        return F.trim(F.when(spaced, F.regexp_replace(n, r"\s+", " ")).otherwise(n))

    def without_pack(n: Column) -> Column:
        return F.when(n.contains("("), F.regexp_replace(n, r"\s*\(\d+\)\s*$", "")).otherwise(n)

    return tx.let(tx.let(name, collapse), without_pack)


def parse_line(line: Column) -> Column:
    """Struct of name, quantity, unit price and price for one item line.

    A counted line ``N x name $p`` and a rated line ``name @ $p`` have their own layouts; every
    other layout names the item by the text before its first price.
    """
    starts_with_digit = (line >= "0") & (line < ":")
    one_price = F.substring_index(line, "$", 2) == line
    head = F.when(one_price, F.substring_index(line, "$", 1)).otherwise(F.regexp_extract(line, _HEAD, 1))
    figure = F.when(one_price, F.regexp_extract(F.substring_index(line, "$", -1), _AFTER_SIGN, 1)).otherwise(
        F.regexp_extract(line, _HEAD, 2)
    )
    counted = starts_with_digit & line.rlike(_COUNTED)
    name = clean_name(
        F.when(counted, F.regexp_extract(line, _COUNTED, 2))
        .when(line.contains("@") & line.rlike(_AT_PRICE), F.regexp_extract(line, _AT_PRICE, 1))
        .otherwise(head)
    )
    quantity = F.coalesce(
        F.when(starts_with_digit, F.regexp_extract(line, _COUNTED, 1).try_cast("decimal(12,3)")),
        F.lit(1).cast("decimal(12,3)"),
    )
    price = F.translate(figure, ",", "").try_cast(tx.MONEY)
    read = F.struct(name.alias("name"), quantity.alias("quantity"), price.alias("price"))
    return tx.let(
        read,
        lambda r: F.struct(
            r["name"].alias("name"),
            r["quantity"].alias("quantity"),
            F.coalesce(F.try_divide(r["price"], r["quantity"]), r["price"]).cast("decimal(18,6)").alias("unit_price"),
            r["price"].alias("total_price"),
        ),
    )


def is_valid(item: Column) -> Column:
    return (F.length(item["name"]) > 1) & F.coalesce(item["total_price"] != 0, F.lit(False))


def _read(line: Column) -> Column:
    """A line with what it says: an item, or a lone price, or neither."""
    priced = line.contains(".") & line.rlike(r"\d\.\d{2}")
    may_be_lone = (line >= "$") & (line < ":")
    lone = F.when(priced & may_be_lone, F.nullif(F.regexp_extract(line, _PRICE_ONLY, 1), F.lit("")))
    item = F.when(priced & line.contains("$"), parse_line(line))
    return F.struct(line.alias("line"), priced.alias("priced"), lone.alias("lone"), item.alias("item"))


def _event(read: Column) -> Column:
    """Kind of a line: S an item by itself, P a price alone, C a name waiting for its price."""
    line, lone, item = read["line"], read["lone"], read["item"]
    dated = line.contains("/") & line.rlike(r"\d{1,2}/\d{1,2}/\d{2,4}")
    kind = (
        F.when(lone.isNotNull(), F.when(lone.rlike("[1-9]"), F.lit("P")))
        .when(read["priced"], F.when(is_valid(item), F.lit("S")))
        .when((F.length(line) > 2) & ~line.contains("ID:") & ~dated, F.lit("C"))
    )
    return F.struct(kind.alias("kind"), F.coalesce(lone, line).alias("body"), item.alias("item"))


_EVENT_TYPE = (
    "struct<kind:string,body:string,item:struct<name:string,quantity:decimal(12,3),"
    "unit_price:decimal(18,6),total_price:decimal(12,2)>>"
)


def _emitted(event: Column, before: Column) -> Column:
    """The item an event completes, given the event before it."""
    wrapped = (event["kind"] == "P") & (before["kind"] == "C")
    return F.when(event["kind"] == "S", event["item"]).when(
        wrapped, parse_line(F.concat(before["body"], F.lit(" $"), event["body"]))
    )


def item_rows(clean: Column, rows: Column) -> Column:
    """The ``rows`` of a cleaned text that its items depend on.

    Where no line is a price alone, no name waits for one, and only lines that hold a price with its sign matter.
    """
    return F.when(clean.rlike(_ANY_LONE), rows).otherwise(tx.rows_with(clean, r"\$.*\d\.\d{2}|\d\.\d{2}.*\$"))


def with_items(df: DataFrame, rows: str = "rows", out: str = "items") -> DataFrame:
    """Adds the item array of each document; narrow, one pass over the lines per step.

    A price-only line becomes an item exactly when the event before it is a waiting name.
    """
    kept = F.filter(F.col(rows), lambda r: is_item_candidate(r["low"]))
    read = F.transform(kept, lambda r: _read(r["line"]))
    events = F.filter(F.transform(read, _event), lambda e: e["kind"].isNotNull())
    # `_events` is read twice below, so it stays a column of its own and is computed once.
    df = df.withColumn("_events", events)
    none = F.array(F.lit(None).cast(_EVENT_TYPE))
    before = F.concat(none, F.slice(F.col("_events"), F.lit(1), F.greatest(F.size("_events") - 1, F.lit(0))))
    emitted = F.array_compact(F.zip_with(F.col("_events"), before, _emitted))
    return df.withColumn(out, F.filter(emitted, is_valid)).drop("_events")


def items_from_line_rows(rows: DataFrame, doc: str, line_no: str, line: str) -> DataFrame:
    """The same items from one row per line, for text that is already stored line by line.

    The window runs inside one document, so a partition never exceeds one file's lines.
    """
    from pyspark.sql import Window

    events = (
        rows.filter(is_item_candidate(F.lower(line)))
        .withColumn("_e", _event(_read(F.col(line))))
        .filter(F.col("_e.kind").isNotNull())
    )
    order = Window.partitionBy(doc).orderBy(line_no)
    events = events.withColumn("_p", F.lag("_e").over(order))
    parsed = events.withColumn("_item", _emitted(F.col("_e"), F.col("_p"))).filter(is_valid(F.col("_item")))
    return parsed.select(doc, line_no, "_item.*")


def explode_items(df: DataFrame, *keep: str, items: str = "items") -> DataFrame:
    """One row per item with its 0-based position; parents without items keep one null row."""
    exploded = df.select(*keep, F.posexplode_outer(items).alias("item_index", "_item"))
    return exploded.select(*keep, "item_index", "_item.*")
