"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded selection.

Targets come from weights by water-filling. Sources get blocks of equal numbers of words by highest quotients
``weight / (2 k + 1)``; each source's blocks are dealt to its shards in the same way. Within a shard, documents
stand in a seeded order, and the shard's first blocks are taken, going round again where the quota exceeds one pass.
Everything is DataFrame code: one aggregate per (source, fine shard), and one shuffle of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillweave.llm.common import SPACE_CLASS, stored

#: Hex digits of the seeded hash that name the fine shard, and the words that a shard should hold at least.
SHARD_DIGITS = 3
SHARD_WORDS = 16_384
#: Words in a block. Shares are met to half a block; the cost doesn't depend on it.
BLOCK_WORDS = 8
#: Rows of cuts that are sent to the texts.
SENT_ROWS = 1 << 20
SHARE = 1.5
REPEATS = 2
WEIGHTS = (3, 1, 2)
SEED = 7


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS) -> DataFrame:
    """(key, source_size) with ``target``: ``share`` of all words by weight, none above ``repeats`` times its source.

    Sources in order of code points, null (the empty key) last, weigh as ``weights`` repeat. The level is the
    greatest one at which the sources below their limit take exactly what the others leave.
    """
    by_name = Window.orderBy(F.col("key") == "", "key")
    by_limit = Window.orderBy("ratio", "key")
    ranked = sources.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    limited = ranked.withColumn("limit", repeats * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    levels = limited.withColumns(
        {
            "filled": F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(Window.partitionBy()),
        }
    ).withColumn("level", (share * F.col("all") - F.col("filled")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    return levels.select(
        "key", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * F.coalesce(level, F.lit(0.0))).alias("target")
    )


def apportion(parties: DataFrame, by: list[str], party: str, weight: str, seats: str) -> DataFrame:
    """Sainte-Lague seats: per group ``by``, ``seats`` go to parties by the highest ``weight / (2 k + 1)``.

    Only quotients that can decide are listed. With n parties, the last quotient taken shifts a party's exact share
    by at most share * n / 2 seats, so seats below that are certain and those above are out of reach; about four rows
    a party remain. Ties go to the smaller party. Adds ``quota``.
    """
    group = Window.partitionBy(*by)
    w = F.col(weight).cast("double")
    shares = parties.withColumns({"_all": F.sum(w).over(group), "_n": F.count(F.lit(1)).over(group)})
    exact = F.col(seats) * w / F.col("_all")
    slack = w * F.col("_n") / (2 * F.col("_all")) + 1
    bounds = shares.withColumns(
        {
            "_low": F.when(F.col("_all") > 0, F.greatest(F.lit(0), F.floor(exact - slack))).otherwise(F.lit(0)).cast("long"),
            "_high": F.when(w > 0, F.floor(exact + slack) + 1).otherwise(F.lit(0)).cast("long"),
        }
    ).withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    listed = bounds.withColumn("_k", F.explode(F.expr("IF(_high > _low, sequence(_low, _high - 1), array(-1L))")))
    quotient = F.when(F.col("_k") >= 0, w / (2 * F.col("_k") + 1)).otherwise(F.lit(-1.0))
    ranked = listed.withColumn("_rank", F.row_number().over(group.orderBy(quotient.desc(), party, "_k")))
    won = F.sum(F.when((F.col("_k") >= 0) & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    keys = list(parties.columns)
    return ranked.groupBy(*keys, "_low").agg(won.alias("_won")).select(*keys, (F.col("_low") + F.col("_won")).alias("quota"))


def _sized(docs: DataFrame, kept: list[str], seed: int) -> DataFrame:
    """The columns ``kept`` as a row, with the source's key, the size, the seeded hash of the id and the finest shard."""
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("hash"),
    ).withColumn("fine", F.conv(F.substring("hash", 1, SHARD_DIGITS), 16, 10).cast("int"))


def _takes(sized: DataFrame, share: float, repeats: int, weights: tuple, block_words: int) -> DataFrame:
    """(key, shards, shard) with source_size, target, shard_size and the words to take of the shard."""
    fine = sized.groupBy("key", "fine").agg(F.sum("size").alias("size"))
    sources = fine.groupBy("key").agg(F.sum("size").alias("source_size"))
    aims = targets(sources, share, repeats, weights)
    blocks = aims.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    quotas = apportion(blocks, [], "key", "target", "seats").withColumn(
        "shards", F.expr(f"least({16 ** SHARD_DIGITS}, CAST(pow(2, length(bin(greatest(1, source_size DIV {SHARD_WORDS}))) - 1) AS INT))")
    )
    shards = (
        fine.join(quotas.select("key", "source_size", "target", "shards", F.col("quota").alias("seats")), "key")
        .groupBy("key", "source_size", "target", "shards", "seats", (F.col("fine") % F.col("shards")).alias("shard"))
        .agg(F.sum("size").alias("shard_size"))
    )
    return apportion(shards, ["key", "source_size", "target", "shards", "seats"], "shard", "shard_size", "seats").select(
        "key", "shards", "shard", "source_size", "target", "shard_size",
        F.least(F.col("quota") * block_words, repeats * F.col("shard_size")).alias("take"),
    )


_PASSES = "IF(shard_size > 0, take DIV shard_size, 0)"
_REST = "IF(shard_size > 0, take % shard_size, 0)"


def mix_plan(
    docs: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS,
    block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> DataFrame:
    """What the mix takes of each document.

    In: ``doc_id``, ``source``, ``text`` and any other columns, which are kept unless they bear a name that is added.
    Adds size, source_size, target, taken (words, repeats counted). A null source is a source of its own and comes
    last; null and empty texts have size 0 and nothing of them is taken; rows with equal ids are taken in the order
    of their sizes, and equal rows are interchangeable; an empty table gives no rows. Reruns agree, since the order
    is a hash of seed and id.
    """
    added = ("size", "source_size", "target", "taken")
    sized = _sized(docs, [c for c in docs.columns if c.lower() not in added], seed)
    takes = _takes(sized, share, repeats, weights, block_words)
    shards = takes.groupBy("key").agg(F.max("shards").alias("shards"))
    placed = sized.join(shards, "key").withColumn("shard", F.col("fine") % F.col("shards")).join(takes.drop("shards"), ["key", "shard"])
    order = Window.partitionBy("key", "shard").orderBy("hash", F.col("row.doc_id"), "size")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rest = F.expr(_REST)
    taken = F.col("size") * F.expr(_PASSES) + F.greatest(F.lit(0), F.least(F.col("end"), rest) - F.col("end") + F.col("size"))
    return placed.withColumn("end", end).select(
        "row.*", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken")
    )


def mix_documents(
    docs: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS,
    block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each whole pass over a document, and one with its
    first words, joined by single spaces, where the last block cuts it. ``n_chars``, if present, follows the text.

    The same mix as ``mix_plan``, but texts aren't shuffled: narrow rows tell where each shard is cut, one row a shard, and
    each document is compared with its shard's cut where it lies. Rows equal in id and size at a cut share its words
    evenly, rounded down. Columns of any other name are kept as they are.
    """
    narrow = stored(_sized(docs, ["doc_id"], seed).select("key", "size", "hash", "fine"), "sizes")
    takes = stored(_takes(narrow, share, repeats, weights, block_words), "takes")
    shards = takes.groupBy("key").agg(F.max("shards").alias("shards"))
    alike = narrow.groupBy("key", "fine", "hash", "size").agg(F.count(F.lit(1)).alias("n")).join(shards, "key")
    alike = alike.withColumn("shard", F.col("fine") % F.col("shards")).join(takes.drop("shards"), ["key", "shard"])
    order = Window.partitionBy("key", "shard").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    alike = alike.withColumn("end", F.sum(F.col("size") * F.col("n")).over(order)).withColumn("begin", F.col("end") - F.col("size") * F.col("n"))
    cut = alike.where(f"begin < {_REST} AND {_REST} <= end").select(
        "key", "shard", F.col("hash").alias("cut_hash"), F.col("size").alias("cut_size"), F.expr(f"({_REST} - begin) DIV n").alias("cut_words")
    )
    cuts = takes.join(cut, ["key", "shard"], "left").select("key", "shards", "shard", F.expr(_PASSES).alias("passes"), "cut_hash", "cut_size", "cut_words")
    cuts = stored(cuts, "cuts")
    # A row per shard, at most 16 ** SHARD_DIGITS a source: sent to the texts unless sources are very many.
    sent = F.broadcast if cuts.count() <= SENT_ROWS else lambda df: df
    rows = _sized(docs, docs.columns, seed).join(sent(cuts.groupBy("key").agg(F.max("shards").alias("shards"))), "key")
    rows = rows.withColumn("shard", F.col("fine") % F.col("shards")).join(sent(cuts.drop("shards")), ["key", "shard"])
    before = "hash < cut_hash OR hash = cut_hash AND size < cut_size"
    part = F.expr(f"CASE WHEN {before} THEN size WHEN hash = cut_hash AND size = cut_size THEN cut_words ELSE 0 END")
    # Whole passes and a part that is the whole text again are rows of the text as it is, marked by -1.
    whole = F.expr("IF(size > 0, passes + IF(part = size, 1, 0), 0)").cast("int")
    times = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array("part")).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("part", part.cast("long")).select("row", F.explode(times).alias("words"))
    text = F.col("row.text")
    cut_text = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0)), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < 0, text).otherwise(cut_text)
    column = {f.name: F.col(f"row.`{f.name}`") for f in docs.schema}
    column["text"] = text
    if "n_chars" in column:
        column["n_chars"] = F.when(F.col("words") < 0, column["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(name) for name, c in column.items()])
